"""Line dedup by the number of distinct sites that carry a line.

Each line hash gets a HyperLogLog sketch of its sites; sketches merge in the aggregation, so a line
that a third of all documents carry arrives as one row per task. An estimate far from the
threshold decides; a line near it gets its exact number of distinct sites. Lines on enough sites
are boilerplate: they stay in one document, the first by id, and go from all others. Lines of few
words, which prose may share by chance, are judged the same way from a higher number of sites on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.frames import set_aside, staged

LG_BUCKETS = 9
# The estimate of a 512-bucket sketch is off by 5 % as a rule; half and double are 10 times that.
NEAR = (0.5, 2.0)
SHORT_SITES = 6


def line_key(line: Column) -> Column:
    """A line is known by its text without outer blanks."""
    return F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def _word_count(line: Column) -> Column:
    return F.when(line == "", 0).otherwise(F.size(F.split(line, r"[\x20\x09-\x0D]+")))


def lines_of(docs: DataFrame, min_words: int, with_short: bool = False) -> DataFrame:
    """(doc_id, site, said, at, key) of each line of at least `min_words` words.

    said: hash of the whole text, at: number of the line in it, key: 128 bits of the trimmed line's
    digest. `with_short`: also lines of one word or more, and whether a line is one of them (short).
    """
    # the hash is taken before lines are made, or it would be taken for each of them
    texts = docs.select("doc_id", F.coalesce(F.col("source"), F.lit("")).alias("site"), F.xxhash64("text").alias("said"), "text")
    trimmed = texts.select("doc_id", "site", "said", F.posexplode(F.split("text", "\n")).alias("at", "_line")).withColumn("_line", line_key(F.col("_line")))
    short = [(_word_count(F.col("_line")) < min_words).alias("short")] if with_short else []
    least = min(1, min_words) if with_short else min_words
    return trimmed.where(_word_count(F.col("_line")) >= least).select("doc_id", "site", "said", "at", _digest(F.col("_line")).alias("key"), *short)


def _digest(line: Column) -> Column:
    return F.unhex(F.substring(F.sha2(line, 256), 1, 32))


def line_spread(lines: DataFrame, min_sites: int = 3, short_sites: int = SHORT_SITES) -> DataFrame:
    """Boilerplate among `lines` (doc_id, site, key, and short if there are any): (key, n_sites, first_doc).

    Short lines are boilerplate from `short_sites` sites on, others from `min_sites`; n_sites is
    exact where the sketch came near that, else the estimate. A null source is a
    site of its own; a null text has no lines; a document without id counts for the spread.
    """
    some_short = "short" in lines.columns
    least = F.when(F.col("short"), short_sites).otherwise(min_sites) if some_short else F.lit(min_sites)
    sketched = lines.groupBy("key").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_BUCKETS))).alias("estimate"),
        F.min("doc_id").alias("first_doc"),
        F.min("site").alias("_low"),
        F.max("site").alias("_high"),
        *([F.max("short").alias("short")] if some_short else []),
    )
    # a line on one site, as most are, can never pass
    sketched = sketched.withColumn("_least", least).where((F.col("_low") != F.col("_high")) & (F.col("estimate") >= NEAR[0] * F.col("_least")))
    spread = staged(sketched.select("key", "estimate", "first_doc", "_least"), "line-spread")
    near = spread.where(F.col("estimate") <= NEAR[1] * F.col("_least"))
    exact = lines.join(near.select("key"), "key").groupBy("key", "site").agg(F.lit(1).alias("_one")).groupBy("key").agg(F.count("*").alias("n_sites"))
    decided = spread.join(exact, "key", "left").withColumn("n_sites", F.coalesce("n_sites", "estimate"))
    return decided.where(F.col("n_sites") >= F.col("_least")).select("key", "n_sites", "first_doc")


def dedup_lines(docs: DataFrame, min_sites: int = 3, min_words: int = 3, short_sites: int | None = SHORT_SITES) -> DataFrame:
    """`docs` with `text` cut to the lines that stay, and n_lines, n_removed, kept_all.

    A line of fewer than `min_words` words goes from `short_sites` sites on, or never where that is
    None; a blank one always stays. A repeat of a boilerplate line inside its
    first document stays too. Null and empty texts stay as they are with n_lines 0 and 1. Rows that
    repeat an id are all the first document. Columns named like the added ones are replaced.

    Lines move as digests only; texts are joined once, by id and hash, with a mark for each of their
    lines, so the work for a text grows with its length whatever it loses.
    """
    added = ["n_lines", "n_removed"]
    # digests are taken once; the passes over lines read them, not the texts
    lines = staged(lines_of(docs, min_words, short_sites is not None), "lines")
    boilerplate = staged(line_spread(lines, min_sites, short_sites or min_sites), "boilerplate")
    hit = (
        lines.join(boilerplate, "key").where(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
        .groupBy(F.col("doc_id").alias("_hit"), F.col("said").alias("_said")).agg(F.array_sort(F.collect_set("at")).alias("_gone"))
    )
    hit = hit.select("_hit", "_said", F.size("_gone").cast("long").alias("_n_gone"), _kept_marks(F.col("_gone")).alias("_stays"))
    rows, own = set_aside(docs.drop(*added), ("doc_id", "source", "text"))
    joined = rows.join(hit, F.col("doc_id").eqNullSafe(F.col("_hit")) & (F.xxhash64("text") == F.col("_said")), "left")
    all_lines = F.split("text", "\n")
    left = F.filter(all_lines, lambda line, i: F.coalesce(F.get("_stays", i), F.lit(True)))
    done = joined.withColumns(
        {
            "n_lines": F.coalesce(F.size(all_lines), F.lit(0)).cast("long"),
            "n_removed": F.coalesce("_n_gone", F.lit(0).cast("long")),
            "text": F.when(F.col("_stays").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")),
        }
    )
    return done.select(*own, *added)


def _kept_marks(gone: Column) -> Column:
    """For each line up to the last of `gone` (sorted numbers) whether it stays."""
    upto = lambda at, i: at - F.when(i == 0, -1).otherwise(F.get(gone, i - 1)) - 1
    return F.flatten(F.transform(gone, lambda at, i: F.concat(F.array_repeat(F.lit(True), upto(at, i)), F.array(F.lit(False)))))
