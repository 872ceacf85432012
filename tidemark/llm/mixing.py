"""Mixing sources to target weights with Pareto order sampling.

A source's target over its size gives each document a number of expected copies. Its whole part is
taken for certain. For the rest a document has an inclusion odds that grows with its size, and a
rank: random odds over inclusion odds. Documents are taken in rank order until the words of the
source reach its target.

No source is gathered in one task: ranks fall into bins, bins of a source are summed and the bin in
which the target is reached is known from the sums. Only documents of that bin are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.frames import set_aside, staged

WEIGHTS = (5.0, 2.0, 1.0)
BINS = 4096
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Number of runs of characters that are not ASCII blanks; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) of `sizes` (source, size).

    Sources in code point order, null last, take the weights in turn. `share` times all words are
    shared by weight; a target stops at `most` times its source's size and what is over goes to the
    others by weight. Filled like vessels: sorted by the level at which each is full, running sums
    of the full ones tell the common level of the rest.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row per source from here on
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    rows = by_source.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * most)
    everything = Window.partitionBy()
    by_level = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last())
    rows = rows.withColumns(
        {
            "_all": F.sum("source_size").over(everything) * share,
            "_left": F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "_full": F.coalesce(F.sum("_cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        }
    )
    # the level if this source and all after it are not full; the first that holds is the common one
    level = (F.col("_all") - F.col("_full")) / F.col("_left")
    rows = rows.withColumn("_level", F.when(level * F.col("_weight") <= F.col("_cap"), level))
    rows = rows.withColumn("_level", F.first("_level", ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("_cap"), F.coalesce(F.col("_level") * F.col("_weight"), F.col("_cap"))).cast("double")
    return rows.select("source", "source_size", target.alias("target"))


def _random() -> Column:
    """A number in (0, 1) that only depends on the seed, the document's id and its source."""
    named = F.concat_ws(":", F.col("_seed"), F.col("doc_id").cast("string"), F.col("source"))
    return (F.conv(F.substring(F.md5(named), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def _ranked(rows: DataFrame, seed: int, most: int) -> DataFrame:
    """Rows that know their source's plan, with _rank and _bin; null where no further copy is open."""
    chance = F.col("_rest") * F.sqrt(F.col("size").cast("double")) / F.col("_moment")
    chance = F.least(F.greatest(chance, F.lit(1e-9)), F.lit(1 - 1e-9))
    rank = (F.col("_u") / (1 - F.col("_u"))) / (chance / (1 - chance))
    open_ = (F.col("_rest") > 0) & (F.col("size") > 0) & (F.col("_sure") < most)
    rows = rows.withColumn("_seed", F.lit(str(seed))).withColumn("_u", _random()).withColumn("_rank", F.when(open_, rank))
    return rows.withColumn("_bin", F.floor(F.col("_rank") / (1 + F.col("_rank")) * BINS)).drop("_seed", "_u")


def source_plan(docs: DataFrame, seed: int = 7, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """One row per source: source_size, target, copies taken of all, and the last rank of which one more is taken."""
    sizes = staged(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    moments = sizes.groupBy(F.col("source").alias("_source")).agg(F.sum(F.col("size") * F.sqrt(F.col("size").cast("double"))).alias("_moment"))
    targets = source_targets(sizes, weights, share, float(most)).join(moments, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    sure = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size") + 1e-12), F.lit(most))).otherwise(0)
    targets = targets.withColumn("_sure", sure.cast("long"))
    targets = staged(targets.withColumn("_rest", F.greatest(F.col("target") - F.col("_sure") * F.col("source_size"), F.lit(0.0))), "mix-targets")
    rows = _ranked(with_plan(sizes, targets), seed, most).where(F.col("_bin").isNotNull()).select("doc_id", "source", "size", "_rest", "_rank", "_bin")

    bins = rows.groupBy("source", "_bin").agg(F.sum("size").alias("_words"), F.first("_rest").alias("_goal"))
    upto = Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("_before", F.coalesce(F.sum("_words").over(upto), F.lit(0)))
    # the first bin in which the words reach the goal; a source has one at most
    met = bins.where((F.col("_before") < F.col("_goal")) & (F.col("_before") + F.col("_words") >= F.col("_goal")))
    met = staged(met.select("source", F.col("_bin").alias("_last"), F.col("_before").alias("_start")), "mix-bins")

    edge = with_plan(rows, met).where(F.col("_bin") == F.col("_last"))
    order = Window.partitionBy("source").orderBy("_rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = edge.withColumn("_to", F.col("_start") + F.sum("size").over(order))
    over, under = F.col("_to") - F.col("_rest"), F.col("_rest") - (F.col("_to") - F.col("size"))
    taken = edge.where((over <= 0) | ((under > 0) & (over <= under)))
    cuts = taken.groupBy(F.col("source").alias("_source")).agg(F.max(F.struct("_rank", "doc_id")).alias("_cut"))
    met = met.join(cuts, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source", "_start").withColumnRenamed("source", "_source")
    return staged(targets.join(met, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source"), "mix-plan")


def with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """`rows` with the written plan of their source: by broadcast while sources are few, else by a join that can be split."""
    plan = plan.withColumnRenamed("source", "_source")
    plan = F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan
    return rows.join(plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def mix(docs: DataFrame, seed: int = 7, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """Each row of `docs` (doc_id, source, text) with size, source_size, target, copies and taken (words).

    The inclusion odds of a further copy grow with the square root of the size. The last document by
    rank is taken if that brings the source nearer to its target. Null and blank texts have size 0
    and nothing to take; a null source is a source; null ids are drawn like any id; rows that repeat
    an id and source are taken together. A source whose target is twice its size is taken twice,
    whole. Columns of `docs` named like the added ones are replaced. Texts are not shuffled.
    """
    plan = source_plan(docs, seed, weights, share, most)
    added = ["size", "source_size", "target", "copies", "taken"]
    rows, own = set_aside(docs.drop(*added), ("doc_id", "source", "text"))
    rows = rows.withColumn("size", word_count(F.col("text")))
    rows = _ranked(with_plan(rows, plan), seed, most)
    # struct order puts null ids first, as the window does
    before = (F.col("_bin") < F.col("_last")) | (F.col("_last").isNull() & F.col("_bin").isNotNull()) | (F.struct("_rank", "doc_id") <= F.col("_cut"))
    more = F.when(F.col("_rank").isNotNull() & before, 1).otherwise(0)
    rows = rows.withColumn("copies", F.col("_sure") + more).withColumn("taken", F.col("copies") * F.col("size"))
    return rows.select(*own, *added)
