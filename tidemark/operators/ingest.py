"""Snapshot ingest: filter, fingerprint, classify, merge into the state, close what is missing.

The sequential rule behind it: companies are taken in id order; each posting of a company inserts
its fingerprint or updates the row that already has it (whoever owns that row), then the company's
own active rows that it did not post are closed. `merge_snapshots` gives the same result as one
aggregation and one full outer join, both on the fingerprint. Company-level frames are broadcast
after a check of their size, so that postings are not shuffled by company; beyond that size they
are, and adaptive execution splits the partitions of large companies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.bind import with_computed
from tidemark.functions.classify import with_job_class
from tidemark.functions.location import KEPT, classify_location
from tidemark.functions.text import fingerprint
from tidemark.operators.providers import PAGE_SPAN
from tidemark.schemas import JOB_COLUMNS
from tidemark.session import is_small, small_side

# fixed values: stored column lengths
MAX_LENGTHS = {
    "source_type": 64, "external_job_id": 512, "title": 1024, "team": 512, "location": 512,
    "employment_type": 256, "level": 256,
}
REQUIRED = ("company_name", "source_type", "title", "url")

ATTRIBUTES = [
    "source_type", "external_job_id", "title", "team", "location", "employment_type", "level", "url",
    "description_text", "posted_at", "raw_payload", "entry_level_score", "is_entry_level",
    "is_software_engineering_related",
]
COUNTERS = [
    "jobs_seen_total", "jobs_inserted_total", "jobs_inserted_software_related",
    "jobs_inserted_entry_level", "jobs_inserted_digest_eligible", "jobs_skipped_international",
    "jobs_skipped_non_software", "jobs_skipped_non_entry_level", "inactive_jobs_marked",
]


# ---- boundary checks ----------------------------------------------------------------------
def posting_violations(postings: DataFrame) -> Column:
    """Array of what is wrong with a posting: missing fields, wrong types, overlong texts."""
    checks = [F.when(F.col(c).isNull(), F.lit(f"{c}: missing")) for c in REQUIRED]
    checks += [F.when(F.length(c) > n, F.lit(f"{c}: longer than {n}")) for c, n in MAX_LENGTHS.items()]
    if "type_errors" in postings.columns:
        typed = F.transform("type_errors", lambda e: F.concat(e, F.lit(": wrong type")))
        return F.concat(F.array_compact(F.array(*checks)), typed)
    return F.array_compact(F.array(*checks))


def validate_postings(postings: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Snapshots in which one bad posting has failed the whole snapshot of its company.

    `ingest` reads `ok` snapshots only, so the postings need not be filtered. Ordinals are page
    positions; a page too long for them fails its snapshot too, rather than mixing up two pages.
    """
    overflow = F.col("ordinal") % PAGE_SPAN == PAGE_SPAN - 1
    problem = F.coalesce(
        F.get(posting_violations(postings), F.lit(0)), F.when(overflow, F.lit("page: too many postings"))
    )
    bad = (
        postings.select("company_id", "cycle_ts", problem.alias("problem"))
        .filter(F.col("problem").isNotNull())
        .groupBy("company_id", "cycle_ts")
        .agg(F.min("problem").alias("problem"))
    )
    failed = F.col("problem").isNotNull() & (F.col("outcome") == "ok")
    return snapshots.join(bad, ["company_id", "cycle_ts"], "left").select(
        "company_id",
        "cycle_ts",
        F.when(failed, F.lit("failed")).otherwise(F.col("outcome")).alias("outcome"),
        F.when(failed, F.concat(F.lit("invalid posting: "), "problem")).otherwise(F.col("error")).alias("error"),
    )


# ---- batch --------------------------------------------------------------------------------
def scanned_companies(companies: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One row per successfully scanned company: (company_id, company_name, cycle_ts)."""
    named = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company_name"))
    return (
        snapshots.filter(F.col("outcome") == "ok").select("company_id", "cycle_ts").join(named, "company_id")
    )


def keep_us(postings: DataFrame, us_only: bool = True) -> DataFrame:
    """The location filter of the ingest."""
    if not us_only:
        return postings
    category = classify_location(F.col("location"))
    return with_computed(postings, _category=category).filter(F.col("_category").isin(*KEPT)).drop("_category")


def prepare_batch(
    postings: DataFrame, scanned: DataFrame, us_only: bool = True, small: bool = False
) -> DataFrame:
    """Kept postings of scanned companies with fingerprint and classification flags.

    `small` says that `scanned` was found small enough to broadcast.
    """
    kept = keep_us(postings.drop("company_name"), us_only).join(
        small_side(scanned, small), ["company_id", "cycle_ts"]
    )
    return (
        with_job_class(kept)
        .withColumn(
            "fingerprint_hash",
            fingerprint(*[F.col(c) for c in ("company_name", "title", "location", "url", "external_job_id")]),
        )
        .select(
            "*",
            F.col("verdict.entry_level_score").alias("entry_level_score"),
            F.col("verdict.is_entry_level").alias("is_entry_level"),
            F.col("verdict.is_software_engineering_related").alias("is_software_engineering_related"),
        )
        .drop("verdict")
    )


def resolve_duplicates(batch: DataFrame) -> DataFrame:
    """One row per fingerprint: identity from its first posting, attributes from its last.

    Plain aggregates, so copies are merged before the shuffle however many there are. `posters`
    holds distinct company ids, and companies that share a fingerprint share their name.
    """
    order = F.struct("company_id", "ordinal")
    identity = F.struct(
        "company_id", "ordinal", "cycle_ts", "is_entry_level", "is_software_engineering_related"
    )
    return batch.groupBy("fingerprint_hash").agg(
        F.min_by(identity, order).alias("first"),
        F.max_by(F.struct("company_id", "cycle_ts", *ATTRIBUTES), order).alias("last"),
        F.collect_set("company_id").alias("posters"),
    )


def running_offsets(
    counts: DataFrame, key: str, value: str, small: bool = False, span: int = 4096
) -> DataFrame:
    """(key, offset): sum of `value` over all smaller keys.

    One window where `counts` was found small; else two levels of windows over ranges of keys, so
    that no task sees more than `span` keys or one row per range.
    """

    def before(by: str, amount: str, *partition: str) -> Column:
        window = Window.partitionBy(*partition).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(amount).over(window), F.lit(0))

    if small:
        return counts.select(key, before(key, value).alias("offset"))
    ranged = counts.withColumn("_range", F.floor(F.col(key) / span))
    ranges = ranged.groupBy("_range").agg(F.sum(value).alias("_sum"))
    starts = ranges.select("_range", before("_range", "_sum").alias("_start"))
    local = ranged.withColumn("_local", before(key, value, "_range"))
    return local.join(starts, "_range").select(key, (F.col("_start") + F.col("_local")).alias("offset"))


def scan_counts(postings: DataFrame, scanned: DataFrame, us_only: bool = True) -> DataFrame:
    """Per scanned company: postings seen, postings filtered out by location, ordinals used."""
    foreign = ~classify_location(F.col("location")).isin(*KEPT) if us_only else F.lit(False)
    per_company = (
        postings.select("company_id", "cycle_ts", "ordinal", foreign.alias("foreign"))
        .groupBy("company_id", "cycle_ts")
        .agg(
            F.count("*").alias("jobs_seen_total"),
            F.count_if("foreign").alias("jobs_skipped_international"),
            (F.max("ordinal") + 1).alias("ordinals"),
        )
    )
    return scanned.join(per_company, ["company_id", "cycle_ts"], "left").na.fill(
        0, ["jobs_seen_total", "jobs_skipped_international", "ordinals"]
    )


# ---- merge --------------------------------------------------------------------------------
# Rows that a task of a merge sorts, some 250 MB of postings with short texts.
TASK_ROWS = 200_000


def merge_tasks(rows: int, buckets: int, least: int = 1) -> int | None:
    """How many tasks, at `least` so many, merge rows that lie in `buckets`; None where a task can take a bucket as it lies.

    A multiple of the buckets, so that what a task writes lies in one bucket still. `least` is the
    session's number of shuffle partitions, to which Spark raises smaller numbers.
    """
    times = -(-rows // (buckets * TASK_ROWS))
    return buckets * max(times, -(-least // buckets)) if times > 1 else None


def dealt(rows: DataFrame, tasks: int | None) -> DataFrame:
    """`rows` dealt to so many tasks by fingerprint; None: as they lie."""
    return rows if tasks is None else rows.repartition(tasks, "fingerprint_hash")


def merge_snapshots(
    jobs: DataFrame, companies: DataFrame, snapshots: DataFrame, postings: DataFrame, us_only: bool = True
) -> DataFrame:
    """The whole new state, with bookkeeping columns for `ingest_counters`.

    `snapshots` holds one row per company. New ids follow posting order and may leave gaps, as
    with a sequence. Bookkeeping: `change` (inserted, updated, closed, kept), `closed_in_cycle`
    (the owner closed it, even if a later company opened it again), and for inserted rows the
    flags of the posting that inserted them.
    """
    scanned = scanned_companies(companies, snapshots)
    small = is_small(scanned)
    batch = resolve_duplicates(prepare_batch(postings, scanned, us_only, small))
    return merge_batch(jobs, batch, scan_counts(postings, scanned, us_only), last_id(jobs), small)


def last_id(jobs: DataFrame) -> Column:
    """The largest id of all jobs, 0 without any."""
    return jobs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last_id")).scalar()


def touched_owners(jobs: DataFrame, batch: DataFrame, counts: DataFrame, small: bool = False, tasks: int | None = None) -> DataFrame:
    """(company_id): owners of the rows that merging `batch` inserts, updates or closes.

    Rows of all other owners come out of the merge as they went in. Reads three narrow columns of
    the state. `batch`, `counts` and `tasks` as in `merge_batch`.
    """
    stored = dealt(jobs.select("fingerprint_hash", F.col("company_id").alias("owner")), tasks)
    posted = dealt(batch.select("fingerprint_hash", F.col("first.company_id").alias("poster")), tasks).join(stored, "fingerprint_hash", "left")
    closing = jobs.filter(F.col("is_active")).join(small_side(counts.select("company_id"), small), "company_id", "left_semi")
    return posted.select(F.coalesce("owner", "poster").alias("company_id")).unionByName(closing.select("company_id"))


def merge_batch(
    jobs: DataFrame, batch: DataFrame, counts: DataFrame, last_id: Column, small: bool = False, tasks: int | None = None
) -> DataFrame:
    """`merge_snapshots` from the rows of `resolve_duplicates` and `scan_counts`.

    `jobs` may be any part of the state that holds all rows of the `touched_owners`; new ids follow `last_id`.
    `tasks` is from `merge_tasks`, where both sides lie in buckets.
    """
    owners = counts.select(
        F.col("company_id").alias("owner"), F.col("cycle_ts").alias("owner_cycle")
    ).join(
        running_offsets(counts, "company_id", "ordinals", small).withColumnRenamed("company_id", "owner"), "owner", "left"
    )
    state = jobs.select(F.struct(*JOB_COLUMNS).alias("s"), "fingerprint_hash")
    both = (
        dealt(state, tasks).join(dealt(batch, tasks), "fingerprint_hash", "full_outer")
        .withColumn("owner", F.coalesce("s.company_id", "first.company_id"))
        .join(small_side(owners, small), "owner", "left")
    )

    is_new, posted = F.col("s").isNull(), F.col("last").isNotNull()
    owner_scanned = F.col("owner_cycle").isNotNull()
    owner_posted = F.coalesce(F.array_contains("posters", F.col("owner")), F.lit(False))
    opened_earlier = posted & (F.col("first.company_id") < F.col("owner"))
    active_at_turn = F.coalesce(F.col("s.is_active"), F.lit(False)) | F.coalesce(opened_earlier, F.lit(False))
    closed_in_cycle = ~is_new & owner_scanned & ~owner_posted & active_at_turn
    stays_open = F.when(posted, (F.col("last.company_id") >= F.col("owner")) | ~owner_scanned).otherwise(
        F.col("s.is_active") & ~owner_scanned
    )
    last_seen = (
        F.when(posted & stays_open, F.col("last.cycle_ts"))
        .when(closed_in_cycle, F.col("owner_cycle"))
        .otherwise(F.col("s.last_seen_at"))
    )
    values = {
        **{c: F.when(posted, F.col(f"last.{c}")).otherwise(F.col(f"s.{c}")) for c in ATTRIBUTES},
        "id": F.coalesce("s.id", last_id + F.col("offset") + F.col("first.ordinal") + 1),
        "company_id": F.col("owner"),
        "first_seen_at": F.coalesce("s.first_seen_at", "first.cycle_ts"),
        "last_seen_at": last_seen,
        "is_active": stays_open,
        "fingerprint_hash": F.col("fingerprint_hash"),
        "created_at": F.coalesce("s.created_at", "first.cycle_ts"),
        "updated_at": F.coalesce("s.updated_at", "first.cycle_ts"),
    }
    change = (
        F.when(is_new, F.lit("inserted"))
        .when(closed_in_cycle & ~stays_open, F.lit("closed"))
        .when(posted, F.lit("updated"))
        .otherwise(F.lit("kept"))
    )
    return both.select(
        *[values[c].alias(c) for c in JOB_COLUMNS],
        change.alias("change"),
        closed_in_cycle.alias("closed_in_cycle"),
        F.when(is_new, F.col("first.is_software_engineering_related")).alias("inserted_software"),
        F.when(is_new, F.col("first.is_entry_level")).alias("inserted_entry_level"),
    )


def ingest_counters(
    merged: DataFrame, companies: DataFrame, snapshots: DataFrame, postings: DataFrame, us_only: bool = True
) -> DataFrame:
    """Counters per scanned company, from narrow columns of the merged state and the postings."""
    return merge_counters(merged, scan_counts(postings, scanned_companies(companies, snapshots), us_only))


def merge_counters(merged: DataFrame, counts: DataFrame) -> DataFrame:
    """`ingest_counters` from merged rows, of which the changed ones suffice, and `scan_counts`.

    The two "skipped non-" counters count inserted rows that are not digest candidates.
    """
    software, entry = F.col("inserted_software"), F.col("inserted_entry_level")
    changes = (
        merged.filter((F.col("change") == "inserted") | F.col("closed_in_cycle"))
        .groupBy("company_id")
        .agg(
            F.count_if(F.col("change") == "inserted").alias("jobs_inserted_total"),
            F.count_if(software).alias("jobs_inserted_software_related"),
            F.count_if(entry).alias("jobs_inserted_entry_level"),
            F.count_if(software & entry).alias("jobs_inserted_digest_eligible"),
            F.count_if(~software).alias("jobs_skipped_non_software"),
            F.count_if(software & ~entry).alias("jobs_skipped_non_entry_level"),
            F.count_if("closed_in_cycle").alias("inactive_jobs_marked"),
        )
    )
    return counts.join(changes, "company_id", "left").na.fill(0, COUNTERS).select("company_id", *COUNTERS)


def total_counters(counters: DataFrame) -> DataFrame:
    """Per-company rows and, with a null company, their sum."""
    return counters.rollup("company_id").agg(*[F.sum(c).alias(c) for c in COUNTERS])


def ingest(
    jobs: DataFrame, companies: DataFrame, snapshots: DataFrame, postings: DataFrame, us_only: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(new state, counters per company). For large states stage the merge instead: see plans.cycle."""
    merged = merge_snapshots(jobs, companies, snapshots, postings, us_only)
    return merged.select(JOB_COLUMNS), ingest_counters(merged, companies, snapshots, postings, us_only)


def stale_jobs(jobs: DataFrame, snapshots: DataFrame, batch: DataFrame) -> DataFrame:
    """Active rows of successfully scanned companies that their company did not post.

    An empty successful snapshot makes all of its company's rows stale.
    """
    scanned = snapshots.filter(F.col("outcome") == "ok").select("company_id")
    posted = batch.select("company_id", "fingerprint_hash")
    return (
        jobs.filter(F.col("is_active"))
        .join(scanned, "company_id", "left_semi")
        .join(posted, ["company_id", "fingerprint_hash"], "left_anti")
    )


def drop_orphans(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """Jobs whose company still exists (deleting a company deletes its jobs)."""
    return jobs.join(companies.select(F.col("id").alias("company_id")), "company_id", "left_semi")


def reclassify(jobs: DataFrame) -> DataFrame:
    """All stored jobs with the current rules applied."""
    changed = {
        "entry_level_score": F.col("verdict.entry_level_score"),
        "is_entry_level": F.col("verdict.is_entry_level"),
        "is_software_engineering_related": F.col("verdict.is_software_engineering_related"),
    }
    return with_job_class(jobs).withColumns(changed).drop("verdict")


def reclassify_tally(reclassified: DataFrame) -> DataFrame:
    software, entry = F.col("is_software_engineering_related"), F.col("is_entry_level")
    return reclassified.agg(
        F.count("*").alias("total"),
        F.count("*").alias("updated"),
        F.count_if(software).alias("software_related"),
        F.count_if(entry).alias("entry_level"),
        F.count_if(software & entry).alias("digest_eligible"),
    )
