"""Many cycles of snapshots merged into the state in one pass.

Applying cycles one after the other rewrites the state once per cycle. What a job looks like after the
last of them only depends on a few facts, each an aggregate over all cycles at once: its first posting
(identity), its last posting (attributes), and the first scan of its owner after that (closing). So the
postings of all cycles are merged by fingerprint, the scanned cycles of a company become one sorted
list, and one full outer join with the state gives the rows that the loop over cycles would give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.operators.ingest import ATTRIBUTES, prepare_batch, scanned_companies
from tidemark.schemas import JOB_COLUMNS


def cycle_offsets(postings: DataFrame, scanned: DataFrame) -> DataFrame:
    """(company_id, cycle_ts, offset): ordinals used by all scans before, cycle by cycle and by company within one."""
    used = postings.groupBy("company_id", "cycle_ts").agg((F.max("ordinal") + 1).alias("used"))
    used = scanned.select("company_id", "cycle_ts").join(used, ["company_id", "cycle_ts"]).withColumn("span", F.floor(F.col("company_id") / 4096))
    # sums over ranges of companies first, so that no window holds more than the ranges or one range of a cycle
    ranges = used.groupBy("cycle_ts", "span").agg(F.sum("used").alias("sum"))
    before = lambda amount, window: F.coalesce(F.sum(amount).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.withColumn("start", before("sum", Window.orderBy("cycle_ts", "span")))
    local = used.withColumn("local", before("used", Window.partitionBy("cycle_ts", "span").orderBy("company_id")))
    return local.join(ranges, ["cycle_ts", "span"]).select("company_id", "cycle_ts", (F.col("start") + F.col("local")).alias("offset"))


def owner_scans(scanned: DataFrame) -> DataFrame:
    """(owner, scans): the cycles in which a company was scanned, in order. As long as a batch has cycles."""
    return scanned.groupBy(F.col("company_id").alias("owner")).agg(F.array_sort(F.collect_set("cycle_ts")).alias("scans"))


def merged_postings(batch: DataFrame) -> DataFrame:
    """One row per fingerprint over all cycles: the first posting's identity, the last one's attributes."""
    order = F.struct("cycle_ts", "company_id", "ordinal")
    return batch.groupBy("fingerprint_hash").agg(
        F.min_by(F.struct("company_id", "cycle_ts", "ordinal", "offset"), order).alias("first"),
        F.max_by(F.struct("company_id", "cycle_ts", *ATTRIBUTES), order).alias("last"),
    )


def merge_cycles(jobs: DataFrame, companies: DataFrame, snapshots: DataFrame, postings: DataFrame, us_only: bool = True) -> DataFrame:
    """The state after all cycles of `snapshots`, the same as after `merge_snapshots` cycle by cycle.

    `snapshots` holds one row per company and cycle. New ids follow cycle, company and posting order and
    leave other gaps than the loop does. A job keeps its owner, id and first day. It is active if
    it was at its last posting and its owner was not scanned after that; at its last posting it was
    if the owner was not scanned then, or no later company of the cycle than the owner came last.
    """
    scanned = scanned_companies(companies, snapshots)
    # a posting's place is known before fingerprints are merged, so no company-level join follows for it
    batch = prepare_batch(postings, scanned, us_only).join(cycle_offsets(postings, scanned), ["company_id", "cycle_ts"])
    last_id = jobs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last_id")).scalar()

    state = jobs.select(F.struct(*JOB_COLUMNS).alias("s"), "fingerprint_hash")
    both = state.join(merged_postings(batch), "fingerprint_hash", "full_outer").withColumn("owner", F.coalesce("s.company_id", "first.company_id"))
    both = both.join(owner_scans(scanned), "owner", "left")

    posted, scans = F.col("last").isNotNull(), F.coalesce("scans", F.array().cast("array<timestamp>"))
    last_posted = F.col("last.cycle_ts")
    open_then = (F.col("last.company_id") >= F.col("owner")) | ~F.array_contains(scans, last_posted)
    active = F.when(posted, open_then).otherwise(F.col("s.is_active"))
    # the scan that closes a job: the owner's first one after the last posting, or of all where nobody posted it
    closing = F.array_min(F.filter(scans, lambda c: last_posted.isNull() | (c > last_posted)))
    values = {
        **{c: F.when(posted, F.col(f"last.{c}")).otherwise(F.col(f"s.{c}")) for c in ATTRIBUTES},
        "id": F.coalesce("s.id", last_id + F.col("first.offset") + F.col("first.ordinal") + 1),
        "company_id": F.col("owner"),
        "first_seen_at": F.coalesce("s.first_seen_at", "first.cycle_ts"),
        "last_seen_at": F.coalesce(F.when(active, closing), last_posted, "s.last_seen_at"),
        "is_active": active & closing.isNull(),
        "fingerprint_hash": F.col("fingerprint_hash"),
        "created_at": F.coalesce("s.created_at", "first.cycle_ts"),
        "updated_at": F.coalesce("s.updated_at", "first.cycle_ts"),
    }
    return both.select(*[values[c].alias(c) for c in JOB_COLUMNS])
