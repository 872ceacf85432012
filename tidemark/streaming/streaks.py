"""404 streaks over a stream of scrape outcomes, with an event when a company is disabled.

A stateful operator keeps the outcomes of each time bucket that is open. Its key is a slot, which many
companies share by hash, and the bucket: a call has a fixed cost of some milliseconds, so there are as
many calls as slots and buckets, not as companies and buckets, and each works on whole arrays. It emits
the summary of a company's bucket whenever a batch changes it; an outcome that comes late only touches
its own slot of its own bucket. The sink stores one summary per company and bucket and folds those of
the companies that a batch has touched. The log itself is never stored or read again. Where a lateness
is given, event time closes buckets: their rows leave the state, and their summaries become one per
company.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidemark import rules
from tidemark.operators.streaks import SUMMARY, Runs, fold, kind_code, streaks_of, summarise
from tidemark.session import shared_folder
from tidemark.sources import tables

STREAKS = "company_id bigint, streak bigint, disabled_at timestamp"
BUCKETS = f"company_id bigint, bucket bigint, {SUMMARY}"
# outcomes of a slot's bucket in order of company, time and seq, each column as the bytes of its longs
_COLUMNS = ("company_id", "at", "seq", "kind")
_KEPT = ", ".join(f"{c} binary" for c in _COLUMNS)
SLOTS = 64
_FIRST = -(1 << 63)
_WIDTHS = {"hour": 3_600_000_000, "day": 86_400_000_000}


class BucketSummaries(StatefulProcessor):
    """Summaries of the outcomes of the companies of one (slot, bucket), emitted when they change.

    The state holds the outcomes that bear on a streak, and one that does not for a company without
    any. `width` is that of a bucket in microseconds where event time closes buckets, else None.
    """

    def __init__(self, threshold: int, width: int | None):
        self.threshold, self.width = threshold, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getValueState("rows", _KEPT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        bucket = int(key[1])
        parts = list(rows)
        arrived = [np.concatenate([part[c].to_numpy(np.int64) for part in parts]) for c in _COLUMNS]
        kept = self.rows.get()
        held = [np.frombuffer(c, np.int64) for c in kept] if kept else [np.zeros(0, np.int64)] * len(_COLUMNS)
        bears = arrived[3] != 0
        silent = np.setdiff1d(arrived[0], np.concatenate([held[0], arrived[0][bears]]))
        added = [np.concatenate([c[bears], s]) for c, s in zip(arrived, (silent, *(np.full(len(silent), v) for v in (bucket, 0, 0))), strict=True)]
        if self.width is not None:
            self.handle.registerTimer((bucket + self.width) // 1000)
        if not len(added[0]):
            return
        merged = [np.concatenate(c) for c in zip(held, added, strict=True)]
        order = np.lexsort(merged[::-1])
        merged = [c[order] for c in merged]
        self.rows.update(tuple(c.tobytes() for c in merged))
        touched = np.unique(added[0])
        old_ids, old = self._summaries(held, touched)
        ids, new = self._summaries(merged, touched)
        # all touched companies are in `ids`, those of them that were known in `old_ids`
        at = np.searchsorted(ids, old_ids)
        changed = np.ones(len(ids), bool)
        changed[at] = differing(old, taken(new, at))
        if changed.any():
            yield shown(ids[changed], bucket, taken(new, np.flatnonzero(changed)))

    def _summaries(self, columns: list[np.ndarray], wanted: np.ndarray) -> tuple[np.ndarray, Runs]:
        """The wanted companies among the rows, and the summary of each."""
        mine = np.isin(columns[0], wanted)
        company, at, _, kind = (c[mine] for c in columns)
        starts = np.flatnonzero(np.concatenate([[True], company[1:] != company[:-1]])[: len(company)])
        return company[starts], summarise(starts, at, kind, self.threshold)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The bucket is closed: the sink has its summaries, and no row of it will come."""
        self.rows.clear()
        return iter(())

    def close(self) -> None:
        pass


def taken(runs: Runs, at: np.ndarray) -> Runs:
    """The summaries at the given ascending places."""
    chosen = np.zeros(len(runs.head), bool)
    chosen[at] = True
    values = {name: column[chosen] for name, column in runs._asdict().items() if name != "head_at"}
    return Runs(head_at=runs.head_at[np.repeat(chosen, runs.head_sizes)], **values)


def differing(a: Runs, b: Runs) -> np.ndarray:
    """For each place whether the summaries there differ."""
    names = ("any_ok", "head", "head_sizes", "tail", "has_hit")
    differ = np.any([getattr(a, n) != getattr(b, n) for n in names], axis=0) | (a.has_hit & (a.hit_at != b.hit_at))
    alike = a.head_sizes == b.head_sizes
    moved = a.head_at[np.repeat(alike, a.head_sizes)] != b.head_at[np.repeat(alike, b.head_sizes)]
    differ[np.repeat(np.flatnonzero(alike), a.head_sizes[alike])[moved]] = True
    return differ


def shown(ids: np.ndarray, bucket: int, runs: Runs) -> pd.DataFrame:
    """Summaries as rows of `BUCKETS`."""
    heads = pd.Series(np.split(runs.head_at, np.cumsum(runs.head_sizes)[:-1]), dtype=object)
    hit_at = pd.arrays.IntegerArray(runs.hit_at, ~runs.has_hit)
    return pd.DataFrame({"company_id": ids, "bucket": bucket, "any_ok": runs.any_ok, "head": runs.head, "head_at": heads, "tail": runs.tail, "hit_at": hit_at})


def bucket_summaries(stream: DataFrame, threshold: int, bucket: str = "day", lateness: str | None = None, slots: int = SLOTS) -> DataFrame:
    """(company_id, bucket in microseconds, summary columns) of the buckets that a batch of outcomes changes.

    Outcomes without company or time are left out; one without seq comes first of its instant. With a
    `lateness`, such as "7 days", rows later than that are dropped and buckets older than that are closed.
    A bucket's rows are dealt to `slots` keys; a checkpoint keeps the number it began with.
    """
    rows = stream.where(F.col("company_id").isNotNull() & F.col("ts").isNotNull())
    if lateness is not None:
        rows = rows.withWatermark("ts", lateness)
    company = F.col("company_id").cast("bigint")
    rows = rows.select(
        F.pmod(F.xxhash64(company), F.lit(slots)).cast("int").alias("slot"), F.unix_micros(F.date_trunc(bucket, "ts")).alias("bucket"), "ts", company.alias("company_id"),
        F.unix_micros("ts").alias("at"), F.coalesce(F.col("seq").cast("bigint"), F.lit(_FIRST)).alias("seq"), kind_code(F.col("kind")).cast("bigint").alias("kind"),
    )
    processor = BucketSummaries(threshold, _WIDTHS[bucket] if lateness is not None else None)
    mode = "EventTime" if lateness is not None else "None"
    return rows.groupBy("slot", "bucket").transformWithStateInPandas(processor, BUCKETS, "Update", mode)


def merge_buckets(stored: DataFrame, changed: DataFrame, threshold: int, closed: int | None = None) -> DataFrame:
    """Stored summaries with the changed ones in place.

    Buckets of the touched companies that began before `closed` become one, named by the first of them.
    """
    after = stored.join(changed.select("company_id", "bucket"), ["company_id", "bucket"], "left_anti").unionByName(changed)
    if closed is None:
        return after
    touched = changed.select("company_id").distinct()
    mine = after.join(touched, "company_id", "left_semi")
    first = mine.where(F.col("bucket") < closed).groupBy("company_id").agg(F.min("bucket").alias("_first"))
    mine = mine.join(first, "company_id", "left").withColumn("_slot", F.when(F.col("bucket") < closed, F.col("_first")).otherwise(F.col("bucket")))
    whole = fold(mine, ["company_id", "_slot"], ["bucket"], threshold).withColumnRenamed("_slot", "bucket")
    return after.join(touched, "company_id", "left_anti").unionByName(whole)


def start_streaks(
    spark: SparkSession,
    stream: DataFrame,
    table: str = "failure_streaks",
    events_path: str | None = None,
    threshold: int = rules.DISABLE_AFTER_404,
    checkpoint: str | None = None,
    bucket: str = "day",
    lateness: str | None = None,
    slots: int = SLOTS,
) -> StreamingQuery:
    """Keeps `table` up to date; disable events go to one folder per batch under `events_path`.

    Summaries are kept in the table `<table>_buckets`. Without `lateness` every outcome counts however
    late it comes, and buckets stay open. Uses the RocksDB state store. `slots` as in `bucket_summaries`.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    checkpoint = checkpoint or f"{shared_folder(spark)}/streams/{table}"
    stored = f"{table}_buckets"
    if not spark.catalog.tableExists(stored):
        tables.write_version(spark.createDataFrame([], BUCKETS), stored, "start")
    if not spark.catalog.tableExists(table):
        tables.write_version(spark.createDataFrame([], STREAKS), table, "start")

    def each(changed: DataFrame, batch_id: int) -> None:
        session, mark = changed.sparkSession, f"b{batch_id}"
        before, done = session.table(table), tables.applied_mark(session, table)
        if done == mark:
            return
        # written once: the state operator must not run again for every reader
        changed = tables.stage_version(changed, f"{table}_changed", mark)
        if tables.applied_mark(session, stored) != mark:
            # event time has passed these: later rows than the batches before allow are dropped by the watermark
            last = F.timestamp_micros(F.max("bucket"))
            closed = session.table(stored).agg(F.unix_micros(F.date_trunc(bucket, last - F.expr(f"INTERVAL {lateness}")))).first()[0] if lateness else None
            after = tables.stage_version(merge_buckets(session.table(stored), changed, threshold, closed), stored, mark)
            tables.publish_version(session, stored, mark, after.columns)
        touched = changed.select("company_id").distinct()
        now = streaks_of(fold(session.table(stored).join(touched, "company_id", "left_semi"), ["company_id"], ["bucket"], threshold), threshold)
        after = tables.stage_version(before.join(touched, "company_id", "left_anti").unionByName(now), table, mark)
        if events_path:
            known = before.filter(F.col("disabled_at").isNotNull()).select("company_id")
            events = after.filter(F.col("disabled_at").isNotNull()).join(known, "company_id", "left_anti")
            events.write.mode("overwrite").parquet(f"{events_path}/batch_id={batch_id}")
        tables.publish_version(session, table, mark, after.columns)
        # readers of the version before may still be at work
        for name in (table, stored):
            tables.drop_versions(session, name, [mark, done or mark])
        tables.drop_versions(session, f"{table}_changed", [mark])

    return (
        bucket_summaries(stream, threshold, bucket, lateness, slots).writeStream.foreachBatch(each)
        .outputMode("update").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
