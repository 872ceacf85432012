"""404 streaks as an associative fold.

A piece of a company's log, however it is cut, is summed up in a few values: the 404s before its first
success and when the first of them came, whether it has a success, the 404s after the last one, and when
a streak that began inside reached the threshold. Summaries of neighbouring pieces combine to that of
both. So the log is range-partitioned by company and time, which deals the rows of a large company to
many tasks, each task sums up what it holds, and summaries are combined in two levels. No task ever
sees a company's day, let alone its log.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tidemark import rules

SUMMARY = "any_ok boolean, head bigint, head_at array<bigint>, tail bigint, hit_at bigint"
SUMMARY_COLUMNS = [c.split()[0] for c in SUMMARY.split(", ")]
OK, MISSING = 2, 1


def kind_code(kind: Column) -> Column:
    """`OK`, `MISSING` or 0; all other outcomes leave a streak as it is."""
    return F.when(kind == "ok", OK).when(kind == "404", MISSING).otherwise(0).cast("tinyint")


class Runs(NamedTuple):
    """Summaries of neighbouring runs of rows: one entry of each array per run, `head_at` as values and sizes."""

    any_ok: np.ndarray
    head: np.ndarray
    head_at: np.ndarray
    head_sizes: np.ndarray
    tail: np.ndarray
    hit_at: np.ndarray
    has_hit: np.ndarray

    def arrays(self) -> list[pa.Array]:
        offsets = np.concatenate([[0], np.cumsum(self.head_sizes)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(self.head_at, pa.int64()))
        return [pa.array(self.any_ok), pa.array(self.head), lists, pa.array(self.tail), pa.array(self.hit_at, pa.int64(), mask=~self.has_hit)]


def summarise(starts: np.ndarray, at: np.ndarray, kind: np.ndarray, threshold: int) -> Runs:
    """Summaries of the runs that begin at `starts`; rows of a run are in order of time."""
    ends = np.append(starts, len(at))[1:]
    before = np.concatenate([[0], np.cumsum(kind == MISSING)])
    misses, oks = np.flatnonzero(kind == MISSING), np.flatnonzero(kind == OK)
    low, high = np.searchsorted(oks, starts), np.searchsorted(oks, ends)
    any_ok = high > low
    first_ok, last_ok = ends.copy(), starts.copy()
    first_ok[any_ok], last_ok[any_ok] = oks[low[any_ok]], oks[high[any_ok] - 1]
    head = before[first_ok] - before[starts]
    sizes = np.minimum(head, threshold)
    skipped = np.cumsum(sizes) - sizes
    shown = misses[np.repeat(before[starts] - skipped, sizes) + np.arange(sizes.sum())]
    # a streak inside a run counts from the last success before each 404
    run = np.searchsorted(starts, misses, "right") - 1
    last = np.searchsorted(oks, misses) - 1
    inner = last >= low[run]
    streak = before[misses[inner] + 1] - before[oks[last[inner]]]
    hits = misses[inner][streak == threshold]
    hit_runs, first = np.unique(np.searchsorted(starts, hits, "right") - 1, return_index=True)
    hit_at, has_hit = np.zeros(len(starts), np.int64), np.zeros(len(starts), bool)
    hit_at[hit_runs], has_hit[hit_runs] = at[hits[first]], True
    return Runs(any_ok, head, at[shown], sizes, before[ends] - before[last_ok], hit_at, has_hit)


def piece_summaries(log: DataFrame, threshold: int) -> DataFrame:
    """(company_id, part, place, summary columns) of the pieces of a log (company_id, ts, seq, kind).

    A piece is what one task holds of a company, cut further where Arrow batches end; part and place
    order the pieces. Outcomes without company or time are left out, those that change nothing too.
    """
    rows = log.where(F.col("company_id").isNotNull() & F.col("ts").isNotNull()).select(
        F.col("company_id").cast("bigint").alias("company_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "seq", kind_code(F.col("kind")).alias("kind")
    )
    order = ["company_id", "at", "seq"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for place, batch in enumerate(batches):
            if batch.num_rows:
                company, at, kind = (batch.column(c).to_numpy() for c in ("company_id", "at", "kind"))
                starts = np.flatnonzero(np.concatenate([[True], company[1:] != company[:-1]]))
                ids = [pa.array(company[starts]), pa.array(np.full(len(starts), part)), pa.array(np.full(len(starts), place))]
                yield pa.RecordBatch.from_arrays([*ids, *summarise(starts, at, kind, threshold).arrays()], names=["company_id", "part", "place", *SUMMARY_COLUMNS])

    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("company_id", "at", "kind")
    return sorted_rows.mapInArrow(run, f"company_id bigint, part bigint, place bigint, {SUMMARY}")


def _nothing() -> Column:
    kinds = dict(c.split() for c in SUMMARY.split(", "))
    values = {"any_ok": F.lit(False), "head": F.lit(0), "head_at": F.array(), "tail": F.lit(0), "hit_at": F.lit(None)}
    return F.struct(*(v.cast(kinds[c]).alias(c) for c, v in values.items()))


def combine(a: Column, b: Column, threshold: int) -> Column:
    """The summary of piece `a` and the piece `b` that follows it."""
    # the 404 of b's head with which the streak that a leaves behind reaches the threshold
    needed = F.lit(threshold) - a["tail"]
    crossing = F.when(a["any_ok"] & (b["head"] >= needed), F.get(b["head_at"], (needed - 1).cast("int")))
    return F.struct(
        (a["any_ok"] | b["any_ok"]).alias("any_ok"),
        F.when(a["any_ok"], a["head"]).otherwise(a["head"] + b["head"]).alias("head"),
        F.when(a["any_ok"], a["head_at"]).otherwise(F.slice(F.concat(a["head_at"], b["head_at"]), 1, threshold)).alias("head_at"),
        F.when(b["any_ok"], b["tail"]).otherwise(a["tail"] + b["tail"]).alias("tail"),
        F.coalesce(a["hit_at"], crossing, b["hit_at"]).alias("hit_at"),
    )


def fold(summaries: DataFrame, keys: list[str], order: list[str], threshold: int) -> DataFrame:
    """One summary for each of `keys`, of pieces in order of the columns `order`."""
    pieces = F.sort_array(F.collect_list(F.struct(*order, F.struct(*SUMMARY_COLUMNS).alias("summary"))))
    whole = F.aggregate(pieces, _nothing(), lambda a, piece: combine(a, piece["summary"], threshold))
    return summaries.groupBy(*keys).agg(whole.alias("_whole")).select(*keys, *(F.col("_whole")[c].alias(c) for c in SUMMARY_COLUMNS))


def company_summaries(pieces: DataFrame, threshold: int) -> DataFrame:
    """One summary per company: neighbouring parts first, as many as there then are groups of them."""
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = pieces.withColumn("part_group", F.floor(F.col("part") / math.ceil(math.sqrt(parts))))
    return fold(fold(grouped, ["company_id", "part_group"], ["part", "place"], threshold), ["company_id"], ["part_group"], threshold)


def streaks_of(summaries: DataFrame, threshold: int, initial: DataFrame | None = None) -> DataFrame:
    """(company_id, streak, disabled_at) from one summary per company; `initial` (company_id, failures) is what came before."""
    if initial is not None:
        summaries = summaries.join(initial.select("company_id", F.col("failures").cast("bigint").alias("_failures")), "company_id", "left")
    failures = F.coalesce("_failures", F.lit(0)) if initial is not None else F.lit(0)
    needed = F.greatest(F.lit(threshold) - failures, F.lit(1))
    head_hit = F.when(F.col("head") >= needed, F.get("head_at", (needed - 1).cast("int")))
    streak = (
        F.when(head_hit.isNotNull(), failures + needed)
        .when(F.col("hit_at").isNotNull(), F.lit(threshold))
        .otherwise(F.when(F.col("any_ok"), F.col("tail")).otherwise(failures + F.col("tail")))
    )
    return summaries.select("company_id", streak.cast("bigint").alias("streak"), F.timestamp_micros(F.coalesce(head_hit, "hit_at")).alias("disabled_at"))


def failure_streaks(outcomes: DataFrame, threshold: int = rules.DISABLE_AFTER_404, initial: DataFrame | None = None) -> DataFrame:
    """Per company after a whole log (company_id, ts, seq, kind) with kind ok, 404 or other:
    (company_id, streak, disabled_at).

    The streak counts the 404s since the last success and stops at the first one that reaches the
    threshold. `seq` orders outcomes of the same instant; `initial` gives (company_id, failures)
    to start from.
    """
    return streaks_of(company_summaries(piece_summaries(outcomes, threshold), threshold), threshold, initial)
