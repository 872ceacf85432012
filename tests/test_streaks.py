"""404 streaks: the associative fold and the stateful stream against a plain loop over the log."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import streaks
from tidemark.sources import tables
from tidemark.streaming import streaks as stream

START = dt.datetime(2026, 3, 1)
LOG = "company_id long, ts timestamp, seq long, kind string"


def by_loop(log, threshold, start=None):
    out = {}
    for company, at, _, kind in sorted(log):
        streak, disabled = out.get(company, ((start or {}).get(company, 0), None))
        if disabled is None:
            streak = 0 if kind == "ok" else streak + (kind == "404")
            disabled = at if kind == "404" and streak >= threshold else None
        out[company] = (streak, disabled)
    return out


def random_log(rng, companies, n):
    kinds = ["404", "404", "other", "ok"]
    return [(rng.choice(companies), START + dt.timedelta(hours=rng.randrange(24 * 12)), seq, rng.choice(kinds)) for seq in range(n)]


def shown(frame):
    return {r.company_id: (r.streak, r.disabled_at) for r in frame.collect()}


@pytest.mark.parametrize("threshold", [1, 2, 3, 6])
def test_summaries_combine_however_a_log_is_cut(spark, threshold):
    """All pieces of a log, combined in any grouping, say what the loop over the whole log says."""
    rng, rows, expected = random.Random(threshold), [], {}
    for case in range(60):
        kinds = [rng.choice([0, 1, 1, 2] if case % 2 else [0, 1, 1, 1]) for _ in range(rng.randint(1, 20))]
        cuts = sorted({0, *(rng.randrange(len(kinds)) for _ in range(rng.randint(0, 6)))})
        runs = streaks.summarise(np.array(cuts), np.arange(len(kinds)) * 1_000_000, np.array(kinds), threshold).arrays()
        rows += [(case, place // 2, place, *(a[place].as_py() for a in runs)) for place in range(len(cuts))]
        names = {0: "other", 1: "404", 2: "ok"}
        expected |= by_loop([(case, dt.datetime(1970, 1, 1) + dt.timedelta(seconds=i), i, names[k]) for i, k in enumerate(kinds)], threshold)
    pieces = spark.createDataFrame(rows, f"company_id long, part long, place long, {streaks.SUMMARY}")
    assert shown(streaks.streaks_of(streaks.company_summaries(pieces, threshold), threshold)) == expected
    flat = streaks.fold(pieces, ["company_id"], ["part", "place"], threshold)
    assert shown(streaks.streaks_of(flat, threshold)) == expected


def test_small_batches_and_initial_streaks(spark):
    rng = random.Random(4)
    log, start = random_log(rng, range(5), 300), {c: rng.randrange(4) for c in range(4)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        initial = spark.createDataFrame(list(start.items()), "company_id long, failures long")
        got = shown(streaks.failure_streaks(spark.createDataFrame(log, LOG), 3, initial))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == by_loop(log, 3, start)
    nothing = [(None, START, 0, "404"), (7, None, 0, "404"), (8, START, 0, None)]
    assert shown(streaks.failure_streaks(spark.createDataFrame(nothing, LOG))) == {8: (0, None)}
    assert streaks.failure_streaks(spark.createDataFrame([], LOG)).count() == 0


def test_a_large_company_is_spread_over_the_tasks(spark):
    """A company with a third of all events, on few days, is summed up by a third of the tasks."""
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 1000 + 10).alias("company_id"),
        F.timestamp_seconds(F.lit(1_772_323_200) + F.col("id") % 7200).alias("ts"), F.col("id").alias("seq"),
        F.when(F.col("id") % 11 == 0, "404").otherwise("ok").alias("kind"),
    )
    spark.conf.set("spark.sql.shuffle.partitions", 12)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        pieces = streaks.piece_summaries(rows, 2).where("company_id = 5").select("part").distinct().count()
        plan = streaks.failure_streaks(rows)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", True)
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert pieces >= 4 and "Window" not in plan and "rangepartitioning(company_id" in plan


def run(spark, rows, folder, table, checkpoint, **options):
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(LOG).parquet(folder)
    stream.start_streaks(spark, source, table, checkpoint=checkpoint, **options).awaitTermination()
    return shown(spark.table(table))


def test_late_outcomes_and_restarts(spark, tmp_path):
    """Batches in any order of time, each by a query started anew, say what the whole log says."""
    rng, log, bucket = random.Random(9), [], "day"
    everything = random_log(rng, range(6), 120)
    for k in range(3):
        part = everything[k * 40 : k * 40 + 40]
        log += part
        assert run(spark, part, str(tmp_path / "in"), f"late_{bucket}", str(tmp_path / "ck"), bucket=bucket, threshold=3) == by_loop(log, 3)
    # a summary per company and bucket, whatever the number of outcomes
    assert spark.table(f"late_{bucket}_buckets").count() == len({(c, t.replace(hour=0) if bucket == "day" else t) for c, t, *_ in log})


def test_lateness_closes_buckets(spark, tmp_path):
    """Rows of closed buckets leave the state, their summaries become one, and what is later than allowed is dropped."""
    day = lambda d, h=1: START + dt.timedelta(days=d, hours=h)
    folder, table, ck = str(tmp_path / "in"), "closing", str(tmp_path / "ck")
    log = []
    for d in range(6):
        rows = [(1, day(d), d, "404"), (1, day(d, 2), d, "ok" if d < 4 else "other"), (2, day(d), d, "404")]
        log += rows
        got = run(spark, rows, folder, table, ck, lateness="2 days", threshold=4)
    assert got == by_loop(log, 4) and got[2] == (4, day(3))
    # one summary for the days before the third, which the batches before have closed, and one for each later day
    assert {r.company_id: r["count"] for r in spark.table(f"{table}_buckets").groupBy("company_id").count().collect()} == {1: 5, 2: 5}
    late = [(1, day(4, 3), 100, "404"), (1, day(0), 101, "404"), (2, day(5, 5), 102, "ok")]
    got = run(spark, late, folder, table, ck, lateness="2 days", threshold=4)
    assert got == by_loop([*log, late[0], late[2]], 4)


def test_a_repeated_batch_changes_nothing(spark):
    stored = spark.createDataFrame([(1, 0, False, 1, [5], 1, None)], stream.BUCKETS)
    changed = spark.createDataFrame([(1, 0, False, 2, [5, 7], 2, None), (2, 0, True, 0, [], 0, None)], stream.BUCKETS)
    once = stream.merge_buckets(stored, changed, 2)
    assert sorted(once.collect()) == sorted(stream.merge_buckets(once, changed, 2).collect()) == sorted(changed.collect())
    assert not tables.applied_mark(spark, "no_such_table")


class Held:
    """A state handle and its one value state."""

    def __init__(self):
        self.value, self.updates = None, 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.value, self.updates = value, self.updates + 1


def test_one_call_serves_all_companies_of_a_slot(spark):
    """Batch by batch, the changed summaries of many companies, each once, and no others."""
    rng, threshold, state = np.random.default_rng(3), 3, Held()
    processor = stream.BucketSummaries(threshold, None)
    processor.init(state)
    log, known = [], {}
    for _ in range(5):
        n = 200
        part = pd.DataFrame({"company_id": rng.integers(0, 60, n), "at": rng.integers(0, 50, n), "seq": rng.integers(0, 9, n), "kind": rng.choice([0, 0, 0, 1, 2], n)})
        log.append(part)
        rows, changed = pd.concat(log).sort_values(["company_id", "at", "seq", "kind"]), {}
        for company, mine in rows.groupby("company_id"):
            summary = [a.to_pylist()[0] for a in streaks.summarise(np.zeros(1, np.int64), mine["at"].to_numpy(), mine["kind"].to_numpy(), threshold).arrays()]
            if known.get(company) != summary:
                known[company] = changed[company] = summary
        out = list(processor.handleInputRows((5, 7), iter([part[:90], part[90:]]), None))
        got = {r.company_id: [r.any_ok, r.head, list(r.head_at), r.tail, None if r.hit_at is pd.NA else r.hit_at] for f in out for r in f.itertuples()}
        assert got == changed and sum(map(len, out)) == len(changed) and all((f["bucket"] == 7).all() for f in out)
    # outcomes that change nothing are not written, and not kept beyond the first of a company
    assert list(processor.handleInputRows((5, 7), iter([part.assign(kind=0)]), None)) == [] and state.updates == 5


def test_state_has_a_key_per_slot_not_per_company(spark, tmp_path):
    rows = spark.range(3000).select(F.col("id").alias("company_id"), F.timestamp_seconds(F.lit(1_772_323_200) + F.col("id")).alias("ts"), F.lit(None).cast("long").alias("seq"), F.lit("404").alias("kind"))
    rows.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(LOG).parquet(str(tmp_path / "in"))
    query = stream.start_streaks(spark, source, "slotted", checkpoint=str(tmp_path / "ck"), threshold=1, slots=8)
    query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 8
    assert spark.table("slotted").where("streak = 1 AND disabled_at IS NOT NULL").count() == 3000
