"""State tables of which a cycle rewrites the touched parts only."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import ingest
from tidemark.plans.cycle import CycleTables, apply_snapshots
from tidemark.schemas import JOB_COLUMNS
from tidemark.sources import parts, tables

DAY = dt.datetime(2026, 3, 1)


def snapshot(spark, cycle, posted):
    """posted: company -> keys of its postings (None: a failed snapshot)."""
    at = DAY + dt.timedelta(days=cycle)
    states = [(c, at, "failed" if keys is None else "ok", None) for c, keys in posted.items()]
    rows = [(c, at, i, None, "lever", str(k), f"Software Engineer {k}", None, "Austin, TX", None, None, f"https://l/{k}", None, None, "{}")
            for c, keys in posted.items() for i, k in enumerate(keys or [])]
    return spark.createDataFrame(states, schemas.SNAPSHOTS), spark.createDataFrame(rows, schemas.POSTINGS)


def state_tables(spark, prefix, n_companies, n_parts, name=lambda i: f"C{i}"):
    names = CycleTables(f"{prefix}_jobs", f"{prefix}_companies", f"{prefix}_postings", 2, n_parts)
    rows = [(i, name(i), "https://c", "lever", {}, True, None, None, 0, None, DAY, DAY) for i in range(1, n_companies + 1)]
    tables.write_version(spark.createDataFrame(rows, schemas.COMPANIES), names.companies, "start")
    tables.write_version(spark.createDataFrame([], schemas.JOBS), names.jobs, "start", "fingerprint_hash", 2)
    return names


def rows_of(df):
    return sorted(map(tuple, df.select(JOB_COLUMNS).collect()), key=lambda r: r[0])


def test_a_cycle_of_one_company_writes_one_part(spark):
    names = state_tables(spark, "one", 100, 16)
    snapshots, postings = snapshot(spark, 1, {c: range(c * 10, c * 10 + 5) for c in range(1, 101)})
    apply_snapshots(spark, names, "c1", snapshots, postings, False).collect()
    files = lambda: {f for f in spark.table("one_jobs").inputFiles()}
    first = files()
    assert len(parts.held_parts(spark, "one_jobs", 16)["c1"]) == 16 and spark.table("one_jobs").count() == 500
    snapshots, postings = snapshot(spark, 2, {7: [70, 71, 79]})
    counters = apply_snapshots(spark, names, "c2", snapshots, postings, False).collect()
    assert [(r.company_id, r.jobs_seen_total, r.jobs_inserted_total, r.inactive_jobs_marked) for r in counters] == [(7, 3, 1, 3)]
    part = spark.range(7, 8).select(parts.part_of(F.col("id"), 16)).first()[0]
    assert parts.held_parts(spark, "one_jobs")["c2"] == [part]
    # other files are the same ones, and few were written
    new = files() - first
    assert 1 <= len(new) <= 2 and all(f"/written=c2/part={part}/" in f for f in new)
    assert {f for f in first if f"/part={part}/" not in f} == files() - new
    state = {int(r.external_job_id): r.is_active for r in spark.table("one_jobs").where("company_id = 7").collect()}
    assert state == {70: True, 71: True, 72: False, 73: False, 74: False, 79: True} and spark.table("one_jobs").count() == 501
    # parts are read in place, and a part's files only
    read = parts.read_parts(spark, "one_jobs", parts.held_parts(spark, "one_jobs"), [part])
    joined = read.join(spark.range(9).select(F.col("id").cast("string").alias("fingerprint_hash")), "fingerprint_hash", "full_outer")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and len(read.inputFiles()) <= 2


@pytest.mark.parametrize("seed", [1])
def test_same_rows_as_the_whole_merge(spark, seed):
    """Cycles of random companies, some of which share their names and so their fingerprints."""
    rng, prefix = random.Random(seed), f"rnd{seed}"
    names = state_tables(spark, prefix, 12, 4, name=lambda i: f"C{i % 5}")
    companies = spark.table(names.companies)
    plain = spark.createDataFrame([], schemas.JOBS)
    for cycle in range(1, 4):
        chosen = rng.sample(range(1, 13), (12, 3, 5)[cycle - 1])
        posted = {c: None if rng.random() < 0.1 else [rng.randrange(6) for _ in range(rng.randrange(4))] for c in chosen}
        snapshots, postings = snapshot(spark, cycle, posted)
        merged = ingest.merge_snapshots(plain, companies, snapshots, postings, False)
        expected = ingest.ingest_counters(merged, companies, snapshots, postings, False)
        counters = apply_snapshots(spark, names, f"c{cycle}", snapshots, postings, False)
        assert sorted(map(tuple, counters.collect())) == sorted(map(tuple, expected.collect()))
        rows = rows_of(merged)
        assert rows_of(spark.table(names.jobs)) == rows
        plain = spark.createDataFrame(rows, schemas.JOBS)


def test_lost_and_repeated_writes(spark):
    names = state_tables(spark, "again", 6, 4)
    for cycle, posted in ((1, {c: [c] for c in range(1, 7)}), (2, {1: [1, 9]})):
        before = parts.held_parts(spark, "again_jobs")
        apply_snapshots(spark, names, f"c{cycle}", *snapshot(spark, cycle, posted), False)
    whole = rows_of(spark.table("again_jobs"))
    # a write that was stored but never published leaves readers alone and is replaced by its repeat
    lost = parts.read_written(spark, "again_jobs", "c1").drop("written")
    parts.stage_parts(lost, "again_jobs", "c3", "fingerprint_hash", 2)
    assert rows_of(spark.table("again_jobs")) == whole
    apply_snapshots(spark, names, "c3", *snapshot(spark, 3, {2: [2]}), False)
    assert spark.table("again_jobs").count() == len(whole) and parts.read_written(spark, "again_jobs", "c3").count() < len(whole)
    # the same mark again changes nothing
    after = rows_of(spark.table("again_jobs"))
    apply_snapshots(spark, names, "c3", *snapshot(spark, 3, {2: []}), False)
    assert rows_of(spark.table("again_jobs")) == after
    # what neither version holds is dropped; the version before can still be read
    held = parts.held_parts(spark, "again_jobs")
    parts.drop_parts(spark, "again_jobs", [before, held])
    assert len(rows_of(parts.read_parts(spark, "again_jobs", before))) == 6 and rows_of(spark.table("again_jobs")) == after
    parts.drop_parts(spark, "again_jobs", [held])
    assert {m for m, _ in parts._stored(spark, "again_jobs_parts")} == set(held) and rows_of(spark.table("again_jobs")) == after


def test_empty_cycle_and_other_layouts(spark):
    names = state_tables(spark, "lay", 3, 4)
    apply_snapshots(spark, names, "c1", *snapshot(spark, 1, {1: [1], 2: [2]}), False)
    # a cycle that changes nothing writes nothing and is still applied
    counters = apply_snapshots(spark, names, "c2", *snapshot(spark, 2, {3: None}), False)
    assert counters.count() == 0 and tables.applied_mark(spark, "lay_jobs") == "c2"
    assert list(parts.held_parts(spark, "lay_jobs")) == ["c1"] and spark.table("lay_jobs").count() == 2
    # another number of parts: rewritten whole
    more = CycleTables(names.jobs, names.companies, names.postings, 2, 8)
    apply_snapshots(spark, more, "c3", *snapshot(spark, 3, {1: []}), False)
    assert list(parts.held_parts(spark, "lay_jobs", 8)) == ["c3"] and parts.held_parts(spark, "lay_jobs", 4) is None
    assert {int(r.external_job_id): r.is_active for r in spark.table("lay_jobs").collect()} == {1: False, 2: True}


def test_a_merge_of_many_rows_is_dealt_to_more_tasks_than_buckets(spark, monkeypatch):
    """With 200 rows in 2 buckets and 25 rows to a task, each file holds a task's share of one bucket, in both cycles."""
    plain = spark.createDataFrame([], schemas.JOBS)
    monkeypatch.setattr(ingest, "TASK_ROWS", 25)
    names = state_tables(spark, "many", 20, 1)
    companies = spark.table(names.companies)
    for cycle, posted in ((1, {c: range(c * 10, c * 10 + 10) for c in range(1, 21)}), (2, {3: [30, 39, 500], 4: []})):
        snapshots, postings = snapshot(spark, cycle, posted)
        plain = spark.createDataFrame(ingest.merge_snapshots(plain, companies, snapshots, postings, False).select(JOB_COLUMNS).collect(), schemas.JOBS)
        apply_snapshots(spark, names, f"c{cycle}", snapshots, postings, False).collect()
        by_key = lambda df: {r.fingerprint_hash: (r.company_id, r.is_active, r.first_seen_at, r.last_seen_at) for r in df.collect()}
        assert by_key(spark.table("many_jobs")) == by_key(plain)
        stored = spark.table("many_jobs").select(F.input_file_name().alias("file"), F.pmod(F.hash("fingerprint_hash"), F.lit(2)).alias("bucket"))
        files = stored.groupBy("file").agg(F.count("*").alias("n"), F.countDistinct("bucket").alias("buckets")).collect()
        assert len(files) > 4 and max(r.n for r in files) <= 50 and {r.buckets for r in files} == {1}


def test_tasks_of_a_merge():
    """Buckets that a task can take stay as they lie; else tasks are a multiple of the buckets and follow the rows."""
    assert ingest.merge_tasks(4 * ingest.TASK_ROWS, 4, 24) is None
    assert [ingest.merge_tasks(n * ingest.TASK_ROWS, 4, 24) for n in (5, 40, 400)] == [24, 40, 400]
    assert ingest.merge_tasks(5 * ingest.TASK_ROWS, 4, 10) == 12
