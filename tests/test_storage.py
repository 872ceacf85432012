"""File sources, versioned tables, the cycle, the streams."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import companies as catalog
from tidemark.plans.cycle import CycleTables, run_cycle
from tidemark.session import shared_folder
from tidemark.sources import captures, sinks, tables, targets
from tidemark.streaming import snapshots as stream, streaks

DAY1, DAY2, DAY3 = (dt.datetime(2026, 3, d) for d in (1, 2, 3))
HEADER = "name,category,source_list,careers_url,source_type,source_config_json,priority,enabled\n"


def company(i, name, kind="lever", config=None, enabled=True):
    return (i, name, f"https://c{i}.com", kind, config or {}, enabled, None, None, 0, None, DAY1, DAY1)


# ---- files --------------------------------------------------------------------------------
def test_targets_file(spark, tmp_path):
    path = tmp_path / "targets.csv"
    path.write_text(HEADER + 'TestCo,d,l,https://b/t,GreenHouse,"{""board_token"": ""testco""}",1,true\n"Two\nLines",d,l,https://x,,,1,yes\n Apple ,d,l, https://a ,workable,,1,on\n')
    good, rejects = targets.split_targets(targets.parse_targets(targets.read_targets(spark, str(path))))
    rows = good.orderBy("line_number").collect()
    assert [(r.line_number, r.name, r.source_type) for r in rows] == [(2, "TestCo", "greenhouse"), (3, "Two\nLines", ""), (4, "Apple", "workable")]
    assert rows[0].source_config == {"board_token": "testco"} and rejects.count() == 0
    normal = catalog.normalize_targets(good).orderBy("ordinal").collect()
    assert [(r.source_type, r.enabled, r.last_error) for r in normal] == [("greenhouse", True, None)] + [("unconfigured", False, "Needs ATS/source config")] * 2


def test_records_across_many_splits(spark, tmp_path):
    """Splits that begin inside a quoted field, blank lines, and line ends of two kinds: the same records as from the csv module."""
    import csv
    import io
    import random

    rng, rows = random.Random(8), []
    for i in range(300):
        text = "".join(rng.choice(['a', '"', ',', '\n', '\n\n', ' ', 'long words ']) for _ in range(rng.randint(0, 30)))
        rows.append([f"n{i}", text, "l", f"https://x/{i}", "lever", "", "1", "yes"])
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([HEADER.strip().split(","), *rows])
    whole = out.getvalue().replace("https://x/7,lever,,1,yes\n", "https://x/7,lever,,1,yes\r\n\n  \n")
    (tmp_path / "targets.csv").write_bytes(whole.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        read = targets.read_targets(spark, str(tmp_path / "targets.csv"))
        got = read.orderBy("line_number").collect()
        splits = spark.read.text(str(tmp_path / "targets.csv")).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert splits > 20
    assert [(r.line_number, r.name, r.category or "", r.careers_url) for r in got] == [(k + 2, r[0], r[1], r[3]) for k, r in enumerate(rows)]


def test_bad_targets(spark, tmp_path):
    path = tmp_path / "targets.csv"
    path.write_text(HEADER + "A,d,l,https://a,,,1,true\nB,d,l,https://b,,{not json},1,true\n,d,l,https://c,,,1,true\n")
    parsed = targets.parse_targets(targets.read_targets(spark, str(path)))
    with pytest.raises(ValueError, match="line 3: invalid source_config_json"):
        targets.split_targets(parsed)
    good, rejects = targets.split_targets(parsed, "quarantine")
    assert good.count() == 1 and [r.row_error for r in rejects.orderBy("line_number").collect()] == ["line 3: invalid source_config_json", "line 4: name is required"]
    path.write_text("name,category\nA,b\n")
    with pytest.raises(ValueError, match="missing required columns: source_list"):
        targets.read_targets(spark, str(path))


def test_companies_json_and_upsert(spark, tmp_path):
    path = tmp_path / "companies.json"
    path.write_text(json.dumps([
        {"name": "A", "source_type": "lever", "source_config": {"company": "a"}, "enabled": False}, {"name": "A", "source_type": "lever", "source_config": {"company": "a2"}},
        {"name": "N", "source_type": "gem", "source_config": {"careers_url": "https://jobs.gem.com/n/x"}}, {"name": "O", "source_type": "lever", "source_config": {"company": "o"}}]))
    stored = spark.createDataFrame([company(5, "A"), company(6, "O", enabled=False), company(7, "O", "gem")], schemas.COMPANIES)
    rows = targets.read_companies_json(spark, str(path))
    after, tally = catalog.upsert_companies(stored, rows, F.lit(DAY2), set_error=False)
    got = {(r.name, r.source_type): r for r in after.collect()}
    assert (got["A", "lever"].id, got["A", "lever"].enabled, got["A", "lever"].source_config) == (5, False, {"company": "a2"})
    assert (got["N", "gem"].enabled, got["N", "gem"].careers_url, got["N", "gem"].id) == (True, "https://jobs.gem.com/n", 10)
    assert got["O", "lever"].enabled is False and got["O", "gem"].careers_url == "https://c7.com"
    assert tally.first()[:2] == (1, 3)
    path.write_text('{"name": "A"}')
    with pytest.raises(ValueError, match="JSON array"):
        targets.read_companies_json(spark, str(path))


def test_captures_round_trip_and_snapshots(spark, tmp_path):
    rows = [(1, "greenhouse", DAY1, "api", 0, "u", 404, "", ""), (2, "greenhouse", DAY1, "api", 0, "u", 200, "", "[]"), (3, "workday", DAY1, "api", 0, "u", 500, "", ""),
            (4, "lever", DAY1, "api", 0, "u", 200, "", "[]"), (4, "lever", DAY1, "api", 1, "u", 200, "", "<"), (5, "odd", DAY1, "api", 0, "u", 200, "", "{}")]
    captures.write_captures(spark.createDataFrame(rows, schemas.CAPTURES), str(tmp_path / "captures"))
    read = captures.read_captures(spark, str(tmp_path / "captures"))
    got = {r.company_id: (r.outcome, r.error) for r in captures.snapshots_from_captures(read).collect()}
    assert got == {1: ("failed", "Client error '404' for url 'u'"), 2: ("failed", "response is not a JSON object"), 3: ("ok", None), 4: ("failed", "response is not JSON"),
                   5: ("failed", "Unknown source_type: odd")}
    assert captures.snapshots_from_captures(read, ()).filter("company_id = 3").first().outcome == "failed"
    pruned = read.filter("source_type = 'lever'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source_type" in pruned


# ---- tables -------------------------------------------------------------------------------
def test_versions(spark):
    with pytest.raises(RuntimeError, match="does not exist"):
        tables.require_table(spark, "no_such")
    tables.write_version(spark.range(3), "numbers", "a", "id", 4)
    assert tables.applied_mark(spark, "numbers") == "a"
    bigger = tables.read_table(spark, "numbers").unionByName(spark.range(3, 5))
    staged = tables.stage_version(bigger, "numbers", "b", "id", 4)
    assert staged.count() == 5 and spark.table("numbers").count() == 3
    tables.publish_version(spark, "numbers", "b", ["id"])
    tables.drop_versions(spark, "numbers", ["b"])
    assert spark.table("numbers").count() == 5 and not spark.catalog.tableExists("numbers__a")
    # a merge on the bucket key reads the stored side without a shuffle
    joined = spark.table("numbers").join(spark.range(9).repartition(3), "id", "full_outer")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


def test_sinks(spark, tmp_path):
    doc = spark.createDataFrame([("s", "h", "t", "{}")], "subject string, html string, text string, metrics string")
    sinks.write_metrics(doc, str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m")).first().value == "{}"
    for day in ("2026-03-01", "2026-03-02", "2026-03-02"):
        sinks.write_digest(doc, str(tmp_path / "d"), day)
    assert spark.read.parquet(str(tmp_path / "d")).count() == 2
    jobs = spark.createDataFrame([(i, i % 2, "C", f"T{i}", "u", None, None) for i in range(6)],
                                 "id long, company_id long, company_name string, title string, url string, location string, posted_at timestamp")
    sinks.write_digest_fragments(jobs, str(tmp_path / "f"), "2026-03-01")
    assert spark.read.text(str(tmp_path / "f")).count() == 8


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


# ---- cycle --------------------------------------------------------------------------------
def lever_body(*keys):
    return json.dumps([{"id": k, "text": "Software Engineer I", "categories": {"location": "Austin, TX"}, "hostedUrl": f"https://l/{k}"} for k in keys])


def test_two_cycles(spark):
    names = CycleTables("cy_jobs", "cy_companies", "cy_postings", 4)
    tables.write_version(spark.createDataFrame([company(1, "A", config={"company": "a"}), company(2, "B", config={"company": "b"}), company(3, "Off", enabled=False)], schemas.COMPANIES), names.companies, "start")
    tables.write_version(spark.createDataFrame([], schemas.JOBS), names.jobs, "start", "fingerprint_hash", 4)

    def captured(cycle, bodies):
        return spark.createDataFrame([(i, "lever", cycle, "api", 0, "https://l", s, "", b) for i, s, b in bodies], schemas.CAPTURES)

    first = run_cycle(spark, captured(DAY1, [(1, 200, lever_body(1, 2)), (2, 200, lever_body(5)), (3, 200, lever_body(9))]), "c1", F.lit(DAY1), names=names, digest_day="2026-02-28")
    assert first.jobs.filter("is_active").count() == 3
    assert json.loads(first.metrics.first().metrics)["new_entry_level_swe_jobs_created"] == 3
    assert first.digest.first().text.count("- Software Engineer I") == 3
    again = run_cycle(spark, captured(DAY2, [(1, 200, lever_body(2, 3)), (2, 404, "")]), "c2", F.lit(DAY2), names=names)
    state = {int(r.external_job_id): (r.is_active, r.first_seen_at, r.last_seen_at) for r in again.jobs.collect()}
    assert state == {1: (False, DAY1, DAY2), 2: (True, DAY1, DAY2), 3: (True, DAY2, DAY2), 5: (True, DAY1, DAY1)}
    doc = json.loads(again.metrics.first().metrics)
    assert (doc["inactive_jobs_marked"], doc["companies_scanned"], doc["scraper_failure_count"]) == (1, 1, 1)
    after = {r.id: (r.enabled, r.consecutive_failures) for r in again.companies.collect()}
    assert after == {1: (True, 0), 2: (True, 1), 3: (False, 0)}
    # the same mark again changes nothing
    repeat = run_cycle(spark, captured(DAY2, [(1, 200, lever_body(2, 3)), (2, 404, "")]), "c2", F.lit(DAY2), names=names)
    assert {r.id: r.consecutive_failures for r in repeat.companies.collect()} == {1: 0, 2: 1, 3: 0}
    assert json.loads(repeat.metrics.first().metrics) == doc


# ---- streams ------------------------------------------------------------------------------
def posted(spark, rows):
    """rows of (company, cycle, ordinal or None, key)"""
    made = [(c, at, o, "x", "lever", str(k), "Software Engineer I", None, "Austin, TX", None, None, f"https://l/{k}", None, None, "{}", "ok", None) for c, at, o, k in rows]
    return spark.createDataFrame(made, f"{schemas.POSTINGS}, outcome string, error string")


def test_streamed_snapshots(spark, tmp_path):
    names = CycleTables("st_jobs", "st_companies", buckets=4)
    tables.write_version(spark.createDataFrame([company(1, "A"), company(2, "B")], schemas.COMPANIES), names.companies, "start")
    tables.write_version(spark.createDataFrame([], schemas.JOBS), names.jobs, "start", "fingerprint_hash", 4)
    folder, late = str(tmp_path / "in"), []

    def run():
        source = stream.read_posting_stream(spark, folder)
        stream.start_ingest(spark, source, names, "st_applied", checkpoint=str(tmp_path / "ck"), on_late=lambda b, n: late.append(n)).awaitTermination()
        return {int(r.external_job_id): (r.is_active, r.first_seen_at, r.last_seen_at) for r in spark.table("st_jobs").collect()}

    posted(spark, [(1, DAY1, 0, 1), (1, DAY1, 1, 2), (2, DAY1, 0, 7), (1, DAY2, 0, 2), (2, DAY2, None, 0)]).write.mode("append").parquet(folder)
    assert run() == {1: (False, DAY1, DAY2), 2: (True, DAY1, DAY2), 7: (False, DAY1, DAY2)}
    assert run() == {1: (False, DAY1, DAY2), 2: (True, DAY1, DAY2), 7: (False, DAY1, DAY2)}
    posted(spark, [(1, DAY1, 0, 9), (2, DAY3, 0, 7)]).write.mode("append").parquet(folder)
    assert run() == {1: (False, DAY1, DAY2), 2: (True, DAY1, DAY2), 7: (True, DAY1, DAY3)} and late == [1]
    # both cycles of the first batch were one write, and what came late is stored
    assert sorted(r.tableName for r in spark.sql("SHOW TABLES LIKE 'st_jobs__*'").collect()) == ["st_jobs__b0", "st_jobs__b1"]
    assert [(r.company_id, r.cycle_ts, r.last_cycle) for r in spark.table("st_applied_late__b1").collect()] == [(1, DAY1, DAY2)]
    # a batch that is delivered again is not applied again
    assert stream.ingest_batch(spark, posted(spark, [(1, DAY3, None, 0)]), 1, names, "st_applied") == 0
    assert spark.table("st_jobs").filter("is_active").count() == 2


def test_streamed_streaks(spark, tmp_path):
    folder, events = str(tmp_path / "in"), str(tmp_path / "events")
    schema = "company_id long, ts timestamp, seq long, kind string"

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        source = spark.readStream.schema(schema).parquet(folder)
        streaks.start_streaks(spark, source, "st_streaks", events, checkpoint=str(tmp_path / "ck")).awaitTermination()
        return {r.company_id: (r.streak, r.disabled_at) for r in spark.table("st_streaks").collect()}

    assert run([(1, DAY1, 0, "404"), (2, DAY1, 0, "404"), (3, DAY1, 0, "404"), (3, DAY2, 1, "404")]) == {1: (1, None), 2: (1, None), 3: (2, DAY2)}
    assert run([(1, DAY2, 1, "other"), (1, DAY3, 2, "404"), (2, DAY2, 1, "ok"), (2, DAY3, 2, "404"), (3, DAY3, 2, "ok")]) == {1: (2, DAY3), 2: (1, None), 3: (2, DAY2)}
    assert sorted((r.batch_id, r.company_id) for r in spark.read.parquet(events).collect()) == [(0, 3), (1, 1)]
