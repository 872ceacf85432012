"""What a merge must keep true of random snapshots, and literal scenarios."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import ingest

OLD, NOW = dt.datetime(2026, 1, 1), dt.datetime(2026, 2, 1)
# location, kept by the filter?
PLACES = [("Austin, TX", True), ("London, UK", False), ("Remote", True)]
# title, description, is software, is entry level
TEXTS = [("Software Engineer I", None, True, True), ("Senior Software Engineer", None, True, False), ("Cook", "campus hire", False, True), ("Cook", None, False, False)]


def company_rows(names):
    return [(i, name, "u", "greenhouse", {}, True, None, None, 0, None, OLD, OLD) for i, name in names.items()]


def posting(company, ordinal, key, text, place, day):
    title, description = TEXTS[text][:2]
    return (company, NOW, ordinal, "payload name", "greenhouse", str(key), title, None, PLACES[place][0], None, None, f"http://p/{key}", description,
            dt.datetime(2026, 1, 1 + day), "{}")


@pytest.mark.parametrize("seed,us_only", [(1, True), (2, True), (3, False), (4, True)])
def test_merge_invariants(spark, seed, us_only):
    rng = random.Random(seed)
    # companies 1 to 6 share two names, so that fingerprints cross companies in both directions
    names = {i: ["Acme", "Globex"][i % 2] for i in range(1, 7)}
    outcomes = {i: rng.choice(["ok", "ok", "failed"]) for i in names}
    empty = rng.choice([i for i, o in outcomes.items() if o == "ok"])
    postings = [
        posting(rng.choice([i for i in names if i != empty]), n, rng.randint(1, 12), rng.randint(0, 3), rng.randint(0, 2), rng.randint(0, 20)) for n in range(140)
    ]
    owners = spark.createDataFrame(company_rows(names), schemas.COMPANIES)
    state = []
    for n in range(60):
        company, key, text, place = rng.choice(list(names)), rng.randint(1, 14), rng.randint(0, 3), rng.randint(0, 2)
        fp = (names[company].lower(), TEXTS[text][0].lower(), PLACES[place][0].lower(), key)
        if fp not in {s["fp"] for s in state}:
            state.append({"fp": fp, "company": company, "first": OLD, "last": OLD, "active": rng.random() < 0.7, "description": TEXTS[text][1], "posted": None,
                          "software": False, "entry": False, "id": 100 + n, "text": text, "place": place})
    from tidemark.functions.text import fingerprint

    raw = spark.createDataFrame(
        [(s["id"], s["company"], names[s["company"]], TEXTS[s["text"]][0], PLACES[s["place"]][0], str(s["fp"][3]), s["description"], s["active"]) for s in state],
        "id long, company_id long, name string, title string, location string, external_job_id string, description_text string, is_active boolean")
    given = raw.withColumn("url", F.concat(F.lit("http://p/"), "external_job_id"))
    given = given.withColumn("fingerprint_hash", fingerprint(*[F.col(c) for c in ("name", "title", "location", "url", "external_job_id")]))
    fixed = {"source_type": F.lit("greenhouse"), "raw_payload": F.lit("{}"), "first_seen_at": F.lit(OLD), "last_seen_at": F.lit(OLD), "created_at": F.lit(OLD),
             "updated_at": F.lit(OLD), "entry_level_score": F.lit(0.0), "is_entry_level": F.lit(False), "is_software_engineering_related": F.lit(False)}
    jobs = given.select(*[(fixed[c] if c in fixed else F.col(c) if c in given.columns else F.lit(None)).cast(t).alias(c)
                          for c, t in (f.split() for f in schemas.JOBS.split(", "))])
    snapshots = spark.createDataFrame([(i, NOW, o, None) for i, o in outcomes.items()], schemas.SNAPSHOTS)
    batch = spark.createDataFrame(postings, schemas.POSTINGS)

    def key_of(p):
        return (names[p[0]].lower(), p[6].lower(), p[8].lower(), int(p[5]))

    scanned = [p for p in postings if outcomes[p[0]] == "ok"]
    kept = [p for p in scanned if not us_only or dict(PLACES)[p[8]]]
    by = {}
    for p in kept:
        by.setdefault(key_of(p), set()).add(p[0])
    held = {s["fp"]: s for s in state}

    merged = ingest.merge_snapshots(jobs, owners, snapshots, batch, us_only).cache()
    got = merged.collect()
    rows = {(names[r.company_id].lower(), r.title.lower(), r.location.lower(), int(r.external_job_id)): r for r in got}
    assert len(got) == len({r.id for r in got}) == len({r.fingerprint_hash for r in got}) == len(rows)
    assert rows.keys() == held.keys() | by.keys()
    for key, r in rows.items():
        old, posters = held.get(key), by.get(key, set())
        # a stored job keeps its id, owner and first day; a new one belongs to its first poster
        assert r.company_id == (old["company"] if old else min(posters))
        assert r.first_seen_at == (OLD if old else NOW)
        assert r.id == old["id"] if old else r.id > max(s["id"] for s in state)
        if r.company_id in posters and max(posters) == r.company_id:
            assert r.is_active and r.last_seen_at == NOW
        if posters:
            software, entry = next(t[2:] for t in TEXTS if t[0] == r.title and t[1] == r.description_text)
            assert r.last_seen_at == NOW and (r.is_software_engineering_related, r.is_entry_level) == (software, entry)
        elif outcomes[r.company_id] == "ok":
            assert not r.is_active and r.last_seen_at == (NOW if old["active"] else OLD)
        else:
            assert (r.is_active, r.last_seen_at) == (old["active"], OLD)
    inserted = sorted((r for r in got if r.change == "inserted"), key=lambda r: r.id)
    assert [r.company_id for r in inserted] == sorted(r.company_id for r in inserted)
    counters = {r.company_id: r for r in ingest.ingest_counters(merged, owners, snapshots, batch, us_only).collect()}
    assert {c: counters[c].jobs_seen_total for c, o in outcomes.items() if o == "ok"} == {c: sum(p[0] == c for p in scanned) for c, o in outcomes.items() if o == "ok"}
    assert sum(counters[c].jobs_inserted_total for c, o in outcomes.items() if o == "ok") == len(by.keys() - held.keys())
    assert sum(counters[c].jobs_skipped_international for c, o in outcomes.items() if o == "ok") == len(scanned) - len(kept)
    total = ingest.total_counters(ingest.ingest_counters(merged, owners, snapshots, batch, us_only)).filter("company_id is null").first()
    assert all(total[c] == sum(r[c] for r in counters.values()) for c in ingest.COUNTERS)
    merged.unpersist()


def test_a_job_of_another_company_of_the_same_name(spark):
    """Company 1 owns the job; what company 2 posts reopens it, since 2 comes later."""
    owners = spark.createDataFrame(company_rows({1: "Acme", 2: "Acme"}), schemas.COMPANIES)
    shots = spark.createDataFrame([(1, NOW, "ok", None), (2, NOW, "ok", None)], schemas.SNAPSHOTS)
    first = ingest.merge_snapshots(spark.createDataFrame([], schemas.JOBS), owners, shots, spark.createDataFrame([posting(1, 0, 7, 0, 0, 0)], schemas.POSTINGS))
    jobs = first.select(*(f.split()[0] for f in schemas.JOBS.split(", ")))
    later = ingest.merge_snapshots(jobs, owners, shots, spark.createDataFrame([posting(2, 0, 7, 0, 0, 0)], schemas.POSTINGS)).collect()
    gone = ingest.merge_snapshots(jobs, owners, shots, spark.createDataFrame([], schemas.POSTINGS)).collect()
    assert [(r.company_id, r.is_active) for r in later] == [(1, True)] and [(r.company_id, r.is_active) for r in gone] == [(1, False)]


@pytest.mark.parametrize("small", [True, False])
def test_running_offsets(spark, small):
    rng = random.Random(5)
    counts = {rng.randint(1, 10**6): rng.randint(0, 9) for _ in range(500)}
    got = ingest.running_offsets(spark.createDataFrame(list(counts.items()), "k long, n long"), "k", "n", small, span=1000).collect()
    assert {r.k: r.offset for r in got} == {k: sum(v for j, v in counts.items() if j < k) for k in counts}


def test_violations_fail_the_snapshot(spark):
    rows = [posting(1, 0, 1, 0, 0, 0), posting(2, 0, 1, 0, 0, 0), posting(3, 2**24 - 1, 1, 0, 0, 0), posting(4, 0, 1, 0, 0, 0)]
    batch = spark.createDataFrame(rows, schemas.POSTINGS).withColumn("title", F.when(F.col("company_id") == 2, F.repeat(F.lit("x"), 1025)).otherwise(F.col("title")))
    batch = batch.withColumn("type_errors", F.when(F.col("company_id") == 4, F.array(F.lit("location"))).otherwise(F.array().cast("array<string>")))
    shots = spark.createDataFrame([(i, NOW, "ok", None) for i in range(1, 6)], schemas.SNAPSHOTS)
    got = {r.company_id: (r.outcome, r.error) for r in ingest.validate_postings(batch, shots).collect()}
    assert got == {1: ("ok", None), 2: ("failed", "invalid posting: title: longer than 1024"), 3: ("failed", "invalid posting: page: too many postings"),
                   4: ("failed", "invalid posting: location: wrong type"), 5: ("ok", None)}


def test_merge_plan_shuffles_by_fingerprint_only_and_not_the_stored_state(spark):
    from tidemark.sources import tables

    tables.write_version(spark.createDataFrame([], schemas.JOBS), "plan_jobs", "start", "fingerprint_hash", 4)
    rest = [spark.createDataFrame([], s) for s in (schemas.COMPANIES, schemas.SNAPSHOTS, schemas.POSTINGS)]
    merged = ingest.merge_snapshots(spark.table("plan_jobs"), *rest)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    lines = plan.splitlines()
    joins = [line for line in lines if "SortMergeJoin" in line]
    assert any("FullOuter" in line and "fingerprint_hash" in line for line in joins)
    assert sum("Exchange hashpartitioning(fingerprint_hash" in line for line in lines) == 1
    assert "Bucketed: true" in plan


def test_company_frames_beyond_the_checked_size_give_the_same_result(spark, monkeypatch):
    owners = spark.createDataFrame(company_rows({1: "A", 2: "B"}), schemas.COMPANIES)
    shots = spark.createDataFrame([(1, NOW, "ok", None), (2, NOW, "ok", None)], schemas.SNAPSHOTS)
    batch = spark.createDataFrame([posting(1 + n % 2, n, n % 5, 0, 0, 0) for n in range(20)], schemas.POSTINGS)
    jobs = spark.createDataFrame([], schemas.JOBS)
    small = sorted(map(str, ingest.merge_snapshots(jobs, owners, shots, batch).collect()))
    monkeypatch.setattr(ingest, "is_small", lambda df: False)
    assert sorted(map(str, ingest.merge_snapshots(jobs, owners, shots, batch).collect())) == small


@pytest.mark.parametrize("seed,us_only", [(11, True)])
def test_many_cycles_at_once_equal_the_loop(spark, seed, us_only):
    """Several cycles, companies that share names, cycles without posts, failed and empty scans: one pass gives what a pass per cycle gives."""
    from tidemark.operators.replay import merge_cycles

    rng = random.Random(seed)
    names = {i: ["Acme", "Globex"][i % 2] for i in range(1, 6)}
    owners = spark.createDataFrame(company_rows(names), schemas.COMPANIES)
    cycles = [NOW + dt.timedelta(hours=h) for h in range(6)]
    shots, rows = [], []
    for cycle in cycles:
        for company in rng.sample(list(names), rng.randint(0, 4)):
            shots.append((company, cycle, rng.choice(["ok", "ok", "ok", "failed"]), None))
            for n in range(rng.choice([0, 2, 5])):
                p = posting(company, n, rng.randint(1, 9), rng.randint(0, 3), rng.randint(0, 2), rng.randint(0, 20))
                rows.append((p[0], cycle, *p[2:]))
    snapshots, batch = spark.createDataFrame(shots, schemas.SNAPSHOTS), spark.createDataFrame(rows, schemas.POSTINGS)
    start = ingest.merge_snapshots(
        spark.createDataFrame([], schemas.JOBS), owners, spark.createDataFrame([(i, OLD, "ok", None) for i in names], schemas.SNAPSHOTS),
        spark.createDataFrame([(c, OLD, *posting(c, c, c, 0, 0, 0)[2:]) for c in names], schemas.POSTINGS),
    ).select(schemas.JOB_COLUMNS)
    start = spark.createDataFrame(start.collect(), schemas.JOBS)
    looped = start
    for cycle in cycles:
        of_cycle = [r for r in rows if r[1] == cycle]
        looped = ingest.merge_snapshots(
            looped, owners, spark.createDataFrame([s for s in shots if s[1] == cycle], schemas.SNAPSHOTS), spark.createDataFrame(of_cycle, schemas.POSTINGS), us_only
        ).select(schemas.JOB_COLUMNS)
        looped = spark.createDataFrame(looped.collect(), schemas.JOBS)
    at_once = merge_cycles(start, owners, snapshots, batch, us_only).collect()
    rest = [c for c in schemas.JOB_COLUMNS if c != "id"]
    shown = lambda r: tuple(str(r[c]) for c in rest)
    assert sorted(map(shown, at_once)) == sorted(map(shown, looped.collect()))
    known = {r.fingerprint_hash: r.id for r in start.collect()}
    assert len({r.id for r in at_once}) == len(at_once) and all(known.get(r.fingerprint_hash, r.id) == r.id for r in at_once)
    new = sorted((r for r in at_once if r.fingerprint_hash not in known), key=lambda r: r.id)
    assert [r.first_seen_at for r in new] == sorted(r.first_seen_at for r in new) and min(r.id for r in new) > max(known.values())
    assert {r.is_active for r in at_once} == {True, False}
