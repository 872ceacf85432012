"""Company catalog, discovery, job links, digest and metrics."""

import datetime as dt
import json

import random

import pytest
from pyspark.sql import functions as F

from tidemark import rules, schemas

from tidemark.operators import companies as catalog, streaks as failure_fold, digest, discovery, metrics

NOW = dt.datetime(2026, 3, 1)


def companies(spark, rows):
    """rows of (id, name, source_type, config, enabled, failures)"""
    return spark.createDataFrame([(i, n, "https://c.com", t, c, e, None, None, f, None, NOW, NOW) for i, n, t, c, e, f in rows], schemas.COMPANIES)


# ---- discovery ----------------------------------------------------------------------------
def candidates(spark, html, url):
    pages = spark.createDataFrame([(1, 0, url, html)], "company_id long, page_ordinal int, page_url string, body string")
    return discovery.signature_candidates(pages)


@pytest.mark.parametrize("html,url,source_type,config", [
    ('<a href="https://boards.greenhouse.io/acme">Jobs</a>', "https://acme.com/careers", "greenhouse", {"board_token": "acme"}),
    ("https://jobs.lever.co/netflix/apply", "https://netflix.com/jobs", "lever", {"company": "netflix"}),
    ("Apply at https://boards.greenhouse.io/acme/jobs/123", "https://acme.com/careers", "greenhouse", {"board_token": "acme"}),
    ('<a href="https://jobs.gem.com/bilt/4509720004">Jobs</a>', "https://www.bilt.com/careers", "gem", {"careers_url": "https://jobs.gem.com/bilt"}),
    ("x", "https://boards.eu.greenhouse.io/zed/jobs", "greenhouse", {"board_token": "zed"}),
    ("https://X.wd1.MyWorkdayJobs.com/en-US/S/login", "https://x.com", "workday", {"careers_url": "https://X.wd1.MyWorkdayJobs.com/en-US/S"}),
    ('<a href="https://c.icims.com/jobs/search?x=1">', "https://x.com", "icims", {"careers_url": "https://c.icims.com/jobs/search"}),
])
def test_signatures(spark, html, url, source_type, config):
    best = discovery.best_candidates(candidates(spark, html, url)).collect()
    assert [(b.source_type, b.source_config) for b in best] == [(source_type, config)]


def test_unsupported_and_unknown(spark):
    oracle = candidates(spark, "https://e.fa.us2.oraclecloud.com/hcmUI/CandidateExperience/x https://t.taleo.net/a", "https://e.com")
    landings = spark.createDataFrame([(1, "https://e.com", None), (2, "https://f.com", None), (3, "https://g.com", "403")], "company_id long, landing_url string, fetch_error string")
    got = {r.company_id: r for r in discovery.discovery_results(landings, discovery.best_candidates(oracle)).collect()}
    assert got[1].bucket == "detected_unsupported" and got[1].source_type == "oracle" and got[1].reason.startswith("Oracle Cloud HCM: https://e.fa")
    assert (got[2].bucket, got[2].reason, got[2].confidence) == ("still_unknown", "No supported ATS pattern detected", "none")
    assert (got[3].bucket, got[3].reason) == ("errors", "Failed to fetch careers landing page: 403")


def test_candidate_links(evaluate):
    page = """<a href="/about">About</a><a href="https://careers.intuit.com/us/en/search-jobs#x">Search jobs</a><a href="https://careers-intuit.icims.com/jobs/search">i</a>
      <iframe title="x" src="https://boards.greenhouse.io/embed"></iframe><a href="ftp://x/jobs">f</a><a href="https://else.org/x">n</a>"""
    got = evaluate([(page,)], "h string", discovery.candidate_links(F.col("h"), F.lit("https://www.intuit.com/careers/")))[0]
    assert [(g.score, g.url) for g in got] == [
        (35, "https://boards.greenhouse.io/embed"), (35, "https://careers-intuit.icims.com/jobs/search"),
        (15, "https://careers.intuit.com/us/en/search-jobs"), (8, "https://www.intuit.com/about")]


# ---- job links ----------------------------------------------------------------------------
def test_job_link_tests(evaluate):
    cases = [("https://careers.example.com/jobs/123-engineer", "Software Engineer", True, 42), ("https://example.com/careers/openings", "View openings", True, 14),
             ("https://careers.example.com/login", "Sign in", False, -1), ("https://careers.example.com/benefits", "Benefits", False, -1),
             ("https://careers.example.com/blog/post", "Blog", False, -1), ("https://e.com/associate/job", "x", False, -1), ("https://e.com/about", "About", False, -1),
             ("https://e.com/jobs/1", "Apply to this job", False, -1), ("https://e.com/jobs/1", "Apply to this very interesting job", True, 34), ("mailto:jobs@e.com", "jobs", False, -1)]
    schema = "u string, t string"
    assert evaluate([c[:2] for c in cases], schema, discovery.is_job_link(F.col("u"), F.col("t"))) == [c[2] for c in cases]
    assert evaluate([c[:2] for c in cases], schema, discovery.job_link_score(F.col("u"), F.col("t"))) == [c[3] for c in cases]


def merged_links(spark, anchors, cap):
    rows = [(1, NOW, page, "https://c.com/", i, f"https://c.com/jobs/{key}", title, place, 0) for page, i, key, title, place in anchors]
    got = discovery.job_links(spark.createDataFrame(rows, schemas.ANCHORS), cap).orderBy("rank").collect()
    return [(r.url.rsplit("/", 1)[1], r.title, r.location) for r in got]


def test_links_of_a_page_keep_the_longest_title(spark):
    anchors = [(0, 0, 5, "Job a", "A"), (0, 1, 6, "Job b", None), (0, 2, 5, "Job abc", "B"), (0, 3, 6, "Job c", "C")]
    assert merged_links(spark, anchors, 200) == [("5", "Job abc", "B"), ("6", "Job b", None)]


def test_links_stop_at_the_cap(spark):
    anchors = [(0, 0, 5, "Job a", "A"), (0, 1, 6, "Job b", "B"), (0, 2, 5, "Job longer", "C"), (1, 0, 7, "Job d", None)]
    assert merged_links(spark, anchors, 2) == [("5", "Job a", "A"), ("6", "Job b", "B")]
    assert merged_links(spark, anchors, 1) == [("5", "Job a", "A")]
    assert merged_links(spark, anchors, 3) == [("5", "Job longer", "C"), ("6", "Job b", "B"), ("7", "Job d", None)]
    assert merged_links(spark, anchors, None) == merged_links(spark, anchors, 3)


def test_links_of_later_pages_update_and_follow(spark):
    anchors = [(0, 0, 5, "Job a", "A"), (1, 0, 6, "Job b", "B"), (1, 1, 5, "Job abcd", None), (2, 0, 5, "Job wxyz", "Z")]
    assert merged_links(spark, anchors, 200) == [("5", "Job abcd", None), ("6", "Job b", "B")]


def test_next_pages(spark):
    urls = ["https://a.com/careers/jobs?x=1", "https://a.com/careers/jobs?x=2", "https://a.com/about", "https://a.com/careers", "https://b.com/jobs", "https://a.com/jobs/login", "https://a.com/search"]
    links = spark.createDataFrame([(1, 0, "https://a.com/careers", "https://a.com/careers", i, u) for i, u in enumerate(urls)],
                                  "company_id long, page_ordinal int, page_url string, landing_url string, pos int, url string")
    got = discovery.next_pages(links).orderBy("rank").collect()
    assert [(r.url, r.score) for r in got] == [("https://a.com/careers", 45), ("https://a.com/careers/jobs?x=1", 25), ("https://a.com/search", 15)]
    visited = spark.createDataFrame([(1, "https://a.com/careers")], "company_id long, url string")
    assert [r.url for r in discovery.next_pages(links, visited).orderBy("rank").collect()] == ["https://a.com/careers/jobs?x=1", "https://a.com/search"]


# ---- probes and outcomes ------------------------------------------------------------------
PROBE_CASES = [
    ("greenhouse", {"board_token": "stripe"}, 200, "{}", True, ""), ("greenhouse", {"board_token": "x"}, 404, "", False, "HTTP 404"),
    ("lever", {"company": "netflix"}, 200, "[]", True, ""), ("ashby", {"organization": "a"}, 403, "", False, "HTTP 403"),
    ("workday", {"careers_url": "https://b.wd1.myworkdayjobs.com/S"}, 200, "<html>myworkdayjobs</html>", True, ""),
    ("icims", {"careers_url": "https://c.icims.com/jobs"}, 200, "hello", False, "page does not look like a job board"),
    ("smartrecruiters", {"company": "a"}, 200, '{"content": []}', True, ""), ("smartrecruiters", {"company": "a"}, 200, "[]", False, "invalid SmartRecruiters API response"),
    ("smartrecruiters", {"company": "a"}, 200, "<x", False, "invalid JSON from SmartRecruiters API"), ("lever", {}, 200, "[]", False, rules.PROBE_UNSUPPORTED),
    ("lever", {"company": "n"}, None, None, False, "boom"), ("generic_playwright", {}, 200, "", True, ""), ("generic_playwright", {}, 404, "", False, "HTTP 404"),
    ("generic_playwright", {}, 500, "", True, ""),
]


def probes(spark, rows):
    return spark.createDataFrame([(i, NOW, s, b, "boom", None, None) for i, (s, b) in rows.items()], schemas.PROBES)


def test_probe_results_and_application(spark):
    rows = companies(spark, [(i, f"c{i}", c[0], c[1], True, 1) for i, c in enumerate(PROBE_CASES)] + [(99, "u", "unconfigured", {}, True, 1)])
    answers = probes(spark, {i: c[2:4] for i, c in enumerate(PROBE_CASES)})
    got = {r.id: r.probe for r in catalog.evaluate_probes(rows, answers).collect()}
    assert [(got[i].valid, got[i].error) for i in range(len(PROBE_CASES))] == [c[4:] for c in PROBE_CASES]
    after = {r.id: r for r in catalog.apply_probes(rows, answers, F.lit(NOW)).collect()}
    assert (after[0].consecutive_failures, after[0].last_validation_status, after[0].enabled) == (0, "200", True)
    assert (after[1].enabled, after[1].consecutive_failures, after[1].last_error) == (False, 2, "Greenhouse board_token x returned 404")
    assert (after[9].validation, after[9].last_error, after[9].last_validation_status) == ("skipped", rules.PROBE_UNSUPPORTED, "error")
    assert after[99].validation == "skipped" and after[99].last_validated_at is None
    kept = {r.id: r for r in catalog.apply_probes(rows, answers, F.lit(NOW), disable_on_404=False).collect()}
    assert (kept[1].enabled, kept[1].consecutive_failures, kept[1].validation) == (True, 2, "failed")


def test_outcomes_of_a_cycle(spark):
    rows = companies(spark, [(1, "A", "lever", {"company": "a"}, True, 1), (2, "B", "lever", {"company": "b"}, True, 0), (3, "C", "gem", {}, True, 1), (4, "D", "gem", {}, True, 1)])
    shots = spark.createDataFrame([(1, NOW, "failed", "Client error '404' for url 'u'"), (2, NOW, "failed", "Client error '404' for url 'u'"), (3, NOW, "ok", None), (4, NOW, "failed", "timed out")], schemas.SNAPSHOTS)
    got = {r.id: (r.enabled, r.consecutive_failures, r.last_error, r.failure) for r in catalog.apply_outcomes(rows, shots).collect()}
    detail = "Lever company slug {} returned 404"
    assert got == {1: (False, 2, detail.format("a"), f"A: invalid_source_config ({detail.format('a')})"), 2: (True, 1, detail.format("b"), f"B: invalid_source_config ({detail.format('b')})"),
                   3: (True, 0, None, None), 4: (True, 1, "timed out", "D: timed out")}


@pytest.mark.parametrize("seed,threshold", [(1, 2), (2, 3), (3, 4)])
def test_streaks_equal_a_plain_loop(spark, seed, threshold):
    rng = random.Random(seed)
    log, expected = [], {}
    start = {c: rng.randint(0, 1) for c in range(6)}
    for company in range(6):
        streak, disabled = start[company], None
        for n in range(rng.randint(1, 25)):
            at, kind = NOW + dt.timedelta(hours=6 * n), rng.choice(["ok", "404", "other", "404"])
            log.append((company, at, n, kind))
            if disabled is None:
                streak = 0 if kind == "ok" else streak + (kind == "404")
                disabled = at if kind == "404" and streak >= threshold else None
        expected[company] = (streak, disabled)
    outcomes = spark.createDataFrame(log, "company_id long, ts timestamp, seq long, kind string")
    initial = spark.createDataFrame(list(start.items()), "company_id long, failures long")
    got = {r.company_id: (r.streak, r.disabled_at) for r in failure_fold.failure_streaks(outcomes, threshold, initial).collect()}
    assert got == expected


def test_selection(spark):
    rows = companies(spark, [(i, f"n{9 - i}", t, {}, i != 4, 0) for i, t in enumerate(["generic_playwright"] * 4 + ["lever", "taleo", "unconfigured", "", "gem"])])
    assert sorted(r.id for r in catalog.companies_to_scrape(rows, generic_budget=2).collect()) == [0, 1, 5, 6, 7, 8]
    assert sorted(r.id for r in catalog.companies_to_scrape(rows, generic_enabled=False).collect()) == [5, 6, 7, 8]
    changed, tally = catalog.enable_generic(rows, 1)
    assert [(r.id, r.source_config) for r in changed.filter("id in (5, 6)").orderBy("id").collect()] == [(5, {}), (6, {"careers_url": "https://c.com"})]
    assert tally.first().updated == 1


# ---- digest and metrics -------------------------------------------------------------------
JOBS = "id long, company_id long, company_name string, title string, url string, location string, posted_at timestamp"


def test_digest_document(spark):
    jobs = spark.createDataFrame([
        (1, 9, "Beta Co", "Software Engineer I", "https://jobs.example.com/1?a=1&b=2", "Remote", dt.datetime(2026, 3, 1)),
        (2, 3, "Alpha <Inc>", "Campus SWE", "https://jobs.example.com/2", None, None), (3, 3, "Alpha <Inc>", "Another", "https://u/3", "", dt.datetime(2026, 3, 2)),
    ], JOBS)
    doc = digest.digest_document(jobs, "2026-03-27").first()
    assert doc.subject == "New Entry-Level SWE Jobs — 2026-03-27"
    assert doc.text == ("New entry-level SWE jobs — 2026-03-27\n\n## Alpha <Inc>\n- Another\n  https://u/3\n  2026-03-02\n- Campus SWE\n  https://jobs.example.com/2\n\n"
                        "## Beta Co\n- Software Engineer I\n  https://jobs.example.com/1?a=1&b=2\n  Remote — 2026-03-01")
    assert "Alpha &lt;Inc&gt;</h3>" in doc.html and '<a href="https://jobs.example.com/1?a=1&amp;b=2">' in doc.html and doc.html.endswith("</ul></body></html>")
    whole = "".join(r.html for r in digest.ordered_fragments(digest.digest_fragments(jobs)).collect())
    assert whole in doc.html


def test_digest_of_any_size(spark):
    jobs = spark.range(30_000).selectExpr("id", "1L AS company_id", "'Acme' AS company_name", "concat('SWE ', id) AS title",
                                          "'https://u' AS url", "CAST(NULL AS STRING) AS location", "CAST(NULL AS TIMESTAMP) AS posted_at")
    assert digest.digest_document(jobs, "2026-03-27").first().text.count("- SWE") == 30_000


def test_empty_digest(spark):
    doc = digest.digest_document(spark.createDataFrame([], JOBS), "2026-03-27").first()
    assert doc.html == "<p>No new entry-level SWE jobs today.</p>" and doc.text == "No new entry-level SWE jobs today."


def test_metrics_document(spark):
    from tidemark.operators.ingest import COUNTERS

    counters = spark.createDataFrame([(1, *range(10, 19)), (2, *range(9))], "company_id long, " + ", ".join(f"{c} long" for c in COUNTERS))
    failures = spark.createDataFrame([(7, "G: x"), (3, "C: y")], "company_id long, failure string")
    row = metrics.scrape_metrics(counters, failures, 7).first()
    doc = json.loads(row.metrics)
    assert (doc["companies_scanned"], doc["jobs_seen_total"], doc["jobs_seen"], doc["new_jobs_created"], doc["new_swe_jobs_created"]) == (2, 10, 10, 12, 14)
    assert doc["scraper_failures"] == ["C: y", "G: x"] and doc["scraper_failure_count"] == 2 and doc["digest_candidates_count"] == 7
    assert row.message.endswith("partial failures")
    quiet = metrics.scrape_metrics(counters, failures.limit(0)).first()
    assert quiet.message == "Scrape pipeline completed" and json.loads(quiet.metrics)["scraper_failures"] == []
