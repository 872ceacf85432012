"""Provider payloads and board pages with literal samples."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import boards, providers
from tidemark.plans.cycle import collect_postings

CYCLE = dt.datetime(2026, 3, 1)


@pytest.fixture
def sourced(spark):
    def make(kind, body, careers="https://acme.com/careers", config=None, method="api"):
        pages = body if isinstance(body, list) else [body]
        captures = spark.createDataFrame(
            [(1, kind, CYCLE, method, i, "https://acme.com/p", 200, "", b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(pages)],
            schemas.CAPTURES,
        )
        return providers.with_source(captures, company(spark, kind, careers, config))

    return make


def company(spark, kind, careers="https://acme.com/careers", config=None, id=1):
    return spark.createDataFrame(
        [(id, "Acme", careers, kind, config or {}, True, None, None, 0, None, CYCLE, CYCLE)], schemas.COMPANIES
    )


def rows(df):
    return sorted(df.collect(), key=lambda r: r["ordinal"])


def test_greenhouse(sourced):
    item = {"id": 12345, "title": "Software Engineer — New Grad", "location": {"name": "San Francisco, CA"},
            "absolute_url": "https://boards.greenhouse.io/acme/jobs/12345", "content": "<p>x</p>", "updated_at": "2026-03-27T12:00:00Z"}
    odd = {"id": 0, "title": None, "location": {"name": 5}, "content": "c" * 50010, "first_published": 1000}
    good, other = rows(providers.greenhouse(sourced("greenhouse", {"jobs": [item, "no", odd]})))
    assert (good.company_name, good.source_type, good.external_job_id, good.location) == ("Acme", "greenhouse", "12345", "San Francisco, CA")
    assert good.posted_at == dt.datetime(2026, 3, 27, 12) and json.loads(good.raw_payload) == item and good.type_errors == []
    assert (other.external_job_id, other.title, other.location, other.url) == ("0", "Untitled", None, "https://acme.com/careers")
    assert other.type_errors == ["location"] and len(other.description_text) == 50000 and other.posted_at == dt.datetime(1970, 1, 1, 0, 16, 40)


def test_wrong_shapes_yield_nothing(sourced):
    for provider, bodies in (
        (providers.greenhouse, [{"jobs": {"a": 1}}, {"jobs": 0}, [], "oops"]),
        (providers.lever, [{"a": 1}, "null"]),
        (providers.ashby, [{"jobs": 3}, {"x": []}]),
        (providers.workday, [[], {"jobPostings": "x"}]),
        (providers.smartrecruiters, [{"content": {}}, []]),
    ):
        assert provider(sourced("x", bodies)).count() == 0


def test_lever(sourced):
    items = [
        {"id": "a", "text": "Dev", "categories": {"team": "Core", "location": ["A", "B", "C", "D", "E", "F"]}, "hostedUrl": "https://l/a", "createdAt": 1710000000000},
        {"id": None, "text": "", "title": "T", "categories": [], "applyUrl": "https://l/b", "descriptionPlain": "", "description": "d"},
    ]
    a, b = rows(providers.lever(sourced("lever", [items])))
    assert (a.title, a.team, a.location, a.url, a.posted_at) == ("Dev", "Core", "A, B, C, D, E", "https://l/a", dt.datetime(2024, 3, 9, 16))
    assert (b.external_job_id, b.title, b.team, b.location, b.description_text) == (None, "T", None, None, "d")


def test_ashby(sourced):
    items = [{"id": 1, "title": "A", "location": {"primaryLocation": {"name": "NYC"}}, "jobUrl": "u1", "publishedDate": "2026-03-01", "employmentType": "FullTime"},
             {"id": 2, "title": "B", "location": "", "locationName": "Remote", "publishedDate": 5, "updatedAt": "2026-03-02"}]
    for body in (items, {"jobs": items}):
        a, b = rows(providers.ashby(sourced("ashby", [body])))
        assert (a.location, a.employment_type, a.posted_at, b.location, b.posted_at) == ("NYC", "FullTime", dt.datetime(2026, 3, 1), "Remote", None)


def test_workday(sourced):
    careers = "https://nvidia.wd5.myworkdayjobs.com/en-US/Site/"
    body = {"total": 1, "jobPostings": [
        {"title": "Intern Engineer", "externalPath": "/job/intern-engineer", "locationsText": "San Jose, CA", "postedOn": 1710000000000, "bulletFields": ["R123"]},
        {"name": "N", "url": "https://x/1", "jobPostingUrl": "/ignored", "id": 0, "location": [{"descriptor": "A"}, "B", {"name": ""}]},
        {"jobPostingTitle": "J", "jobPostingUrl": "rel/path"}]}
    a, b, c = rows(providers.workday(sourced("workday", body, careers)))
    assert (a.url, a.location, a.external_job_id, a.posted_at) == ("https://nvidia.wd5.myworkdayjobs.com/job/intern-engineer", "San Jose, CA", "R123", dt.datetime(2024, 3, 9, 16))
    assert (b.title, b.url, b.external_job_id, b.location) == ("N", "https://x/1", "0", "A, B")
    assert (c.title, c.url, c.external_job_id, c.location) == ("J", "https://nvidia.wd5.myworkdayjobs.com/rel/path", None, None)


def test_smartrecruiters(sourced):
    body = {"content": [
        {"id": "abc-123", "name": "Software Engineer", "location": {"city": "Austin", "region": "TX", "country": "US"}, "ref": "software-engineer-abc", "releasedDate": "2026-03-01T12:00:00.000Z"},
        {"id": "n", "location": {"fullLocation": "Whole"}, "typeOfEmployment": {"label": 3}}]}
    a, b = rows(providers.smartrecruiters(sourced("smartrecruiters", body, "https://jobs.smartrecruiters.com/acme")))
    assert (a.external_job_id, a.location, a.url) == ("abc-123", "Austin, TX, US", "https://jobs.smartrecruiters.com/acme/software-engineer-abc")
    assert (b.title, b.location, b.url, b.type_errors) == ("Untitled", "Whole", "https://jobs.smartrecruiters.com/acme/posting/n", ["employment_type"])


GEM = '<a href="https://jobs.gem.com/bilt/4509720004">E</a> <a href=\'https://jobs.gem.com/bilt/am9icG9zdDp4\'>P</a> <a href="https://jobs.gem.com/other/1">O</a> <a href="https://jobs.gem.com/bilt/4509720004">E</a>'


def test_gem(sourced):
    a, b = rows(boards.gem(sourced("gem", GEM, "https://jobs.gem.com/Bilt/x")))
    assert (a.url, a.title, a.external_job_id) == ("https://jobs.gem.com/bilt/4509720004", "Role at bilt", "4509720004")
    assert b.title == "Role at bilt"
    fallback = '<a href="/bilt/">board</a><a href="/bilt/a.b">x</a><a href="/bilt/abc.d">y</a><a href="https://e.com">z</a>'
    urls = [r.url for r in rows(boards.gem(sourced("gem", fallback, "https://jobs.gem.com/bilt")))]
    assert urls == ["https://jobs.gem.com/bilt/a.b", "https://jobs.gem.com/bilt/abc.d"]


def test_icims(sourced):
    page = '<a href="https://c.icims.com/jobs/12345/software-engineer/job">Software Engineer</a><a href="/jobs/99/x/job"> </a>' + "." * 300 + '<a href="/jobs/98/data/job"><b>Data Analyst</b></a><a href="/jobs/99/x/job">again</a>'
    a, b, c = rows(boards.icims(sourced("icims", page, "https://c.icims.com/jobs")))
    assert (a.title, a.external_job_id, a.url) == ("Software Engineer", "12345", "https://c.icims.com/jobs/12345/software-engineer/job")
    # the window before the second link reaches back to the first one's text
    assert (b.title, b.url) == ("Software Engineer", "https://c.icims.com/jobs/99/x/job")
    assert (c.title, c.external_job_id) == ("Data Analyst", "98")
    fallback = rows(boards.icims(sourced("icims", '<a href="/jobs/search">s</a><a href="/jobs/login/5">l</a><a href="/about">a</a>', "https://c.icims.com/jobs")))
    assert [(r.url, r.title) for r in fallback] == [("https://c.icims.com/jobs/search", "Open position")]


def test_smartrecruiters_html(sourced):
    page = '<a href="/Acme/posting/1">a</a><a href="/about">b</a><a href="https://x.com/job/2">c</a>'
    found = rows(boards.smartrecruiters_html(sourced("smartrecruiters", page, "https://jobs.smartrecruiters.com/Acme")))
    assert [r.url for r in found] == ["https://jobs.smartrecruiters.com/Acme/posting/1"]


def test_hrefs(evaluate):
    page = """<A HREF = '/a'>x</a><a href="mailto:x@y">m</a><a href="#top">t</a><a href=" b ">b</a><a href="/a">again</a><a href="http://o.com">o</a>"""
    assert evaluate([(page,), (None,)], "h string", boards.extract_hrefs(F.col("h"), F.lit("http://h.com/d/"))) == [
        ["http://h.com/a", "http://h.com/d/b", "http://o.com"], []]


def test_rendered_list(spark):
    made = spark.createDataFrame(
        [(1, CYCLE, 0, "https://w.com/a/", i, u, t, None, None, "Acme") for i, (u, t) in enumerate([("/job/1", " T "), ("", "x"), (None, "y"), ("http://z", None)])],
        "company_id long, cycle_ts timestamp, page_ordinal int, page_url string, pos int, url string, title string, location string, posted_on string, company_name string")
    assert [(r.url, r.title) for r in rows(providers.rendered_rows(made))] == [("https://w.com/job/1", "T"), ("http://z", "Untitled")]


def test_every_source_type_is_combined_and_methods_are_chosen(spark):
    def capture(id, kind, method, body):
        return (id, kind, CYCLE, method, 0, "https://p", 200, "", body if isinstance(body, str) else json.dumps(body))

    icims = "".join(f'<a href="/jobs/{i}/x/job">Role {i} here</a>' for i in range(2))
    captures = spark.createDataFrame([
        capture(1, "greenhouse", "api", {"jobs": [{"title": "g"}]}),
        capture(2, "lever", "api", [{"text": "l"}]),
        capture(3, "ashby", "api", [{"title": "a"}]),
        capture(4, "smartrecruiters", "api", {"content": []}),
        capture(4, "smartrecruiters", "html", '<a href="/x/posting/1">p</a>'),
        capture(5, "icims", "html", icims),
        capture(5, "icims", "rendered", icims + '<a href="/jobs/7/x/job">Seventh</a>'),
        capture(6, "gem", "html", GEM),
        capture(7, "workday", "api", {"jobPostings": []}),
    ], schemas.CAPTURES)
    kinds = ["greenhouse", "lever", "ashby", "smartrecruiters", "icims", "gem", "workday", "generic_playwright"]
    careers = {"smartrecruiters": "https://jobs.smartrecruiters.com/x", "gem": "https://jobs.gem.com/bilt", "icims": "https://c.icims.com/jobs"}
    owners = None
    for i, kind in enumerate(kinds, 1):
        one = company(spark, kind, careers.get(kind, "https://w.com/careers"), id=i)
        owners = one if owners is None else owners.unionByName(one)
    anchors = spark.createDataFrame([
        (7, CYCLE, 0, "https://w.com/", 0, "/job/9", "Nine", None, 1), (7, CYCLE, 0, "https://w.com/", 1, "/job/8", "Eight", None, 0),
        (7, CYCLE, 0, "https://w.com/", 2, "/job/8", "Again", None, 0), (8, CYCLE, 0, "https://g.com/", 0, "/jobs/1", "Engineer", "NYC", 0),
    ], schemas.ANCHORS)
    counts = {r.source_type: r["count"] for r in collect_postings(captures, owners, anchors).groupBy("source_type").count().collect()}
    assert counts == {"greenhouse": 1, "lever": 1, "ashby": 1, "smartrecruiters": 1, "icims": 3, "gem": 2, "workday": 1, "generic_playwright": 1}
    # caps are parameters: three links of a page, of which one or all are kept
    links = spark.createDataFrame([(8, CYCLE, 0, "https://g.com/", i, f"/jobs/{i}", f"Engineer {i}", None, 0) for i in range(3)], schemas.ANCHORS)
    kept = {cap: collect_postings(captures, owners, links, link_cap=cap).where("source_type = 'generic_playwright'").count() for cap in (1, 2, None)}
    assert kept == {1: 1, 2: 2, None: 3}
