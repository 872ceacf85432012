"""Scalar functions against literal values and the standard library."""

import datetime as dt
import hashlib
import html
import random
import re
import unicodedata
from urllib.parse import urljoin, urlsplit

import pytest
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions import classify, location, source_urls, text, timestamps, urls, variants

UTC = dt.timezone.utc


# ---- text ---------------------------------------------------------------------------------
def test_stable_characters_are_left_alone_by_nfkc():
    stable = re.compile(f"[{text.NFKC_STABLE}]")
    chars = [chr(i) for i in range(0x3000) if stable.match(chr(i))]
    assert len(chars) > 250
    assert all(unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c) for c in chars)


def test_space_class_equals_python(evaluate):
    assert [i for i in range(0x10000) if re.match(text.SPACE, chr(i))] == [i for i in range(0x10000) if chr(i).isspace()]


def test_fingerprint_parts(evaluate):
    values = ["Acme", "  A  b\tC ", None, "", "ﬁne ①", "école", "ＡＢ｜Ｃ", "x\x01y", "Straße  Z", "ÀÉ", "ΑΣ Σ", "İx"]

    def expected(v):
        return " ".join(unicodedata.normalize("NFKC", v or "").lower().strip().split())

    got = evaluate([(v,) for v in values], "v string", text.normalize_for_fingerprint(F.col("v")))
    assert got == [expected(v) for v in values]
    rows = [(values[i], values[i - 1], values[i - 2], values[i - 3], values[i - 4]) for i in range(len(values))]
    keys = evaluate(rows, "a string, b string, c string, d string, e string", text.fingerprint(*[F.col(c) for c in "abcde"]))
    assert keys == [hashlib.sha256("|".join(map(expected, r)).encode()).hexdigest() for r in rows]


def test_fingerprint_is_stable_and_sees_the_url(evaluate):
    rows = [
        ("Acme", "Software Engineer I", "Remote", "https://e.com/1", "abc"),
        ("acme", "  software engineer i  ", "remote", "https://e.com/1", "abc"),
        ("Acme", "Software Engineer I", "Remote", "https://e.com/2", "abc"),
    ]
    a, b, c = evaluate(rows, "a string, b string, c string, d string, e string", text.fingerprint(*[F.col(x) for x in "abcde"]))
    assert a == b != c and len(a) == 64


def test_link_titles(evaluate):
    cases = {"Software Engineer — New Grad": "Software Engineer — New Grad", "Apply": "Open position", " apply  NOW ": "Open position",
             "": "Open position", None: "Open position", "a  b\n c": "a b c", "x" * 161: "x" * 157 + "...", "y" * 160: "y" * 160,
             "Apply for this": "Apply for this"}
    assert evaluate([(k,) for k in cases], "t string", text.title_from_link_text(F.col("t"))) == list(cases.values())


def test_html_escape(evaluate):
    values = ["<a href=\"x\">it's & that</a>", "&amp;", ""]
    assert evaluate([(v,) for v in values], "v string", text.html_escape(F.col("v"))) == [html.escape(v) for v in values]


# ---- rules --------------------------------------------------------------------------------
def test_required_words_occur_in_every_match():
    samples = ["new grad", "University Graduate", "entry-level", "0-2 years", "bachelors degree required", "bachelor's degree preferred",
               "l3 new grad", "5+ year", "10 + years", "full stack engineer", "system engineer", "systems engineer"]
    for rule in (*rules.ENTRY_POSITIVE, *rules.ENTRY_NEGATIVE, *rules.SOFTWARE, *rules.NON_SOFTWARE):
        for sample in [*samples, rule.label]:
            if re.search(rule.regex, sample, re.I):
                assert all(w in sample.lower() for w in rule.required_words())


def classified(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, title string, description_text string, level string")
    return [r["verdict"] for r in sorted(classify.with_job_class(df).collect(), key=lambda r: r["i"])]


def test_classification_equals_the_rules_one_by_one(spark):
    rng = random.Random(3)
    words = ["Software", "engineer", "I", "intern", "new", "grad", "Senior", "SALES", "full-stack", "full stack", "sre", "HR", "ml", "data", "\n",
             "5 + years", "0-2 years", "ſenior", "Kelvin", "staff", "İntern", "entry level", "developer", "campus", "people", "l3"]
    rows = [tuple(None if rng.random() < 0.2 else " ".join(rng.choices(words, k=rng.randint(0, 7))) for _ in range(3)) for _ in range(300)]

    def found(rule_list, value):
        return [r.label for r in rule_list if re.search(r.regex, value, re.I)]

    for (title, description, level), got in zip(rows, classified(spark, rows)):
        full = "\n".join([title or "", *[x for x in (level, description) if x]])
        positive, negative = found(rules.ENTRY_POSITIVE, full), found(rules.ENTRY_NEGATIVE, full)
        non, explicit = found(rules.NON_SOFTWARE, title or ""), found(rules.EXPLICIT_SOFTWARE_TITLE, title or "")
        veto = bool(non) and not explicit
        software = [] if veto else found(rules.SOFTWARE, title or "") or found(rules.SOFTWARE, full)
        score = 2.0 * len(positive) - 3.0 * len(negative)
        assert (got.entry_level_matched, got.entry_level_negative_matched) == (positive, negative), (title, description, level)
        assert (got.software_matched, got.non_software_matched) == (software, non)
        assert (got.entry_level_score, got.is_entry_level) == (score, score > 0)
        assert got.is_software_engineering_related == bool(software)


REJECTED = ["Sales Development Representative - New Grad", "Product Manager, New Grad", "Sales Engineer, University Graduate",
            "Customer Success Associate, Entry Level", "Account Executive, Early Career", "Business Analyst Intern"]
ACCEPTED = ["Software Engineer, New Grad", "Backend Engineer I", "Frontend Software Engineer - University Grad", "Machine Learning Engineer, Early Career",
            "Site Reliability Engineer I", "Data Engineer I", "Infrastructure Engineer, University Graduate"]


def test_rejected_and_accepted_titles(spark):
    verdicts = classified(spark, [(t, None, None) for t in REJECTED + ACCEPTED])
    for v in verdicts[: len(REJECTED)]:
        assert not v.is_software_engineering_related and v.non_software_matched and v.rejection_reason == "non_software_role_in_title"
    for v in verdicts[len(REJECTED):]:
        assert v.is_digest_eligible and v.rejection_reason is None


def test_classification_details(spark):
    senior, one, wordy, none = classified(
        spark,
        [("Senior Software Engineer", "Looking for senior talent.", None), ("Software Engineer I", "campus hire", None),
         ("Engineer", "We need a full-stack engineer, internship", "l2"), (None, None, None)],
    )
    assert senior.rejection_reason == "not_entry_level" and senior.entry_level_score == -3.0
    assert one.entry_level_matched == ["software engineer i", "engineer i", "campus"] and one.entry_level_score == 6.0
    assert wordy.software_matched == ["full stack engineer", "full-stack engineer"] and wordy.entry_level_matched == []
    assert none.rejection_reason == "no_software_engineering_indicators"


# ---- locations ----------------------------------------------------------------------------
LOCATIONS = {
    "US": ["San Francisco, CA", "New York, NY", "Seattle, WA", "Austin, TX", "United States", "USA", "US", "Boston, Massachusetts", "Hybrid - San Francisco",
           "Hybrid NYC", "Remote/San Francisco", "New York, NY or Remote", "Rio de Janeiro", "Portland (OR)", "(CA)", "x ,  wa", "c.a."],
    "REMOTE_US": ["Remote", "Remote US", "US Remote", "Remote - United States", "Remote, USA", "Anywhere in US", "Work from home", "remote – us", "Somewhere remote"],
    "INTERNATIONAL": ["London, UK", "Berlin, Germany", "Toronto, Canada", "Vancouver, BC, Canada", "India", "Singapore", "Dublin, Ireland", "Amsterdam, Netherlands",
                      "Tokyo, Japan", "Sydney, Australia", "Remote EMEA", "Remote Europe", "Remote Canada", "Remote India", "Paris, France", "Remote - UK",
                      "EMEA", "APAC", "San Francisco, CA | London, UK", "Paris, TX", "Albuquerque, New Mexico"],
    "UNKNOWN": ["Multiple Locations", "TBD", None, "", "   ", "Mars", "of ca", "Austin / Mars", "|"],
}


def test_location_categories(evaluate):
    cases = [(place, kind) for kind, places in LOCATIONS.items() for place in places]
    got = evaluate([(p,) for p, _ in cases], "l string", location.classify_location(F.col("l")))
    assert [(p, g) for (p, _), g in zip(cases, got)] == cases


def test_normalized_locations(evaluate):
    cases = {"  San Francisco,  CA  ": "san francisco, ca", "Remote\tUS": "remote us", "": "", None: ""}
    assert evaluate([(c,) for c in cases], "l string", location.normalize_location(F.col("l"))) == list(cases.values())


# ---- timestamps ---------------------------------------------------------------------------
ISO = ["20260301", "2026-W10-1", "2026-W10", "2026W101", "2020-W53-7", "2021-W53", "2026-03-01T12", "2026-03-01 12:30", "2026-03-01T12:00:00.000Z",
       "2026-03-01T12:00:00+0530", "2026-03-01T12:00:00-08:00", "2026-03-01T12:00:00+05", "2026", "2026-03", "Posted 3 Days Ago", "2026-02-30",
       "2026-03-01T25:00", "2026-03-01T12:00:00.1234567", "20260301T101112", "2026-3-1", "0000-01-01", "2026-03-01T12:00:00,5Z", "", "2026-03-01T",
       "2026-03-01x08:09", "2026-02-29", "2024-02-29", "2026-03-01T12:61", "2026-03-01T12:00:00+25:00", " 2026-03-01", "2026-03-01T12:00:00+05:30:15"]


def from_iso(value):
    try:
        parsed = dt.datetime.fromisoformat(value.replace("Z", "+00:00") if value.endswith("Z") else value)
    except ValueError:
        return None
    return (parsed if parsed.tzinfo else parsed.replace(tzinfo=UTC)).astimezone(UTC).strftime("%Y-%m-%d %H:%M:%S.%f")


def test_iso_texts(evaluate):
    shown = F.date_format(timestamps.parse_iso(F.col("v")), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    assert dict(zip(ISO, evaluate([(v,) for v in ISO], "v string", shown))) == {v: from_iso(v) for v in ISO}


def test_epochs_and_json_values(evaluate):
    cases = {"1710000000000": "2024-03-09 16:00:00", "1710000000": "2024-03-09 16:00:00", "true": "1970-01-01 00:00:01", "null": None, '"x"': None,
             "{}": None, '"2026-03-01T12:00:00Z"': "2026-03-01 12:00:00", "1.5": "1970-01-01 00:00:01.5"}
    shown = variants.timestamp(variants.parse(F.col("v"))).cast("string")
    assert evaluate([(c,) for c in cases], "v string", shown) == list(cases.values())
    one = evaluate([("1710000000000",)], "v string", variants.timestamp(variants.parse(F.col("v")), "ms").cast("string"))
    assert one == ["2024-03-09 16:00:00"]


def test_local_days_have_23_24_or_25_hours(evaluate):
    days = [("2026-03-08",), ("2026-03-09",), ("2026-11-01",)]
    start = timestamps.day_start(F.col("d").cast("date"), "America/Los_Angeles")
    end = timestamps.day_start(F.date_add(F.col("d").cast("date"), 1), "America/Los_Angeles")
    assert evaluate(days, "d string", (F.unix_timestamp(end) - F.unix_timestamp(start)) / 3600) == [23.0, 24.0, 25.0]
    inside = timestamps.within_local_day(F.col("t").cast("timestamp"), F.lit("2026-03-08").cast("date"), "America/Los_Angeles")
    times = [("2026-03-08 07:59:59.999999",), ("2026-03-08 08:00:00",), ("2026-03-09 06:59:59.999999",), ("2026-03-09 07:00:00",)]
    assert evaluate(times, "t string", inside) == [False, True, True, False]


# ---- json values --------------------------------------------------------------------------
def test_truthiness_and_fallbacks(evaluate):
    values = ["null", '""', "0", "0.0", "-0", "false", "[]", "{}", "1", '"0"', "[0]", '{"a":null}', "true", "1e-5", '"x"']
    truthy = evaluate([(v,) for v in values], "v string", variants.truthy(variants.parse(F.col("v"))))
    assert truthy == [False] * 8 + [True] * 7
    doc = variants.parse(F.col("v"))
    pick = variants.to_text(variants.first_truthy(variants.field(doc, "a"), variants.field(doc, "b")))
    rows = [('{"a":0,"b":"x"}',), ('{"a":"y","b":"x"}',), ('{"b":0}',), ('{"a":""}',), ('{"a":true}',), ('{"a":7.5}',)]
    assert evaluate(rows, "v string", pick) == ["x", "y", "0", None, "True", "7.5"]


# ---- urls ---------------------------------------------------------------------------------
BASES = ["https://a.com/b/c?x=1#f", "http://a.com", "https://a.com/b/", "", "https://A.com:80/b/../c"]
REFS = ["d", "/d", "/d/../e", "../x", "../../../x", "?q=1", "#z", "//h.com/p", "http://o.com/x#", "mailto:x", "HTTPS://q.com/a?", "./", "..", ".", "",
        "d/./e/", "a//b", "/a//b", "x?y=/../z", "http:foo", "/no.", "/.hid", "/a;b", "javascript:void(0)", "ftp://f/x", "https://a.com", "g?y/./x", "/./g"]


def test_relative_references(evaluate):
    rows = [(b, r) for b in BASES for r in REFS]
    assert evaluate(rows, "b string, r string", urls.resolve_url(F.col("b"), F.col("r"))) == [urljoin(b, r) for b, r in rows]
    assert evaluate([(None, "x"), ("http://a", None)], "b string, r string", urls.resolve_url(F.col("b"), F.col("r"))) == [None, None]


def test_url_parts(evaluate):
    values = ["https://A.com:8080/p/q;x?a=b&c#frag", "mailto:x@y", "/just/path?x", "http://h", "//h/p", "HTTP://h/p?"]
    got = evaluate([(v,) for v in values], "u string", urls.split_url(F.col("u")))
    assert [tuple(g) for g in got] == [tuple(urlsplit(v)) for v in values]


def test_board_urls(evaluate):
    workday = evaluate(
        [("https://boeing.wd1.myworkdayjobs.com/en-US/EXTERNAL_CAREERS/login",), ("https://x.wd5.myworkdayjobs.com/Site",), ("https://x.myworkdayjobs.com/jobs",),
         ("https://x.com/Site",), ("https://x.myworkdayjobs.com/en-US/jobs/Other",), (None,)],
        "u string", urls.workday_parts(F.col("u")),
    )
    assert [tuple(w) if w else None for w in workday] == [
        ("https://boeing.wd1.myworkdayjobs.com", "boeing", "EXTERNAL_CAREERS"), ("https://x.wd5.myworkdayjobs.com", "x", "Site"), None, None,
        ("https://x.myworkdayjobs.com", "x", "Other"), None,
    ]
    for function, cases in {
        urls.gem_board_url: {"https://jobs.gem.com/bilt/12/": "https://jobs.gem.com/bilt", "https://x.com/a/": "https://x.com/a"},
        urls.smartrecruiters_slug: {"https://jobs.smartrecruiters.com/Netflix": "Netflix", "https://x.com/y": None},
        urls.icims_board_url: {"https://c.icims.com/login": "https://c.icims.com/jobs", "https://c.icims.com/jobs/1?x": "https://c.icims.com/jobs/1",
                               "https://c.icims.com": "https://c.icims.com/jobs", None: None},
        urls.workday_board_url: {"https://w/a/Login?x#y": "https://w/a", "https://w": "https://w/", None: None},
        urls.without_query: {"https://a.com": "https://a.com/", "https://a.com/b?x#y": "https://a.com/b"},
        urls.registrable_domain: {"a.b.Example.com": "example.com", "localhost": "localhost"},
    }.items():
        assert evaluate([(c,) for c in cases], "u string", function(F.col("u"))) == list(cases.values())


# ---- source urls --------------------------------------------------------------------------
CONFIG = "t string, c map<string,string>"


def test_validation_urls(evaluate):
    cases = [
        ("greenhouse", {"board_token": "stripe"}, "https://boards-api.greenhouse.io/v1/boards/stripe/jobs"),
        ("greenhouse", {"token": "s"}, "https://boards-api.greenhouse.io/v1/boards/s/jobs"),
        ("greenhouse", {}, None),
        ("lever", {"company": "netflix"}, "https://api.lever.co/v0/postings/netflix"),
        ("ashby", {"org": "x"}, "https://api.ashbyhq.com/posting-api/job-board/x"),
        ("ashby", {"org": "x", "posting_api_url": "https://own"}, "https://own"),
        ("smartrecruiters", {"careers_url": "https://jobs.smartrecruiters.com/Netflix"}, "https://api.smartrecruiters.com/v1/companies/Netflix/postings"),
        ("workday", {"careers_url": "https://n.wd5.myworkdayjobs.com/en-US/Site/"}, "https://n.wd5.myworkdayjobs.com/en-US/Site"),
        ("gem", {"careers_url": "https://jobs.gem.com/bilt"}, "https://jobs.gem.com/bilt"),
        ("icims", {}, None),
        ("unconfigured", {"careers_url": "x"}, None),
    ]
    got = evaluate([c[:2] for c in cases], CONFIG, source_urls.validation_url_for(F.col("t"), F.col("c")))
    assert got == [c[2] for c in cases]


def test_careers_urls_and_errors(evaluate):
    rows = [("greenhouse", {"board_token": "airbnb"}), ("lever", {}), ("ashby", {}), ("workday", {"page_url": "https://w/"}), ("workday", {}), ("taleo", {})]
    got = evaluate(rows, CONFIG, source_urls.careers_url_or_error(F.col("t"), F.col("c")))
    assert [tuple(g) for g in got] == [
        ("https://boards.greenhouse.io/airbnb", None), (None, "Lever source_config requires company"), ("https://jobs.ashbyhq.com/", None),
        ("https://w", None), (None, "workday source_config requires careers_url"), ("", None),
    ]


@pytest.mark.parametrize("kind,body,expected", [
    ("icims", '<a href="/jobs/1/job">Engineer</a> icims careers', True),
    ("gem", '<a href="https://jobs.gem.com/bilt/123">job</a>', True),
    ("workday", "<html>myworkdayjobs job posting</html>", True),
    ("icims", "<html><body>hello</body></html>", False),
    ("greenhouse", "apply now", False),
    ("greenhouse", "apply now" + "x" * 200, True),
    ("icims", None, False),
])
def test_job_board_pages(evaluate, kind, body, expected):
    assert evaluate([(kind, body)], "k string, b string", source_urls.looks_like_job_board(F.col("b"), F.col("k"))) == [expected]
