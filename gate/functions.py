"""Queries for the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gate import sqltext
from gate.registry import query
from gate.surrogates import (
    FINGERPRINT_SQL, LEVELS, SOURCE_TYPES, SQL_CUSTOMER_COMPANIES, SQL_PAGES, TITLES, customer_companies, pages, pick,
    postings, quoted, sql_pick, sql_postings, table,
)
from tidemark import rules
from tidemark.functions import classify, location, source_urls, text, timestamps, urls, variants
from tidemark.sources.targets import config_from_variant

SPACE_SQL = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"


@query(
    "text_whitespace",
    f"""SELECT doc_id, sha256(t) AS digest, length(t) AS n
    FROM (SELECT doc_id, trim(regexp_replace(text, '{SPACE_SQL}+', ' ', 'g')) AS t FROM documents)""",
)
def text_whitespace(spark, d):
    clean = text.normalize_whitespace(F.col("text"))
    return table(spark, d, "documents").select(
        "doc_id", F.sha2(clean, 256).alias("digest"), F.length(clean).cast("bigint").alias("n")
    )


@query(
    "posting_fingerprints",
    f"WITH {sql_postings()} SELECT ordinal, {FINGERPRINT_SQL} AS fingerprint_hash FROM postings_v",
)
def posting_fingerprints(spark, d):
    key = text.fingerprint(*[F.col(c) for c in ("company_name", "title", "location", "url", "external_job_id")])
    return postings(spark, d).select("ordinal", key.alias("fingerprint_hash"))


@query(
    "document_fingerprints",
    f"""SELECT doc_id, sha256(trim(regexp_replace(lower(text), '{SPACE_SQL}+', ' ', 'g')) || '|' || source || '|' || lang || '||') AS fingerprint_hash
    FROM documents""",
)
def document_fingerprints(spark, d):
    none = F.lit(None).cast("string")
    key = text.fingerprint(F.col("text"), F.col("source"), F.col("lang"), none, none)
    return table(spark, d, "documents").select("doc_id", key.alias("fingerprint_hash"))


_LABELS = """array_to_string(sw, '|') AS software, array_to_string(non_l, '|') AS non_software,
  array_to_string(pos_l, '|') AS positive, array_to_string(neg_l, '|') AS negative"""


def _verdict_columns(key: str):
    return [
        key,
        F.col("v.is_software_engineering_related").alias("is_swe"),
        F.col("v.is_entry_level").alias("is_entry"),
        F.col("v.entry_level_score").alias("entry_level_score"),
        F.col("v.rejection_reason").alias("reason"),
        F.array_join("v.software_matched", "|").alias("software"),
        F.array_join("v.non_software_matched", "|").alias("non_software"),
        F.array_join("v.entry_level_matched", "|").alias("positive"),
        F.array_join("v.entry_level_negative_matched", "|").alias("negative"),
    ]


@query(
    "classify_postings",
    f"""WITH {sql_postings()}, {sqltext.classified('postings_v')}
    SELECT ordinal, is_swe, is_entry, entry_level_score, reason, {_LABELS} FROM classified""",
)
def classify_postings(spark, d):
    return classify.with_job_class(postings(spark, d), "v").select(*_verdict_columns("ordinal"))


@query(
    "classify_documents",
    f"""WITH src AS (SELECT doc_id, {sql_pick(TITLES, 'doc_id')} AS title, {sql_pick(LEVELS, 'doc_id')} AS level,
      text AS description_text FROM documents), {sqltext.classified('src')}
    SELECT doc_id, is_swe, is_entry, entry_level_score, reason, {_LABELS} FROM classified""",
)
def classify_documents(spark, d):
    k = F.col("doc_id")
    rows = table(spark, d, "documents").withColumns({"title": pick(TITLES, k), "level": pick(LEVELS, k)})
    return classify.with_job_class(rows, "v", description="text").select(*_verdict_columns("doc_id"))


@query(
    "entry_level_scores",
    f"""WITH {sql_postings()}, {sqltext.classified('postings_v')}
    SELECT ordinal, entry_level_score AS score, is_entry AS is_entry_level, len(pos_l) AS n_positive, len(neg_l) AS n_negative
    FROM classified""",
)
def entry_level_scores(spark, d):
    return classify.with_entry_score(postings(spark, d), "s").select(
        "ordinal", "s.score", "s.is_entry_level",
        F.size("s.matched_positive").cast("bigint").alias("n_positive"),
        F.size("s.matched_negative").cast("bigint").alias("n_negative"),
    )


@query(
    "software_roles",
    f"""WITH {sql_postings()}, {sqltext.classified('postings_v')}
    SELECT ordinal, is_swe, array_to_string(sw, '|') AS software,
      CASE WHEN reason <> 'not_entry_level' THEN reason END AS reason FROM classified""",
)
def software_roles(spark, d):
    return classify.with_software_role(postings(spark, d), "r").select(
        "ordinal", F.col("r.is_software").alias("is_swe"),
        F.array_join("r.software_matched", "|").alias("software"), F.col("r.reason").alias("reason"),
    )


@query(
    "location_categories",
    f"""WITH {sql_postings()}, {sqltext.location_categories('postings_v')}
    SELECT ordinal, norm AS normalized, category FROM postings_v p
    JOIN loc_cat c ON p.location IS NOT DISTINCT FROM c.location
    JOIN locs l ON p.location IS NOT DISTINCT FROM l.location""",
)
def location_categories(spark, d):
    return postings(spark, d).select(
        "ordinal",
        location.normalize_location(F.col("location")).alias("normalized"),
        location.classify_location(F.col("location")).alias("category"),
    )


@query(
    "timestamp_values",
    """SELECT o_orderkey, CASE o_orderkey % 11
      WHEN 0 THEN o_orderdate WHEN 1 THEN o_orderdate WHEN 2 THEN o_orderdate + INTERVAL 3723 SECOND
      WHEN 3 THEN o_orderdate WHEN 4 THEN o_orderdate + INTERVAL 1000000000 SECOND WHEN 5 THEN o_orderdate
      WHEN 9 THEN TIMESTAMP '1970-01-01 00:00:01'
      WHEN 10 THEN o_orderdate + INTERVAL 72000123456 MICROSECOND END AS parsed FROM orders""",
)
def timestamp_values(spark, d):
    at = F.col("o_orderdate").cast("timestamp")
    k, day = F.col("o_orderkey") % 11, F.date_format(at, "yyyy-MM-dd")
    epoch = F.unix_timestamp(at)

    def quoted_text(*parts):
        return F.concat(F.lit('"'), *[p if not isinstance(p, str) else F.lit(p) for p in parts], F.lit('"'))

    value = (
        F.when(k == 0, quoted_text(day, "T00:00:00Z"))
        .when(k == 1, quoted_text(day))
        .when(k == 2, quoted_text(F.date_format(at, "yyyyMMdd"), "T010203"))
        .when(k == 3, quoted_text(day, " 05:30:00+0530"))
        .when(k == 4, ((epoch + 1_000_000_000) * 1000).cast("string"))
        .when(k == 5, epoch.cast("string"))
        .when(k == 6, quoted_text("Posted 3 Days Ago"))
        .when(k == 7, F.lit("null"))
        .when(k == 8, quoted_text(F.date_format(at, "yyyy")))
        .when(k == 9, F.lit("true"))
        .otherwise(quoted_text(day, "T12:00:00.123456-08:00"))
    )
    return table(spark, d, "orders").select(
        "o_orderkey", variants.timestamp(variants.parse(value)).alias("parsed")
    )


@query(
    "local_days",
    """SELECT event_id, CAST(local AS DATE) AS day,
      (date_trunc('day', local) AT TIME ZONE 'America/Los_Angeles') AT TIME ZONE 'UTC' AS starts
    FROM (SELECT event_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles' AS local FROM events)""",
)
def local_days(spark, d):
    day = timestamps.local_day(F.col("ts").cast("timestamp"), rules.TIME_ZONE)
    return table(spark, d, "events").select(
        "event_id", day.alias("day"), timestamps.day_start(day, rules.TIME_ZONE).alias("starts")
    )


_URL_SQL = r"""regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS netloc,
  regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS query,
  regexp_extract(url, '#(.*)$', 1) AS fragment"""


@query("url_parts", f"SELECT page_id, {_URL_SQL} FROM pages")
def url_parts(spark, d):
    return table(spark, d, "pages").select("page_id", urls.split_url(F.col("url")).alias("u")).select("page_id", "u.*")


@query(
    "url_forms",
    f"""WITH p AS (SELECT page_id, url, {_URL_SQL} FROM pages)
    SELECT page_id, scheme || '://' || netloc || path AS page, regexp_replace(url, '#.*$', '') AS link,
      array_to_string(string_split(netloc, '.')[-2:], '.') AS domain,
      CASE WHEN path LIKE '%/jobs%' THEN rtrim(string_split(url, '?')[1], '/') ELSE scheme || '://' || netloc || '/jobs' END AS icims,
      scheme || '://' || netloc || rtrim(path, '/') AS workday
    FROM p""",
)
def url_forms(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select(
        "page_id",
        urls.without_query(url).alias("page"),
        urls.without_fragment(url).alias("link"),
        urls.registrable_domain(urls.host(url)).alias("domain"),
        urls.icims_board_url(url).alias("icims"),
        urls.workday_board_url(url).alias("workday"),
    )


_BOARDS = [
    "https://Acme{n}.wd1.myworkdayjobs.com/en-US/Site{n}/login", "https://acme{n}.wd5.myworkdayjobs.com/Site{n}?q=1",
    "https://jobs.gem.com/co{n}/123", "https://jobs.smartrecruiters.com/Co{n}/x", "https://example.com/careers/",
]


@query(
    "board_slugs",
    f"""SELECT id, CASE WHEN m < 2 THEN 'acme' || id END AS tenant, CASE WHEN m < 2 THEN 'Site' || id END AS site,
      CASE m WHEN 0 THEN 'https://Acme' || id || '.wd1.myworkdayjobs.com' WHEN 1 THEN 'https://acme' || id || '.wd5.myworkdayjobs.com' END AS origin,
      CASE WHEN m = 2 THEN 'https://jobs.gem.com/co' || id
        ELSE rtrim(replace({sql_pick(_BOARDS, 'id')}, '{{n}}', CAST(id AS VARCHAR)), '/') END AS gem,
      CASE WHEN m = 3 THEN 'Co' || id END AS smart
    FROM (SELECT c_custkey AS id, c_custkey % 5 AS m FROM customer)""",
)
def board_slugs(spark, d):
    k = F.col("c_custkey")
    url = F.replace(pick(_BOARDS, k), F.lit("{n}"), k.cast("string"))
    parts = urls.workday_parts(url)
    return table(spark, d, "customer").select(
        k.alias("id"), parts["tenant"].alias("tenant"), parts["site"].alias("site"), parts["origin"].alias("origin"),
        urls.gem_board_url(url).alias("gem"), urls.smartrecruiters_slug(url).alias("smart"),
    )


_REFS = ["a/b", "../x", "?q=1", "//h.example.com/p?x", "/../y/./z", ".", "http://o.example.com", "a//b", "#top", "mailto:x", "./d/e/.."]


@query(
    "links_resolved",
    f"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^https?://[^/?#]+') AS origin, regexp_extract(url, '^(https?)', 1) AS scheme,
        regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, {sql_pick(_REFS, 'page_id')} AS ref FROM pages),
      q AS (SELECT *, origin || regexp_replace(path, '[^/]*$', '') AS folder FROM p)
    SELECT page_id, ref, CASE page_id % {len(_REFS)} WHEN 0 THEN folder || 'a/b' WHEN 1 THEN regexp_replace(folder, '([^/:])/[^/]+/$', '\\1/') || 'x'
      WHEN 2 THEN origin || path || '?q=1' WHEN 3 THEN scheme || '://h.example.com/p?x' WHEN 4 THEN origin || '/y/z' WHEN 5 THEN folder
      WHEN 7 THEN folder || 'a/b' WHEN 8 THEN regexp_replace(url, '#.*$', '') || '#top' WHEN 10 THEN folder || 'd/' ELSE ref END AS url FROM q""",
)
def links_resolved(spark, d):
    """Relative references of every form against page urls."""
    ref = pick(_REFS, F.col("page_id"))
    return table(spark, d, "pages").select("page_id", ref.alias("ref"), urls.resolve_url(F.col("url"), ref).alias("url"))


@query(
    "source_urls",
    f"""WITH {SQL_CUSTOMER_COMPANIES} SELECT id,
      CASE source_type WHEN 'greenhouse' THEN 'https://boards.greenhouse.io/' || token
        WHEN 'lever' THEN 'https://jobs.lever.co/' || token WHEN 'ashby' THEN 'https://jobs.ashbyhq.com/' || coalesce(token, '')
        WHEN 'smartrecruiters' THEN 'https://jobs.smartrecruiters.com/' || token
        WHEN 'gem' THEN rtrim(page, '/') WHEN 'workday' THEN rtrim(page, '/') WHEN 'icims' THEN rtrim(page, '/')
        WHEN 'generic_playwright' THEN rtrim(page, '/') ELSE coalesce(page, '') END AS careers,
      CASE WHEN c_custkey % 7 = 0 THEN CASE source_type WHEN 'greenhouse' THEN 'Greenhouse source_config requires board_token'
        WHEN 'lever' THEN 'Lever source_config requires company'
        WHEN 'smartrecruiters' THEN 'SmartRecruiters source_config requires company or careers_url'
        WHEN 'gem' THEN 'Gem source_config requires careers_url'
        WHEN 'workday' THEN 'workday source_config requires careers_url' WHEN 'icims' THEN 'icims source_config requires careers_url'
        WHEN 'generic_playwright' THEN 'generic_playwright source_config requires careers_url' END END AS error,
      CASE source_type WHEN 'greenhouse' THEN 'https://boards-api.greenhouse.io/v1/boards/' || token || '/jobs'
        WHEN 'lever' THEN 'https://api.lever.co/v0/postings/' || token
        WHEN 'ashby' THEN 'https://api.ashbyhq.com/posting-api/job-board/' || token
        WHEN 'smartrecruiters' THEN 'https://api.smartrecruiters.com/v1/companies/' || token || '/postings'
        WHEN 'gem' THEN rtrim(page, '/') WHEN 'workday' THEN rtrim(page, '/') WHEN 'icims' THEN rtrim(page, '/')
        WHEN 'generic_playwright' THEN rtrim(page, '/') END AS probe,
      source_type IN ('greenhouse', 'lever', 'ashby', 'smartrecruiters') AS expects_json
    FROM companies_v""",
)
def source_urls_query(spark, d):
    kind, config = F.col("source_type"), F.col("source_config")
    careers = source_urls.careers_url_or_error(kind, config)
    return customer_companies(spark, d).select(
        "id", careers["url"].alias("careers"), careers["error"].alias("error"),
        source_urls.validation_url_for(kind, config).alias("probe"), source_urls.expects_json(kind).alias("expects_json"),
    )


@query(
    "link_titles",
    f"""SELECT doc_id, CASE WHEN t = '' OR regexp_matches(t, '^(?i)apply( now)?$') THEN 'Open position'
      WHEN length(t) > 160 THEN substring(t, 1, 157) || '...' ELSE t END AS title
    FROM (SELECT doc_id, trim(regexp_replace(text, '{SPACE_SQL}+', ' ', 'g')) AS t FROM documents)""",
)
def link_titles(spark, d):
    return table(spark, d, "documents").select("doc_id", text.title_from_link_text(F.col("text")).alias("title"))


@query(
    "escaped_pages",
    """SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS digest
    FROM pages""",
)
def escaped_pages(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(text.html_escape(F.col("html")), 256).alias("digest"))


_MESSAGES = ["Client error '404' for url", "HTTP 404", "status 404", "page not found", "404 Not Found", "timed out", "Status 500"]


@query(
    "not_found_errors",
    f"""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id % 2 = 0
        ELSE lower(m) LIKE '%404%' AND regexp_matches(lower(m), 'not found|status|client error') END AS is_404,
      CASE {sql_pick(SOURCE_TYPES, 'event_id')}
        WHEN 'greenhouse' THEN 'Greenhouse board_token u' || user_id || ' returned 404' WHEN 'lever' THEN 'Lever company slug ? returned 404'
        WHEN 'ashby' THEN 'Ashby organization ? returned 404' WHEN 'smartrecruiters' THEN 'SmartRecruiters company ? returned 404'
        WHEN 'workday' THEN 'Workday careers_url returned 404' WHEN 'icims' THEN 'iCIMS careers_url returned 404'
        WHEN 'gem' THEN 'Gem careers_url returned 404' WHEN 'generic_playwright' THEN 'Generic Playwright careers_url returned 404'
        ELSE m END AS detail
    FROM (SELECT *, {sql_pick(_MESSAGES, 'event_id')} AS m FROM events)""",
)
def not_found_errors(spark, d):
    k = F.col("event_id")
    message, kind = pick(_MESSAGES, k), pick(SOURCE_TYPES, k)
    status = F.when(k % 3 == 0, F.when(k % 2 == 0, F.lit(404)).otherwise(F.lit(500)))
    config = F.create_map(F.lit("board_token"), F.concat(F.lit("u"), F.col("user_id").cast("string")))
    return table(spark, d, "events").select(
        "event_id",
        source_urls.is_not_found(status, message).alias("is_404"),
        source_urls.not_found_detail(kind, config, message).alias("detail"),
    )


_BOOLS = ["1", "true", " YES ", "y", "On", "0", "false", "", "no", None, "2"]


@query(
    "config_values",
    f"""SELECT event_id, CASE WHEN event_id % 5 > 1 THEN CAST(json_extract_string(props, '$.k') AS VARCHAR) END AS k,
      event_id % 5 > 1 AS is_object, coalesce(lower(trim({sql_pick(_BOOLS, 'event_id')})) IN ('1', 'true', 'yes', 'y', 'on'), false) AS flag
    FROM events""",
)
def config_values(spark, d):
    n = F.col("event_id")
    raw = F.when(n % 5 == 0, F.lit("{broken")).when(n % 5 == 1, F.lit("[1]")).otherwise(F.col("props"))
    document = variants.parse(raw)
    config = F.when(variants.is_kind(document, "OBJECT"), config_from_variant(document))
    return table(spark, d, "events").select(
        "event_id", F.try_element_at(config, F.lit("k")).alias("k"), config.isNotNull().alias("is_object"),
        source_urls.parse_bool(pick(_BOOLS, n)).alias("flag"),
    )


@query(
    "job_board_pages",
    f"""WITH {SQL_PAGES} SELECT page_id, (kind = 'gem' AND low LIKE '%jobs.gem.com%') OR (kind = 'icims' AND low LIKE '%icims%' AND low LIKE '%/jobs/%')
      OR (kind = 'workday' AND low LIKE '%workday%') OR (kind = 'smartrecruiters' AND (low LIKE '%smartrecruiters%' OR low LIKE '%posting%'))
      OR (length(body) >= 200 AND regexp_matches(body, {quoted('(?i)' + rules.JOB_BOARD_HINTS)})) AS is_board
    FROM (SELECT *, lower(body) AS low, {sql_pick(SOURCE_TYPES, 'page_id // 2')} AS kind FROM pages_v)""",
)
def job_board_pages(spark, d):
    kind = pick(SOURCE_TYPES, F.floor(F.col("page_id") / 2))
    return pages(spark, d).select("page_id", source_urls.looks_like_job_board(F.col("body"), kind).alias("is_board"))
