"""Queries for source discovery, job links and the crawl frontier."""

from __future__ import annotations

from pyspark.sql import functions as F

from gate.boards import SQL_ANCHORS, page_anchors
from gate.catalog import now
from gate.registry import query
from gate.surrogates import SQL_LINKS, SQL_PAGES, catalog_columns, pages, quoted
from tidemark import rules
from tidemark.operators import boards, companies as catalog, discovery, providers

_BOARD_HOSTS = " OR ".join(f"host LIKE '%{h}%'" for h in rules.BOARD_HOSTS)
_DOMAIN = "array_to_string(string_split({0}, '.')[-2:], '.')"
SQL_CANDIDATES = f"""iframes_v AS (SELECT page_id, page_url, origin, regexp_extract(body, '<iframe[^>]+src="([^"]+)"', 1) AS href FROM pages_v WHERE page_id % 11 = 3),
raw_v AS (SELECT page_id, page_url, origin, href, pos FROM hrefs_v UNION ALL SELECT page_id, page_url, origin, href, 1000000 FROM iframes_v),
cand_v AS (SELECT page_id, regexp_replace(CASE WHEN href LIKE '/%' THEN origin || href ELSE href END, '#.*$', '') AS url,
    arg_min(href, pos) AS href, any_value(origin) AS origin FROM raw_v GROUP BY 1, 2),
scored_v AS (SELECT page_id, url,
    CASE WHEN regexp_matches(url || ' ' || href, {quoted('(?i)' + rules.LINK_HINT)}) THEN 10 ELSE 0 END + CASE WHEN {_BOARD_HOSTS} THEN 25 ELSE 0 END
    + CASE WHEN {_DOMAIN.format('host')} = {_DOMAIN.format('page_host')} THEN 5 ELSE 0 END + CASE WHEN host = page_host THEN 3 ELSE 0 END AS score
  FROM (SELECT *, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS host, lower(regexp_extract(origin, '^https?://(.*)$', 1)) AS page_host FROM cand_v))"""


@query(
    "candidate_links",
    f"""WITH {SQL_PAGES}, {SQL_LINKS}, {SQL_CANDIDATES}
    SELECT page_id, rn - 1 AS rank, score, url FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, url) AS rn FROM scored_v WHERE score > 0)
    WHERE rn <= 5""",
)
def candidate_links(spark, d):
    links = discovery.candidate_links(F.col("body"), F.col("page_url"), limit=5)
    return pages(spark, d).select("page_id", F.posexplode(links).alias("rank", "link")).select("page_id", "rank", "link.*")


_SLUG, _WORD = "([a-z0-9_-]+)", """[^"''\\s<>]"""


def _first(pattern: str) -> str:
    return f"nullif(regexp_extract(t, '(?i){pattern}', 1), '')"


_BASE = "https://jobs.gem.com/"
SIGNATURES = [
    ("greenhouse", 100, True, _first(f"boards-api\\.greenhouse\\.io/v1/boards/{_SLUG}/"), "Greenhouse API board token: "),
    ("greenhouse", 95, True, _first(f"(?:boards|job-boards)\\.greenhouse\\.io/{_SLUG}"), "Greenhouse board URL token: "),
    ("lever", 100, True, _first(f"jobs\\.lever\\.co/{_SLUG}"), "Lever jobs URL slug: "),
    ("lever", 98, True, _first(f"api\\.lever\\.co/v0/postings/{_SLUG}"), "Lever API slug: "),
    ("ashby", 100, True, _first(f"jobs\\.ashbyhq\\.com/{_SLUG}"), "Ashby jobs org: "),
    ("ashby", 98, True, _first(f"api\\.ashbyhq\\.com/posting-api/job-board/{_SLUG}"), "Ashby posting API org: "),
    ("workday", 90, True, f"regexp_replace({_first(f'(https?://[a-z0-9.-]*\\.myworkdayjobs\\.com/{_WORD}+)')}, '/login$', '')", "Workday host: "),
    ("smartrecruiters", 88, True, _first(f"jobs\\.smartrecruiters\\.com/{_SLUG}"), "SmartRecruiters board: "),
    ("icims", 85, True, _first(f"(https?://[a-z0-9.-]*\\.icims\\.com{_WORD}*)"), "iCIMS URL: "),
    ("gem", 84, True, f"'{_BASE}' || {_first(f'jobs\\.gem\\.com/{_SLUG}')}", "Gem jobs board: "),
    ("taleo", 82, False, _first(f"(https?://{_WORD}*taleo\\.net{_WORD}*)"), "Taleo URL: "),
    ("eightfold", 84, False, _first(f"(https?://{_WORD}*eightfold\\.ai{_WORD}*)"), "Eightfold URL: "),
    ("oracle", 86, False, _first(f"(https?://[a-z0-9.-]*\\.oraclecloud\\.com/hcmUI/CandidateExperience{_WORD}*)"), "Oracle Cloud HCM: "),
]
SQL_SIGNATURES = "blob_v AS (SELECT page_id, company_id, page_ordinal, page_url, body || chr(10) || page_url AS t FROM pages_v), sig_v AS (" + " UNION ALL ".join(
    f"SELECT page_id, company_id, page_ordinal, {i} AS rule_ordinal, '{provider}' AS provider, {confidence} AS confidence, {str(supported).lower()} AS supported, v, '{evidence}' || v AS evidence "
    f"FROM (SELECT *, {value} AS v FROM blob_v) WHERE v IS NOT NULL"
    for i, (provider, confidence, supported, value, evidence) in enumerate(SIGNATURES)
) + f""" UNION ALL SELECT page_id, company_id, page_ordinal, 10, 'taleo', 70, false, NULL, 'Taleo reference in page (no board URL extracted)' FROM blob_v
    WHERE lower(t) LIKE '%taleo.net%' AND {SIGNATURES[10][3]} IS NULL)"""


@query("provider_signatures", f"WITH {SQL_PAGES}, {SQL_SIGNATURES} SELECT page_id, rule_ordinal, provider, confidence, supported, evidence FROM sig_v")
def provider_signatures(spark, d):
    return discovery.signature_candidates(pages(spark, d)).select(
        "page_id", "rule_ordinal", "provider", "confidence", F.col("source_type").isNotNull().alias("supported"), "evidence"
    )


SQL_BEST = """best_v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY supported DESC, confidence DESC, page_ordinal, rule_ordinal) AS rn FROM sig_v) WHERE rn = 1)"""


def best(spark, d):
    return discovery.best_candidates(discovery.signature_candidates(pages(spark, d)))


@query("best_signatures", f"WITH {SQL_PAGES}, {SQL_SIGNATURES}, {SQL_BEST} SELECT company_id, provider, confidence, evidence FROM best_v")
def best_signatures(spark, d):
    return best(spark, d).select("company_id", "provider", "confidence", "evidence")


def results(spark, d):
    landings = (
        pages(spark, d)
        .groupBy("company_id")
        .agg(F.min_by("page_url", "page_ordinal").alias("landing_url"))
        .withColumn("fetch_error", F.when(F.col("company_id") % 9 == 0, F.lit("403")))
    )
    return discovery.discovery_results(landings, best(spark, d))


_REASON = f"""CASE WHEN fetch_error IS NOT NULL THEN 'Failed to fetch careers landing page: ' || fetch_error WHEN supported THEN evidence
  WHEN provider IS NOT NULL THEN evidence || '. Provider ''' || provider || ''' is detected but not auto-enabled (supported scrapers: {', '.join(sorted(rules.SOURCE_TYPES))}).'
  ELSE 'No supported ATS pattern detected' END"""
SQL_RESULTS = f"""landing_v AS (SELECT company_id, arg_min(page_url, page_ordinal) AS landing_url, CASE WHEN company_id % 9 = 0 THEN '403' END AS fetch_error FROM pages_v GROUP BY company_id),
result_v AS (SELECT l.company_id, landing_url, fetch_error, provider, supported, v, evidence, {_REASON} AS reason,
  CASE WHEN fetch_error IS NOT NULL THEN 'errors' WHEN supported THEN 'configured_supported' WHEN provider IS NOT NULL THEN 'detected_unsupported' ELSE 'still_unknown' END AS bucket
  FROM landing_v l LEFT JOIN best_v b ON b.company_id = l.company_id)"""
_FOUND = f"WITH {SQL_PAGES}, {SQL_SIGNATURES}, {SQL_BEST}, {SQL_RESULTS}"


@query(
    "discovery_results",
    f"""{_FOUND} SELECT company_id, CASE WHEN bucket IN ('configured_supported', 'detected_unsupported') THEN provider ELSE '' END AS source_type, bucket, reason,
      CASE bucket WHEN 'configured_supported' THEN 'high' WHEN 'detected_unsupported' THEN 'medium' ELSE 'none' END AS confidence,
      CASE WHEN bucket = 'detected_unsupported' THEN coalesce(rtrim(v, '/'), landing_url) ELSE landing_url END AS final_careers_url FROM result_v""",
)
def discovery_results(spark, d):
    return results(spark, d).select("company_id", "source_type", "bucket", "reason", "confidence", "final_careers_url")


def discovery_targets(spark, d):
    return catalog_columns(
        pages(spark, d).select(F.col("company_id").alias("id")).distinct().select(
            "id", F.concat(F.lit("Company "), F.col("id").cast("string")).alias("name"), F.lit(rules.UNCONFIGURED).alias("source_type"),
            F.lit(False).alias("enabled"), F.lit("old").alias("last_error"),
        )
    )


def applied(spark, d, targets=None, **options):
    targets = discovery_targets(spark, d) if targets is None else targets
    probes = targets.select(
        F.col("id").alias("company_id"), now().alias("probed_at"), F.when(F.col("id") % 2 == 0, 200).otherwise(500).alias("status_code"),
        F.lit('{"x": "jobs.gem.com icims /jobs/ workday"}').alias("body"), F.lit(None).cast("string").alias("error"),
        F.lit(None).cast("int").alias("rendered_status"), F.lit(None).cast("string").alias("rendered_error"),
    )
    return catalog.apply_discovery(targets, results(spark, d), probes, **options)


@query(
    "discovery_applied",
    f"""{_FOUND} SELECT company_id AS id, CASE WHEN bucket = 'configured_supported' THEN provider ELSE 'unconfigured' END AS source_type,
      bucket = 'configured_supported' AND company_id % 2 = 0 AS enabled,
      CASE WHEN bucket = 'errors' THEN 'old' WHEN bucket = 'configured_supported' THEN CASE WHEN company_id % 2 = 1 THEN 'HTTP 500' END ELSE reason END AS last_error
    FROM result_v""",
)
def discovery_applied(spark, d):
    return applied(spark, d)[0].select("id", "source_type", "enabled", "last_error")


def some_configured(spark, d):
    """Discovery targets of which every third has a source already."""
    has = F.col("id") % 3 == 0
    return discovery_targets(spark, d).withColumns({"source_type": F.when(has, "lever").otherwise(F.col("source_type")), "enabled": has | F.col("enabled")})


@query(
    "discovery_spares_configured",
    f"""{_FOUND} SELECT company_id AS id, CASE WHEN company_id % 3 = 0 THEN 'lever' WHEN bucket = 'configured_supported' THEN provider ELSE 'unconfigured' END AS source_type,
      company_id % 3 = 0 OR bucket = 'configured_supported' AND company_id % 2 = 0 AS enabled,
      CASE WHEN company_id % 3 = 0 OR bucket = 'errors' THEN 'old' WHEN bucket = 'configured_supported' THEN CASE WHEN company_id % 2 = 1 THEN 'HTTP 500' END ELSE reason END AS last_error
    FROM result_v""",
)
def discovery_spares_configured(spark, d):
    """Companies that have a source keep it, whatever was found on their pages."""
    return applied(spark, d, some_configured(spark, d))[0].select("id", "source_type", "enabled", "last_error")


@query(
    "discovery_replaces_configured",
    f"""{_FOUND} SELECT company_id AS id, CASE WHEN bucket = 'errors' AND company_id % 3 = 0 THEN 'lever' WHEN bucket = 'configured_supported' THEN provider ELSE 'unconfigured' END AS source_type,
      CASE WHEN bucket = 'errors' THEN company_id % 3 = 0 ELSE bucket = 'configured_supported' AND company_id % 2 = 0 END AS enabled FROM result_v""",
)
def discovery_replaces_configured(spark, d):
    """The same targets where finds replace what is configured."""
    return applied(spark, d, some_configured(spark, d), replace_configured=True)[0].select("id", "source_type", "enabled")


@query(
    "discovery_counters",
    f"""{_FOUND} SELECT count(*) AS processed, {', '.join(f"count(*) FILTER (WHERE bucket = '{b}') AS {b}" for b in ('configured_supported', 'detected_unsupported', 'still_unknown', 'errors'))},
      count(*) FILTER (WHERE bucket = 'configured_supported' AND company_id % 2 = 0) AS enabled_after_validation FROM result_v""",
)
def discovery_counters(spark, d):
    return applied(spark, d)[1]


# ---- job links -----------------------------------------------------------------------------
def _any(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {quoted('(?i)' + pattern)})"


SQL_LINK_TESTS = f"""resolved_v AS (SELECT * EXCLUDE (text), trim(text) AS text, origin || href AS url FROM anchors_v),
tested_v AS (SELECT *, {_any('url', rules.REJECT_URL)} OR {_any("url || ' ' || text", rules.REJECT_TEXT)} OR {_any('text', '^apply( now)?$')}
    OR ({_any('text', r'\bapply\b')} AND length(text) < 24) AS rejected,
  regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\\?(.*)$', 1) AS qs FROM resolved_v),
flagged_v AS (SELECT *, NOT rejected AND ({_any("path || ' ' || qs || ' ' || text", rules.ACCEPT_TEXT)} OR {_any("path || ' ' || qs || ' ' || text", rules.JOB_PATH_HINT)}) AS is_job FROM tested_v)"""
_ANCHORED = f"WITH {SQL_PAGES}, {SQL_LINKS}, {SQL_ANCHORS}, {SQL_LINK_TESTS}"


@query(
    "job_link_scores",
    f"""{_ANCHORED} SELECT page_id, anchor_ordinal, rejected, is_job, CASE WHEN NOT is_job THEN -1 ELSE 10
      + CASE WHEN low LIKE '%/job/%' OR low LIKE '%/jobs/%' THEN 20 ELSE 0 END + CASE WHEN low LIKE '%engineer%' OR low LIKE '%software%' THEN 8 ELSE 0 END
      + CASE WHEN low LIKE '%requisition%' OR low LIKE '%posting%' THEN 6 ELSE 0 END + CASE WHEN length(text) > 8 THEN 4 ELSE 0 END END AS score
    FROM (SELECT *, lower(url || ' ' || text) AS low FROM flagged_v)""",
)
def job_link_scores(spark, d):
    url, text = F.concat("origin", "href"), F.trim("text")
    return page_anchors(spark, d).select(
        "page_id", "anchor_ordinal", discovery.is_rejected_url(url, text).alias("rejected"),
        discovery.is_job_link(url, text).alias("is_job"), discovery.job_link_score(url, text).alias("score"),
    )


CAP = 2
# merge with a cap, once per page and once per company: rows up to the first sight of the last place
def sql_merged(per_page: float, per_company: float) -> str:
    return f"""titled_v AS (SELECT *, CASE WHEN text = '' THEN 'Open position' ELSE regexp_replace(text, '\\s+', ' ', 'g') END AS title FROM flagged_v WHERE is_job),
page_first AS (SELECT page_id, url, min(anchor_ordinal) AS f FROM titled_v GROUP BY 1, 2),
page_rank AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY f) AS rank FROM page_first),
page_stop AS (SELECT page_id, max(f) FILTER (WHERE rank = {per_page}) AS stop FROM page_rank GROUP BY 1),
page_links AS (SELECT page_id, company_id, page_ordinal, url, rank, title, location FROM (
  SELECT t.*, rank, row_number() OVER (PARTITION BY t.page_id, t.url ORDER BY length(title) DESC, anchor_ordinal) AS rn FROM titled_v t
  JOIN page_rank r ON r.page_id = t.page_id AND r.url = t.url AND rank <= {per_page} JOIN page_stop s ON s.page_id = t.page_id AND (stop IS NULL OR anchor_ordinal <= stop)) WHERE rn = 1),
co_first AS (SELECT company_id, url, min((page_ordinal, rank)) AS f FROM page_links GROUP BY 1, 2),
co_rank AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY f) AS place FROM co_first),
co_stop AS (SELECT company_id, max(f) FILTER (WHERE place = {per_company}) AS stop FROM co_rank GROUP BY 1),
co_links AS (SELECT company_id, place AS rank, url, title, location FROM (
  SELECT p.*, place, row_number() OVER (PARTITION BY p.company_id, p.url ORDER BY length(title) DESC, (page_ordinal, p.rank)) AS rn FROM page_links p
  JOIN co_rank r ON r.company_id = p.company_id AND r.url = p.url AND place <= {per_company} JOIN co_stop s ON s.company_id = p.company_id AND (stop IS NULL OR (page_ordinal, p.rank) <= stop)) WHERE rn = 1)"""


SQL_MERGED = sql_merged(CAP, CAP * 2)
NO_CAP = 10**9


def merged_links(spark, d, per_page=CAP, per_company=CAP * 2):
    links = discovery.merge_page_links(discovery.anchor_links(page_anchors(spark, d)), discovery.PAGE, ["pos"], per_page)
    return discovery.merge_links(links.withColumnRenamed("rank", "pos"), ["company_id"], ["page_ordinal", "pos"], per_company)


@query("merged_job_links", f"{_ANCHORED}, {SQL_MERGED} SELECT * FROM co_links")
def merged_job_links(spark, d):
    return merged_links(spark, d)


@query(
    "generic_postings",
    f"""{_ANCHORED}, {sql_merged(NO_CAP, NO_CAP)} SELECT company_id, rank - 1 AS ordinal, 'generic_playwright' AS source_type, title, url, location FROM co_links""",
)
def generic_postings(spark, d):
    rows = merged_links(spark, d, None, None).withColumns(
        {
            "cycle_ts": now(), "page_ordinal": F.lit(0), "pos": F.col("rank") - 1, "company_name": F.lit("x"),
            "careers_url": F.lit("https://x"), "source_config": catalog.empty_config(),
        }
    )
    return providers.generic_links(rows).select("company_id", "ordinal", "source_type", "title", "url", "location")


@query(
    "job_links_of_companies",
    f"{_ANCHORED}, {sql_merged(200, 200)} SELECT * FROM co_links",
)
def job_links_of_companies(spark, d):
    return discovery.job_links(page_anchors(spark, d))


_PATH_HINTS = " OR ".join(f"low LIKE '%{h}%'" for h in rules.FOLLOW_PATH_HINTS)
_EXACT = ", ".join(map(quoted, rules.FOLLOW_EXACT_PATHS))


@query(
    "next_pages",
    f"""WITH {SQL_PAGES}, {SQL_LINKS}, own AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS key, arg_min(url, rank) AS url FROM links_v
        WHERE url LIKE origin || '/%' GROUP BY 1, 2),
      scored AS (SELECT page_id, url, CASE WHEN {_PATH_HINTS} THEN 15 ELSE 0 END + CASE WHEN {_any('low', rules.JOB_PATH_HINT)} THEN 10 ELSE 0 END
          + CASE WHEN low IN ({_EXACT}) THEN 20 ELSE 0 END AS score
        FROM (SELECT *, lower(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)) AS low FROM own)
        WHERE NOT ({_any('url', rules.REJECT_URL)} OR {_any("url || ' '", rules.REJECT_TEXT)}))
    SELECT page_id, score, url FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, url) AS rn FROM scored WHERE score > 0) WHERE rn <= 20""",
)
def next_pages(spark, d):
    links = boards.page_links(pages(spark, d)).withColumn("landing_url", F.col("page_url"))
    numbers = pages(spark, d).select("page_id", "company_id", "page_ordinal")
    return discovery.next_pages(links).join(numbers, ["company_id", "page_ordinal"]).select("page_id", "score", "url")
