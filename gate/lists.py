"""Queries for job lists, digests and metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gate.ingest import SQL_KEPT, SQL_SETTING, _PER_COMPANY, setting
from gate.registry import ORACLES, query
from gate.surrogates import SQL_STATE, companies, job_state, postings, sql_postings
from tidemark.operators import companies as catalog, digest, ingest, lists, metrics
from tidemark.session import shared_folder
from tidemark.sources import sinks

DAY = "1995-04-01"
ZONE = "America/Los_Angeles"
_STATE = f"WITH {sql_postings()}, {SQL_STATE}"
_LOCAL = f"CAST((first_seen_at AT TIME ZONE 'UTC') AT TIME ZONE '{ZONE}' AS DATE)"
_LIST = ["id", "company_id", "title", "location", "first_seen_at", "is_active"]


def state(spark, d):
    return job_state(postings(spark, d))


@query(
    "jobs_list",
    f"""{_STATE} SELECT id, company_id, title, location, first_seen_at, is_active
    FROM state_v JOIN nation ON n_nationkey + 1 = company_id
    WHERE n_name ILIKE '%nation_1%' AND is_active AND is_entry_level ORDER BY first_seen_at DESC, id LIMIT 50 OFFSET 20""",
)
def jobs_list(spark, d):
    items, _ = lists.list_jobs(
        state(spark, d), companies(spark, d), company=" nation_1 ", is_active=True, is_entry_level=True, limit=50, offset=20
    )
    return items.select(_LIST)


@query(
    "jobs_list_total",
    f"""{_STATE} SELECT count(*) AS total FROM state_v JOIN nation ON n_nationkey + 1 = company_id
    WHERE n_name ILIKE '%nation_1%' AND is_active AND is_entry_level""",
)
def jobs_list_total(spark, d):
    return lists.list_jobs(state(spark, d), companies(spark, d), company="nation_1", is_active=True, is_entry_level=True)[1]


@query("jobs_of_company", f"{_STATE} SELECT id, company_id, title, location, first_seen_at, is_active FROM state_v WHERE company_id = 3 AND NOT is_active")
def jobs_of_company(spark, d):
    return lists.filter_jobs(state(spark, d), company_id=3, is_active=False).select(_LIST)


@query("jobs_by_name_pattern", f"""{_STATE} SELECT id, company_id FROM state_v JOIN nation ON n_nationkey + 1 = company_id WHERE n_name ILIKE '%n%_2%'""")
def jobs_by_name_pattern(spark, d):
    return lists.by_company_name(state(spark, d), companies(spark, d), "n%_2").select("id", "company_id")


@query("jobs_with_company", f"{_STATE} SELECT id, CASE WHEN company_id % 4 = 0 THEN 'Unknown' ELSE n_name END AS company_name FROM state_v JOIN nation ON n_nationkey + 1 = company_id")
def jobs_with_company(spark, d):
    known = companies(spark, d).filter(F.col("id") % 4 != 0)
    return lists.with_company_name(state(spark, d), known).select("id", "company_name")


@query("jobs_first_seen_on_day", f"{_STATE} SELECT id, first_seen_at FROM state_v WHERE {_LOCAL} = DATE '{DAY}'")
def jobs_first_seen_on_day(spark, d):
    return lists.filter_jobs(state(spark, d), first_seen_day=DAY).select("id", "first_seen_at")


@query(
    "new_today",
    f"""{_STATE} SELECT id, company_id, title, location, first_seen_at, is_active FROM state_v WHERE {_LOCAL} = DATE '{DAY}'
    ORDER BY company_id, title, id LIMIT 100""",
)
def new_today(spark, d):
    return lists.new_today(state(spark, d), DAY)[0].select(_LIST)


@query("new_today_total", f"{_STATE} SELECT count(*) AS total FROM state_v WHERE {_LOCAL} = DATE '{DAY}'")
def new_today_total(spark, d):
    return lists.new_today(state(spark, d), DAY)[1]


AS_OF = "1995-04-02"


@query("jobs_in_window", f"{_STATE} SELECT id, first_seen_at FROM state_v WHERE first_seen_at >= TIMESTAMP '{AS_OF}' - INTERVAL 36 HOUR")
def jobs_in_window(spark, d):
    return lists.seen_since(state(spark, d), F.lit(AS_OF).cast("timestamp"), 36).select("id", "first_seen_at")


@query("jobs_in_order", f"{_STATE} SELECT id, company_id, title FROM state_v ORDER BY id")
def jobs_in_order(spark, d):
    return state(spark, d).select("id", "company_id", "title").orderBy("id")


_CANDIDATES = f"""{_STATE}, cand AS (SELECT s.*, n_name AS company_name FROM state_v s JOIN nation ON n_nationkey + 1 = company_id
  WHERE is_entry_level AND is_software_engineering_related AND first_seen_at >= TIMESTAMP '{AS_OF}' - INTERVAL 36 HOUR)"""


def candidates(spark, d):
    return digest.select_digest_jobs(
        state(spark, d), companies(spark, d), F.lit(AS_OF).cast("timestamp"), lookback_hours=36
    )


@query("digest_candidates", f"{_CANDIDATES} SELECT id, company_id, title, company_name FROM cand")
def digest_candidates(spark, d):
    return candidates(spark, d).select("id", "company_id", "title", "company_name")


@query(
    "digest_candidates_of_day",
    f"""{_STATE} SELECT id, company_id, title FROM state_v WHERE is_entry_level AND is_software_engineering_related AND {_LOCAL} = DATE '{DAY}'""",
)
def digest_candidates_of_day(spark, d):
    chosen = digest.select_digest_jobs(state(spark, d), companies(spark, d), F.lit(AS_OF).cast("timestamp"), lookback_hours=0, day=DAY)
    return chosen.select("id", "company_id", "title")


@query(
    "digest_candidates_default_day",
    f"""{_STATE} SELECT id, company_id, title FROM state_v WHERE is_entry_level AND is_software_engineering_related AND {_LOCAL} = DATE '{DAY}'""",
)
def digest_candidates_default_day(spark, d):
    """No day given: the local day of an evening that is the next day in UTC."""
    chosen = digest.select_digest_jobs(state(spark, d), companies(spark, d), F.lit(f"{AS_OF} 03:00").cast("timestamp"))
    return chosen.select("id", "company_id", "title")


def _esc(x):
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        x = f"replace({x}, '{raw}'" + f", '{entity}')" if raw != "''" else f"replace({x}, '''', '{entity}')"
    return x


_ITEMS = f"""items AS (SELECT company_name, 1 AS part, company_id, title, id,
    '<li style="margin-bottom:10px;"><a href="' || {_esc('url')} || '">' || {_esc('title')} || '</a>' ||
      CASE WHEN meta <> '' THEN '<br/><span style="color:#555;font-size:13px;">' || {_esc('meta')} || '</span>' ELSE '' END || '</li>' AS html,
    '- ' || title || chr(10) || '  ' || url || CASE WHEN meta <> '' THEN chr(10) || '  ' || meta ELSE '' END AS text
  FROM (SELECT *, concat_ws(' — ', nullif(location, ''), strftime(posted_at, '%Y-%m-%d')) AS meta FROM cand))"""


@query(
    "digest_fragments",
    f"""{_CANDIDATES}, {_ITEMS} SELECT * FROM items
    UNION ALL SELECT DISTINCT company_name, 0, NULL, NULL, NULL, '<h3 style="margin:20px 0 8px;">' || company_name || '</h3><ul style="margin:0;padding-left:20px;">', '## ' || company_name FROM cand
    UNION ALL SELECT DISTINCT company_name, 2, NULL, NULL, NULL, '</ul>', '' FROM cand""",
)
def digest_fragments(spark, d):
    return digest.digest_fragments(candidates(spark, d))


_DAY_CAND = f"""{_STATE}, cand AS (SELECT s.*, n_name AS company_name FROM state_v s JOIN nation ON n_nationkey + 1 = company_id
  WHERE is_entry_level AND is_software_engineering_related AND {_LOCAL} = DATE '{DAY}')"""


@query(
    "digest_document",
    f"""{_DAY_CAND}, {_ITEMS}, sections AS (SELECT company_name,
      '<h3 style="margin:20px 0 8px;">' || company_name || '</h3><ul style="margin:0;padding-left:20px;">' || string_agg(html, '' ORDER BY company_id, title, id) || '</ul>' AS html,
      '## ' || company_name || chr(10) || string_agg(text, chr(10) ORDER BY company_id, title, id) || chr(10) AS text FROM items GROUP BY company_name)
    SELECT 'New Entry-Level SWE Jobs — {DAY}' AS subject,
      coalesce('<html><body style="font-family:system-ui,Segoe UI,Roboto,sans-serif;font-size:15px;line-height:1.5;"><h2 style="margin:0 0 12px;">New entry-level SWE jobs — {DAY}</h2>'
        || string_agg(html, '' ORDER BY company_name) || '</body></html>', '<p>No new entry-level SWE jobs today.</p>') AS html,
      coalesce('New entry-level SWE jobs — {DAY}' || chr(10) || chr(10) || rtrim(string_agg(text, chr(10) ORDER BY company_name), chr(10)), 'No new entry-level SWE jobs today.') AS text
    FROM sections""",
)
def digest_document(spark, d):
    chosen = digest.select_digest_jobs(state(spark, d), companies(spark, d), F.lit(AS_OF).cast("timestamp"), day=DAY)
    return digest.digest_document(chosen, DAY)


@query("digest_stored", ORACLES["digest_document"])
def digest_stored(spark, d):
    """The document as the sink stores it, written twice for its day."""
    folder = f"{shared_folder(spark)}/digest-{uuid.uuid4().hex}"
    for _ in range(2):
        sinks.write_digest(digest_document(spark, d), folder, DAY)
    return spark.read.parquet(folder).select("subject", "html", "text")


@query(
    "digest_metrics",
    f"""{_CANDIDATES} SELECT count(*) AS digest_candidates_count, count(*) AS digest_jobs_count, 'last 36 hours (UTC)' AS digest_window FROM cand""",
)
def digest_metrics(spark, d):
    doc = digest.digest_window(36)
    fields = "digest_candidates_count bigint, digest_jobs_count bigint, digest_window string"
    return metrics.digest_metrics(candidates(spark, d), doc).select(F.from_json("metrics", fields).alias("m")).select("m.*")


_METRIC_FIELDS = (
    "companies_scanned bigint, jobs_seen_total bigint, new_jobs_created_all bigint, new_swe_jobs_created bigint, "
    "new_entry_level_swe_jobs_created bigint, jobs_skipped_international bigint, inactive_jobs_marked bigint, jobs_seen bigint, "
    "scraper_failure_count bigint, digest_candidates_count bigint"
)


@query(
    "scrape_metrics",
    f"""WITH {SQL_SETTING}, {SQL_KEPT}, per AS ({_PER_COMPANY})
    SELECT count(*) AS companies_scanned, CAST(sum(jobs_seen_total) AS BIGINT) AS jobs_seen_total, CAST(sum(jobs_inserted_total) AS BIGINT) AS new_jobs_created_all,
      CAST(sum(jobs_inserted_software_related) AS BIGINT) AS new_swe_jobs_created, CAST(sum(jobs_inserted_digest_eligible) AS BIGINT) AS new_entry_level_swe_jobs_created,
      CAST(sum(jobs_skipped_international) AS BIGINT) AS jobs_skipped_international, CAST(sum(inactive_jobs_marked) AS BIGINT) AS inactive_jobs_marked,
      CAST(sum(jobs_seen_total) AS BIGINT) AS jobs_seen, (SELECT count(*) FROM snapshots_v WHERE outcome = 'failed') AS scraper_failure_count,
      7 AS digest_candidates_count, 'Scrape pipeline completed with partial failures' AS message,
      (SELECT string_agg(r_name || ': ' || CASE WHEN error LIKE '%404%' THEN 'invalid_source_config (Greenhouse board_token ? returned 404)' ELSE error END, '|' ORDER BY company_id)
        FROM snapshots_v JOIN nation ON n_nationkey + 1 = company_id JOIN region ON r_regionkey = n_regionkey WHERE outcome = 'failed') AS failures
    FROM per""",
)
def scrape_metrics(spark, d):
    jobs, owners, shots, batch = setting(spark, d)
    merged = ingest.merge_snapshots(jobs, owners, shots, batch)
    counters = ingest.ingest_counters(merged, owners, shots, batch)
    failures = metrics.scrape_failures(catalog.apply_outcomes(owners, shots))
    doc = metrics.scrape_metrics(counters, failures, 7)
    fields = _METRIC_FIELDS + ", scraper_failures array<string>"
    return doc.select(F.from_json("metrics", fields).alias("m"), "message").select(
        "m.*", F.array_join("m.scraper_failures", "|").alias("failures"), "message"
    ).drop("scraper_failures")
