"""Queries for the company catalog: imports, probes, outcomes, selection, summaries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gate.registry import query
from gate.surrogates import (
    SOURCE_TYPES, SQL_CUSTOMER_COMPANIES, SQL_SNAPSHOTS, customer_companies, companies, outcomes, pick, quoted, snapshots, sql_pick, table,
)
from tidemark import rules
from tidemark.functions import variants
from tidemark.operators import companies as catalog, metrics, streaks as failure_fold
from tidemark.plans.cycle import NO_CAPTURE, unscraped
from tidemark.session import shared_folder
from tidemark.sources import targets

NOW = "2002-02-02"


def now():
    return F.lit(NOW).cast("timestamp")


# ---- imports: customers as target rows -----------------------------------------------------
# names repeat after 400 rows per thousand; every 50th row is bad in one of four ways
def raw_targets(spark, d):
    k = F.col("c_custkey")
    bad = F.when(k % 50 == 49, F.floor(k / 50) % 4)
    return table(spark, d, "customer").select(
        F.when(bad == 0, F.lit("  ")).otherwise(F.concat(F.lit(" Target "), (k % 400).cast("string"), F.lit(" "))).alias("name"),
        F.col("c_mktsegment").alias("category"),
        F.lit("list").alias("source_list"),
        F.when(bad == 1, F.lit("")).otherwise(F.concat(F.lit("https://t.example.com/"), k.cast("string"))).alias("careers_url"),
        F.upper(pick(SOURCE_TYPES, k % 400)).alias("source_type"),
        F.when(bad == 2, F.lit("{oops")).when(bad == 3, F.lit("[1]"))
        .when(k % 3 == 0, F.concat(F.lit('{"board_token": "t'), k.cast("string"), F.lit('", "n": 5}'))).alias("source_config_json"),
        F.lit("1").alias("priority"),
        F.when(k % 4 == 0, F.lit("Yes")).when(k % 4 == 1, F.lit("no")).otherwise(F.lit("1")).alias("enabled"),
        (k + 2).alias("line_number"),
    )


_SUPPORTED = ", ".join(map(quoted, rules.SOURCE_TYPES))
SQL_TARGETS = f"""raw_v AS (
  SELECT c_custkey + 2 AS line_number, 'Target ' || (c_custkey % 400) AS name, 'https://t.example.com/' || c_custkey AS careers_url,
    {sql_pick(SOURCE_TYPES, 'c_custkey % 400')} AS kind, CASE WHEN c_custkey % 3 = 0 THEN 't' || c_custkey END AS token,
    c_custkey % 4 <> 1 AS enabled, CASE WHEN c_custkey % 50 = 49 THEN (c_custkey // 50) % 4 END AS bad FROM customer),
good_v AS (SELECT *, kind IN ({_SUPPORTED}) AS known FROM raw_v WHERE bad IS NULL),
rows_v AS (SELECT name, careers_url, CASE WHEN known THEN kind ELSE 'unconfigured' END AS source_type, CASE WHEN known THEN token END AS token,
  known AND enabled AS enabled, CASE WHEN NOT known THEN 'Needs ATS/source config' END AS last_error, line_number AS ordinal FROM good_v),
stored_v AS (SELECT c_custkey + 1 AS id, 'Target ' || (c_custkey % 700) AS name, {sql_pick(SOURCE_TYPES, 'c_custkey % 400')} AS source_type,
  'https://own.example.com/' || c_custkey AS careers_url FROM customer)"""


def stored(spark, d):
    k = F.col("c_custkey")
    return customer_companies(spark, d).select(
        *[c for c in customer_companies(spark, d).columns if c not in ("name", "source_type", "careers_url")]
    ).withColumn("c_custkey", F.col("id") - 1).withColumns(
        {
            "name": F.concat(F.lit("Target "), (k % 700).cast("string")),
            "source_type": pick(SOURCE_TYPES, k % 400),
            "careers_url": F.concat(F.lit("https://own.example.com/"), k.cast("string")),
        }
    ).drop("c_custkey")


@query(
    "target_rejects",
    f"""WITH {SQL_TARGETS} SELECT line_number, 'line ' || line_number || ': ' || CASE bad WHEN 0 THEN 'name is required'
      WHEN 1 THEN 'careers_url is required for ''' || name || '''' WHEN 2 THEN 'invalid source_config_json'
      ELSE 'source_config_json must be a JSON object' END AS row_error FROM raw_v WHERE bad IS NOT NULL""",
)
def target_rejects(spark, d):
    _, rejects = targets.split_targets(targets.parse_targets(raw_targets(spark, d)), "quarantine")
    return rejects.select("line_number", "row_error")


@query("target_rows", f"WITH {SQL_TARGETS} SELECT * FROM rows_v")
def target_rows(spark, d):
    good, _ = targets.split_targets(targets.parse_targets(raw_targets(spark, d)), "quarantine")
    return catalog.normalize_targets(good).select(
        "name", "careers_url", "source_type", F.try_element_at("source_config", F.lit("board_token")).alias("token"), "enabled", "last_error", "ordinal"
    )


def imported(spark, d):
    good, _ = targets.split_targets(targets.parse_targets(raw_targets(spark, d)), "quarantine")
    return catalog.upsert_companies(stored(spark, d), catalog.normalize_targets(good), now())


_MATCH = """keyed AS (SELECT name, source_type, arg_max(careers_url, ordinal) AS new_url, arg_max(enabled, ordinal) AS new_enabled,
    max_by({'e': last_error}, ordinal).e AS new_error, min(ordinal) AS ordinal, count(*) AS n FROM rows_v GROUP BY 1, 2),
  matched AS (SELECT k.*, s.id FROM keyed k LEFT JOIN (SELECT name, source_type, min(id) AS id FROM stored_v GROUP BY 1, 2) s
    ON s.name = k.name AND s.source_type = k.source_type)"""


@query(
    "imported_companies",
    f"""WITH {SQL_TARGETS}, {_MATCH} SELECT s.id, s.name, s.source_type, coalesce(m.new_url, s.careers_url) AS careers_url,
      coalesce(m.new_enabled, (s.id - 1) % 5 <> 0) AS enabled,
      CASE WHEN m.id IS NOT NULL THEN m.new_error WHEN (s.id - 1) % 3 > 0 THEN 'earlier error' END AS last_error
    FROM stored_v s LEFT JOIN matched m ON m.id = s.id
    UNION ALL SELECT (SELECT max(id) FROM stored_v) + ordinal, name, source_type, new_url, new_enabled, new_error FROM matched WHERE id IS NULL""",
)
def imported_companies(spark, d):
    return imported(spark, d)[0].select("id", "name", "source_type", "careers_url", "enabled", "last_error")


@query(
    "import_tally",
    f"""WITH {SQL_TARGETS}, {_MATCH} SELECT count(*) FILTER (WHERE id IS NULL) AS inserted,
      CAST(sum(n) - count(*) FILTER (WHERE id IS NULL) AS BIGINT) AS updated, CAST(0 AS BIGINT) AS skipped,
      CAST(sum(CASE WHEN source_type = 'unconfigured' THEN n ELSE 0 END) AS BIGINT) AS unconfigured FROM matched""",
)
def import_tally(spark, d):
    return imported(spark, d)[1]


@query(
    "json_import",
    f"""WITH {SQL_TARGETS}, rows_j AS (SELECT c_custkey + 1 AS ordinal, 'Target ' || (c_custkey % 900) AS name, 'lever' AS source_type,
        CASE WHEN c_custkey % 2 = 0 THEN 'https://j.example.com/' || c_custkey ELSE 'https://jobs.lever.co/j' || c_custkey END AS url,
        CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 2 = 0 END AS enabled FROM customer),
      keyed AS (SELECT name, source_type, arg_max(url, ordinal) AS new_url, arg_max(enabled, ordinal) FILTER (WHERE enabled IS NOT NULL) AS new_enabled, min(ordinal) AS ordinal
        FROM rows_j GROUP BY 1, 2),
      matched AS (SELECT k.*, s.id FROM keyed k LEFT JOIN (SELECT name, source_type, min(id) AS id FROM stored_v GROUP BY 1, 2) s
        ON s.name = k.name AND s.source_type = k.source_type)
    SELECT s.id, s.name, coalesce(m.new_url, s.careers_url) AS careers_url, coalesce(m.new_enabled, (s.id - 1) % 5 <> 0) AS enabled
    FROM stored_v s LEFT JOIN matched m ON m.id = s.id
    UNION ALL SELECT (SELECT max(id) FROM stored_v) + ordinal, name, new_url, coalesce(new_enabled, true) FROM matched WHERE id IS NULL""",
)
def json_import(spark, d):
    k = F.col("c_custkey")
    item = F.struct(
        F.concat(F.lit("Target "), (k % 900).cast("string")).alias("name"),
        F.lit("lever").alias("source_type"),
        F.struct(F.concat(F.lit("j"), k.cast("string")).alias("company")).alias("source_config"),
        F.when(k % 2 == 0, F.concat(F.lit("https://j.example.com/"), k.cast("string"))).alias("careers_url"),
        F.when(k % 3 == 0, k % 2 == 0).alias("enabled"),
    )
    items = table(spark, d, "customer").select(k.alias("pos"), variants.parse(F.to_json(item)).alias("item"))
    rows = targets.company_rows(items)
    after, _ = catalog.upsert_companies(stored(spark, d), rows.drop("row_error"), now(), set_error=False)
    return after.select("id", "name", "careers_url", "enabled")


@query(
    "seeded_companies",
    f"""WITH {SQL_TARGETS}, extra AS (SELECT 'Target ' || (c_custkey % 1000) AS name, min(c_custkey + 1) AS ordinal FROM customer GROUP BY 1)
    SELECT id, name FROM stored_v UNION ALL SELECT (SELECT max(id) FROM stored_v) + ordinal, name FROM extra WHERE name NOT IN (SELECT name FROM stored_v)""",
)
def seeded_companies(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(
        F.concat(F.lit("Target "), (k % 1000).cast("string")).alias("name"), F.lit("https://s.example.com").alias("careers_url"),
        F.lit("ashby").alias("source_type"), catalog.empty_config().alias("source_config"), F.lit(False).alias("enabled"), (k + 1).alias("ordinal"),
    )
    return catalog.seed_missing(stored(spark, d), rows, now()).select("id", "name")


@query(
    "created_company",
    f"""WITH {SQL_CUSTOMER_COMPANIES} SELECT id, name, enabled FROM companies_v UNION ALL SELECT max(id) + 1, 'New', true FROM companies_v""",
)
def created_company(spark, d):
    row = spark.range(1).select(
        F.lit("New").alias("name"), F.lit("https://n").alias("careers_url"), F.lit("gem").alias("source_type"),
        catalog.empty_config().alias("source_config"), F.lit(True).alias("enabled"),
    )
    return catalog.create_company(customer_companies(spark, d), row, now()).select("id", "name", "enabled")


@query("listed_companies", f"WITH {SQL_CUSTOMER_COMPANIES} SELECT id, name FROM companies_v WHERE NOT enabled ORDER BY name, id")
def listed_companies(spark, d):
    return catalog.list_companies(customer_companies(spark, d), enabled=False).select("id", "name")


# ---- probes --------------------------------------------------------------------------------
_STATUS = ["200", "404", "403", "200", "500", None, "200", "301", "200", "404", "200", "200", "503"]
_BODIES = ["[]", '{"jobs":[]}', "<html>icims /jobs/ workday jobs.gem.com</html>", "nothing here", "{bad"]


def probes(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        (k + 1).alias("company_id"), now().alias("probed_at"), pick(_STATUS, k).cast("int").alias("status_code"),
        pick(_BODIES, k).alias("body"), F.lit("connect timeout").alias("error"),
        pick(["200", "404", None], k).cast("int").alias("rendered_status"),
        F.when(k % 4 == 3, F.lit("browser crashed")).alias("rendered_error"),
    )


SQL_PROBES = f"""{SQL_CUSTOMER_COMPANIES},
probed AS (SELECT *, CAST({sql_pick(_STATUS, 'c_custkey')} AS INTEGER) AS st, {sql_pick(_BODIES, 'c_custkey')} AS body,
  CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE coalesce(CAST({sql_pick(["200", "404", None], 'c_custkey')} AS INTEGER), 200) END AS rst FROM companies_v),
judged AS (SELECT *,
  CASE WHEN source_type = 'generic_playwright' THEN trim(careers_url) = ''
    WHEN source_type IN ('greenhouse', 'lever', 'ashby', 'smartrecruiters') THEN token IS NULL
    WHEN source_type IN ('workday', 'icims', 'gem') THEN page IS NULL ELSE true END AS no_url,
  CASE WHEN source_type = 'generic_playwright' AND coalesce(st, 0) NOT IN (200, 403, 404) THEN rst ELSE st END AS status FROM probed),
verdicts AS (SELECT *, CASE WHEN no_url THEN NULL ELSE status END AS status_code,
  CASE WHEN no_url AND source_type = 'generic_playwright' THEN '{"missing careers_url"}' WHEN no_url THEN 'validation not supported for this source_type'
    WHEN source_type = 'generic_playwright' THEN CASE WHEN status IS NULL THEN 'browser crashed' WHEN coalesce(st, 0) IN (403, 404) OR status >= 400 THEN 'HTTP ' || status END
    WHEN status IS NULL THEN 'connect timeout' WHEN status <> 200 THEN 'HTTP ' || status
    WHEN source_type = 'smartrecruiters' THEN CASE c_custkey % 5 WHEN 1 THEN NULL WHEN 0 THEN 'invalid SmartRecruiters API response' ELSE 'invalid JSON from SmartRecruiters API' END
    WHEN source_type IN ('workday', 'icims', 'gem') AND c_custkey % 5 <> 2 THEN 'page does not look like a job board' END AS err FROM judged)"""


@query(
    "probe_results",
    f"WITH {SQL_PROBES} SELECT id, status_code, err IS NULL AS valid, coalesce(err, '') AS error FROM verdicts",
)
def probe_results(spark, d):
    return catalog.evaluate_probes(customer_companies(spark, d), probes(spark, d)).select(
        "id", "probe.status_code", "probe.valid", "probe.error"
    )


_DETAIL = """CASE source_type WHEN 'greenhouse' THEN 'Greenhouse board_token ' || token || ' returned 404' WHEN 'lever' THEN 'Lever company slug  returned 404'
  WHEN 'ashby' THEN 'Ashby organization ' || token || ' returned 404' WHEN 'smartrecruiters' THEN 'SmartRecruiters company ' || token || ' returned 404'
  WHEN 'workday' THEN 'Workday careers_url returned 404' WHEN 'icims' THEN 'iCIMS careers_url returned 404' WHEN 'gem' THEN 'Gem careers_url returned 404'
  WHEN 'generic_playwright' THEN 'Generic Playwright careers_url returned 404' END"""
SQL_VALIDATED = f"""{SQL_PROBES}, validated AS (SELECT *, enabled AND source_type <> 'unconfigured' AS sel,
  CASE WHEN NOT enabled THEN NULL WHEN source_type = 'unconfigured' THEN 'skipped' WHEN status_code IS NULL AND err LIKE '%not supported%' THEN 'skipped'
    WHEN err IS NULL THEN 'valid' WHEN status_code = 404 THEN 'disabled' ELSE 'failed' END AS validation FROM verdicts)"""


@query(
    "validated_companies",
    f"""WITH {SQL_VALIDATED} SELECT id, validation, enabled AND coalesce(validation, '') <> 'disabled' AS enabled,
      CASE WHEN validation = 'valid' THEN 0 WHEN validation = 'disabled' THEN greatest(consecutive_failures, 2) ELSE consecutive_failures END AS consecutive_failures,
      CASE WHEN validation = 'valid' THEN '200' WHEN sel THEN coalesce(CAST(status_code AS VARCHAR), 'error') ELSE last_validation_status END AS last_validation_status,
      CASE WHEN validation = 'valid' THEN NULL WHEN validation = 'disabled' THEN {_DETAIL} WHEN sel THEN err ELSE last_error END AS last_error FROM validated""",
)
def validated_companies(spark, d):
    return catalog.apply_probes(customer_companies(spark, d), probes(spark, d), now()).select(
        "id", "validation", "enabled", "consecutive_failures", "last_validation_status", "last_error"
    )


@query(
    "validation_tally",
    f"""WITH {SQL_VALIDATED} SELECT {', '.join(f"count(*) FILTER (WHERE validation = '{k}') AS {k}_count" for k in ('valid', 'disabled', 'failed', 'skipped'))} FROM validated""",
)
def validation_tally(spark, d):
    return catalog.validation_tally(catalog.apply_probes(customer_companies(spark, d), probes(spark, d), now()))


# ---- outcomes ------------------------------------------------------------------------------
@query(
    "company_outcomes",
    f"""WITH {SQL_SNAPSHOTS}, c AS (SELECT s.*, n_name AS name, CAST(company_id % 2 AS INTEGER) AS cf, error LIKE '%404%' AS missing
        FROM snapshots_v s JOIN nation ON n_nationkey + 1 = company_id)
    SELECT company_id AS id, CASE WHEN outcome = 'ok' THEN 0 WHEN missing THEN cf + 1 ELSE cf END AS consecutive_failures,
      NOT (coalesce(missing, false) AND cf + 1 >= 2) AS enabled,
      CASE WHEN missing THEN 'Greenhouse board_token ? returned 404' WHEN outcome = 'failed' THEN error END AS last_error,
      name || ': ' || CASE WHEN missing THEN 'invalid_source_config (Greenhouse board_token ? returned 404)' ELSE error END AS failure FROM c""",
)
def company_outcomes(spark, d):
    owners = companies(spark, d).withColumn("consecutive_failures", (F.col("id") % 2).cast("int"))
    return catalog.apply_outcomes(owners, snapshots(owners)).select("id", "consecutive_failures", "enabled", "last_error", "failure")


STREAKS_SQL = """WITH o AS (SELECT user_id AS company_id, ts, event_id AS seq, CASE event_type WHEN 'error' THEN '404' WHEN 'purchase' THEN 'ok' ELSE 'other' END AS kind FROM events),
  i AS (SELECT *, sum(CASE WHEN kind = 'ok' THEN 1 ELSE 0 END) OVER (PARTITION BY company_id ORDER BY ts, seq) AS island FROM o),
  r AS (SELECT *, sum(CASE WHEN kind = '404' THEN 1 ELSE 0 END) OVER (PARTITION BY company_id, island ORDER BY ts, seq) AS streak FROM i),
  h AS (SELECT company_id, min(ts) AS disabled_at, arg_min(streak, (ts, seq)) AS s FROM r WHERE kind = '404' AND streak >= {n} GROUP BY 1),
  e AS (SELECT company_id, arg_max(streak, (ts, seq)) AS s FROM r GROUP BY 1)
  SELECT company_id, CAST(coalesce(h.s, e.s) AS BIGINT) AS streak, disabled_at FROM e LEFT JOIN h USING (company_id)"""


@query("failure_streaks", STREAKS_SQL.format(n=2))
def failure_streaks(spark, d):
    return failure_fold.failure_streaks(outcomes(spark, d))


@query("failure_streaks_of_five", STREAKS_SQL.format(n=5))
def failure_streaks_of_five(spark, d):
    return failure_fold.failure_streaks(outcomes(spark, d), threshold=5)


# ---- files: written, and read back --------------------------------------------------------
@query(
    "target_lines",
    """SELECT c_custkey + 2 AS line_number, CASE WHEN c_custkey % 7 = 3 THEN 'Target ' || c_custkey || chr(10) || '"of" two, lines' ELSE 'Target ' || c_custkey END AS name,
      'https://t.example.com/' || c_custkey AS careers_url, CASE WHEN c_custkey % 3 = 0 THEN '{"board_token": "t' || c_custkey || '"}' END AS source_config_json FROM customer""",
)
def target_lines(spark, d):
    """Targets as one CSV file, in the order of their keys, whose quoted fields hold quotes, commas and line breaks."""
    k = F.col("c_custkey")
    name = F.concat(F.lit("Target "), k.cast("string"))
    rows = table(spark, d, "customer").select(
        F.when(k % 7 == 3, F.concat(name, F.lit('\n"of" two, lines'))).otherwise(name).alias("name"), F.col("c_mktsegment").alias("category"), F.lit("list").alias("source_list"),
        F.concat(F.lit("https://t.example.com/"), k.cast("string")).alias("careers_url"), F.lit("lever").alias("source_type"),
        F.when(k % 3 == 0, F.concat(F.lit('{"board_token": "t'), k.cast("string"), F.lit('"}'))).alias("source_config_json"), F.lit("1").alias("priority"), F.lit("yes").alias("enabled"), k,
    )
    folder = f"{shared_folder(spark)}/targets-{uuid.uuid4().hex}"
    rows.repartition(1).sortWithinPartitions("c_custkey").drop("c_custkey").write.csv(folder, header=True, quote='"', escape='"')
    return targets.read_targets(spark, folder).select("line_number", "name", "careers_url", "source_config_json")


# ---- selection and summaries ---------------------------------------------------------------
@query(
    "companies_to_scrape",
    f"""WITH {SQL_CUSTOMER_COMPANIES} SELECT id, source_type FROM (SELECT *, row_number() OVER (PARTITION BY source_type ORDER BY id) AS rn FROM companies_v WHERE enabled)
    WHERE source_type <> 'generic_playwright' OR rn <= 25""",
)
def companies_to_scrape(spark, d):
    return catalog.companies_to_scrape(customer_companies(spark, d)).select("id", "source_type")


@query(
    "generic_eligible",
    f"""WITH {SQL_CUSTOMER_COMPANIES} SELECT id FROM companies_v WHERE trim(careers_url) <> '' AND source_type IN ('unconfigured', 'taleo')""",
)
def generic_eligible(spark, d):
    return customer_companies(spark, d).filter(catalog.eligible_for_generic()).select("id")


@query("discovery_selection", f"WITH {SQL_CUSTOMER_COMPANIES} SELECT id, name FROM companies_v WHERE source_type = 'unconfigured'")
def discovery_selection(spark, d):
    return catalog.companies_to_discover(customer_companies(spark, d)).select("id", "name")


@query(
    "unscraped_companies",
    f"""WITH {SQL_CUSTOMER_COMPANIES} SELECT id AS company_id, TIMESTAMP '2002-01-02' AS cycle_ts, 'failed' AS outcome, '{NO_CAPTURE}' AS error
    FROM companies_v WHERE enabled AND id NOT IN (SELECT n_nationkey + 1 FROM nation)""",
)
def unscraped_companies(spark, d):
    """Companies of customers, of which only those with a nation's number have a snapshot."""
    chosen = customer_companies(spark, d).filter("enabled")
    return unscraped(chosen, snapshots(companies(spark, d)), F.lit("2002-01-02").cast("timestamp"))


@query(
    "generic_enabled",
    f"""WITH {SQL_CUSTOMER_COMPANIES}, chosen AS (SELECT id FROM companies_v WHERE trim(careers_url) <> '' AND source_type IN ('unconfigured', 'taleo') ORDER BY name, id LIMIT 25)
    SELECT id, CASE WHEN hit THEN 'generic_playwright' ELSE source_type END AS source_type, enabled OR hit AS enabled, CASE WHEN NOT hit THEN last_error END AS last_error,
      CASE WHEN hit THEN careers_url ELSE page END AS page FROM (SELECT *, id IN (SELECT id FROM chosen) AS hit FROM companies_v)""",
)
def generic_enabled(spark, d):
    after, _ = catalog.enable_generic(customer_companies(spark, d), limit=25)
    return after.select("id", "source_type", "enabled", "last_error", F.try_element_at("source_config", F.lit("careers_url")).alias("page"))


@query(
    "company_totals",
    f"""WITH {SQL_CUSTOMER_COMPANIES} SELECT count(*) AS total, count(*) FILTER (WHERE enabled) AS enabled, count(*) FILTER (WHERE NOT enabled) AS disabled,
      count(*) FILTER (WHERE source_type IN ('unconfigured', '')) AS unconfigured FROM companies_v""",
)
def company_totals(spark, d):
    return metrics.company_totals(customer_companies(spark, d))


@query(
    "company_breakdown",
    f"""WITH {SQL_CUSTOMER_COMPANIES} SELECT 'source_type' AS dimension, CASE WHEN source_type = '' THEN 'unconfigured' ELSE source_type END AS key, count(*) AS n FROM companies_v GROUP BY 2
    UNION ALL SELECT 'last_validation_status', coalesce(nullif(last_validation_status, ''), 'never'), count(*) FROM companies_v GROUP BY 2""",
)
def company_breakdown(spark, d):
    return metrics.company_breakdown(customer_companies(spark, d))
