"""Stand-ins for postings, states, captures and pages, derived from the given tables.

There is no job table among the test tables. Each stand-in is written twice, as a Spark frame and
as a DuckDB common table expression of the same name and columns, and always covers whole tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.session import spread

TITLES = [
    "Software Engineer, New Grad", "Backend Engineer I", "Sales Engineer, University Graduate",
    "Senior Software Engineer", "Machine Learning Engineer, Early Career", "Account Executive, Early Career",
    "Site Reliability Engineer I", "Data Engineer I", "Product Manager, New Grad", "Staff Platform Engineer",
    "Frontend Software Engineer - University Grad", "Business Analyst Intern", "Full Stack Engineer",
    "Full-Stack  Engineer, Campus", "Principal Architect", "SRE Lead", "Software Developer", "ML Engineer",
    "Sales Software Engineer", "Human Resources Generalist", "HR Partner", "Engineering Manager",
    "Associate Software Engineer", "Junior Software Engineer", "Talent Partner", "Systems Engineer",
    "System Engineer II", "DevOps Engineer", "iOS Engineer", "Customer Success Associate, Entry Level",
    "Data Analyst", "SWE I", "L3 New Grad Engineer", "Director of Design", "Infrastructure Engineer, University Graduate",
    "Office Cook", "Software Engineer I",
]
LEVELS = [None, "Entry Level", "Senior", "", "New Grad"]
DESCRIPTIONS = [
    None, "Looking for senior talent.", "campus hire", "5+ years of experience", "0-2 years of experience",
    "A bachelor's degree required", "Work as a software engineer with us", "", "You lead a team & <own> it",
    "10 + years; bachelors degree preferred", "Work with the director and the staff",
]
LOCATIONS = [
    "San Francisco, CA", "New York, NY", "Seattle, WA", "Austin, TX", "United States", "USA", "US",
    "Boston, Massachusetts", "Hybrid - San Francisco", "Hybrid NYC", "Remote/San Francisco", "Remote",
    "Remote US", "US Remote", "Remote - United States", "Remote, USA", "Anywhere in US", "Work from home",
    "London, UK", "Berlin, Germany", "Toronto, Canada", "Vancouver, BC, Canada", "India", "Singapore",
    "Dublin, Ireland", "Amsterdam, Netherlands", "Tokyo, Japan", "Sydney, Australia", "Remote EMEA",
    "Remote Europe", "Remote Canada", "Remote India", "Paris, France", "Remote - UK", "EMEA", "APAC",
    "Multiple Locations", "TBD", "San Francisco, CA | London, UK", "New York, NY or Remote", None, "",
    "  Denver,   CO ", "Paris, TX", "Albuquerque, New Mexico", "based in or", "Rio de Janeiro", "Portland (OR)",
    "Chicago; Remote", "Austin and Dallas", "Somewhere, remote", "of in me", "Kansas City",
]
SOURCE_TYPES = [
    "greenhouse", "lever", "ashby", "smartrecruiters", "workday", "icims", "gem", "generic_playwright",
    "unconfigured", "taleo", "",
]
assert (len(TITLES), len(LEVELS), len(DESCRIPTIONS), len(LOCATIONS), len(SOURCE_TYPES)) == (37, 5, 11, 53, 11)


def pick(values: Sequence, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (index % len(values) + 1).cast("int"))


def quoted(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def sql_pick(values: Sequence, index: str) -> str:
    return f"([{', '.join(map(quoted, values))}])[1 + ({index}) % {len(values)}]"


SPREAD = ("orders", "documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; those with costly work per row use all cores even when they are one file."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in SPREAD else rows


def div(column: str, n: int) -> Column:
    return F.floor(F.col(column) / n)


# ---- postings: one per order; the customer (or a block of customers) is the posting --------
def postings(spark: SparkSession, sf_dir: str, block: int = 1) -> DataFrame:
    """Orders as sightings. `block` customers share one posting, `company_name` is the region's
    name when block > 1, so that companies share names and fingerprints."""
    nation = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    rows = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .withColumn("g", div("o_custkey", block))
    )
    g, k = F.col("g"), F.col("o_orderkey")
    return rows.select(
        (F.col("c_nationkey") + 1).cast("bigint").alias("company_id"),
        F.lit("2002-01-01").cast("timestamp").alias("cycle_ts"),
        k.alias("ordinal"),
        F.col("r_name" if block > 1 else "n_name").alias("company_name"),
        F.lit("greenhouse").alias("source_type"),
        g.cast("string").alias("external_job_id"),
        pick(TITLES, g).alias("title"),
        F.col("o_orderpriority").alias("team"),
        pick(LOCATIONS, F.floor(g / 3)).alias("location"),
        F.lit(None).cast("string").alias("employment_type"),
        pick(LEVELS, k).alias("level"),
        F.concat(F.lit("https://jobs.example.com/"), g.cast("string")).alias("url"),
        pick(DESCRIPTIONS, k).alias("description_text"),
        F.col("o_orderdate").cast("timestamp").alias("posted_at"),
        F.to_json(F.struct(k.alias("id"))).alias("raw_payload"),
    )


def sql_postings(block: int = 1) -> str:
    name = "r_name" if block > 1 else "n_name"
    return f"""postings_v AS (
  SELECT c_nationkey::BIGINT + 1 AS company_id, TIMESTAMP '2002-01-01' AS cycle_ts, o_orderkey AS ordinal,
    {name} AS company_name, 'greenhouse' AS source_type, CAST(o_custkey // {block} AS VARCHAR) AS external_job_id,
    {sql_pick(TITLES, f'o_custkey // {block}')} AS title, o_orderpriority AS team,
    {sql_pick(LOCATIONS, f'(o_custkey // {block}) // 3')} AS location, CAST(NULL AS VARCHAR) AS employment_type,
    {sql_pick(LEVELS, 'o_orderkey')} AS level,
    'https://jobs.example.com/' || CAST(o_custkey // {block} AS VARCHAR) AS url,
    {sql_pick(DESCRIPTIONS, 'o_orderkey')} AS description_text, o_orderdate AS posted_at,
    '{{"id":' || o_orderkey || '}}' AS raw_payload
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""


def companies(spark: SparkSession, sf_dir: str, shared_names: bool = False) -> DataFrame:
    """Nations as companies."""
    nation = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return catalog_columns(
        nation.select(
            (F.col("n_nationkey") + 1).cast("bigint").alias("id"),
            F.col("r_name" if shared_names else "n_name").alias("name"),
            F.lit("greenhouse").alias("source_type"),
        )
    )


def catalog_columns(rows: DataFrame) -> DataFrame:
    """Fills the company columns that are not given."""
    at = F.lit("2001-01-01").cast("timestamp")
    defaults = {
        "careers_url": F.lit("https://example.com/careers"),
        "source_config": F.create_map().cast("map<string,string>"),
        "enabled": F.lit(True),
        "last_validated_at": F.lit(None).cast("timestamp"),
        "last_validation_status": F.lit(None).cast("string"),
        "consecutive_failures": F.lit(0),
        "last_error": F.lit(None).cast("string"),
        "created_at": at,
        "updated_at": at,
    }
    return rows.withColumns({k: v for k, v in defaults.items() if k not in rows.columns})


# ---- companies: one per customer, of all kinds --------------------------------------------
def customer_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as companies of every source type, with and without their settings."""
    k = F.col("c_custkey")
    kind = pick(SOURCE_TYPES, k)
    slug = F.concat(F.lit("co"), k.cast("string"))
    key = F.concat(F.lit("https://x.example.com/"), k.cast("string"), F.lit("/"))
    config = (
        F.when(k % 7 == 0, F.create_map().cast("map<string,string>"))
        .when(kind == "greenhouse", F.create_map(F.lit("board_token"), slug))
        .when(kind == "lever", F.create_map(F.lit("company"), F.lit(""), F.lit("site"), slug))
        .when(kind == "ashby", F.create_map(F.lit("organization"), slug))
        .when(kind == "smartrecruiters", F.create_map(F.lit("company"), slug))
        .otherwise(F.create_map(F.lit("careers_url"), key))
    )
    return catalog_columns(
        table(spark, sf_dir, "customer").select(
            (k + 1).alias("id"),
            F.col("c_name").alias("name"),
            F.when(k % 6 == 0, F.lit("  ")).otherwise(F.concat(F.lit("https://own.example.com/"), k.cast("string"))).alias("careers_url"),
            kind.alias("source_type"),
            config.alias("source_config"),
            (k % 5 != 0).alias("enabled"),
            F.when(k % 4 == 0, F.lit("200")).when(k % 4 == 1, F.lit("404")).when(k % 4 == 2, F.lit("")).alias("last_validation_status"),
            (k % 3).cast("int").alias("consecutive_failures"),
            F.when(k % 3 > 0, F.lit("earlier error")).alias("last_error"),
        )
    )


SQL_CUSTOMER_COMPANIES = f"""companies_v AS (
  SELECT *, CASE WHEN c_custkey % 7 <> 0 THEN slug END AS token,
    CASE WHEN c_custkey % 7 <> 0 AND source_type NOT IN ('greenhouse', 'lever', 'ashby', 'smartrecruiters')
      THEN 'https://x.example.com/' || c_custkey || '/' END AS page
  FROM (SELECT c_custkey, c_custkey + 1 AS id, c_name AS name,
    CASE WHEN c_custkey % 6 = 0 THEN '  ' ELSE 'https://own.example.com/' || c_custkey END AS careers_url,
    {sql_pick(SOURCE_TYPES, 'c_custkey')} AS source_type, 'co' || c_custkey AS slug,
    c_custkey % 5 <> 0 AS enabled,
    CASE c_custkey % 4 WHEN 0 THEN '200' WHEN 1 THEN '404' WHEN 2 THEN '' END AS last_validation_status,
    CAST(c_custkey % 3 AS INTEGER) AS consecutive_failures,
    CASE WHEN c_custkey % 3 > 0 THEN 'earlier error' END AS last_error
  FROM customer))"""


# ---- job state and batch: orders before and after a date, which together are all orders ----
STATE_END = "1999-01-01"
SILENT = 5  # this company posts nothing in the batch, its orders are all in the state
SQL_EARLIER = f"(posted_at < TIMESTAMP '{STATE_END}' OR company_id = {SILENT})"


def earlier() -> Column:
    return (F.col("posted_at") < F.lit(STATE_END).cast("timestamp")) | (F.col("company_id") == SILENT)


# a crawl of a quarter takes two days
CRAWL_HOURS = 48


def normal_sql(expr: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({expr}, '')), '\\s+', ' ', 'g'))"


FINGERPRINT_SQL = "sha256(" + " || '|' || ".join(
    normal_sql(c) for c in ("company_name", "title", "location", "url", "external_job_id")
) + ")"


def job_state(rows: DataFrame) -> DataFrame:
    """The state after `rows`: one row per posting, owned by its first poster, first seen by the crawl of its quarter."""
    from tidemark.functions.text import fingerprint

    key = fingerprint(*[F.col(c) for c in ("company_name", "title", "location", "url", "external_job_id")])
    first = F.min_by(F.struct([c for c in rows.columns if c != "cycle_ts"]), F.struct("company_id", "ordinal"))
    merged = (
        rows.groupBy("external_job_id")
        .agg(first.alias("f"), F.min("posted_at").alias("first_seen_at"), F.max("posted_at").alias("last_seen_at"))
    )
    g = F.col("external_job_id").cast("bigint")
    crawled = F.timestamp_add("HOUR", (F.col("external_job_id").cast("bigint") % CRAWL_HOURS).cast("int"), F.date_trunc("quarter", F.col("first_seen_at")))
    return (
        merged.select("f.*", crawled.alias("first_seen_at"), "last_seen_at")
        .withColumns(
            {
                "id": g + 1,
                "fingerprint_hash": key,
                "is_active": g % 5 != 0,
                "entry_level_score": (g % 7).cast("double") - 3,
                "is_entry_level": g % 7 > 3,
                "is_software_engineering_related": g % 3 > 0,
                "created_at": F.col("first_seen_at"),
                "updated_at": F.col("first_seen_at"),
            }
        )
        .drop("company_name", "ordinal")
    )


def sql_state(rows: str = "true") -> str:
    return f"""state_v AS (
  SELECT * EXCLUDE (company_name, ordinal, cycle_ts, rn), {FINGERPRINT_SQL} AS fingerprint_hash,
    CAST(external_job_id AS BIGINT) + 1 AS id, CAST(external_job_id AS BIGINT) % 5 <> 0 AS is_active,
    CAST(CAST(external_job_id AS BIGINT) % 7 AS DOUBLE) - 3 AS entry_level_score,
    CAST(external_job_id AS BIGINT) % 7 > 3 AS is_entry_level,
    CAST(external_job_id AS BIGINT) % 3 > 0 AS is_software_engineering_related,
    first_seen_at AS created_at, first_seen_at AS updated_at
  FROM (SELECT *, date_trunc('quarter', min(posted_at) OVER (PARTITION BY external_job_id)) + to_hours(CAST(external_job_id AS BIGINT) % {CRAWL_HOURS}) AS first_seen_at,
      max(posted_at) OVER (PARTITION BY external_job_id) AS last_seen_at,
      row_number() OVER (PARTITION BY external_job_id ORDER BY company_id, ordinal) AS rn
    FROM postings_v WHERE {rows}) WHERE rn = 1)"""


SQL_STATE = sql_state()


def batch_postings(rows: DataFrame) -> DataFrame:
    """The orders that are not in the state before; one scanned company posts nothing."""
    return rows.filter(~earlier())


SQL_BATCH = f"""batch_v AS (SELECT * FROM postings_v WHERE NOT {SQL_EARLIER})"""


def snapshots(company_rows: DataFrame) -> DataFrame:
    failed = F.col("id") % 7 == 3
    return company_rows.select(
        F.col("id").alias("company_id"),
        F.lit("2002-01-01").cast("timestamp").alias("cycle_ts"),
        F.when(failed, F.lit("failed")).otherwise(F.lit("ok")).alias("outcome"),
        F.when(failed & (F.col("id") % 2 == 0), F.lit("Client error '404' for url 'x'"))
        .when(failed, F.lit("timed out"))
        .alias("error"),
    )


SQL_SNAPSHOTS = """snapshots_v AS (
  SELECT n_nationkey::BIGINT + 1 AS company_id, TIMESTAMP '2002-01-01' AS cycle_ts,
    CASE WHEN (n_nationkey + 1) % 7 = 3 THEN 'failed' ELSE 'ok' END AS outcome,
    CASE WHEN (n_nationkey + 1) % 7 = 3 THEN CASE WHEN (n_nationkey + 1) % 2 = 0 THEN 'Client error ''404'' for url ''x'''
      ELSE 'timed out' END END AS error
  FROM nation)"""


# ---- outcomes: events ---------------------------------------------------------------------
def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("company_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.when(kind == "error", F.lit("404")).when(kind == "purchase", F.lit("ok")).otherwise(F.lit("other")).alias("kind"),
    )


# ---- pages --------------------------------------------------------------------------------
# Links appended to a page by its number; the last entry adds none.
INSERTS = [
    '<a href="https://jobs.gem.com/co{n}/{n}">Engineer</a>',
    '<a href="https://careers-co{n}.icims.com/jobs/{n}/software-engineer/job">Software Engineer {n}</a>',
    '<a href="https://jobs.smartrecruiters.com/co{n}/posting/{n}">PM</a>',
    '<iframe src="https://boards.greenhouse.io/co{n}/jobs"></iframe><a href="/login">Login</a>',
    '<a href="https://co{n}.wd1.myworkdayjobs.com/en-US/Site{n}/login">Careers</a><a href="mailto:a@b.c">m</a>',
    '<a href="https://jobs.lever.co/co{n}">x</a><a href="https://api.ashbyhq.com/posting-api/job-board/co{n}">y</a>',
    '<a href="https://co{n}.taleo.net/careersection/">t</a><a href="/jobs/search?page=2">Open positions</a>',
    "see taleo.net for jobs",
    '<a href="https://co{n}.eightfold.ai/careers">e</a><a href="/careers#top">Careers</a>',
    '<a href="https://x{n}.oraclecloud.com/hcmUI/CandidateExperience/en">o</a><a href="/jobs/{n}">Software Engineer</a>',
    "",
]


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of companies, four pages each, with a board link of some kind appended to most."""
    k = F.col("page_id")
    extra = F.replace(pick(INSERTS, k), F.lit("{n}"), k.cast("string"))
    return table(spark, sf_dir, "pages").select(
        "page_id",
        (div("page_id", 4) + 1).alias("company_id"),
        (k % 4).cast("int").alias("page_ordinal"),
        F.col("url").alias("page_url"),
        F.concat("html", extra).alias("body"),
    )


SQL_PAGES = f"""pages_v AS (
  SELECT page_id, page_id // 4 + 1 AS company_id, CAST(page_id % 4 AS INTEGER) AS page_ordinal, url AS page_url,
    html || replace({sql_pick(INSERTS, 'page_id')}, '{{n}}', CAST(page_id AS VARCHAR)) AS body,
    regexp_extract(url, '^https?://[^/?#]+') AS origin
  FROM pages)"""

HREF_SQL = """'(?i)href\\s*=\\s*["'']([^"''#][^"'']*)["'']'"""
# hrefs of a page, absolute; the test pages hold rooted and absolute ones only
SQL_LINKS = f"""hrefs_v AS (
  SELECT page_id, company_id, page_ordinal, page_url, origin, body, href, i AS pos,
    CASE WHEN href LIKE '/%' THEN origin || href ELSE href END AS url
  FROM (SELECT *, unnest(found) AS href, generate_subscripts(found, 1) AS i
    FROM (SELECT *, regexp_extract_all(body, {HREF_SQL}, 1) AS found FROM pages_v))
  WHERE href NOT LIKE 'mailto:%' AND href NOT LIKE 'tel:%' AND href NOT LIKE 'javascript:%'),
links_v AS (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY first_pos) - 1 AS rank
  FROM (SELECT page_id, company_id, page_ordinal, page_url, origin, url, min(pos) AS first_pos
    FROM hrefs_v GROUP BY ALL))"""
