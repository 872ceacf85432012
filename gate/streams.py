"""Queries for stored captures, the whole cycle, and the streaming jobs.

The stateful ones keep their tables under names of their own, so runs do not meet.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gate.catalog import STREAKS_SQL
from gate.providers import captures_of, iso, k, seconds
from gate.registry import query
from gate.surrogates import (
    FINGERPRINT_SQL, SOURCE_TYPES, SQL_PAGES, companies, pages, pick, postings, quoted, sql_pick, sql_postings,
)
from gate import sqltext
from tidemark import rules, schemas
from tidemark.plans.cycle import NO_CAPTURE, CycleTables, run_cycle
from tidemark.session import shared_folder
from tidemark.sources import captures, tables
from tidemark.streaming import snapshots as snapshot_stream, streaks


def fresh(name: str) -> str:
    return f"{name}_{uuid.uuid4().hex[:12]}"


_SWALLOWED = ", ".join(map(quoted, captures.SWALLOWED))


@query(
    "captured_snapshots",
    f"""WITH {SQL_PAGES}, c AS (SELECT company_id, page_ordinal, {sql_pick(SOURCE_TYPES, 'company_id')} AS kind,
        CASE WHEN page_id % 17 = 3 THEN 404 WHEN page_id % 19 = 4 THEN 503 ELSE 200 END AS st, page_url, page_id % 23 = 5 AS broken FROM pages_v),
      e AS (SELECT company_id, page_ordinal, CASE WHEN kind NOT IN ({', '.join(map(quoted, rules.SOURCE_TYPES))}) THEN 'Unknown source_type: ' || kind
        WHEN kind IN ({_SWALLOWED}) THEN NULL WHEN st = 404 THEN 'Client error ''404'' for url ''' || page_url || '''' WHEN st = 503 THEN 'Server error ''503'' for url ''' || page_url || ''''
        WHEN broken AND kind IN ('greenhouse', 'lever', 'ashby') THEN 'response is not JSON' WHEN kind = 'greenhouse' AND page_ordinal = 3 THEN 'response is not a JSON object' END AS error FROM c)
    SELECT company_id, CASE WHEN bool_or(error IS NOT NULL) THEN 'failed' ELSE 'ok' END AS outcome, arg_min(error, page_ordinal) FILTER (WHERE error IS NOT NULL) AS error
    FROM e GROUP BY company_id""",
)
def captured_snapshots(spark, d):
    n = F.col("page_id")
    rows = pages(spark, d).withColumns(
        {
            "source_type": pick(SOURCE_TYPES, F.col("company_id")),
            "cycle_ts": F.lit("2002-01-01").cast("timestamp"),
            "status_code": F.when(n % 17 == 3, 404).when(n % 19 == 4, 503).otherwise(200),
            "body": F.when(n % 23 == 5, F.col("body")).when(F.col("page_ordinal") == 3, F.lit("[]")).otherwise(F.to_json(F.struct("body"))),
        }
    )
    return captures.snapshots_from_captures(rows).select("company_id", "outcome", "error")


# ---- a whole cycle -------------------------------------------------------------------------
def bodies_of(spark, d, kept="true"):
    """Captures of three providers, of the kept postings."""
    rows = postings(spark, d).filter(kept)
    shapes = [
        ("greenhouse", F.struct(k().alias("id"), "title", F.col("url").alias("absolute_url"), iso().alias("updated_at")), '{"jobs":[', "]}"),
        ("lever", F.struct(k().alias("id"), F.col("title").alias("text"), F.col("url").alias("hostedUrl"), (seconds() * 1000).alias("createdAt")), "[", "]"),
        ("ashby", F.struct(k().alias("id"), "title", F.col("url").alias("jobUrl"), iso().alias("publishedDate")), "[", "]"),
    ]
    bodies = None
    for i, (kind, item, opening, closing) in enumerate(shapes):
        part = captures_of(rows.filter(F.col("company_id") % 3 == i), F.to_json(item), opening, closing, kind)
        bodies = part if bodies is None else bodies.unionByName(part)
    return bodies


def cycle(spark, d, captured=None, failures=None):
    """Captures of three providers, fetched into an empty state; companies come with so many failures."""
    source = F.element_at(F.array(*map(F.lit, ("greenhouse", "lever", "ashby"))), (F.col("id") % 3 + 1).cast("int"))
    names = CycleTables(fresh("jobs"), fresh("companies"), fresh("postings"), buckets=4, parts=8)
    owners = companies(spark, d).withColumns({"source_type": source, "consecutive_failures": (F.lit(0) if failures is None else failures).cast("int")})
    tables.write_version(owners, names.companies, "start")
    tables.write_version(spark.createDataFrame([], schemas.JOBS), names.jobs, "start", "fingerprint_hash", 4)
    captured = bodies_of(spark, d) if captured is None else captured
    return run_cycle(spark, captured, "c1", F.lit("2002-01-02").cast("timestamp"), names=names, us_only=False), names


@query(
    "cycle_jobs",
    f"""WITH {sql_postings()} SELECT company_id, title, url, CAST(ordinal AS VARCHAR) AS external_job_id, is_active,
      {FINGERPRINT_SQL.replace("external_job_id", "CAST(ordinal AS VARCHAR)").replace("coalesce(location, '')", "''")} AS fingerprint_hash
    FROM postings_v, (SELECT true AS is_active)""",
)
def cycle_jobs(spark, d):
    return cycle(spark, d)[0].jobs.select("company_id", "title", "url", "external_job_id", "is_active", "fingerprint_hash")


@query(
    "cycle_of_few_companies",
    f"""WITH {sql_postings()} SELECT company_id, CAST(ordinal AS VARCHAR) AS external_job_id,
      company_id > 3 OR ordinal % 4 < 2 AS is_active, CASE WHEN company_id > 3 THEN TIMESTAMP '2002-01-01' ELSE TIMESTAMP '2002-01-02' END AS last_seen_at FROM postings_v""",
)
def cycle_of_few_companies(spark, d):
    """A second cycle in which three companies post part of their jobs; it writes the parts of these companies only."""
    _, names = cycle(spark, d)
    few = bodies_of(spark, d, (F.col("company_id") <= 3) & (F.col("ordinal") % 4 < 2))
    few = few.withColumn("cycle_ts", F.lit("2002-01-02").cast("timestamp"))
    jobs = run_cycle(spark, few, "c2", F.lit("2002-01-03").cast("timestamp"), names=names, us_only=False).jobs
    return jobs.select("company_id", "external_job_id", "is_active", "last_seen_at")


# every fifth company answers 404, of every seventh there is no capture
_FAILING = f"""WITH {sql_postings()}, seen_v AS (SELECT company_id, count(*) AS n FROM postings_v GROUP BY 1),
  c_v AS (SELECT n_nationkey::BIGINT + 1 AS id, coalesce(n, 0) AS n, n IS NULL OR (n_nationkey + 1) % 7 = 3 AS missing, (n_nationkey + 1) % 5 = 2 AS gone, (n_nationkey + 1) % 2 AS before
    FROM nation LEFT JOIN seen_v ON company_id = n_nationkey + 1)"""


def stored_failing(spark, d):
    """The captures with failures, written as the source stores them and read back."""
    given = bodies_of(spark, d).where(F.col("company_id") % 7 != 3)
    folder = f"{shared_folder(spark)}/{fresh('captures')}"
    captures.write_captures(given.withColumn("status_code", F.when(F.col("company_id") % 5 == 2, 404).otherwise(200)), folder)
    return captures.read_captures(spark, folder)


@query(
    "stored_captures",
    f"""{_FAILING} SELECT id AS company_id, CASE WHEN gone THEN 'failed' ELSE 'ok' END AS outcome,
      CASE WHEN gone THEN {quoted("Client error '404' for url 'https://example.com/api'")} END AS error FROM c_v WHERE NOT missing""",
)
def stored_captures(spark, d):
    return captures.snapshots_from_captures(stored_failing(spark, d)).select("company_id", "outcome", "error")


@query(
    "cycle_companies",
    f"""{_FAILING} SELECT id, NOT (gone AND NOT missing AND before + 1 >= 2) AS enabled, CAST(CASE WHEN missing THEN before WHEN gone THEN before + 1 ELSE 0 END AS INT) AS consecutive_failures,
      CASE WHEN gone AND NOT missing THEN '404' END AS last_validation_status, CASE WHEN missing THEN '{NO_CAPTURE}' WHEN gone THEN 'not found' END AS last_error FROM c_v""",
)
def cycle_companies(spark, d):
    """The stored companies after a cycle, read from their table."""
    _, names = cycle(spark, d, stored_failing(spark, d), F.col("id") % 2)
    error = F.when(F.col("last_validation_status") == "404", F.when(F.col("last_error").isNotNull(), F.lit("not found"))).otherwise(F.col("last_error"))
    return tables.read_table(spark, names.companies).select("id", "enabled", "consecutive_failures", "last_validation_status", error.alias("last_error"))


@query(
    "cycle_counters",
    f"""{_FAILING} SELECT id AS company_id, n AS jobs_seen_total, n AS jobs_inserted_total, 0::BIGINT AS jobs_skipped_international, 0::BIGINT AS inactive_jobs_marked
    FROM c_v WHERE NOT missing AND NOT gone""",
)
def cycle_counters(spark, d):
    counters = cycle(spark, d, stored_failing(spark, d))[0].counters
    return counters.select("company_id", "jobs_seen_total", "jobs_inserted_total", "jobs_skipped_international", "inactive_jobs_marked")


# ---- streams -------------------------------------------------------------------------------
@query("streamed_streaks", STREAKS_SQL.format(n=2))
def streamed_streaks(spark, d):
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    kind = F.col("event_type")
    stream = (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).select(
            F.col("user_id").alias("company_id"),
            F.col("ts").cast("timestamp").alias("ts"),
            F.col("event_id").alias("seq"),
            F.when(kind == "error", F.lit("404")).when(kind == "purchase", F.lit("ok")).otherwise(F.lit("other")).alias("kind"),
        )
    )
    name = fresh("streaks")
    streaks.start_streaks(spark, stream, name).awaitTermination()
    return spark.table(name).select("company_id", "streak", "disabled_at")


@query("streamed_streaks_in_batches", STREAKS_SQL.format(n=2))
def streamed_streaks_in_batches(spark, d):
    """The same outcomes in four batches without regard to their time, so that most come late."""
    kind = F.col("event_type")
    rows = spark.read.parquet(f"{d}/events.parquet").select(
        F.col("user_id").alias("company_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.when(kind == "error", F.lit("404")).when(kind == "purchase", F.lit("ok")).otherwise(F.lit("other")).alias("kind"),
    )
    folder, name = f"{shared_folder(spark)}/{fresh('outcomes')}", fresh("streaks")
    rows.repartitionByRange(4, F.xxhash64("seq")).write.parquet(folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    streaks.start_streaks(spark, stream, name).awaitTermination()
    return spark.table(name).select("company_id", "streak", "disabled_at")


_CYCLE = "CASE WHEN posted_at < TIMESTAMP '1997-01-01' THEN 1 WHEN posted_at < TIMESTAMP '1999-01-01' THEN 2 ELSE 3 END"


@query(
    "streamed_ingest",
    f"""WITH {sql_postings()}, {sqltext.location_categories('postings_v')},
      kept_v AS (SELECT p.*, {_CYCLE} AS c FROM postings_v p JOIN loc_cat l ON p.location IS NOT DISTINCT FROM l.location WHERE category IN ('US', 'REMOTE_US'))
    SELECT {FINGERPRINT_SQL} AS fingerprint_hash, company_id, level, posted_at, max_c = 3 AS is_active, TIMESTAMP '2001-12-31' + INTERVAL 1 DAY * min_c AS first_seen_at,
      TIMESTAMP '2001-12-31' + INTERVAL 1 DAY * least(max_c + 1, 3) AS last_seen_at
    FROM (SELECT *, min(c) OVER w AS min_c, max(c) OVER w AS max_c, row_number() OVER (PARTITION BY external_job_id ORDER BY c DESC, ordinal DESC) AS rn
      FROM kept_v WINDOW w AS (PARTITION BY external_job_id)) WHERE rn = 1""",
)
def streamed_ingest(spark, d):
    """Three cycles of postings, written as files and read back as a stream."""
    return streamed_cycles(spark, d, F.when(F.col("posted_at") < "1997-01-01", 1).when(F.col("posted_at") < "1999-01-01", 2).otherwise(3))


@query(
    "streamed_ingest_of_thirty_cycles",
    f"""WITH {sql_postings()}, {sqltext.location_categories('postings_v')},
      c_v AS (SELECT *, date_diff('day', TIMESTAMP '1992-01-01', posted_at) // 81 + 1 AS c FROM postings_v),
      scans_v AS (SELECT DISTINCT company_id, c FROM c_v),
      kept_v AS (SELECT p.* FROM c_v p JOIN loc_cat l ON p.location IS NOT DISTINCT FROM l.location WHERE category IN ('US', 'REMOTE_US')),
      jobs_v AS (SELECT *, (SELECT min(s.c) FROM scans_v s WHERE s.company_id = k.company_id AND s.c > max_c) AS closing
        FROM (SELECT *, min(c) OVER w AS min_c, max(c) OVER w AS max_c, row_number() OVER (PARTITION BY external_job_id ORDER BY c DESC, ordinal DESC) AS rn
          FROM kept_v WINDOW w AS (PARTITION BY external_job_id)) k WHERE rn = 1)
    SELECT {FINGERPRINT_SQL} AS fingerprint_hash, company_id, level, posted_at, closing IS NULL AS is_active, TIMESTAMP '2001-12-31' + INTERVAL 1 DAY * min_c AS first_seen_at,
      TIMESTAMP '2001-12-31' + INTERVAL 1 DAY * coalesce(closing, max_c) AS last_seen_at FROM jobs_v""",
)
def streamed_ingest_of_thirty_cycles(spark, d):
    """Thirty cycles of postings in one batch, one write of the state."""
    return streamed_cycles(spark, d, F.floor(F.datediff("posted_at", F.lit("1992-01-01")) / 81) + 1)


def streamed_cycles(spark, d, cycle):
    rows = postings(spark, d).withColumns(
        {
            "cycle_ts": F.timestamp_add("DAY", cycle.cast("int"), F.lit("2001-12-31").cast("timestamp")),
            "outcome": F.lit("ok"),
            "error": F.lit(None).cast("string"),
        }
    )
    folder = f"{shared_folder(spark)}/{fresh('arrived')}"
    rows.write.parquet(folder)
    names = CycleTables(fresh("jobs"), fresh("companies"), buckets=8)
    tables.write_version(companies(spark, d), names.companies, "start")
    tables.write_version(spark.createDataFrame([], schemas.JOBS), names.jobs, "start", "fingerprint_hash", 8)
    stream = snapshot_stream.read_posting_stream(spark, folder)
    snapshot_stream.start_ingest(spark, stream, names, fresh("applied")).awaitTermination()
    return spark.table(names.jobs).select(
        "fingerprint_hash", "company_id", "level", "posted_at", "is_active", "first_seen_at", "last_seen_at"
    )
