"""Queries for the snapshot ingest. Regions lend their name to five companies each, so that
companies share fingerprints; see the surrogates for state, batch and outcomes."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from gate import sqltext
from gate.registry import query
from gate.surrogates import (
    FINGERPRINT_SQL, SQL_BATCH, SQL_EARLIER, SQL_SNAPSHOTS, SQL_STATE, batch_postings, companies, earlier, job_state, postings, snapshots, sql_postings,
    sql_state,
)
from tidemark.functions.location import classify_location
from tidemark.operators import ingest
from tidemark.schemas import JOB_COLUMNS

BLOCK = 8


def setting(spark, d):
    rows = postings(spark, d, BLOCK)
    owners = companies(spark, d, shared_names=True)
    return job_state(rows.filter(earlier())), owners, snapshots(owners), batch_postings(rows)


SQL_SETTING = f"{sql_postings(BLOCK)}, {sql_state(SQL_EARLIER)}, {SQL_BATCH}, {SQL_SNAPSHOTS}, {sqltext.location_categories('postings_v')}"
# kept postings of scanned companies, fingerprinted and classified; p1/pn mark first and last copy
SQL_KEPT = f"""scan AS (SELECT * FROM snapshots_v WHERE outcome = 'ok'),
seen AS (SELECT b.*, category IN ('US', 'REMOTE_US') AS kept FROM batch_v b SEMI JOIN scan USING (company_id)
  JOIN loc_cat c ON b.location IS NOT DISTINCT FROM c.location),
{sqltext.classified("(SELECT * FROM seen WHERE kept)")},
fp AS (SELECT *, {FINGERPRINT_SQL} AS fingerprint_hash FROM classified),
batch AS (SELECT *, row_number() OVER (PARTITION BY fingerprint_hash ORDER BY company_id, ordinal) AS p1,
  row_number() OVER (PARTITION BY fingerprint_hash ORDER BY company_id DESC, ordinal DESC) AS pn FROM fp),
firsts AS (SELECT * FROM batch WHERE p1 = 1), lasts AS (SELECT * FROM batch WHERE pn = 1),
posters AS (SELECT DISTINCT fingerprint_hash, company_id FROM batch),
used AS (SELECT company_id, max(ordinal) + 1 AS n FROM seen GROUP BY company_id),
starts AS (SELECT company_id, coalesce(sum(n) OVER (ORDER BY company_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM used),
merged AS (
  SELECT coalesce(s.fingerprint_hash, l.fingerprint_hash) AS fingerprint_hash, s.fingerprint_hash IS NULL AS is_new, l.fingerprint_hash IS NOT NULL AS posted,
    coalesce(s.company_id, f.company_id) AS owner, coalesce(s.is_active, false) AS was_active,
    coalesce(s.id, CAST((SELECT coalesce(max(id), 0) FROM state_v) + off + f.ordinal + 1 AS BIGINT)) AS id,
    coalesce(s.company_id, f.company_id) IN (SELECT company_id FROM scan) AS owner_scanned,
    EXISTS (SELECT 1 FROM posters p WHERE p.fingerprint_hash = s.fingerprint_hash AND p.company_id = s.company_id) AS owner_posted,
    coalesce(f.company_id < s.company_id, false) AS opened_before, coalesce(l.company_id > s.company_id, false) AS opened_after,
    coalesce(s.first_seen_at, TIMESTAMP '2002-01-01') AS first_seen_at, s.last_seen_at AS state_seen, f.is_swe AS first_swe, f.is_entry AS first_entry,
    CASE WHEN l.fingerprint_hash IS NOT NULL THEN l.title ELSE s.title END AS title, CASE WHEN l.fingerprint_hash IS NOT NULL THEN l.level ELSE s.level END AS level,
    CASE WHEN l.fingerprint_hash IS NOT NULL THEN l.team ELSE s.team END AS team,
    CASE WHEN l.fingerprint_hash IS NOT NULL THEN l.description_text ELSE s.description_text END AS description_text,
    CASE WHEN l.fingerprint_hash IS NOT NULL THEN l.posted_at ELSE s.posted_at END AS posted_at,
    CASE WHEN l.fingerprint_hash IS NOT NULL THEN l.entry_level_score ELSE s.entry_level_score END AS entry_level_score,
    CASE WHEN l.fingerprint_hash IS NOT NULL THEN l.is_swe ELSE s.is_software_engineering_related END AS is_software_engineering_related,
    CASE WHEN l.fingerprint_hash IS NOT NULL THEN l.is_entry ELSE s.is_entry_level END AS is_entry_level
  FROM state_v s FULL JOIN lasts l ON s.fingerprint_hash = l.fingerprint_hash
  LEFT JOIN firsts f ON f.fingerprint_hash = l.fingerprint_hash LEFT JOIN starts ON starts.company_id = f.company_id),
turn AS (SELECT *, NOT is_new AND owner_scanned AND NOT owner_posted AND (was_active OR opened_before) AS closed FROM merged),
final AS (SELECT *, CASE WHEN is_new THEN true WHEN owner_scanned AND NOT owner_posted THEN opened_after ELSE posted OR was_active END AS is_active,
  CASE WHEN posted OR closed THEN TIMESTAMP '2002-01-01' ELSE state_seen END AS last_seen_at FROM turn)"""
_COLUMNS = """id, owner AS company_id, title, level, team, description_text, posted_at, first_seen_at, last_seen_at, is_active,
  entry_level_score, is_entry_level, is_software_engineering_related, fingerprint_hash"""
_NAMES = [
    "id", "company_id", "title", "level", "team", "description_text", "posted_at", "first_seen_at", "last_seen_at", "is_active",
    "entry_level_score", "is_entry_level", "is_software_engineering_related", "fingerprint_hash",
]


@query("snapshot_ingest", f"WITH {SQL_SETTING}, {SQL_KEPT} SELECT {_COLUMNS} FROM final")
def snapshot_ingest(spark, d):
    jobs, owners, shots, batch = setting(spark, d)
    return ingest.merge_snapshots(jobs, owners, shots, batch).select(_NAMES)


_COUNTS = """SELECT scan.company_id, count(s.ordinal) AS jobs_seen_total,
  count(*) FILTER (WHERE NOT s.kept) AS jobs_skipped_international FROM scan LEFT JOIN seen s ON s.company_id = scan.company_id GROUP BY 1"""
_CHANGES = """SELECT owner AS company_id, count(*) FILTER (WHERE is_new) AS jobs_inserted_total,
  count(*) FILTER (WHERE is_new AND first_swe) AS jobs_inserted_software_related,
  count(*) FILTER (WHERE is_new AND first_entry) AS jobs_inserted_entry_level,
  count(*) FILTER (WHERE is_new AND first_swe AND first_entry) AS jobs_inserted_digest_eligible,
  count(*) FILTER (WHERE is_new AND NOT first_swe) AS jobs_skipped_non_software,
  count(*) FILTER (WHERE is_new AND first_swe AND NOT first_entry) AS jobs_skipped_non_entry_level,
  count(*) FILTER (WHERE closed) AS inactive_jobs_marked FROM final GROUP BY 1"""
_PER_COMPANY = "SELECT c.company_id, " + ", ".join(f"coalesce({n}, 0) AS {n}" for n in ingest.COUNTERS) + (
    f" FROM ({_COUNTS}) c LEFT JOIN ({_CHANGES}) g ON g.company_id = c.company_id"
)


@query(
    "ingest_counters",
    f"""WITH {SQL_SETTING}, {SQL_KEPT}, per AS ({_PER_COMPANY})
    SELECT company_id, {', '.join(f'CAST(sum({n}) AS BIGINT) AS {n}' for n in ingest.COUNTERS)} FROM per GROUP BY ROLLUP (company_id)""",
)
def ingest_counters(spark, d):
    jobs, owners, shots, batch = setting(spark, d)
    merged = ingest.merge_snapshots(jobs, owners, shots, batch)
    return ingest.total_counters(ingest.ingest_counters(merged, owners, shots, batch))


@query(
    "ingest_without_location_filter",
    f"""WITH {SQL_SETTING}, {SQL_KEPT.replace('WHERE kept)', 'WHERE true)')} SELECT {_COLUMNS} FROM final""",
)
def ingest_without_location_filter(spark, d):
    jobs, owners, shots, batch = setting(spark, d)
    return ingest.merge_snapshots(jobs, owners, shots, batch, us_only=False).select(_NAMES)


@query(
    "batch_duplicates",
    f"""WITH {SQL_SETTING.replace(SQL_BATCH, "batch_v AS (SELECT * FROM postings_v)")}, {SQL_KEPT} SELECT f.fingerprint_hash, f.company_id AS first_company, f.ordinal AS first_ordinal,
      l.company_id AS last_company, l.level, l.posted_at, (SELECT count(*) FROM posters p WHERE p.fingerprint_hash = f.fingerprint_hash) AS n_posters
    FROM firsts f JOIN lasts l ON f.fingerprint_hash = l.fingerprint_hash""",
)
def batch_duplicates(spark, d):
    """All orders as one batch."""
    _, owners, shots, _ = setting(spark, d)
    prepared = ingest.prepare_batch(postings(spark, d, BLOCK), ingest.scanned_companies(owners, shots))
    return ingest.resolve_duplicates(prepared).select(
        "fingerprint_hash", F.col("first.company_id").alias("first_company"), F.col("first.ordinal").alias("first_ordinal"),
        F.col("last.company_id").alias("last_company"), "last.level", "last.posted_at",
        F.size("posters").cast("bigint").alias("n_posters"),
    )


@query(
    "stale_jobs",
    f"""WITH {SQL_SETTING}, {SQL_KEPT} SELECT s.id, s.company_id FROM state_v s SEMI JOIN scan ON scan.company_id = s.company_id
    WHERE s.is_active AND NOT EXISTS (SELECT 1 FROM posters p WHERE p.fingerprint_hash = s.fingerprint_hash AND p.company_id = s.company_id)""",
)
def stale_jobs(spark, d):
    jobs, owners, shots, batch = setting(spark, d)
    prepared = ingest.prepare_batch(batch, ingest.scanned_companies(owners, shots))
    return ingest.stale_jobs(jobs, shots, prepared).select("id", "company_id")


@query(
    "us_postings",
    f"""WITH {sql_postings()}, {sqltext.location_categories('postings_v')} SELECT ordinal, location, category FROM postings_v p
    JOIN loc_cat c ON p.location IS NOT DISTINCT FROM c.location WHERE category IN ('US', 'REMOTE_US')""".replace("p.location,", "p.location,").replace(
        "SELECT ordinal, location, category", "SELECT ordinal, p.location, category"
    ),
)
def us_postings(spark, d):
    return ingest.keep_us(postings(spark, d)).select("ordinal", "location", classify_location(F.col("location")).alias("category"))


_ELIGIBLE = f"""WITH {sql_postings()}, {sqltext.location_categories('postings_v')}, {sqltext.classified('postings_v')}
    SELECT company_id, ordinal, title, p.location, {FINGERPRINT_SQL.replace("location", "p.location")} AS fingerprint_hash, entry_level_score
    FROM classified p JOIN loc_cat c ON p.location IS NOT DISTINCT FROM c.location
    WHERE category IN ('US', 'REMOTE_US') AND is_swe AND is_entry"""


@query("eligible_postings", _ELIGIBLE)
def eligible_postings(spark, d):
    """Location filter, classification, fingerprint: the digest candidates among fresh postings."""
    prepared = ingest.prepare_batch(
        postings(spark, d),
        companies(spark, d).select(
            F.col("id").alias("company_id"), F.col("name").alias("company_name"), F.lit("2002-01-01").cast("timestamp").alias("cycle_ts")
        ),
    )
    return prepared.filter(F.col("is_entry_level") & F.col("is_software_engineering_related")).select(
        "company_id", "ordinal", "title", "location", "fingerprint_hash", "entry_level_score"
    )


@query(
    "reclassified_jobs",
    f"""WITH {sql_postings()}, {SQL_STATE}, {sqltext.classified("(SELECT * EXCLUDE (entry_level_score) FROM state_v)")}
    SELECT id, is_swe AS is_software_engineering_related, is_entry AS is_entry_level, entry_level_score FROM classified""",
)
def reclassified_jobs(spark, d):
    return ingest.reclassify(job_state(postings(spark, d))).select(
        "id", "is_software_engineering_related", "is_entry_level", "entry_level_score"
    )


@query(
    "reclassified_tally",
    f"""WITH {sql_postings()}, {SQL_STATE}, {sqltext.classified("(SELECT * EXCLUDE (entry_level_score) FROM state_v)")}
    SELECT count(*) AS total, count(*) AS updated, count(*) FILTER (WHERE is_swe) AS software_related, count(*) FILTER (WHERE is_entry) AS entry_level,
      count(*) FILTER (WHERE is_swe AND is_entry) AS digest_eligible FROM classified""",
)
def reclassified_tally(spark, d):
    return ingest.reclassify_tally(ingest.reclassify(job_state(postings(spark, d))))


@query(
    "jobs_of_kept_companies",
    f"WITH {sql_postings()}, {SQL_STATE} SELECT id, company_id FROM state_v WHERE company_id % 2 = 1",
)
def jobs_of_kept_companies(spark, d):
    kept = companies(spark, d).filter(F.col("id") % 2 == 1)
    return ingest.drop_orphans(job_state(postings(spark, d)), kept).select("id", "company_id")
