"""Catalog summaries and run metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark import rules
from tidemark.functions.text import strip


def company_totals(companies: DataFrame) -> DataFrame:
    """One row: total, enabled, disabled, unconfigured."""
    label = F.lower(strip(F.coalesce("source_type", F.lit(""))))
    return companies.agg(
        F.count("*").alias("total"),
        F.count_if("enabled").alias("enabled"),
        (F.count("*") - F.count_if("enabled")).alias("disabled"),
        F.count_if(label.isin(*rules.UNCONFIGURED_LABELS)).alias("unconfigured"),
    )


def company_breakdown(companies: DataFrame) -> DataFrame:
    """(dimension, key, n) by source type and by validation status, in one grouping-sets pass."""
    keyed = companies.select(
        F.coalesce(F.nullif(strip(F.coalesce("source_type", F.lit(""))), F.lit("")), F.lit(rules.UNCONFIGURED)).alias(
            "source_type"
        ),
        F.coalesce(
            F.nullif(strip(F.coalesce(F.nullif("last_validation_status", F.lit("")), F.lit("never"))), F.lit("")),
            F.lit("never"),
        ).alias("status"),
    )
    both = keyed.groupingSets([["source_type"], ["status"]], "source_type", "status").agg(F.count("*").alias("n"))
    by_source = F.col("status").isNull()
    return both.select(
        F.when(by_source, F.lit("source_type")).otherwise(F.lit("last_validation_status")).alias("dimension"),
        F.coalesce("source_type", "status").alias("key"),
        "n",
    ).orderBy("dimension", F.desc("n"), "key")


def run_message(has_failures: bool) -> str:
    return "Scrape pipeline completed with partial failures" if has_failures else "Scrape pipeline completed"


def scrape_failures(companies_after: DataFrame) -> DataFrame:
    """(company_id, failure) of the failed companies of a cycle, from `apply_outcomes`."""
    return companies_after.filter(F.col("failure").isNotNull()).select(F.col("id").alias("company_id"), "failure")


def scrape_metrics(counters: DataFrame, failures: DataFrame, digest_candidates: int | None = None) -> DataFrame:
    """One row (metrics JSON, message). `counters` has one row per scanned company."""
    from tidemark.operators.ingest import COUNTERS

    totals = counters.agg(
        F.count("*").alias("companies_scanned"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS],
    )
    # One message per failed company: bounded by the catalog.
    messages = failures.agg(F.array_sort(F.collect_list(F.struct("company_id", "failure"))).alias("f"))
    aliases = {
        "companies_scanned": "companies_scanned",
        "jobs_seen_total": "jobs_seen_total",
        "jobs_inserted_total": "jobs_inserted_total",
        "new_jobs_created_all": "jobs_inserted_total",
        "new_swe_jobs_created": "jobs_inserted_software_related",
        "new_entry_level_swe_jobs_created": "jobs_inserted_digest_eligible",
        "jobs_inserted_software_related": "jobs_inserted_software_related",
        "jobs_inserted_entry_level": "jobs_inserted_entry_level",
        "jobs_inserted_digest_eligible": "jobs_inserted_digest_eligible",
        "jobs_skipped_international": "jobs_skipped_international",
        "jobs_skipped_non_software": "jobs_skipped_non_software",
        "jobs_skipped_non_entry_level": "jobs_skipped_non_entry_level",
        "digest_candidates_count": None,
        "inactive_jobs_marked": "inactive_jobs_marked",
        "jobs_seen": "jobs_seen_total",
        "new_jobs_created": "jobs_inserted_total",
    }
    failed = messages.select(F.col("f.failure").alias("failed")).scalar()
    fields = [
        (F.col(source) if source else F.lit(digest_candidates or 0).cast("bigint")).alias(name)
        for name, source in aliases.items()
    ]
    doc = totals.withColumn("failed", failed).select(
        F.to_json(
            F.struct(
                *fields,
                F.col("failed").alias("scraper_failures"),
                F.size("failed").cast("bigint").alias("scraper_failure_count"),
            )
        ).alias("metrics"),
        F.when(F.size("failed") > 0, F.lit(run_message(True))).otherwise(F.lit(run_message(False))).alias("message"),
    )
    return doc


def digest_metrics(candidates: DataFrame, window: str) -> DataFrame:
    """One row (metrics JSON) for a digest; delivery is not part of this library."""
    n = F.col("n")
    return candidates.agg(F.count("*").alias("n")).select(
        F.to_json(
            F.struct(
                F.lit(window).alias("digest_window"),
                n.alias("digest_candidates_count"),
                n.alias("digest_swe_jobs_count"),
                n.alias("digest_entry_level_swe_jobs_count"),
                n.alias("digest_jobs_count"),
            )
        ).alias("metrics")
    )
