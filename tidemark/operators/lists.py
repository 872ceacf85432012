"""Filtered, sorted and paged job lists."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from tidemark import rules
from tidemark.functions.timestamps import within_local_day
from tidemark.schemas import JOB_LIST_COLUMNS


def by_company_name(jobs: DataFrame, companies: DataFrame, name: str | None) -> DataFrame:
    """Case-insensitive substring on the company name; `%` and `_` in it stay wildcards."""
    wanted = (name or "").strip()
    if not wanted:
        return jobs
    matching = companies.filter(F.col("name").ilike(f"%{wanted}%")).select(F.col("id").alias("company_id"))
    return jobs.join(matching, "company_id")


def with_company_name(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """Jobs with `company_name`; a missing company reads Unknown."""
    names = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company_name"))
    return jobs.join(names, "company_id", "left").withColumn(
        "company_name", F.coalesce("company_name", F.lit("Unknown"))
    )


def filter_jobs(
    jobs: DataFrame,
    *,
    company_id: int | None = None,
    is_entry_level: bool | None = None,
    is_active: bool | None = None,
    first_seen_day: date | str | None = None,
    zone: str = rules.TIME_ZONE,
) -> DataFrame:
    """Equality and calendar-day filters; one that is not given does not filter."""
    if company_id is not None:
        jobs = jobs.filter(F.col("company_id") == company_id)
    for name, wanted in (("is_entry_level", is_entry_level), ("is_active", is_active)):
        if wanted is not None:
            jobs = jobs.filter(F.col(name).eqNullSafe(wanted))
    if first_seen_day is not None:
        jobs = jobs.filter(within_local_day(F.col("first_seen_at"), _day(first_seen_day), zone))
    return jobs


def seen_since(jobs: DataFrame, as_of: Column, hours: int) -> DataFrame:
    """First seen in the last `hours` before `as_of`; there is no upper bound."""
    return jobs.filter(F.col("first_seen_at") >= as_of - F.make_dt_interval(hours=F.lit(hours)))


def digest_eligible(jobs: DataFrame) -> DataFrame:
    """Entry-level software jobs, active or not."""
    return jobs.filter(F.col("is_entry_level") & F.col("is_software_engineering_related"))


def page(rows: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must be between 1 and 500, offset not negative")
    return (rows.offset(offset) if offset else rows).limit(limit)


def list_jobs(
    jobs: DataFrame,
    companies: DataFrame,
    *,
    company: str | None = None,
    limit: int = 50,
    offset: int = 0,
    **filters,
) -> tuple[DataFrame, DataFrame]:
    """(items, total): one page of the newest jobs, and the count of all that match.

    Companies are joined only when their name is asked for.
    """
    found = filter_jobs(by_company_name(jobs, companies, company), **filters)
    newest = found.select(JOB_LIST_COLUMNS).orderBy(F.desc("first_seen_at"), "id")
    return page(newest, limit, offset), found.agg(F.count("*").alias("total"))


def new_today(
    jobs: DataFrame, today: date | str, *, zone: str = rules.TIME_ZONE, limit: int = 100, offset: int = 0
) -> tuple[DataFrame, DataFrame]:
    """(items, total) of the jobs first seen on a calendar day, by company and title."""
    found = filter_jobs(jobs, first_seen_day=today, zone=zone)
    ordered = found.select(JOB_LIST_COLUMNS).orderBy("company_id", "title", "id")
    return page(ordered, limit, offset), found.agg(F.count("*").alias("total"))


def _day(day: date | str) -> Column:
    return F.lit(str(day)).cast("date")
