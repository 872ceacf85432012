"""One scrape cycle: captures in, new job state, company state, digest and metrics out."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark import rules
from tidemark.functions.timestamps import local_day
from tidemark.operators import boards, companies as catalog, digest, discovery, ingest, metrics, providers
from tidemark.schemas import COMPANY_COLUMNS, JOB_COLUMNS
from tidemark.session import is_small, small_side
from tidemark.sources import captures as capture_source, parts, tables

# Providers with one kind of capture, by source type: sourced captures in, postings out.
PROVIDERS = {
    "greenhouse": providers.greenhouse,
    "lever": providers.lever,
    "ashby": providers.ashby,
    "gem": boards.gem,
}
# those of them whose postings carry a description
DESCRIBED = ("greenhouse", "lever", "ashby")
NO_CAPTURE = "No capture of this company was given"
_COMPANY_KEY = ["company_id", "cycle_ts"]


def _smartrecruiters(sourced: DataFrame, small: bool) -> DataFrame:
    api = providers.smartrecruiters(sourced.filter(F.col("method") == "api"), keep=("method",))
    html = boards.smartrecruiters_html(sourced.filter(F.col("method") == "html"))
    return boards.choose_method(api.unionByName(html), "api", "html", small=small).drop("method")


def _icims(sourced: DataFrame, small: bool) -> DataFrame:
    found = boards.icims(sourced)
    return boards.choose_method(found, "html", "rendered", rules.ICIMS_ENOUGH, small).drop("method")


def _workday(sourced: DataFrame, anchors: DataFrame | None, small: bool, description_cap: int | None) -> DataFrame:
    api = providers.workday(sourced.filter(F.col("method") == "api"), ("method",), description_cap)
    if anchors is None:
        return api.drop("method")
    rows = boards.workday_anchor_rows(anchors.drop("company_name", "careers_url", "source_config")).join(
        small_side(anchors.select(*_COMPANY_KEY, "company_name").distinct(), small), _COMPANY_KEY
    )
    rendered = providers.rendered_rows(
        rows.withColumn("method", F.lit("rendered")), keep=("method",)
    )
    return boards.choose_method(api.unionByName(rendered), "api", "rendered", small=small).drop("method")


def _generic(anchors: DataFrame, small: bool, link_cap: int | None) -> DataFrame:
    links = discovery.job_links(anchors, link_cap, by=("company_id", "cycle_ts"))
    source = anchors.select(*_COMPANY_KEY, "company_name", "careers_url", "source_config").dropDuplicates(_COMPANY_KEY)
    rows = links.join(small_side(source, small), _COMPANY_KEY).withColumns(
        {"page_ordinal": F.lit(0), "pos": F.col("rank") - 1}
    )
    return providers.generic_links(rows)


def collect_postings(
    captures: DataFrame,
    companies: DataFrame,
    anchors: DataFrame | None = None,
    extra_providers: dict | None = None,
    link_cap: int | None = rules.MAX_LINKS,
    description_cap: int | None = rules.DESCRIPTION_CAP,
) -> DataFrame:
    """Postings of all providers for the given companies.

    Each branch filters on `source_type`, the partition column of stored captures. A provider is
    a function from sourced captures to postings; add or replace some with `extra_providers`.
    `link_cap` bounds the links kept per generic company, `description_cap` the characters kept of a
    description; None keeps all.
    """
    small = is_small(companies)
    sourced = providers.with_source(capture_source.usable(captures), companies, small)
    capped = {kind: partial(PROVIDERS[kind], description_cap=description_cap) for kind in DESCRIBED}
    one_kind = {**PROVIDERS, **capped, **(extra_providers or {})}

    def of(kind: str) -> DataFrame:
        return sourced.filter(F.col("source_type") == kind)

    def anchors_of(kind: str) -> DataFrame | None:
        if anchors is None:
            return None
        owners = companies.filter(F.col("source_type") == kind).select(
            F.col("id").alias("company_id"), F.col("name").alias("company_name"), "careers_url", "source_config"
        )
        return anchors.join(small_side(owners, small), "company_id")

    branches = [provider(of(kind)) for kind, provider in one_kind.items()]
    branches += [
        _smartrecruiters(of("smartrecruiters"), small),
        _icims(of("icims"), small),
        _workday(of("workday"), anchors_of("workday"), small, description_cap),
    ]
    if anchors is not None:
        branches.append(_generic(anchors_of(rules.GENERIC), small, link_cap))
    return reduce(lambda a, b: a.unionByName(b), branches)


@dataclass(frozen=True)
class CycleTables:
    """Names of the state tables, and the layout of the job state.

    A cycle rewrites the parts of the companies whose jobs it changes; within a part rows lie in
    buckets of their fingerprints. A part has up to `buckets` files, or a multiple of that once a
    bucket of the merge has more than `ingest.TASK_ROWS` rows: it is then dealt to several tasks.
    """

    jobs: str = "jobs"
    companies: str = "companies"
    postings: str = "cycle_postings"
    buckets: int = 200
    parts: int = 32


@dataclass(frozen=True)
class CycleResult:
    jobs: DataFrame
    companies: DataFrame
    counters: DataFrame
    metrics: DataFrame
    digest: DataFrame | None


def apply_snapshots(
    spark: SparkSession, names: CycleTables, mark: str, snapshots: DataFrame, postings: DataFrame, us_only: bool
) -> DataFrame:
    """Merges a cycle into the stored state and publishes it; returns counters per company.

    The batch is prepared once and stored in the buckets of the state. Only the parts of the state
    that it changes are read and written, with their bookkeeping columns, and the counters read those
    columns back. A mark that is already current is not applied again. A state of another layout is
    rewritten whole, the first time.
    """
    batch_name, counts_name = f"{names.postings}_batch", f"{names.postings}_counts"
    if tables.applied_mark(spark, names.jobs) != mark:
        scanned = ingest.scanned_companies(tables.read_table(spark, names.companies), snapshots)
        small = is_small(scanned)
        counts = tables.write_version(ingest.scan_counts(postings, scanned, us_only), counts_name, mark)
        prepared = ingest.resolve_duplicates(ingest.prepare_batch(postings, scanned, us_only, small))
        batch = tables.write_version(prepared, batch_name, mark, "fingerprint_hash", names.buckets)
        state = tables.read_table(spark, names.jobs)
        last_id, held = ingest.last_id(state), parts.held_parts(spark, names.jobs, names.parts)
        n_posted, least = batch.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
        if held is None:
            touched, held = range(names.parts), {}
        else:
            owners = ingest.touched_owners(state, batch, counts, small, ingest.merge_tasks(n_posted + state.count(), names.buckets, least))
            touched = [r[0] for r in owners.select(parts.part_of(F.col("company_id"), names.parts)).distinct().collect()]
            state = parts.read_parts(spark, names.jobs, held, touched).select(JOB_COLUMNS)
        tasks = ingest.merge_tasks(n_posted + state.count(), names.buckets, least)
        merged = ingest.merge_batch(state, batch, counts, last_id, small, tasks)
        placed = merged.withColumn(parts.PART, parts.part_of(F.col("company_id"), names.parts))
        parts.stage_parts(placed, names.jobs, mark, "fingerprint_hash", names.buckets)
        parts.publish_parts(spark, names.jobs, mark, touched, held, names.parts, JOB_COLUMNS)
        tables.drop_versions(spark, batch_name, [mark])
        tables.drop_versions(spark, counts_name, [mark])
    return ingest.merge_counters(parts.read_written(spark, names.jobs, mark), tables.read_table(spark, counts_name))


def unscraped(chosen: DataFrame, given: DataFrame, as_of: Column) -> DataFrame:
    """A failed snapshot for each chosen company that is not among the ones `given`, so that every company has an outcome."""
    missing = chosen.join(given.select(F.col("company_id").alias("id")).distinct(), "id", "left_anti")
    return missing.select(
        F.col("id").alias("company_id"), as_of.alias("cycle_ts"), F.lit("failed").alias("outcome"), F.lit(NO_CAPTURE).alias("error")
    )


def run_cycle(
    spark: SparkSession,
    captures: DataFrame,
    mark: str,
    as_of: Column,
    *,
    anchors: DataFrame | None = None,
    names: CycleTables = CycleTables(),
    us_only: bool = True,
    generic_enabled: bool = True,
    generic_budget: int = rules.GENERIC_BUDGET,
    swallow: tuple[str, ...] = capture_source.SWALLOWED,
    digest_day: str | None = None,
    lookback_hours: int | None = None,
    extra_providers: dict | None = None,
    link_cap: int | None = rules.MAX_LINKS,
    description_cap: int | None = rules.DESCRIPTION_CAP,
) -> CycleResult:
    """Scrape, ingest, company outcomes, and a digest when `digest_day` or `lookback_hours` is given.

    A chosen company without a capture fails; a generic one does so only where `anchors` are given.
    `extra_providers`, `link_cap` and `description_cap` as in `collect_postings`.
    """
    for name in (names.companies, names.jobs):
        tables.require_table(spark, name)
    companies = tables.read_table(spark, names.companies)
    earlier = {name: tables.applied_mark(spark, name) for name in (names.jobs, names.companies)}
    earlier_parts = parts.held_parts(spark, names.jobs)
    # kept under the mark: a repeated cycle scrapes the same companies, whatever its outcomes changed
    selection = f"{names.postings}_selection"
    if tables.applied_mark(spark, selection) != mark:
        tables.write_version(catalog.companies_to_scrape(companies, generic_enabled, generic_budget), selection, mark)
    chosen = tables.read_table(spark, selection)
    wanted = small_side(chosen.select(F.col("id").alias("company_id")), is_small(chosen))
    scraped = captures.join(wanted, "company_id", "left_semi")
    # Parsing is the expensive step and its results are read several times, so they are written once.
    parsed = collect_postings(scraped, chosen, anchors, extra_providers, link_cap, description_cap)
    postings = tables.write_version(parsed, names.postings, mark)
    fetched = capture_source.snapshots_from_captures(scraped, swallow)
    if anchors is not None:
        rendered = (
            anchors.join(
                chosen.filter(F.col("source_type") == rules.GENERIC).select(F.col("id").alias("company_id")),
                "company_id",
                "left_semi",
            )
            .select("company_id", "cycle_ts")
            .distinct()
            .join(fetched, _COMPANY_KEY, "left_anti")
            .select(*_COMPANY_KEY, F.lit("ok").alias("outcome"), F.lit(None).cast("string").alias("error"))
        )
        fetched = fetched.unionByName(rendered)
    due = chosen if anchors is not None else chosen.filter(F.col("source_type") != rules.GENERIC)
    # read from the captures' ids, so that no body is parsed for it
    given = scraped.select("company_id")
    given = given if anchors is None else given.unionByName(anchors.select("company_id"))
    fetched = fetched.unionByName(unscraped(due, given, as_of))
    snapshots = tables.write_version(ingest.validate_postings(postings, fetched), f"{names.postings}_snapshots", mark)
    counters = apply_snapshots(spark, names, mark, snapshots, postings, us_only)
    after = catalog.apply_outcomes(companies, snapshots)
    if tables.applied_mark(spark, names.companies) != mark:
        outcome = tables.stage_version(after, names.companies, mark)
        tables.publish_version(spark, names.companies, mark, COMPANY_COLUMNS)
    else:
        outcome = spark.table(tables.version_table(names.companies, mark))
    for name in (names.postings, selection, f"{names.postings}_snapshots"):
        tables.drop_versions(spark, name, [mark])
    # the version before stays for readers that still use it
    for name, before in earlier.items():
        if before != mark:
            tables.drop_versions(spark, name, [mark, before or mark])
    if earlier[names.jobs] != mark:
        parts.drop_parts(spark, names.jobs, [earlier_parts, parts.held_parts(spark, names.jobs)])
    failures = metrics.scrape_failures(outcome)
    jobs, current = tables.read_table(spark, names.jobs), tables.read_table(spark, names.companies)
    document = candidates = None
    if digest_day is not None or lookback_hours:
        selected = digest.select_digest_jobs(
            jobs, current, as_of, lookback_hours=lookback_hours, day=digest_day
        )
        candidates = selected.count()
        document = digest.digest_document(selected, digest_day or local_day(as_of, rules.TIME_ZONE))
    return CycleResult(
        jobs, current, counters, metrics.scrape_metrics(counters, failures, candidates), document
    )
