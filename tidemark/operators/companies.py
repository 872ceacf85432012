"""The company catalog: imports, probes, run budget, bulk changes.

Companies are a dimension table; their frames are small next to postings. New ids are the largest
id plus the row's ordinal, so they are unique and ordered but may leave gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark import rules
from tidemark.functions import variants as V
from tidemark.functions.source_urls import (
    careers_url_for,
    expects_json,
    is_not_found,
    looks_like_job_board,
    not_found_detail,
    setting,
    validation_url_for,
)
from tidemark.functions.text import strip
from tidemark.schemas import COMPANY_COLUMNS

EMPTY_CONFIG = "map<string,string>"


def empty_config() -> Column:
    return F.create_map().cast(EMPTY_CONFIG)


def _replaced(companies: DataFrame, **changes: Column) -> DataFrame:
    return companies.select(*[changes.get(c, F.col(c)).alias(c) for c in COMPANY_COLUMNS])


def _next_id(companies: DataFrame) -> Column:
    return companies.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last_id")).scalar()


# ---- imports ------------------------------------------------------------------------------
def normalize_targets(targets: DataFrame) -> DataFrame:
    """Target rows as company values; unknown source types become unconfigured and disabled."""
    known = F.col("source_type").isin(*rules.SOURCE_TYPES)
    return targets.select(
        "name",
        "careers_url",
        F.when(known, F.col("source_type")).otherwise(F.lit(rules.UNCONFIGURED)).alias("source_type"),
        F.when(known, F.col("source_config")).otherwise(empty_config()).alias("source_config"),
        (known & F.col("enabled")).alias("enabled"),
        F.when(~known, F.lit(rules.NEEDS_SOURCE_ERROR)).alias("last_error"),
        F.col("line_number").cast("bigint").alias("ordinal"),
    )


def match_companies(companies: DataFrame, rows: DataFrame) -> DataFrame:
    """Import rows merged per (name, source_type) and matched with the stored company of that key.

    The last row of a key gives the values, but `enabled` comes from the last row that states it.
    `id` is null for keys to insert. Where the stored key is not unique its smallest id is taken.
    """
    values = F.struct("careers_url", "source_config", "last_error")
    merged = rows.groupBy("name", "source_type").agg(
        F.max_by(values, "ordinal").alias("new"),
        F.max_by("enabled", F.when(F.col("enabled").isNotNull(), F.col("ordinal"))).alias("new_enabled"),
        F.min("ordinal").alias("ordinal"),
        F.count("*").alias("n_rows"),
    )
    stored = companies.groupBy("name", "source_type").agg(F.min("id").alias("id"))
    return merged.join(stored, ["name", "source_type"], "left")


def upsert_companies(
    companies: DataFrame, rows: DataFrame, as_of: Column, set_error: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(companies after the import, tally) for rows (name, careers_url, source_type, source_config,
    enabled, last_error, ordinal). A null `enabled` means not stated: true on insert, else unchanged.
    """
    matched = match_companies(companies, rows)
    changes = matched.filter(F.col("id").isNotNull()).select("id", "new", "new_enabled")
    updated = _replaced(
        companies.join(changes, "id", "left"),
        careers_url=F.coalesce("new.careers_url", "careers_url"),
        source_config=F.coalesce("new.source_config", "source_config"),
        enabled=F.coalesce("new_enabled", "enabled"),
        last_error=F.when(F.col("new").isNotNull(), F.col("new.last_error")).otherwise(F.col("last_error"))
        if set_error
        else F.col("last_error"),
    )
    inserted = new_companies(
        matched.filter(F.col("id").isNull()).select(
            "name", "source_type", "new.*", F.coalesce("new_enabled", F.lit(True)).alias("enabled"), "ordinal"
        ),
        companies,
        as_of,
    )
    tally = matched.agg(
        F.count_if(F.col("id").isNull()).alias("inserted"),
        (F.coalesce(F.sum("n_rows"), F.lit(0)) - F.count_if(F.col("id").isNull())).alias("updated"),
        F.lit(0).cast("bigint").alias("skipped"),
        F.coalesce(F.sum(F.when(F.col("source_type") == rules.UNCONFIGURED, F.col("n_rows"))), F.lit(0)).alias(
            "unconfigured"
        ),
    )
    return updated.unionByName(inserted), tally


def new_companies(rows: DataFrame, companies: DataFrame, as_of: Column) -> DataFrame:
    """Rows with an `ordinal` (from 1) as fresh company rows."""
    given = set(rows.columns)
    values = {
        "id": _next_id(companies) + F.col("ordinal"),
        "last_validated_at": F.lit(None).cast("timestamp"),
        "last_validation_status": F.lit(None).cast("string"),
        "consecutive_failures": F.lit(0),
        "created_at": as_of,
        "updated_at": as_of,
    }
    if "last_error" not in given:
        values["last_error"] = F.lit(None).cast("string")
    return rows.select(*[values.get(c, F.col(c)).alias(c) for c in COMPANY_COLUMNS if c in given | set(values)])


def seed_missing(companies: DataFrame, rows: DataFrame, as_of: Column) -> DataFrame:
    """Adds rows whose name is not stored yet, whatever its source type; the first of a name wins."""
    values = F.struct(*[c for c in rows.columns if c not in ("name", "ordinal")])
    firsts = rows.groupBy("name").agg(F.min_by(values, "ordinal").alias("v"), F.min("ordinal").alias("ordinal"))
    missing = firsts.join(companies.select("name"), "name", "left_anti").select("name", "v.*", "ordinal")
    return companies.select(COMPANY_COLUMNS).unionByName(new_companies(missing, companies, as_of))


def create_company(companies: DataFrame, row: DataFrame, as_of: Column) -> DataFrame:
    """Appends one company."""
    return companies.select(COMPANY_COLUMNS).unionByName(
        new_companies(row.withColumn("ordinal", F.lit(1)), companies, as_of)
    )


def list_companies(companies: DataFrame, enabled: bool | None = None, limit: int | None = None) -> DataFrame:
    found = companies if enabled is None else companies.filter(F.col("enabled").eqNullSafe(enabled))
    ordered = found.orderBy("name", "id")
    return ordered.limit(limit) if limit else ordered


# ---- probes -------------------------------------------------------------------------------
def evaluate_probes(companies: DataFrame, probes: DataFrame) -> DataFrame:
    """Adds `probe`: struct(status_code, valid, error, url) to companies, from one probe row each.

    `probe` is null where a probe was needed and is missing.
    """
    generic = F.col("source_type") == rules.GENERIC
    own_url = strip(F.coalesce(F.nullif("careers_url", F.lit("")), setting(F.col("source_config"), "careers_url")))
    url = F.nullif(
        F.when(generic, own_url).otherwise(validation_url_for(F.col("source_type"), F.col("source_config"))),
        F.lit(""),
    )
    status, body = F.col("p.status_code"), F.col("p.body")
    http_error = F.concat(F.lit("HTTP "), status.cast("string"))
    document = V.parse(body)
    body_error = (
        F.when(
            F.col("source_type") == "smartrecruiters",
            F.when(document.isNull(), F.lit("invalid JSON from SmartRecruiters API")).when(
                ~V.is_kind(document, "OBJECT"), F.lit("invalid SmartRecruiters API response")
            ),
        )
        .when(expects_json(F.col("source_type")), F.lit(None))
        .when(
            ~looks_like_job_board(body, F.col("source_type")), F.lit("page does not look like a job board")
        )
    )
    plain_error = (
        F.when(status.isNull(), F.coalesce("p.error", F.lit("unknown error")))
        .when(status != 200, http_error)
        .otherwise(body_error)
    )
    rendered_status = F.when(
        F.col("p.rendered_error").isNull(), F.coalesce("p.rendered_status", F.lit(200))
    )
    settled = F.coalesce(status.isin(200, 403, 404), F.lit(False))
    generic_status = F.when(settled, status).otherwise(rendered_status)
    generic_error = F.when(generic_status.isNull(), F.col("p.rendered_error")).when(
        F.when(settled, status != 200).otherwise(rendered_status >= 400),
        F.concat(F.lit("HTTP "), generic_status.cast("string")),
    )
    final_status = F.when(generic, generic_status).otherwise(status)
    final_error = F.when(generic, generic_error).otherwise(plain_error)

    def outcome(status_code, error, at) -> Column:
        return F.struct(
            status_code.alias("status_code"),
            error.isNull().alias("valid"),
            F.coalesce(error, F.lit("")).alias("error"),
            at.alias("url"),
        )

    no_url = F.when(generic, F.lit("missing careers_url")).otherwise(F.lit(rules.PROBE_UNSUPPORTED))
    answers = probes.select(F.col("company_id").alias("id"), F.struct(*probes.columns).alias("p"))
    return (
        companies.join(answers, "id", "left")
        .withColumn(
            "probe",
            F.when(url.isNull(), outcome(F.lit(None).cast("int"), no_url, F.lit(None).cast("string"))).when(
                F.col("p").isNotNull(), outcome(final_status, final_error, url)
            ),
        )
        .drop("p")
    )


def apply_probes(
    companies: DataFrame,
    probes: DataFrame,
    as_of: Column,
    *,
    only_enabled: bool = True,
    disable_on_404: bool = True,
    re_enable_valid: bool = False,
) -> DataFrame:
    """Companies after validation, with `validation`: valid, disabled, failed, skipped, or null.

    Companies that were not selected, are unconfigured or have no probe row stay as they are.
    """
    selected = F.col("enabled") if only_enabled else F.lit(True)
    configured = F.col("source_type") != rules.UNCONFIGURED
    judged = selected & configured & F.col("probe").isNotNull()
    status, valid = F.col("probe.status_code"), judged & F.col("probe.valid")
    missing = judged & ~F.col("probe.valid") & F.coalesce(status == 404, F.lit(False))
    detail = not_found_detail(F.col("source_type"), F.col("source_config"), F.lit(None).cast("string"))
    failures = F.col("consecutive_failures")
    disabled = missing & F.lit(disable_on_404)
    validation = (
        F.when(selected & ~configured, F.lit("skipped"))
        .when(judged & status.isNull() & F.col("probe.error").contains("not supported"), F.lit("skipped"))
        .when(valid, F.lit("valid"))
        .when(disabled, F.lit("disabled"))
        .when(judged, F.lit("failed"))
    )
    changes = {
        "last_validated_at": F.when(judged, as_of).otherwise(F.col("last_validated_at")),
        "last_validation_status": F.when(valid, F.lit("200"))
        .when(judged, F.coalesce(status.cast("string"), F.lit("error")))
        .otherwise(F.col("last_validation_status")),
        "enabled": F.when(disabled, F.lit(False))
        .when(valid & F.lit(re_enable_valid), F.lit(True))
        .otherwise(F.col("enabled")),
        "consecutive_failures": F.when(valid, F.lit(0))
        .when(disabled, F.greatest(failures, F.lit(rules.DISABLE_AFTER_404)))
        .when(missing, failures + 1)
        .otherwise(failures),
        "last_error": F.when(valid, F.lit(None))
        .when(missing, detail)
        .when(judged, F.nullif("probe.error", F.lit("")))
        .otherwise(F.col("last_error")),
    }
    return evaluate_probes(companies, probes).select(
        *[changes.get(c, F.col(c)).alias(c) for c in COMPANY_COLUMNS], validation.alias("validation"), "probe"
    )


def validation_tally(validated: DataFrame) -> DataFrame:
    kind = F.col("validation")
    return validated.agg(
        *[F.count_if(kind == k).alias(f"{k}_count") for k in ("valid", "disabled", "failed", "skipped")]
    )


# ---- scrape outcomes ----------------------------------------------------------------------
def apply_outcomes(companies: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Companies after one cycle, with `failure`: the message of a failed scrape, else null.

    A success resets the failure count; a 404 counts and disables at the threshold; any other
    error is only noted.
    """
    result = snapshots.select(
        F.col("company_id").alias("id"), "outcome", F.col("error").alias("scrape_error")
    )
    ok, failed = (F.coalesce(F.col("outcome") == v, F.lit(False)) for v in ("ok", "failed"))
    error = F.col("scrape_error")
    missing = failed & is_not_found(F.lit(None).cast("int"), error)
    detail = not_found_detail(F.col("source_type"), F.col("source_config"), error)
    failures = F.when(ok, F.lit(0)).when(missing, F.col("consecutive_failures") + 1).otherwise(
        F.col("consecutive_failures")
    )
    message = F.when(missing, F.concat(F.lit("invalid_source_config ("), detail, F.lit(")"))).otherwise(error)
    changes = {
        "consecutive_failures": failures,
        "last_error": F.when(missing, detail).when(failed, error).when(~ok, F.col("last_error")),
        "last_validation_status": F.when(missing, F.lit("404")).otherwise(F.col("last_validation_status")),
        "enabled": F.col("enabled") & ~(missing & (failures >= rules.DISABLE_AFTER_404)),
    }
    return companies.join(result, "id", "left").select(
        *[changes.get(c, F.col(c)).alias(c) for c in COMPANY_COLUMNS],
        F.when(failed, F.concat("name", F.lit(": "), message)).alias("failure"),
    )


# ---- selection and bulk changes -----------------------------------------------------------
def companies_to_scrape(
    companies: DataFrame, generic_enabled: bool = True, generic_budget: int = rules.GENERIC_BUDGET
) -> DataFrame:
    """Enabled companies; of the generic kind only the first `generic_budget` by id."""
    enabled = companies.filter(F.col("enabled"))
    generic = F.col("source_type") == rules.GENERIC
    budget = generic_budget if generic_enabled else 0
    return enabled.filter(~generic).unionByName(enabled.filter(generic).orderBy("id").limit(budget))


def eligible_for_generic() -> Column:
    """Has a careers url and no source type of its own that can be scraped."""
    kind = F.col("source_type")
    other = kind.isNotNull() & (kind != "") & ~kind.isin(*rules.SOURCE_TYPES)
    return (strip(F.coalesce("careers_url", F.lit(""))) != "") & ((kind == rules.UNCONFIGURED) | other)


def enable_generic(companies: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(companies with generic scraping switched on for the first eligible ones by name, tally)."""
    eligible = companies.filter(eligible_for_generic())
    chosen = (eligible.orderBy("name", "id").limit(limit) if limit else eligible).select(
        "id", F.lit(True).alias("chosen")
    )
    url = strip(F.col("careers_url"))
    hit = F.coalesce("chosen", F.lit(False))
    changed = _replaced(
        companies.join(chosen, "id", "left"),
        source_type=F.when(hit, F.lit(rules.GENERIC)).otherwise(F.col("source_type")),
        source_config=F.when(hit, F.create_map(F.lit("careers_url"), url)).otherwise(F.col("source_config")),
        enabled=F.col("enabled") | hit,
        last_error=F.when(~hit, F.col("last_error")),
    )
    return changed, chosen.agg(F.count("*").alias("eligible"), F.count("*").alias("updated"))


def companies_to_discover(companies: DataFrame, limit: int | None = None) -> DataFrame:
    """Unconfigured companies, the first `limit` by name where a limit is given."""
    open_ = companies.filter(F.col("source_type") == rules.UNCONFIGURED)
    return open_.orderBy("name", "id").limit(limit) if limit else open_


def apply_discovery(
    companies: DataFrame, discovered: DataFrame, probes: DataFrame, replace_configured: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(companies after source discovery, counters).

    Results of companies that have a source are neither applied nor counted, unless
    `replace_configured`.

    Supported finds are configured, and enabled when their probe is valid; otherwise the company
    stays unconfigured with the reason noted. Companies whose landing page failed keep their row.
    """
    found = discovered.select(F.col("company_id").alias("id"), F.struct(*discovered.columns).alias("d"))
    supported = F.col("d.bucket") == "configured_supported"
    target = companies.join(found, "id", "left")
    if not replace_configured:
        target = target.withColumn("d", F.when(F.col("source_type") == rules.UNCONFIGURED, F.col("d")))
    proposed = target.filter(supported).select(
        "id",
        "name",
        F.col("d.source_type").alias("source_type"),
        F.col("d.source_config").alias("source_config"),
        F.coalesce(
            F.nullif(careers_url_for(F.col("d.source_type"), F.col("d.source_config")), F.lit("")),
            "d.final_careers_url",
            "careers_url",
        ).alias("careers_url"),
    )
    judged = evaluate_probes(proposed, probes).select(
        "id",
        F.struct("source_type", "source_config", "careers_url").alias("n"),
        F.coalesce("probe.valid", F.lit(False)).alias("valid"),
        F.coalesce(
            F.nullif("probe.error", F.lit("")),
            F.concat(F.lit("Validation failed (HTTP "), F.col("probe.status_code").cast("string"), F.lit(")")),
            F.lit("unknown error"),
        ).alias("probe_error"),
    )
    joined = target.join(judged, "id", "left")
    configured = F.col("n").isNotNull()
    left_alone = F.col("d").isNull() | (F.col("d.bucket") == "errors")
    valid = configured & F.coalesce("valid", F.lit(False))

    def changed(when_configured: Column, otherwise: Column, name: str) -> Column:
        return F.when(left_alone, F.col(name)).when(configured, when_configured).otherwise(otherwise)

    after = _replaced(
        joined,
        source_type=changed(F.col("n.source_type"), F.lit(rules.UNCONFIGURED), "source_type"),
        source_config=changed(F.col("n.source_config"), empty_config(), "source_config"),
        careers_url=changed(F.col("n.careers_url"), F.col("careers_url"), "careers_url"),
        enabled=changed(valid, F.lit(False), "enabled"),
        last_error=changed(F.when(~valid, F.col("probe_error")), F.col("d.reason"), "last_error"),
        consecutive_failures=F.when(valid, F.lit(0)).otherwise(F.col("consecutive_failures")),
        last_validation_status=F.when(valid, F.lit("200")).otherwise(F.col("last_validation_status")),
    )
    counters = joined.filter(F.col("d").isNotNull()).agg(
        F.count("*").alias("processed"),
        *[
            F.count_if(F.col("d.bucket") == b).alias(b)
            for b in ("configured_supported", "detected_unsupported", "still_unknown", "errors")
        ],
        F.count_if(valid).alias("enabled_after_validation"),
    )
    return after, counters
