"""Stored provider responses, the input that stands in for live fetching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark import rules, schemas
from tidemark.functions import variants as V

# Source types whose fetch errors read as an empty, successful snapshot (which closes every
# active job of the company). Pass an empty tuple to treat them like the others.
SWALLOWED = ("workday", "smartrecruiters", rules.GENERIC)


# A JSON value above this many bytes may be too large for VARIANT; one that then does not parse
# is unread rather than empty.
SURE_BYTES = 16 << 20


def read_captures(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return spark.read.schema(schemas.CAPTURES).format(format).load(path)


def write_captures(captures: DataFrame, path: str) -> None:
    """Partitioned by source type, so each provider branch reads its own files only."""
    captures.write.partitionBy("source_type").mode("append").parquet(path)


def usable(captures: DataFrame) -> DataFrame:
    return captures.filter(F.col("status_code") < 400)


def snapshots_from_captures(captures: DataFrame, swallow: tuple[str, ...] = SWALLOWED) -> DataFrame:
    """One snapshot per company and cycle: failed with its first error, else ok.

    An http error fails the snapshot, and so does a body that is no JSON where JSON is due or,
    for Greenhouse, no JSON object. A list or object of more than `SURE_BYTES` that cannot be parsed
    fails it for every source type, since reading it as empty would close the company's jobs.
    """
    kind, status = F.col("source_type"), F.col("status_code")
    side = F.when(status < 500, F.lit("Client error")).otherwise(F.lit("Server error"))
    http = F.concat(side, F.lit(" '"), status.cast("string"), F.lit("' for url '"), "page_url", F.lit("'"))
    broken = V.parse(F.col("body")).isNull()
    unread = (F.octet_length("body") > SURE_BYTES) & F.col("body").rlike(r"^\s*[\[{]") & broken
    error = (
        F.when(~kind.isin(*rules.SOURCE_TYPES), F.concat(F.lit("Unknown source_type: "), kind))
        .when((status < 400) & unread, F.lit("response is too large to parse"))
        .when(kind.isin(*swallow) if swallow else F.lit(False), F.lit(None))
        .when(status >= 400, http)
        .when(kind.isin(*rules.JSON_SOURCE_TYPES) & broken, F.lit("response is not JSON"))
        .when((kind == "greenhouse") & ~F.col("body").rlike(r"^\s*\{"), F.lit("response is not a JSON object"))
    )
    narrow = captures.select("company_id", "cycle_ts", "page_ordinal", error.alias("error"))
    return (
        narrow.groupBy("company_id", "cycle_ts")
        .agg(F.min_by("error", F.when(F.col("error").isNotNull(), F.col("page_ordinal"))).alias("error"))
        .select(
            "company_id",
            "cycle_ts",
            F.when(F.col("error").isNull(), F.lit("ok")).otherwise(F.lit("failed")).alias("outcome"),
            "error",
        )
    )
