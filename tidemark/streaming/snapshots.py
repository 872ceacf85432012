"""Continuous ingest: all cycles of a micro-batch of posting files are merged in one pass."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark import schemas
from tidemark.operators.replay import merge_cycles
from tidemark.plans.cycle import CycleTables
from tidemark.schemas import JOB_COLUMNS
from tidemark.session import shared_folder
from tidemark.sources import tables

APPLIED = "company_id bigint, cycle_ts timestamp"


def split_late(snapshots: DataFrame, applied: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(snapshots newer than the last one applied for their company, the others with that cycle)."""
    last = applied.select("company_id", F.col("cycle_ts").alias("last_cycle"))
    known = snapshots.join(last, "company_id", "left")
    on_time = F.col("last_cycle").isNull() | (F.col("cycle_ts") > F.col("last_cycle"))
    return known.filter(on_time).drop("last_cycle"), known.filter(~on_time)


def merge_applied(applied: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Last applied cycle per company after `snapshots`."""
    return (
        applied.unionByName(snapshots.select("company_id", "cycle_ts"))
        .groupBy("company_id")
        .agg(F.max("cycle_ts").alias("cycle_ts"))
    )


def ingest_batch(
    spark: SparkSession, rows: DataFrame, batch_id: int, names: CycleTables, applied_table: str, us_only: bool = True
) -> int:
    """Applies one batch of postings, all its cycles at once; returns how many late snapshots it dropped.

    `rows` has posting columns plus `outcome` and `error`; a snapshot without postings is one row
    whose `ordinal` is null. A batch is one version named after it, so a batch that is delivered
    again finds its version current or rewrites it with the same rows. Late snapshots are
    stored per batch in the table `<applied_table>_late`, with the cycle that had been applied.
    """
    mark = f"b{batch_id}"
    done = tables.applied_mark(spark, applied_table)
    if done is not None and done.startswith("b") and int(done[1:].split("_")[0]) >= batch_id:
        return 0
    applied = spark.table(applied_table)
    all_snapshots = rows.groupBy("company_id", "cycle_ts").agg(F.max("outcome").alias("outcome"), F.max("error").alias("error"))
    on_time, late = split_late(all_snapshots, applied)
    late = tables.stage_version(late, f"{applied_table}_late", mark)
    snapshots = tables.stage_version(on_time, f"{applied_table}_snapshots", mark)
    postings = rows.filter(F.col("ordinal").isNotNull()).drop("outcome", "error")
    before = tables.applied_mark(spark, names.jobs)
    if before != mark:
        merged = merge_cycles(tables.read_table(spark, names.jobs), tables.read_table(spark, names.companies), snapshots, postings, us_only)
        tables.stage_version(merged, names.jobs, mark, "fingerprint_hash", names.buckets)
        tables.publish_version(spark, names.jobs, mark, JOB_COLUMNS)
    tables.write_version(merge_applied(applied, snapshots), applied_table, mark)
    # The version before stays for readers that still use it.
    tables.drop_versions(spark, applied_table, [mark, done or mark])
    tables.drop_versions(spark, names.jobs, [mark, before or mark])
    tables.drop_versions(spark, f"{applied_table}_snapshots", [mark])
    return late.count()


def start_ingest(
    spark: SparkSession,
    stream: DataFrame,
    names: CycleTables,
    applied_table: str = "applied_cycles",
    us_only: bool = True,
    checkpoint: str | None = None,
    on_late: Callable[[int, int], None] | None = None,
) -> StreamingQuery:
    """Runs all available input through `ingest_batch`. The state tables must exist."""
    if not spark.catalog.tableExists(applied_table):
        tables.write_version(spark.createDataFrame([], APPLIED), applied_table, "start")

    def each(rows: DataFrame, batch_id: int) -> None:
        late = ingest_batch(rows.sparkSession, rows, batch_id, names, applied_table, us_only)
        if late and on_late:
            on_late(batch_id, late)

    return (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint or f"{shared_folder(spark)}/streams/{names.jobs}")
        .trigger(availableNow=True)
        .start()
    )


def read_posting_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Posting files as they arrive."""
    schema = f"{schemas.POSTINGS}, outcome string, error string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
