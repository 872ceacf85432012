"""Versioned tables: every write makes a new table, then a view is pointed at it.

Readers of the view see the old version until the new one is complete. Plain Parquet tables have
no MERGE, and a table must not be overwritten while it is read; this gives both an upsert and an
atomic switch. Bucketing the job state by fingerprint lets each cycle's merge read the state
without shuffling it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

NOT_READY = "Table {name} does not exist: create it with write_version before running jobs"
MARK = "tidemark.mark"


def require_table(spark: SparkSession, name: str) -> None:
    if not spark.catalog.tableExists(name):
        raise RuntimeError(NOT_READY.format(name=name))


def read_table(spark: SparkSession, name: str, order_by: Sequence[str] = ()) -> DataFrame:
    """The whole current version; sorted only when asked."""
    require_table(spark, name)
    table = spark.table(name)
    return table.orderBy(*order_by) if order_by else table


def applied_mark(spark: SparkSession, name: str) -> str | None:
    """The mark of the current version, null before the first one."""
    return table_property(spark, name, MARK)


def table_property(spark: SparkSession, name: str, key: str) -> str | None:
    if not spark.catalog.tableExists(name):
        return None
    rows = spark.sql(f"SHOW TBLPROPERTIES {name}").filter(F.col("key") == key).collect()
    return rows[0]["value"] if rows else None


def version_table(name: str, mark: str) -> str:
    return f"{name}__{mark}"


def stage_version(
    df: DataFrame, name: str, mark: str, bucket_by: str | None = None, buckets: int = 200
) -> DataFrame:
    """Writes the rows of a version without making it current; returns the stored rows."""
    writer = df.write.mode("overwrite").format("parquet")
    if bucket_by:
        writer = writer.bucketBy(buckets, bucket_by).sortBy(bucket_by)
    writer.saveAsTable(version_table(name, mark))
    return df.sparkSession.table(version_table(name, mark))


def publish_version(spark: SparkSession, name: str, mark: str, columns: Sequence[str]) -> None:
    """Points the view at the staged version, showing `columns` only."""
    spark.sql(
        f"CREATE OR REPLACE VIEW {name} TBLPROPERTIES ('{MARK}' = '{mark}') "
        f"AS SELECT {', '.join(columns)} FROM {version_table(name, mark)}"
    )


def write_version(
    df: DataFrame, name: str, mark: str, bucket_by: str | None = None, buckets: int = 200
) -> DataFrame:
    """Stages and publishes; writing the same mark again replaces that version with the same rows."""
    stage_version(df, name, mark, bucket_by, buckets)
    publish_version(df.sparkSession, name, mark, df.columns)
    return df.sparkSession.table(name)


def drop_versions(spark: SparkSession, name: str, keep: Sequence[str]) -> None:
    """Drops the versions of a table whose marks are not listed."""
    base = name.split(".")[-1]
    prefix = name[: len(name) - len(base)]
    kept = {version_table(base, m) for m in keep}
    database = prefix.rstrip(".") or spark.catalog.currentDatabase()
    for row in spark.sql(f"SHOW TABLES IN {database} LIKE '{base}__*'").collect():
        if row["tableName"] not in kept:
            spark.sql(f"DROP TABLE {prefix}{row['tableName']}")
