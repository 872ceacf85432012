"""Tables of which a write replaces only the parts it touches.

A table `name` is a view over the stored table `<name>_parts`, partitioned by the mark of a write and
by part, and bucketed by the key of the merge inside each part. The view's properties say which
write holds each part now. A write adds partitions under its own mark and then moves the view, so
readers see the version before until the new one is complete, and a write that was lost halfway is
repeated under the same mark. A merge that prunes to some parts still reads them without a shuffle.

The list of parts is the only thing the driver sees; it has as many entries as the table has parts.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.sources.tables import MARK, table_property

PART, WRITTEN = "part", "written"
_HELD, _COUNT = "tidemark.parts", "tidemark.part_count"

# which parts each write holds: mark -> parts
Held = dict[str, list[int]]


def part_of(key: Column, parts: int) -> Column:
    """The part of a row. `key` must not change while the row is stored."""
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def parts_table(name: str) -> str:
    return f"{name}_parts"


def held_parts(spark: SparkSession, name: str, parts: int | None = None) -> Held | None:
    """The current version's parts; null where the table has another layout or another number of parts."""
    held = table_property(spark, name, _HELD)
    if held is None or (parts is not None and table_property(spark, name, _COUNT) != str(parts)):
        return None
    return json.loads(held)


def _within(held: Held, wanted: Iterable[int] | None = None) -> str:
    """The partitions of a version, or those of some of its parts, as a condition on partition columns alone."""
    wanted = None if wanted is None else set(wanted)
    chosen = {mark: [p for p in parts if wanted is None or p in wanted] for mark, parts in held.items()}
    terms = [f"({WRITTEN} = '{mark}' AND {PART} IN ({', '.join(map(str, ps))}))" for mark, ps in chosen.items() if ps]
    return " OR ".join(terms) or "false"


def read_parts(spark: SparkSession, name: str, held: Held, wanted: Iterable[int] | None = None) -> DataFrame:
    """Rows of the version `held`, of all parts or of some; only their files are read."""
    return spark.table(parts_table(name)).where(_within(held, wanted))


def read_written(spark: SparkSession, name: str, mark: str) -> DataFrame:
    """All rows that the write `mark` stored."""
    return spark.table(parts_table(name)).where(F.col(WRITTEN) == mark)


def stage_parts(df: DataFrame, name: str, mark: str, bucket_by: str, buckets: int) -> None:
    """Stores rows (with their column `part`) under a mark without making them current.

    What an earlier attempt stored under the mark goes first. The number of buckets is that of the
    first write.
    """
    spark, table = df.sparkSession, parts_table(name)
    exists = spark.catalog.tableExists(table)
    if exists:
        _drop(spark, table, [p for p in _stored(spark, table) if p[0] == mark])
    writer = df.withColumn(WRITTEN, F.lit(mark)).write.format("parquet").partitionBy(WRITTEN, PART)
    writer.bucketBy(buckets, bucket_by).sortBy(bucket_by).mode("append" if exists else "overwrite").saveAsTable(table)


def publish_parts(
    spark: SparkSession, name: str, mark: str, touched: Iterable[int], before: Held, parts: int, columns: Sequence[str]
) -> Held:
    """Points the view at the `touched` parts of write `mark` and at the other parts as they were before."""
    touched = set(touched)
    held = {m: [p for p in ps if p not in touched] for m, ps in before.items() if m != mark}
    held = {m: ps for m, ps in held.items() if ps} | ({mark: sorted(touched)} if touched else {})
    properties = {MARK: mark, _HELD: json.dumps(held), _COUNT: str(parts)}
    listed = ", ".join(f"'{k}' = '{v}'" for k, v in properties.items())
    spark.sql(
        f"CREATE OR REPLACE VIEW {name} TBLPROPERTIES ({listed}) "
        f"AS SELECT {', '.join(columns)} FROM {parts_table(name)} WHERE {_within(held)}"
    )
    return held


def drop_parts(spark: SparkSession, name: str, keep: Sequence[Held | None]) -> None:
    """Drops stored partitions that none of the versions in `keep` holds."""
    table = parts_table(name)
    if not spark.catalog.tableExists(table):
        return
    kept = {(mark, part) for held in keep if held for mark, parts in held.items() for part in parts}
    _drop(spark, table, [p for p in _stored(spark, table) if p not in kept])


def _stored(spark: SparkSession, table: str) -> list[tuple[str, int]]:
    """(mark, part) of the stored partitions."""
    rows = spark.sql(f"SHOW PARTITIONS {table}").collect()
    specs = [dict(step.split("=", 1) for step in row["partition"].split("/")) for row in rows]
    return [(spec[WRITTEN], int(spec[PART])) for spec in specs]


def _drop(spark: SparkSession, table: str, partitions: Sequence[tuple[str, int]]) -> None:
    if partitions:
        listed = ", ".join(f"PARTITION ({WRITTEN} = '{mark}', {PART} = {part})" for mark, part in partitions)
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {listed}")
