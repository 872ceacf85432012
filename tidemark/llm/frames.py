"""Helpers around frames: written intermediate tables and the held-out rule."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.session import shared_folder


# Bytes of a batch of rows on its way to Python; Spark's own bound is 10 000 rows, whatever their length.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = "8m"


def bounded_batches(spark: SparkSession) -> None:
    """From now on rows go to Python in batches of `BATCH_BYTES`, unless the session has a bound of its own.

    Long texts, of which a pair has two, else make batches that an executor holds several times, once in
    its own memory and once in each worker's. Operators give the same rows however batches are cut.
    """
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """`df` written as a table in the shared folder and read back.

    Cuts the lineage: a lost executor costs the tasks that read the table, not what made it.
    """
    path = f"{shared_folder(df.sparkSession)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column | str) -> Column:
    """Whether a document's labels are kept from training: crc32 of the id's text is a multiple of 5."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(text, y) of at most `most` labelled documents that are not held out, the first by hash of id.

    `most` bounds what a fit reads, and is why the ids may be broadcast. Null ids and labels are
    skipped; of an id labelled twice the larger label holds, and of an id with several rows one is taken.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    # of an id that many rows repeat the first text by length and content stands for all
    return rows.groupBy("doc_id").agg(F.min(F.struct(F.length("text").alias("size"), "text")).alias("first"), F.first("y").alias("y")).select("first.text", "y")


def set_aside(df: DataFrame, needed: Iterable[str]) -> tuple[DataFrame, list[Column]]:
    """`df` with all columns but `needed` under names that no operator uses, and the columns that give it back as it was."""
    keep = {n.lower() for n in needed}
    names = {c: c if c.lower() in keep else f"own {k}" for k, c in enumerate(df.columns)}
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    return df.select(*(quoted(c).alias(n) for c, n in names.items())), [quoted(n).alias(c) for c, n in names.items()]


def fresh(columns: list[str], name: str) -> str:
    """`name`, made longer until no column is called so in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
