"""Output documents: run metrics and digests."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from tidemark.operators.digest import digest_fragments, ordered_fragments


def write_metrics(metrics: DataFrame, path: str) -> None:
    """One JSON document per run, as text."""
    metrics.select("metrics").write.mode("overwrite").text(path)


def write_digest(document: DataFrame, path: str, day: date | str) -> None:
    """Subject, html and text of one digest; writing a day again replaces that day only."""
    document.write.mode("overwrite").parquet(f"{path}/digest_date={day}")


def write_digest_fragments(candidates: DataFrame, path: str, day: date | str) -> None:
    """A digest of any size as sorted text files; their names give the order of reading."""
    lines = ordered_fragments(digest_fragments(candidates)).select(F.col("html").alias("value"))
    lines.write.mode("overwrite").text(f"{path}/digest_date={day}")
