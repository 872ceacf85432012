"""Operators as stages of the corpus pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import decontaminate, jaccard, line_dedup, mixing, toxicity
from tidemark.llm.frames import bounded_batches, staged, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic."""
    bounded_batches(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(F.col("predicted") == 0).select(docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with boilerplate lines cut; those of which nothing is left go. n_chars follows the text."""
    done = line_dedup.dedup_lines(docs)
    done = done.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        chars = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        done = done.withColumn("n_chars", chars)
    return done.select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id, once."""
    bounded_batches(spark)
    known = staged(jaccard.similar(docs).where(F.col("doc_id").isNotNull()), "near-copies")
    ids = known.groupBy("doc_id").agg(F.min("component_id").alias("first"), F.count("*").alias("n"))
    ids = staged(ids.where((F.col("first") != F.col("doc_id")) | (F.col("n") > 1)), "not-alone")
    few = ids.count() <= jaccard.BROADCAST_IDS
    side = lambda df: F.broadcast(df) if few else df
    out = docs.join(side(ids.select("doc_id")), "doc_id", "left_anti")
    twice = ids.where(F.col("first") == F.col("doc_id"))
    if not twice.isEmpty():
        out = out.unionByName(docs.join(side(twice.select("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return out.select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated, with every benchmark span cut. n_chars follows the text."""
    bounded_batches(spark)
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with their number of copies."""
    return mixing.mix(docs).where(F.col("copies") > 0)
