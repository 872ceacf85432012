"""Session helpers: where shared intermediate data may be written."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F

# Rows of a narrow frame that every executor can hold, some tens of megabytes.
BROADCAST_ROWS = 500_000

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where it is unset a local session gets a temporary folder; a cluster session is refused,
    because a machine-local folder is lost with its machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all machines can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(_LOCAL[app])
    return _LOCAL[app]


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores where its files give fewer partitions than that; larger inputs as they are.

    For parsing and matching work on small tables, which would otherwise run in one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether `df` has at most `max_rows` rows; counts no further than that. Runs a job."""
    return df.limit(max_rows + 1).count() <= max_rows


def small_side(df: DataFrame, small: bool) -> DataFrame:
    """`df` marked for broadcast where its size was checked (`is_small`), else left to the planner.

    The planner cannot know that a company-level frame is small once it comes out of joins and
    aggregates, and would shuffle the other side, all postings, by company. Beyond the checked
    size it does that, and adaptive execution splits the partitions of large companies.
    """
    return F.broadcast(df) if small else df
