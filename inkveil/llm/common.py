"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract: U+0020 and U+0009 to U+000D.
SPACE = r"\x20\x09-\x0D"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names; a local session without one, as in tests, gets a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="inkveil-ckpt-"))
    return context.getCheckpointDir()


#: Spark's setting by which a query's shuffle files go when it ends, not when the driver happens to collect its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the cluster's shared checkpoint folder and cuts its lineage there; the shuffle files that it took go."""
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        return df.select("*").checkpoint()  # a query of its own, so that none reads these files again
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    """The maximal runs of ``[^\\x20\\x09-\\x0D]`` of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


#: Most rows of a table that is broadcast, whatever the session's threshold: a proven bound, counted first.
BROADCAST_ROWS = 50_000


def small(df: DataFrame) -> DataFrame:
    """Marks ``df``, already cut and of a few narrow columns, for broadcast if it counts no more than ``BROADCAST_ROWS``."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df
