"""Keeping plans small: computed columns that are evaluated once, tables whose lineage is cut."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sealed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns behind a generator of one row.

    A filter on them is not pushed down to where it would repeat their expressions, and they are evaluated
    once however often they are used. Costs no shuffle.
    """
    fresh = F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in columns], fresh)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names; a local session without one, as in tests, gets a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="inkveil-ckpt-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the cluster's shared checkpoint folder and cuts its lineage there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """Deals a table of fewer partitions than the cluster has cores over all of them; a larger one is left as it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.isStreaming or df.rdd.getNumPartitions() >= cores else df.repartition(cores)
