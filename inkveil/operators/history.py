"""Preferences and the list of targets used last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.config import CONFIG

PREFERENCES = "redactionMode string, redactionColor string, manualDrawMode string"


def read_json(text: Column, schema: str, fallback: Column) -> Column:
    """Parsed JSON; the fallback where it is null or broken."""
    parsed = F.from_json(F.when(F.try_parse_json(text).isNotNull(), text), schema)
    return F.coalesce(parsed, fallback)


def write_json(value: Column) -> Column:
    return F.to_json(value)


def recent_targets(uses: DataFrame, keys: list[str], value: str = "value", seq: str = "seq", limit: int = CONFIG.history_limit) -> DataFrame:
    """The last distinct values of each key, newest first: a use moves its value to the front.

    Values are trimmed and empty ones ignored. One aggregate and one ranked window.
    """
    rows = uses.withColumn(value, F.trim(F.col(value))).filter(F.col(value) != "")
    last = rows.groupBy(*keys, value).agg(F.max(seq).alias("last_seq"))
    w = Window.partitionBy(*keys).orderBy(F.desc("last_seq"), value)
    return last.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= limit)
