"""Streams of OCR pages and of edits.

``detect_stream`` is stateless: each arriving page is searched by itself, so it needs no watermark.
``edit_stream`` and ``pointer_stream`` keep each image's stamps as state, so a batch costs what it touches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.schemas import EDIT_EVENTS, OCR_PAGES, POINTERS
from ..operators.match import exact_matches, normal_targets
from ..operators.units import line_units
from . import sessions


def page_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A folder of OCR pages (Parquet) as a stream."""
    return spark.readStream.schema(OCR_PAGES).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def detect_stream(pages: DataFrame, targets: DataFrame) -> DataFrame:
    """Exact hits of each arriving page; the static targets are joined to the stream."""
    return exact_matches(line_units(pages), normal_targets(targets))


def edit_stream(spark: SparkSession, events_path: str, images: DataFrame, out_path: str, checkpoint: str, files_per_trigger: int = 100):
    """Starts a query that keeps ``out_path`` at the stamps of all edits seen (``sessions.SESSION_STAMPS``): one Parquet folder a batch.

    A batch writes the images that it touches; ``sessions.latest`` reads the newest stamps of all.
    """
    events = spark.readStream.schema(EDIT_EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(events_path)
    return sessions.write_batches(sessions.edit_stamps(events, images), out_path, checkpoint)


def pointer_stream(spark: SparkSession, events_path: str, images: DataFrame, out_path: str, checkpoint: str, files_per_trigger: int = 100):
    """The same for pointer events (``schemas.POINTERS``)."""
    events = spark.readStream.schema(POINTERS).option("maxFilesPerTrigger", files_per_trigger).parquet(events_path)
    return sessions.write_batches(sessions.session_stamps(events, images), out_path, checkpoint)
