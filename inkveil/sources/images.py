"""Image sources and sinks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import output_name
from .png import Png


def read_images(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Decoded images of a folder as RGBA rows, by Spark's own image reader; what can't be decoded has an error.

    The reader gives BGR(A); the swap to RGBA is the only step in Python. Keys are the files' paths.
    """
    found = spark.read.format("image").option("dropInvalid", False).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    rows = found.select(F.col("image.origin").alias("path"), "image.width", "image.height", "image.nChannels", "image.data")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            data, error = [], []
            for d, w, h, n in zip(f["data"], f["width"], f["height"], f["nChannels"]):
                ok = w > 0 and h > 0 and n in (1, 3, 4)
                data.append(to_rgba(d, w, h, n).tobytes() if ok else None)
                error.append(None if ok else "the image can't be decoded")
            yield pd.DataFrame({"image_id": f["path"], "path": f["path"], "width": f["width"], "height": f["height"], "data": data, "error": error})

    return rows.mapInPandas(run, "image_id string, path string, width int, height int, data binary, error string")


def to_rgba(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    """RGBA of the reader's grey, BGR or BGRA bytes."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    out = np.full((height, width, 4), 255, np.uint8)
    out[..., :3] = a[..., :3][..., ::-1] if channels > 1 else a
    if channels == 4:
        out[..., 3] = a[..., 3]
    return out


def read_png(spark: SparkSession, path: str, partition_bytes: int = 64 << 20) -> DataFrame:
    """Decoded PNG files of a folder as RGBA rows, in partitions of about so many bytes (``sources.png``); keys are the files' paths."""
    spark.dataSource.register(Png)
    found = spark.read.format("png").option("partition_bytes", partition_bytes).load(path)
    return found.select(F.col("path").alias("image_id"), "path", "width", "height", "data", "error")


def named(files: DataFrame) -> DataFrame:
    """Adds ``output_name`` to rendered images, from the last part of their path."""
    return files.withColumn("output_name", output_name(F.element_at(F.split("path", "/"), -1)))


def write_images(files: DataFrame, path: str) -> None:
    """Writes rendered images (path, data: PNG bytes) as PNG files named after their image, by the sink of ``sources.png``."""
    files.sparkSession.dataSource.register(Png)
    named(files).select("output_name", "data").write.format("png").mode("overwrite").save(path)
