"""OCR as a pluggable source: a table of earlier readings, or a function run where the images lie."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.config import CONFIG
from ..functions.schemas import OCR_PAGES, OCR_REPLIES
from ..operators import raster

#: The page passes, in order, and the segmentation mode of pages.
PASSES = (("contrast", 0), ("color", 1))
PAGE_MODE = 11


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """OCR pages from JSON lines or Parquet, by their declared schema."""
    if path.rstrip("/").endswith((".json", ".jsonl", ".ndjson")):
        return spark.read.schema(OCR_PAGES).json(path)
    return spark.read.schema(OCR_PAGES).parquet(path)


def table_provider(replies: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A provider that answers requests from a table of replies."""
    return lambda requests: replies.join(requests.select("request_id").distinct(), "request_id", "left_semi")


def picture(rgba: np.ndarray, variant: str, crop: dict | None, zoom: float, border: int = 0) -> np.ndarray:
    """What a reading gets to see: a window (default: all) of the page, as a variant, enlarged, in a white border."""
    if crop is not None:
        x, y = int(crop["x0"]), int(crop["y0"])
        rgba = raster.crop(rgba, x, y, int(crop["x1"]) - x, int(crop["y1"]) - y)
    seen = raster.VARIANTS[variant](rgba)
    if zoom != 1:
        seen = raster.resize(seen, max(1, int(raster.half_up(seen.shape[1] * zoom))), max(1, int(raster.half_up(seen.shape[0] * zoom))))
    return raster.white_border(seen, border) if border else seen


def enlarged(rgba: np.ndarray) -> tuple[np.ndarray, int]:
    """The analysed page enlarged for reading, and its border."""
    page, _ = raster.analysed(rgba)
    height, width = page.shape[:2]
    low, high = CONFIG.ocr_scale
    scale = max(low, min(high, float(np.sqrt(CONFIG.ocr_pixels / (width * height)))))
    return raster.resize(page, int(raster.half_up(width * scale)), int(raster.half_up(height * scale))), int(raster.half_up(CONFIG.ocr_border * scale))


def read_page(rgba: np.ndarray, variant: str) -> tuple[np.ndarray, int]:
    """The page of one pass, as a variant; and its border."""
    large, border = enlarged(rgba)
    return raster.VARIANTS[variant](large), border


class Pages:
    """One image and the pages made of it, each at most once."""

    def __init__(self, data: bytes, width: int, height: int):
        self.rgba = raster.pixels(data, width, height)
        self._made: dict[str, np.ndarray] = {}

    def of(self, variant: str) -> np.ndarray:
        """What a variant is cut from: the enlarged page as it is (``ocr``), the analysed page (``analysed``), the image (others)."""
        if variant not in ("ocr", "analysed"):
            return self.rgba
        if variant not in self._made:
            self._made[variant] = read_page(self.rgba, "source")[0] if variant == "ocr" else raster.analysed(self.rgba)[0]
        return self._made[variant]

    def seen(self, request: dict) -> np.ndarray:
        """The picture of a request: the crop (in pixels of what it is cut from), as a variant, enlarged, in a white border."""
        variant = request["variant"]
        kernel = "source" if variant in ("ocr", "analysed") else variant
        return picture(self.of(variant), kernel, request["crop"], float(request["zoom"]), int(request.get("border") or 0))


def _dict(row) -> dict:
    return row.asDict(True) if hasattr(row, "asDict") else dict(row)


def _by_image(requests: DataFrame, images: DataFrame) -> DataFrame:
    """One row of pixels an image, with all that is asked of it: some dozens of narrow requests a target.

    Spark guesses the size of pixels from that of the table they are made of, and would collect them all to broadcast
    them; the hint has each partition hash its requests, and the pixels pass by them.
    """
    asked = requests.groupBy("image_id").agg(F.collect_list(F.struct(*requests.columns)).alias("requests"))
    return images.select("image_id", "width", "height", "data").join(asked.hint("shuffle_hash"), "image_id")


#: Bytes of pictures that are handed on at a time, about.
PIECE = 1 << 22
PICTURE = "request_id string, width int, height int, data binary"


def pictures(requests: DataFrame, images: DataFrame) -> DataFrame:
    """(request_id, width, height, data): the picture of every request (image_id, request_id, variant, zoom, crop, and border if any)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, held = [], 0
        for f in frames:
            for r in f.itertuples(index=False):
                pages = Pages(r.data, r.width, r.height)
                for q in map(_dict, r.requests):
                    seen = pages.seen(q)
                    out.append((q["request_id"], seen.shape[1], seen.shape[0], np.ascontiguousarray(seen).tobytes()))
                    held += seen.size
                    if held >= PIECE:
                        yield pd.DataFrame(out, columns=["request_id", "width", "height", "data"])
                        out, held = [], 0
        if out:
            yield pd.DataFrame(out, columns=["request_id", "width", "height", "data"])

    return _by_image(requests, images).mapInPandas(run, PICTURE)


def _provider(recognise: Callable[[dict], dict], images: DataFrame, own: bool) -> Callable[[DataFrame], DataFrame]:
    def provide(requests: DataFrame) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for r in f.itertuples(index=False):
                    pages, out = Pages(r.data, r.width, r.height), []
                    for q in map(_dict, r.requests):
                        try:
                            seen = pages.seen(q) if own else pages.rgba
                            got = recognise({**q, "width": seen.shape[1], "height": seen.shape[0], "data": np.ascontiguousarray(seen).tobytes()})
                            out.append((q["request_id"], got.get("text"), got.get("lines") or [], None))
                        except Exception as e:  # noqa: BLE001  the error is the row's result
                            out.append((q["request_id"], None, [], f"ERROR: {e}"))
                    yield pd.DataFrame(out, columns=["request_id", "text", "lines", "error"])

        return _by_image(requests, images).mapInPandas(run, OCR_REPLIES)

    return provide


def function_provider(recognise: Callable[[dict], dict], images: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A provider that calls ``recognise(request with the image's pixels) -> {text, lines}`` beside the image.

    A failed reading becomes a reply with its error, as a row: one bad crop never stops a job. Whatever the
    function sets up (a worker, a model) lives in its module and so once per Python process. An image's pixels
    are met once, by all that is asked of it.
    """
    return _provider(recognise, images, False)


def picture_provider(recognise: Callable[[dict], dict], images: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """The same, with each request's own picture (width, height, data) instead of the whole image."""
    return _provider(recognise, images, True)


def page_pictures(images: DataFrame) -> DataFrame:
    """(image_id, pass_ix, variant, width, height, data): the two pages of every image as they are read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                out = []
                large, border = enlarged(raster.pixels(r.data, r.width, r.height))
                for ix, (variant, _) in enumerate(PASSES):
                    seen = raster.white_border(raster.VARIANTS[variant](large), border)
                    out.append((r.image_id, ix, variant, seen.shape[1], seen.shape[0], seen.tobytes()))
                yield pd.DataFrame(out, columns=["image_id", "pass_ix", "variant", "width", "height", "data"])

    return images.select("image_id", "width", "height", "data").mapInPandas(run, "image_id string, pass_ix int, variant string, width int, height int, data binary")


def page_requests(images: DataFrame) -> DataFrame:
    """The two page passes of every image as requests."""
    from ..functions.numbers import analysis_scale, ocr_scale, scaled_size

    a = analysis_scale(F.col("width"), F.col("height"))
    sized = images.select("image_id", "width", "height", a.alias("analysis_scale"))
    sized = sized.withColumns({"_w": scaled_size(F.col("width"), F.col("analysis_scale")), "_h": scaled_size(F.col("height"), F.col("analysis_scale"))})
    sized = sized.withColumn("scale", F.col("analysis_scale") * ocr_scale(F.col("_w"), F.col("_h")))
    passes = F.array(*[F.struct(F.lit(n).alias("variant"), F.lit(i).alias("pass_ix")) for n, i in PASSES])
    return sized.withColumn("p", F.explode(passes)).select("image_id", "p.pass_ix", "p.variant", F.lit(PAGE_MODE).alias("psm"), "analysis_scale", "scale")


def pages_from_replies(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """Replies to ``page_requests`` (with request_id ``image/pass_ix``) as OCR pages; failed ones are left out.

    The read page had a white border, ``ocr_border`` pixels of the analysed page wide; it is taken off here.
    """
    r = requests.withColumn("request_id", F.concat_ws("/", "image_id", F.col("pass_ix").cast("string"))).join(replies, "request_id")
    border = F.floor(CONFIG.ocr_border * F.col("scale") / F.col("analysis_scale") + F.lit(0.5)).cast("double")
    r = r.filter(F.col("error").isNull() & F.col("lines").isNotNull())
    return r.select("image_id", F.col("variant").alias("pass"), "pass_ix", "scale", border.alias("off_x"), border.alias("off_y"), "text", "lines")
