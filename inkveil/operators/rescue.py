"""Requests for another reading of a place, and what their replies decide."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import analysis_scale, half_up, ocr_scale, scaled_size
from ..functions.plan import cut, sealed
from ..functions.text import normalize
from .groups import KEY, representative

#: The readings tried in turn, as (source of the crop, page segmentation mode, only for weak candidates).
LADDER = (("source", 7, False), ("ocr", 7, False), ("source", 8, True), ("bin180", 7, False), ("bin220", 7, False), ("invert", 7, False))
ZOOM = 3


def crop_boxes(best: Column, width: Column, height: Column) -> Column:
    """struct<source, ocr>: the window around a candidate with two characters of context, rounded once where it is cut.

    ``source`` is in the image's pixels, ``ocr`` in those of the page that was read (the analysed page enlarged, ``scale`` over the
    image). Padding is measured on the page. Null where nothing of the window is inside.
    """
    scale = best["scale"]
    analysed = analysis_scale(width, height)
    page = [scaled_size(v, analysed) for v in (width, height)]
    enlarged = ocr_scale(*page)
    # Boxes were divided by the scale: times it they are the page's again, up to the last digits.
    on_page = lambda v: F.round(v * scale, 6)
    outer, inner = ({k: on_page(best[box][k]) for k in ("x0", "y0", "x1", "y1")} for box in ("around", "box"))
    pad = {a: F.greatest(F.lit(30.0), half_up((inner[a + "1"] - inner[a + "0"]) * part)) for a, part in (("x", 0.65), ("y", 0.55))}

    def window(over: Column, most: list[Column]) -> Column:
        sides = []
        for a, size in zip("xy", most):
            sides += [F.greatest(F.lit(0.0), F.floor((outer[a + "0"] - pad[a]) / over).cast("double")).alias(a + "0"), F.least(size.cast("double"), F.ceil((outer[a + "1"] + pad[a]) / over).cast("double")).alias(a + "1")]
        box = F.struct(sides[0], sides[2], sides[1], sides[3])
        return F.when((box["x1"] > box["x0"]) & (box["y1"] > box["y0"]), box)

    return F.struct(window(scale, [width, height]).alias("source"), window(F.lit(1.0), [half_up(v * enlarged) for v in page]).alias("ocr"))


def refine_requests(open_: DataFrame, images: DataFrame) -> DataFrame:
    """Groups still open -> requests, one per step of the ladder that applies (the third only to weak candidates).

    A step on the image's own pixels has its crop in these, one on the page that was read (``ocr``) in the page's. The third takes the
    page's window where the image's is empty. ``first``: whether a request is its group's first.
    """
    rows = open_.join(images.select("image_id", "width", "height"), "image_id")
    rows = sealed(rows, {"best": representative(F.col("members"))})
    rows = sealed(rows, {"crops": crop_boxes(F.col("best"), F.col("width"), F.col("height"))})
    weak = (F.col("best.similarity") < 0.70) | (F.col("best.exact_chars") <= 2)
    steps = F.array(*[F.struct(F.lit(i).alias("attempt_ix"), F.lit(v).alias("variant"), F.lit(p).alias("psm"), F.lit(w).alias("weak")) for i, (v, p, w) in enumerate(LADDER)])
    variant = lambda s: F.when(s["weak"] & F.col("crops.source").isNull(), F.lit("ocr")).otherwise(s["variant"])
    crop = lambda s: F.when(variant(s) == "ocr", F.col("crops.ocr")).otherwise(F.col("crops.source"))
    able = F.filter(steps, lambda s: (~s["weak"] | weak) & crop(s).isNotNull())
    rows = rows.select("*", F.posexplode(able).alias("_place", "s")).withColumns({"variant": variant(F.col("s")), "crop": crop(F.col("s"))})
    name = F.concat_ws("/", "image_id", "target_id", F.col("group_ix").cast("string"), F.col("s.attempt_ix").cast("string"))
    return rows.select("image_id", "target_id", name.alias("request_id"), F.lit("refine").alias("kind"), "group_ix", "s.attempt_ix", "variant", "s.psm", F.lit(ZOOM).alias("zoom"), "crop", (F.col("_place") == 0).alias("first"))


def resolve(requests: DataFrame, replies: DataFrame, targets: DataFrame, groups: DataFrame) -> DataFrame:
    """The groups confirmed by a reply that contains the target: by the first step of the ladder that does.

    Their box is the group's; they carry no characters, so later rules treat them as boxes only. A reply with
    an error confirms nothing; a missing one neither.
    """
    read = requests.join(replies.select("request_id", F.col("text").alias("_text"), "error"), "request_id").filter(F.col("error").isNull())
    read = read.join(targets.select("target_id", "target"), "target_id").withColumn("_text", normalize(F.col("_text"))).filter(F.contains("_text", "target"))
    first = read.withColumn("_rn", F.row_number().over(Window.partitionBy(*KEY, "group_ix").orderBy("attempt_ix"))).filter("_rn = 1")
    return first.join(groups.select(*KEY, "group_ix", "box", representative(F.col("members"))["candidate"].alias("candidate")), [*KEY, "group_ix"]).select(*KEY, "group_ix", "candidate", "attempt_ix", "variant", "box", F.lit("再OCR").alias("recovery"))


def resolve_in_rounds(requests: DataFrame, provider: Callable[[DataFrame], DataFrame], targets: DataFrame, groups: DataFrame, look: Callable[[str, DataFrame], DataFrame] = lambda stage, df: df) -> tuple[DataFrame, DataFrame]:
    """Asks step by step -> the groups confirmed (``resolve``), and the requests that were asked.

    The frontier of a round is the next step of the groups that no step confirmed so far; each round's replies are written before
    the next one is made, so nothing is read twice and nothing that an earlier step settled is read at all. ``look`` sees each round's
    requests ("requests") and what they confirm ("refined") before they are written.
    """
    requests = cut(requests)
    group = [*KEY, "group_ix"]
    found, asked, done = [], [], None
    for step in range(len(LADDER)):
        frontier = requests.filter(F.col("attempt_ix") == step)
        frontier = cut(look("requests", frontier if done is None else frontier.join(done, group, "left_anti").select(*requests.columns)))
        if frontier.isEmpty():
            continue
        asked.append(frontier)
        found.append(cut(look("refined", resolve(frontier, provider(frontier), targets, groups))))
        fresh = found[-1].select(*group)
        done = fresh if done is None else done.union(fresh)
    if not asked:
        return resolve(requests, provider(requests), targets, groups), requests
    return reduce(DataFrame.union, found), reduce(DataFrame.union, asked)


def region_requests(regions: DataFrame, images: DataFrame, zoom: int = 2) -> DataFrame:
    """Text regions, in the image's pixels -> requests of their enlarged crops; one reading serves every target of an image.

    The crop is cut from the analysed page, on which regions are whole pixels, and is in its pixels; ``page_scale`` leads back.
    """
    s = F.col("page_scale")
    rows = regions.join(images.select("image_id", analysis_scale(F.col("width"), F.col("height")).alias("page_scale")), "image_id")
    at = lambda k: half_up(F.col(k) * s)
    crop = F.struct(at("x").alias("x0"), at("y").alias("y0"), (at("x") + at("w")).alias("x1"), (at("y") + at("h")).alias("y1"))
    name = F.concat_ws("/", "image_id", F.lit("region"), F.col("region_ix").cast("string"))
    return rows.select("image_id", F.lit(None).cast("string").alias("target_id"), name.alias("request_id"), F.lit("region").alias("kind"), F.col("region_ix").alias("group_ix"), F.lit(0).alias("attempt_ix"), F.lit("analysed").alias("variant"), F.lit(7).alias("psm"), F.lit(zoom).alias("zoom"), crop.alias("crop"), "page_scale")


def region_pages(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """Replies to region requests as OCR pages in crop space: scale and offset lead back to the image."""
    r = requests.join(replies.select("request_id", "text", "lines", "error"), "request_id").filter(F.col("error").isNull() & F.col("lines").isNotNull())
    zoom = F.col("zoom").cast("double")
    return r.select("image_id", F.lit("local").alias("pass"), F.col("group_ix").alias("pass_ix"), (zoom * F.col("page_scale")).alias("scale"), (-F.col("crop.x0") * zoom).alias("off_x"), (-F.col("crop.y0") * zoom).alias("off_y"), "text", "lines")
