"""Detect and cover: targets and OCR readings of many images to covering rectangles.

Every step is keyed by (image_id, target_id), the step tables are narrow, and images' pixels take no part.
Readings beyond the pages come from a provider (a function of requests to replies); without one the steps
that need it are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.config import CONFIG, SOURCES
from ..functions.plan import cut
from ..functions.numbers import analysis_scale, half_up, scaled_size, template_scale
from ..functions.rects import add_visual_rect
from ..operators.groups import fast_recovery, group_candidates, open_groups
from ..operators.match import exact_matches, near_candidates, normal_targets
from ..operators.rescue import refine_requests, region_pages, region_requests, resolve_in_rounds
from ..operators.suppress import numbered, suppress
from ..operators.templates import accepted_boxes, rescue_search, template_heights
from ..operators.units import line_units

KEY = ["image_id", "target_id"]
#: The order in which boxes are taken: by source, then by what orders the boxes of one.
PLACE = ["source_ix", "o0", "o1", "o2"]
NO_SYMBOLS = "array<struct<ch:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>,raw:string,bbox_source:string>>"
DEFAULT_STYLE = ("black", "#1a1a1a")


def _boxes(rows: DataFrame, source: str, order: list, symbols: bool) -> DataFrame:
    b = F.col("box")
    s = F.col("symbols") if symbols else F.array().cast(NO_SYMBOLS)
    place = [o.cast("int").alias(n) for o, n in zip([F.lit(SOURCES.index(source)), *order, *[F.lit(0)] * (3 - len(order))], PLACE)]
    return rows.select(*KEY, *place, b["x0"].alias("x"), b["y0"].alias("y"), (b["x1"] - b["x0"]).alias("w"), (b["y1"] - b["y0"]).alias("h"), F.lit(source).alias("source"), s.alias("symbols"))


def paint_boxes(matches: DataFrame, refined: DataFrame | None = None, accepted: DataFrame | None = None, local: DataFrame | None = None) -> DataFrame:
    """The boxes to cover, in order: exact hits, confirmed readings, recovered candidates, hits in regions.

    One ordered suppression over their union; a hit that overlaps an earlier one by over 45 % of the smaller
    area goes. One row per kept box with its place ``ord_ix``.
    """
    rows = _boxes(matches, "OCR", [F.col("pass_ix"), F.col("line_ix"), F.col("at")], True)
    if refined is not None:
        rows = rows.unionByName(_boxes(refined, "再OCR", [F.col("group_ix")], False))
    if accepted is not None:
        rows = rows.unionByName(_boxes(accepted, "近似候補救出", [F.col("group_ix")], False))
    if local is not None:
        rows = rows.unionByName(_boxes(local, "局所OCR", [F.col("pass_ix"), F.col("line_ix"), F.col("at")], True))
    kept = numbered(suppress(rows, KEY, PLACE), KEY, PLACE, "ord_ix")
    return kept.select(*KEY, "ord_ix", "x", "y", "w", "h", "source", "symbols")


def with_italic(boxes: DataFrame, italic: DataFrame | None) -> DataFrame:
    """Adds template hits behind the others; they were checked against all covered boxes when they were found."""
    if italic is None:
        return boxes
    extra = italic.select(*KEY, (F.lit(1_000_000) + F.col("ord")).cast("int").alias("ord_ix"), "x", "y", "w", "h", F.lit("イタリック救出").alias("source"), F.array().cast(NO_SYMBOLS).alias("symbols"))
    return boxes.unionByName(extra)


def stamps(boxes: DataFrame, images: DataFrame, style: tuple[str, str] = DEFAULT_STYLE) -> DataFrame:
    """Covering rectangles of the boxes; each keeps the style of the moment."""
    rows = boxes.join(images.select("image_id", "width", "height"), "image_id")
    rows = add_visual_rect(rows, F.struct("x", "y", "w", "h"), F.col("symbols"), F.col("source"), F.col("width"), F.col("height"))
    fixed = F.struct(F.lit(style[0]).alias("mode"), F.lit(style[1]).alias("color"))
    return rows.select(*KEY, F.col("ord_ix").alias("stamp_ix"), "rect.x", "rect.y", "rect.w", "rect.h", "source", F.lit("ocr").alias("kind"), fixed.alias("style"))


def italic_search(images: DataFrame, boxes: DataFrame, matches: DataFrame, near: DataFrame, templates: DataFrame, targets: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """Places that a target's templates find and no box covers yet, and what the search did (``rescue_search``).

    Of the templates (one row per target, height and skew) those of the two heights around the median
    height of the hits are used, or the usual two. All that is asked of an image meets its pixels once.
    """
    sized = images.select("image_id", "width", "height", analysis_scale(F.col("width"), F.col("height")).alias("scale"))
    sized = sized.withColumns({"_w": scaled_size(F.col("width"), F.col("scale")), "_h": scaled_size(F.col("height"), F.col("scale"))}).withColumn("_t", template_scale(F.col("_w"), F.col("_h")))
    known = template_heights(matches, near, sized)
    usual = F.array(*[F.lit(h) for h in CONFIG.template_heights])
    if regions is not None:
        sized = sized.join(regions.select("image_id").distinct(), "image_id", "left_semi")
    sized = sized.select("image_id", "_t")
    in_plane = F.greatest(F.lit(18.0), half_up(F.col("_height") * F.col("_t"))).cast("int")
    templates = templates.join(targets.select("target_id"), "target_id", "left_semi")
    # Images meet the templates of their own heights by equality, of a target with a known height at that one only.
    own = sized.join(known.select(*KEY, "heights"), "image_id").withColumn("_height", F.explode("heights")).withColumn("target_height", in_plane)
    own = own.select(*KEY, "target_height").join(templates, ["target_id", "target_height"])
    other = sized.withColumn("_height", F.explode(usual)).withColumn("target_height", in_plane).select("image_id", "target_height").distinct()
    other = other.join(templates, "target_height").join(known.select(*KEY), KEY, "left_anti")
    asked = own.unionByName(other)
    asked = asked.groupBy(*KEY).agg(F.array_sort(F.collect_set(F.struct("target_height", "skew", "w", "h", "samples", "bg_samples"))).alias("templates"))
    taken = boxes.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("ord_ix", "x", "y", "w", "h"))).alias("existing"))
    asked = asked.join(taken, KEY, "left")
    if regions is not None:
        asked = asked.join(regions.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("region_ix", "x", "y", "w", "h"))).alias("regions")), "image_id", "left")
    else:
        asked = asked.withColumn("regions", F.lit(None).cast("array<struct<x:double,y:double,w:double,h:double>>"))
    return rescue_search(images, asked)


def stages(images: DataFrame, targets: DataFrame, pages: DataFrame, provider: Callable[[DataFrame], DataFrame] | None = None, regions: DataFrame | None = None, templates: DataFrame | None = None, watch: Callable[[str, DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """All step tables by name; ``stamps`` is the result.

    ``watch`` (``metrics.Watch``) sees every step table before it is written; with it hits of regions and stamps are written too.

    Targets, lines, hits, near candidates, their groups (all and open) and recovered hits feed several later steps and are written once, to the
    shared checkpoint folder: they are small beside the pages, and plans stay small.
    """
    wanted = cut(normal_targets(targets))
    lines = cut(line_units(pages))
    look = watch or (lambda stage, df: df)
    matches = cut(look("matches", exact_matches(lines, wanted)))
    near = cut(look("near", near_candidates(lines, wanted)))
    groups = cut(look("groups", group_candidates(near)))
    open_ = cut(look("open", open_groups(groups, matches)))
    accepted = cut(look("accepted", fast_recovery(open_, groups)))
    left = open_.join(accepted.select(*KEY, "group_ix"), [*KEY, "group_ix"], "left_anti")
    out = {"targets": wanted, "lines": lines, "matches": matches, "near": near, "groups": groups, "open": open_, "accepted": accepted}
    refined = local = None
    if provider is not None:
        refined, requests = resolve_in_rounds(refine_requests(left, images), provider, wanted, groups, look)
        out |= {"requests": requests, "refined": refined}
        if regions is not None:
            asked = region_requests(regions, images)
            local = exact_matches(line_units(region_pages(asked, provider(asked))), wanted)
            local = cut(watch("local", local)) if watch else local
            out |= {"region_requests": asked, "local": local}
    out["boxes"] = paint_boxes(matches, refined, accepted, local)
    if templates is not None:
        # Pixels are searched once, for the boxes and for the counts of a diagnosis.
        out["italic_search"] = cut(look("italic_search", italic_search(images, out["boxes"], matches, near, templates, wanted, regions)))
        out["italic"] = accepted_boxes(out["italic_search"])
        out["boxes"] = with_italic(out["boxes"], out["italic"])
    out["stamps"] = stamps(out["boxes"], images)
    if watch:
        out["stamps"] = cut(watch("stamps", out["stamps"]))
    return out


def redact(images: DataFrame, targets: DataFrame, pages: DataFrame, provider: Callable[[DataFrame], DataFrame] | None = None, regions: DataFrame | None = None, templates: DataFrame | None = None) -> DataFrame:
    """The covering rectangles of every image and target."""
    return stages(images, targets, pages, provider, regions, templates)["stamps"]
