"""Boxes: overlap, ordered suppression, proximity clustering.

Suppression and clustering depend on the order of their input, so both are folds over a sorted array that a
group of (image, target) holds: some hundred boxes at most, bounded by the operators that make them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .config import CONFIG
from .plan import let


def intersection(a: Column, b: Column) -> Column:
    """Shared area of two boxes with x, y, w, h."""
    ix = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    iy = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.greatest(F.lit(0.0), ix) * F.greatest(F.lit(0.0), iy)


def _area(a: Column) -> Column:
    return a["w"] * a["h"]


def overlaps_divided(threshold: float):
    """Shared part of the smaller area above the threshold; a box without area overlaps nothing."""

    def test(kept: Column, box: Column) -> Column:
        least = F.least(_area(kept), _area(box))
        return F.when(least > 0, intersection(kept, box) / least > threshold).otherwise(F.lit(False))

    return test


def greedy(boxes: Column, overlaps, limit: int | None = None) -> Column:
    """In order, keeps every box that overlaps none kept before, up to ``limit``."""
    none = F.filter(boxes, lambda b: F.lit(False))

    def step(kept: Column, box: Column) -> Column:
        clash = F.exists(kept, lambda k: overlaps(k, box))
        if limit is not None:
            clash = clash | (F.size(kept) >= limit)
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(box)))

    return F.aggregate(boxes, none, step)


def _centre_gap(a: Column, b: Column, gap: float, width: float, height: float) -> Column:
    """Whether the centres of two corner boxes are near for their sizes."""
    dx = F.abs((a["x0"] + a["x1"]) / 2 - (b["x0"] + b["x1"]) / 2)
    dy = F.abs((a["y0"] + a["y1"]) / 2 - (b["y0"] + b["y1"]) / 2)
    w = F.greatest(a["x1"] - a["x0"], b["x1"] - b["x0"], F.lit(1.0))
    h = F.greatest(a["y1"] - a["y0"], b["y1"] - b["y0"], F.lit(1.0))
    return (dx <= F.greatest(F.lit(gap), w * width)) & (dy <= F.greatest(F.lit(gap), h * height))


def near_group(a: Column, b: Column) -> Column:
    return _centre_gap(a, b, CONFIG.group_gap, CONFIG.group_width, CONFIG.group_height)


def touches_exact(a: Column, b: Column) -> Column:
    return _centre_gap(a, b, CONFIG.touch_gap, CONFIG.touch_width, CONFIG.touch_height)


def envelope(a: Column, b: Column) -> Column:
    return F.struct(F.least(a["x0"], b["x0"]).alias("x0"), F.least(a["y0"], b["y0"]).alias("y0"), F.greatest(a["x1"], b["x1"]).alias("x1"), F.greatest(a["y1"], b["y1"]).alias("y1"))


def cluster(items: Column, box_of=lambda x: x["box"]) -> Column:
    """Items in order -> array of struct<box, ixs>: each joins the first group whose box, so far, is near.

    A group's box grows with its members, which makes the result depend on the order. ``ixs`` are the
    members' places in ``items``, so that the fold carries no more than boxes and numbers.
    """
    corner = lambda b: F.struct(*[b[k].cast("double").alias(k) for k in ("x0", "y0", "x1", "y1")])
    none = F.array().cast("array<struct<box:struct<x0:double,y0:double,x1:double,y1:double>,ixs:array<int>>>")

    def step(groups: Column, i: Column) -> Column:
        def joined(box: Column) -> Column:
            def into(at: Column) -> Column:
                grown = F.transform(groups, lambda g, k: F.when(k == at - 1, F.struct(envelope(g["box"], box).alias("box"), F.concat(g["ixs"], F.array(i)).alias("ixs"))).otherwise(g))
                return F.when(at > 0, grown).otherwise(F.concat(groups, F.array(F.struct(box.alias("box"), F.array(i).alias("ixs")))))

            return let(F.array_position(F.transform(groups, lambda g: near_group(g["box"], box)), F.lit(True)), into)

        return let(corner(box_of(F.get(items, i))), joined)

    return F.when(F.size(items) > 0, F.aggregate(F.sequence(F.lit(0), F.size(items) - 1), none, step)).otherwise(none)
