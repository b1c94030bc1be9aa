"""Ordered suppression of boxes as a DataFrame operation."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.config import CONFIG
from ..functions.plan import cut
from ..functions.spatial import greedy, overlaps_divided
from .cells import extent, meet

#: Most boxes of a group that are folded in one piece.
FOLD = 400
#: First boxes of a larger group that a round settles.
ROUND = 4000


@dataclass(frozen=True)
class Sides:
    """x, y, w, h of boxes in order."""

    x: np.ndarray
    y: np.ndarray
    w: np.ndarray
    h: np.ndarray

    def kept(self, threshold: float) -> np.ndarray:
        """The places of the boxes that overlap none kept before, by the rule of ``overlaps_divided``."""
        area, kept = self.w * self.h, np.zeros(len(self.x), np.int64)
        n = 0
        for i in range(len(self.x)):
            k = kept[:n]
            ix = np.minimum(self.x[k] + self.w[k], self.x[i] + self.w[i]) - np.maximum(self.x[k], self.x[i])
            iy = np.minimum(self.y[k] + self.h[k], self.y[i] + self.h[i]) - np.maximum(self.y[k], self.y[i])
            least = np.minimum(area[k], area[i])
            shared = np.maximum(0.0, ix) * np.maximum(0.0, iy)
            if not np.any((least > 0) & (shared > 0) & (shared / np.where(least > 0, least, 1) > threshold)):
                kept[n] = i
                n += 1
        return kept[:n]


def _fold(boxes: DataFrame, keys: list[str], order: list[str], threshold: float, limit: int | None) -> DataFrame:
    rest = [c for c in boxes.columns if c not in {*keys, *order}]
    packed = boxes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias("_b"))
    return packed.select(*keys, F.inline(greedy(F.col("_b"), overlaps_divided(threshold), limit))).select(*boxes.columns)


def _rounds(boxes: DataFrame, keys: list[str], order: list[str], threshold: float) -> DataFrame:
    """Boxes (keys, order, x, y, w, h) -> the (keys, order) that are kept.

    What comes first is settled by what came before it alone: a round keeps the first ``ROUND`` boxes of each group that overlap none kept
    of them, and takes from the rest all that overlap one of these, which meet them by grid cells. So no task holds more
    than a round's boxes of a group, and boxes are compared with those near them.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    left, kept = cut(boxes), []
    schema = left.select(*keys, *order, "x", "y", "w", "h").schema

    def settle(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(order, kind="stable")
        return f.iloc[Sides(*(f[k].to_numpy(float) for k in "xywh")).kept(threshold)]

    while not left.isEmpty():
        first = cut(left.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= ROUND).drop("_n"))
        kept.append(cut(first.groupBy(*keys).applyInPandas(lambda f: settle(f), schema)))
        rest = left.join(first.select(*keys, *order), [*keys, *order], "left_anti")
        box = extent(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h"))
        rest = cut(rest.select(*left.columns))
        near = meet(kept[-1], rest, keys, box, box).filter(overlaps_divided(threshold)(F.col("l"), F.col("r")))
        left = cut(rest.join(near.select(*keys, *[F.col("r")[o].alias(o) for o in order]).distinct(), [*keys, *order], "left_anti").select(*left.columns))
    return reduce(DataFrame.union, kept).select(*keys, *order)


def suppress(boxes: DataFrame, keys: list[str], order: list[str], threshold: float = CONFIG.box_overlap, limit: int | None = None) -> DataFrame:
    """Keeps, within each ``keys`` group and in ``order``, the boxes (x, y, w, h) that overlap none kept before.

    Boxes overlap if they share more than ``threshold`` of the smaller area; one without area overlaps none. While no group has more than
    ``FOLD`` boxes, each becomes one sorted array and is folded once, by one shuffle on the keys; larger groups are settled
    in rounds. ``order`` must be total, and is without nulls, for a defined result; descending order: negate beforehand. All other columns are carried.
    """
    most = boxes.groupBy(*keys).count().agg(F.max("count")).first()[0]
    if most is None or most <= FOLD:
        return _fold(boxes, keys, order, threshold, limit)
    kept = _rounds(boxes.select(*keys, *order, "x", "y", "w", "h"), keys, order, threshold)
    out = boxes.join(kept, [*keys, *order], "left_semi")
    if limit is not None:
        out = out.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= limit).drop("_n")
    return out.select(*boxes.columns)


def numbered(boxes: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Adds each box's place within its group."""
    return boxes.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
