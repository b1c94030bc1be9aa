"""Boxes that meet, by grid cells: an equality join where a condition on coordinates would compare every pair of an image.

A box is on the level whose cells are at least as large as it is, so it lies in four of them at most, and in as many on
every coarser level. Two boxes meet on the coarser of their two levels, in the cell that holds the corner where their
intersection begins: each pair once. Rows are spread over the levels that occur, some twenty at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXTENT = ("x0", "y0", "x1", "y1")


def extent(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(*[v.cast("double").alias(k) for k, v in zip(EXTENT, (x0, y0, x1, y1))])


def _level(e: Column) -> Column:
    size = F.greatest(e["x1"] - e["x0"], e["y1"] - e["y0"], F.lit(1.0))
    return F.ceil(F.log2(size)).cast("int")


def _placed(rows: DataFrame, keys: list[str], at: Column, name: str) -> DataFrame:
    """(keys, name: the row, with its level and extent), of rows with a finite extent."""
    finite = F.lit(True)
    for k in EXTENT:
        finite = finite & (F.abs(at[k]) < float("inf"))
    e = F.struct(*[at[k].alias(k) for k in EXTENT])
    out = rows.filter(F.coalesce(finite, F.lit(False))).select(*keys, F.struct(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), e.alias("e"), _level(e).alias("level")).alias(name))
    return out


def _spread(rows: DataFrame, keys: list[str], name: str, levels: list[int]) -> DataFrame:
    own = F.filter(F.array(*[F.lit(v) for v in levels]), lambda v: v >= F.col(name)["level"])
    rows = rows.withColumn("_level", F.explode(own))
    e, side = F.col(name)["e"], F.pow(F.lit(2.0), F.col("_level"))
    cells = lambda a: F.sequence(F.floor(e[a + "0"] / side), F.floor(e[a + "1"] / side))
    return rows.withColumn("_cx", F.explode(cells("x"))).withColumn("_cy", F.explode(cells("y")))


def meet(left: DataFrame, right: DataFrame, keys: list[str], left_extent: Column, right_extent: Column) -> DataFrame:
    """(keys, l, r): the pairs of rows, as structs, whose extents share a point and whose keys agree; each pair once."""
    a, b = _placed(left, keys, left_extent, "l"), _placed(right, keys, right_extent, "r")
    seen = a.select(F.col("l.level").alias("v")).union(b.select(F.col("r.level").alias("v"))).distinct()
    levels = sorted(r["v"] for r in seen.collect())  # of sizes that are powers of two: some dozens at most
    if not levels:
        return a.join(b, keys).select(*keys, "l.row", "r.row").toDF(*keys, "l", "r")
    both = _spread(a, keys, "l", levels).join(_spread(b, keys, "r", levels), [*keys, "_level", "_cx", "_cy"])
    side = F.pow(F.lit(2.0), F.col("_level"))
    begins = lambda k: F.floor(F.greatest(F.col(f"l.e.{k}"), F.col(f"r.e.{k}")) / side)
    both = both.filter((F.col("_level") == F.greatest("l.level", "r.level")) & (begins("x0") == F.col("_cx")) & (begins("y0") == F.col("_cy")))
    apart = (F.col("l.e.x0") > F.col("r.e.x1")) | (F.col("r.e.x0") > F.col("l.e.x1")) | (F.col("l.e.y0") > F.col("r.e.y1")) | (F.col("r.e.y0") > F.col("l.e.y1"))
    return both.filter(~apart).select(*keys, F.col("l.row").alias("l"), F.col("r.row").alias("r"))


def around(box: Column, gap: float, width: float, height: float) -> Column:
    """The extent around a box's centre within which another box's centre is near it: boxes that are near have extents that meet."""
    reach = lambda a, part: F.greatest(F.lit(gap), F.greatest(box[a + "1"] - box[a + "0"], F.lit(1.0)) * part)
    centre = lambda a: (box[a + "0"] + box[a + "1"]) / 2
    x, y, rx, ry = centre("x"), centre("y"), reach("x", width), reach("y", height)
    return extent(x - rx, y - ry, x + rx, y + ry)
