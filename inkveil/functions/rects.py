"""From a hit's characters to the rectangle that covers it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .config import CONFIG, NAME_CHARACTER
from .numbers import half_up, median_or_zero, positive_box
from .plan import let, sealed


def _rect(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for c, n in ((x, "x"), (y, "y"), (w, "w"), (h, "h"))])


def _boxed(symbols: Column) -> Column:
    return F.filter(symbols, lambda s: positive_box(s["bbox"]))


def _characters(symbols: Column) -> Column:
    return F.filter(F.transform(symbols, lambda s: s["ch"]), lambda c: c.isNotNull() & (c != ""))


def short_name(chars: Column) -> Column:
    """One to three characters, all of Japanese names (a long-vowel mark is none)."""
    return (F.size(chars) >= 1) & (F.size(chars) <= 3) & F.forall(chars, lambda c: c.rlike(NAME_CHARACTER))


def paint_box(box: Column, symbols: Column) -> Column:
    """Union of the symbols' boxes, or the given box if there is none; a split short name is never too wide."""
    symbols = F.coalesce(symbols, F.filter(symbols, lambda s: F.lit(False)))
    given = _rect(box["x"], box["y"], box["w"], box["h"])

    def union(own: Column) -> Column:
        side = lambda k, f: f(F.transform(own, lambda s: s["bbox"][k]))
        around = _rect(side("x0", F.array_min), side("y0", F.array_min), side("x1", F.array_max), side("y1", F.array_max))

        def guarded(b: Column) -> Column:
            w, h = F.greatest(F.lit(1.0), b["w"] - b["x"]), F.greatest(F.lit(1.0), b["h"] - b["y"])
            split = F.exists(own, lambda s: s["bbox_source"] == "word-split")
            cap = lambda c: h * F.size(c) * CONFIG.short_name_height_width
            too_wide = F.when(split, let(_characters(own), lambda c: short_name(c) & (w > cap(c)))).otherwise(F.lit(False))
            return _rect(b["x"], b["y"], F.when(too_wide, F.greatest(F.lit(1.0), cap(_characters(own)))).otherwise(w), h)

        return F.when(F.size(own) > 0, let(around, guarded)).otherwise(given)  # around: right and bottom edge in w and h

    return let(_boxed(symbols), union)


def visual_rect(box: Column, symbols: Column, source: Column, width: Column, height: Column) -> dict[str, Column]:
    """Steps to the covering rectangle as named columns, to be added in turn; the last is ``rect``.

    Later steps read earlier ones several times over, so each must be evaluated before the next.
    """
    p, c = F.col("_p"), F.col("_c")
    own = _boxed(symbols)
    medial = median_or_zero(F.transform(own, lambda s: s["bbox"]["x1"] - s["bbox"]["x0"]))
    local = F.col("_short") & (source == "局所OCR") & (F.size(own) > 0) & (F.col("_mw") > 0)
    tall = F.col("_mw") * CONFIG.short_name_shape
    wide = F.col("_mw") * F.size(c) * CONFIG.short_name_median_width
    too_tall, too_wide = local & (p["h"] > tall), local & (p["w"] > wide)
    shaped = _rect(
        p["x"],
        F.when(too_tall, p["y"] + p["h"] / 2 - tall / 2).otherwise(p["y"]),
        F.when(too_wide, F.greatest(F.lit(1.0), wide)).otherwise(p["w"]),
        F.when(too_tall, tall).otherwise(p["h"]),
    )
    s = F.col("_s")
    expected = s["h"] * F.size(c) * CONFIG.short_name_step
    counted = F.col("_short") & (s["h"] > 0)
    narrow, broad = counted & (s["w"] < expected * CONFIG.short_name_narrow), counted & (s["w"] > expected * CONFIG.short_name_wide)
    extra = F.greatest(F.lit(0.0), expected - s["w"])
    normal = _rect(F.when(narrow, F.greatest(F.lit(0.0), s["x"] - extra * 0.70)).otherwise(s["x"]), s["y"], F.when(narrow | broad, expected).otherwise(s["w"]), s["h"])
    n = F.col("_n")
    even = F.greatest(F.lit(2.0), half_up(n["h"] * 0.08))
    left = F.when(F.col("_short"), F.greatest(F.lit(4.0), half_up(n["h"] * 0.16))).otherwise(even)
    split = F.exists(symbols, lambda x: x["bbox_source"] == "word-split")
    right = F.when(F.col("_short"), F.when(split, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(even)
    e = F.col("_e")
    return {
        "_p": paint_box(box, symbols),
        "_c": _characters(symbols),
        "_short": short_name(_characters(symbols)),
        "_mw": medial,
        "_s": shaped,
        "_n": normal,
        "_e": F.struct(
            F.greatest(F.lit(0.0), half_up(n["x"] - left)).alias("x0"),
            F.greatest(F.lit(0.0), half_up(n["y"] - even)).alias("y0"),
            F.least(width.cast("double"), half_up(n["x"] + n["w"] + right)).alias("x1"),
            F.least(height.cast("double"), half_up(n["y"] + n["h"] + even)).alias("y1"),
        ),
        "rect": _rect(e["x0"], e["y0"], F.greatest(F.lit(1.0), e["x1"] - e["x0"]), F.greatest(F.lit(1.0), e["y1"] - e["y0"])),
    }


def add_visual_rect(df, box: Column, symbols: Column, source: Column, width: Column, height: Column):
    """``df`` with ``rect``, the covering rectangle."""
    steps = visual_rect(box, symbols, source, width, height)
    for names in (("_p", "_c", "_short", "_mw"), ("_s",), ("_n",), ("_e",)):
        df = sealed(df, {k: steps[k] for k in names})
    return df.withColumn("rect", steps["rect"]).drop(*[k for k in steps if k.startswith("_")])


def manual_rect(box: Column) -> Column:
    """Rectangle painted for a hand-drawn box. Its right edge ends 6 short of the drawn one, on purpose kept so."""
    pad = F.greatest(F.lit(4.0), half_up(F.least(box["w"], box["h"]) * 0.12))
    return _rect(F.greatest(F.lit(0.0), box["x"] - pad - 6), F.greatest(F.lit(0.0), box["y"] - pad - 2), box["w"] + pad, box["h"] + 2 * (pad + 2))
