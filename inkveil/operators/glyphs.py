"""Templates from strings: glyph pictures of a font, side by side, slanted, cut out and sampled.

Fonts differ by machine, so glyphs are an input table: (font, ch, width, height, advance, data: RGBA), all of a font on one baseline, that is of
one height. A target that has a character without a glyph gets no template.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .raster import half_up, pixels
from .templates import PIECE, make_template

POINTS = "array<struct<x:int,y:int>>"
_POINTS = pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())]))
TEMPLATE = pa.schema([("target_id", pa.string()), ("target_height", pa.int32()), ("skew", pa.float64()), ("w", pa.int32()), ("h", pa.int32()), ("samples", _POINTS), ("bg_samples", _POINTS)])


def line(glyphs: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """Glyphs and their advances -> one picture on a clear ground; where glyphs overlap, the more opaque pixel shows."""
    starts = np.cumsum([0, *[advance for _, advance in glyphs]])
    height = max(g.shape[0] for g, _ in glyphs)
    out = np.zeros((height, max(int(s) + g.shape[1] for s, (g, _) in zip(starts, glyphs)), 4), np.uint8)
    for s, (g, _) in zip(starts.tolist(), glyphs):
        place = out[: g.shape[0], s : s + g.shape[1]]
        np.copyto(place, g, where=(g[..., 3] > place[..., 3])[..., None])
    return out


def slanted(rgba: np.ndarray, skew: float) -> np.ndarray:
    """Each row moved to the right by ``skew`` times its number (to the left below 0), between pixels by linear parts."""
    height, width = rgba.shape[:2]
    shift = skew * np.arange(height)
    shift -= min(0.0, float(shift.min()))
    whole = np.floor(shift).astype(int)
    part = (shift - whole)[:, None, None]
    wide = int(whole.max()) + width + 1
    at = np.arange(wide)[None, :] - whole[:, None]
    padded = np.zeros((height, width + 2, 4))  # clear on both sides
    padded[:, 1:-1] = rgba
    take = lambda k: np.take_along_axis(padded, np.clip(k + 1, 0, width + 1)[..., None], axis=1)
    return half_up(take(at) * (1 - part) + take(at - 1) * part).astype(np.uint8)


def draw_templates(targets: DataFrame, glyphs: DataFrame, variants: DataFrame) -> DataFrame:
    """targets (target_id, target), glyphs of one font, variants (target_height, skew) -> the templates table.

    Characters meet their glyphs by equality; a target's are gathered, some dozens at most.
    """
    ch = targets.select("target_id", "target", F.posexplode(F.split("target", "")).alias("at", "ch"))
    glyph = F.struct("at", "width", "height", "advance", "data")
    drawn = ch.join(glyphs, "ch").groupBy("target_id", "target").agg(F.array_sort(F.collect_list(glyph)).alias("glyphs")).filter(F.size("glyphs") == F.length("target"))
    asked = drawn.crossJoin(F.broadcast(variants.agg(F.collect_list(F.struct("target_height", "skew")).alias("variants"))))  # one row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, PIECE):
                out = []
                for r in b.slice(at, PIECE).to_pylist():
                    flat = line([(pixels(g["data"], g["width"], g["height"]), g["advance"]) for g in r["glyphs"]])
                    for v in r["variants"]:
                        t = make_template(slanted(flat, v["skew"]), v["target_height"], v["skew"])
                        out.append({"target_id": r["target_id"], "target_height": v["target_height"], "skew": v["skew"], "w": t["w"], "h": t["h"], **{k: [{"x": int(x), "y": int(y)} for x, y in t[k]] for k in ("samples", "bg_samples")}})
                yield pa.RecordBatch.from_pylist(out, TEMPLATE)

    return asked.select("target_id", "glyphs", "variants").mapInArrow(run, f"target_id string, target_height int, skew double, w int, h int, samples {POINTS}, bg_samples {POINTS}")
