"""Template search on grey planes: scan grids, scores, coarse to fine, rescue of what reading missed.

Templates (sample points of a rendered target) are an input table, since fonts differ by machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType

from ..functions.config import CONFIG
from ..functions.numbers import half_up as col_half_up
from ..functions.numbers import median_of
from .raster import analysed, grey_plane, half_up, pixels, resize, shared_area


def scan_positions(start: int, end: int, step: int, offset: int = 0) -> list[int]:
    """start + offset, + step, ... up to end, and end itself; ascending, none before start."""
    return sorted({v for v in [*range(start + offset, end + 1, step), end] if start <= v <= end})


@F.arrow_udf(ArrayType(IntegerType()))
def _scan(start: pa.Array, end: pa.Array, step: pa.Array, offset: pa.Array) -> pa.Array:
    return pa.array([scan_positions(*r) for r in zip(*(c.to_pylist() for c in (start, end, step, offset)))], pa.list_(pa.int32()))


def scan_grids(start: Column, end: Column, step: int, offset: int = 0) -> Column:
    """``scan_positions`` of each row, as an array."""
    return _scan(start, end, F.lit(step), F.lit(offset))


def _two(start: int, end: int) -> set[int]:
    return {*scan_positions(start, end, CONFIG.coarse_step), *scan_positions(start, end, CONFIG.coarse_step, CONFIG.coarse_offset)}


def region_positions(regions: list[dict], w: int, h: int, width: int, height: int) -> tuple[list[int], list[int]]:
    """Grid positions around the regions; those of x and of y are pooled over all regions."""
    m = CONFIG.region_margin
    xs: set[int] = set()
    ys: set[int] = set()
    for r in regions:
        x0, y0 = max(0, int(np.floor(r["x"] - m))), max(0, int(np.floor(r["y"] - m)))
        x1 = min(width - w, int(np.ceil(r["x"] + r["w"] + m - w)))
        y1 = min(height - h, int(np.ceil(r["y"] + r["h"] + m - h)))
        if x1 >= x0 and y1 >= y0:
            xs |= _two(x0, x1)
            ys |= _two(y0, y1)
    return sorted(xs), sorted(ys)


def near_region(x, y, w, h, r) -> np.ndarray:
    """Whether boxes have their centres in or near a region (x, y, w, h); of arrays element by element."""
    m, cx, cy = CONFIG.region_margin, x + w / 2, y + h / 2
    return (r["x"] - m <= cx) & (cx <= r["x"] + r["w"] + m) & (r["y"] - m <= cy) & (cy <= r["y"] + r["h"] + m)


def overlaps_box(x, y, w, h, o) -> np.ndarray:
    """Whether positions overlap a covered box: the threshold itself does, areas count 1 at least."""
    ix = np.maximum(0, np.minimum(o["x"] + o["w"], x + w) - np.maximum(o["x"], x))
    iy = np.maximum(0, np.minimum(o["y"] + o["h"], y + h) - np.maximum(o["y"], y))
    least = np.minimum(np.maximum(1, o["w"] * o["h"]), np.maximum(1, w * h))
    return (o["w"] > 0) & (o["h"] > 0) & (ix * iy > 0) & (ix * iy / least >= CONFIG.template_overlap)


def _any(test, x, y, w, h, boxes: list[dict]) -> np.ndarray:
    hit = np.zeros(np.broadcast_shapes(np.shape(x), np.shape(y)), bool)
    for b in boxes:
        hit |= test(x, y, w, h, b)
    return hit


def open_positions(xs: np.ndarray, ys: np.ndarray, w: int, h: int, regions: list[dict], existing: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Of a grid (y, x) of positions: those in or near a region, if there are any, and of these the ones that nothing covers."""
    x, y = np.asarray(xs)[None, :], np.asarray(ys)[:, None]
    asked = _any(near_region, x, y, w, h, regions) if regions else np.ones((len(ys), len(xs)), bool)
    return asked, asked & ~_any(overlaps_box, x, y, w, h, existing)


def _of_lists(test):
    """A test of a box against other boxes as a column: whether any of a list of boxes passes."""

    @F.arrow_udf(BooleanType())
    def run(x: pa.Array, y: pa.Array, w: pa.Array, h: pa.Array, others: pa.Array) -> pa.Array:
        owner = np.repeat(np.arange(len(x)), others.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        flat = others.flatten()
        o = {k: pc.struct_field(flat, k).to_numpy(zero_copy_only=False) for k in ("x", "y", "w", "h")}
        hit = test(*(c.to_numpy(zero_copy_only=False)[owner] for c in (x, y, w, h)), o)
        return pa.array(np.bincount(owner, hit, len(x)) > 0)

    return run


_near_any, _overlaps_any = _of_lists(near_region), _of_lists(overlaps_box)
_SIDES = ("x", "y", "w", "h")


def _gathered(boxes: DataFrame, name: str) -> DataFrame:
    """(image_id, name): the boxes of each image; some dozens at most."""
    return boxes.groupBy("image_id").agg(F.collect_list(F.struct(*_SIDES)).alias(name))


def touches_region(boxes: DataFrame, regions: DataFrame) -> DataFrame:
    """Boxes (image_id, x, y, w, h) whose centre lies in or near a text region of their image; all of an image without regions."""
    rows = boxes.join(_gathered(regions, "_r"), "image_id", "left")
    return rows.withColumn("_hit", _near_any(*_SIDES, "_r")).filter(F.col("_r").isNull() | F.col("_hit")).select(*boxes.columns)


def uncovered(boxes: DataFrame, existing: DataFrame) -> DataFrame:
    """Boxes that no covered box of their image overlaps."""
    rows = boxes.join(_gathered(existing, "_k"), "image_id", "left")
    return rows.withColumn("_hit", _overlaps_any(*_SIDES, "_k")).filter(~F.col("_hit")).select(*boxes.columns)


class Plane:
    """A grey plane for templates: of both ranges of grey, the 64 pixels from each place on as the bits of a word.

    A template's points are masks of such words, row by row, so a count of its points that lie in range is a sum of bit counts, for a whole
    grid of positions at once. The words are made once for all templates of an image.
    """

    def __init__(self, grey: np.ndarray):
        low, high = CONFIG.gray_text
        self.grey, (self.height, self.width) = grey, grey.shape
        self.text, self.ground = self._words((grey >= low) & (grey <= high)), self._words(grey <= CONFIG.gray_background)

    def _words(self, hit: np.ndarray) -> np.ndarray:
        words = np.zeros((self.height, self.width + 64), np.uint64)
        words[:, : self.width] = hit
        for k in (1, 2, 4, 8, 16, 32):
            words[:, :-k] |= words[:, k:] << np.uint64(k)
        return words[:, : self.width + 1]  # the last place: nothing beyond the edge

    def count(self, words: np.ndarray, points: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
        """(y, x): how many of a template's points, repeats counted, hit at each position of the grid."""
        total = np.zeros((len(ys), len(xs)), np.int64)
        places, times = np.unique(points, axis=0, return_counts=True) if len(points) else (points, np.zeros(0, int))
        while len(places):
            masks: dict[tuple[int, int], int] = {}
            for x, y in places.tolist():
                masks[y, x // 64] = masks.get((y, x // 64), 0) | 1 << x % 64
            for (y, k), mask in masks.items():
                total += np.bitwise_count(words[(ys + y)[:, None], np.minimum(xs + 64 * k, self.width)[None, :]] & np.uint64(mask))
            times = times - 1
            places, times = places[times > 0], times[times > 0]
        return total

    def score(self, xs: np.ndarray, ys: np.ndarray, template: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(y, x) of a grid: (score, share of text points in the text range, share of background points dark enough)."""
        fg, bg = (np.array(template[k], int).reshape(-1, 2) for k in ("samples", "bg_samples"))
        f = self.count(self.text, fg, xs, ys) / max(1, len(fg))
        g = self.count(self.ground, bg, xs, ys) / max(1, len(bg))
        return f * CONFIG.template_weights[0] + g * CONFIG.template_weights[1], f, g


#: Rows of points that are held as Python objects at a time.
PIECE = 256


def score_positions(rows: DataFrame) -> DataFrame:
    """rows: (id, width, height, data: grey bytes, x, y, samples, bg_samples) -> (id, score, fg_score, bg_score) of one position each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PIECE):
                b = whole.slice(at, PIECE)
                out = []
                for r in b.to_pylist():
                    own = {k: [(p["x"], p["y"]) for p in r[k]] for k in ("samples", "bg_samples")}
                    s, x, y = Plane(np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"])).score(np.array([r["x"]]), np.array([r["y"]]), own)
                    out.append((r["id"], float(s[0, 0]), float(x[0, 0]), float(y[0, 0])))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), *[pa.float64()] * 3))], names=["id", "score", "fg_score", "bg_score"])

    return rows.mapInArrow(run, "id bigint, score double, fg_score double, bg_score double")


def suppress(candidates: list[dict], limit: int) -> list[dict]:
    kept: list[dict] = []
    for c in sorted(candidates, key=lambda c: -c["score"]):
        if len(kept) >= limit:
            break
        if not any(shared_area(c, k) > min(c["w"] * c["h"], k["w"] * k["h"]) * CONFIG.template_overlap for k in kept):
            kept.append(c)
    return kept


def search(plane: Plane, template: dict, regions: list[dict] | None = None, existing: list[dict] | None = None) -> dict:
    """Positions of one template on one plane: a coarse grid, its best seeds, then their surroundings."""
    height, width = plane.height, plane.width
    w, h = template["w"], template["h"]
    regions, existing = regions or [], existing or []
    if not w or w >= width or h >= height:
        return {"candidates": [], "coarse_passed": 0, "scored": 0, "skipped": 0}
    top, bottom = int(np.floor(height * CONFIG.search_top)), max(int(np.floor(height * CONFIG.search_top)), height - h)
    left = int(np.floor(width * CONFIG.search_left))
    right = max(left, width - w - int(np.floor(width * CONFIG.search_right)))
    low, high = CONFIG.gray_text
    probe = plane.grey[top : min(height - 1, bottom + h) + 1, left : right + 1 : 5]
    filled = np.zeros(height + h + 1, bool)
    filled[top : top + len(probe)] = ((probe >= low) & (probe <= high)).sum(axis=1) >= 4
    xs, ys = region_positions(regions, w, h, width, height) if regions else (sorted(_two(left, right)), sorted(_two(top, bottom)))
    ys = [y for y in ys if filled[y : y + h : max(2, CONFIG.coarse_step)].any()]

    def good(xs: list[int], ys: list[int], least: tuple[float, float]) -> tuple[list[dict], int, int]:
        """The positions that score enough, by rows; how many were scored, and skipped since they are covered."""
        if not xs or not ys:
            return [], 0, 0
        xs, ys = np.array(xs), np.array(ys)
        asked, free = open_positions(xs, ys, w, h, regions, existing)
        s, f, g = plane.score(xs, ys, template) if free.any() else (np.zeros(free.shape),) * 3
        hits = np.argwhere(free & (s >= least[0]) & (g >= least[1])).tolist()
        found = [{"x": int(xs[i]), "y": int(ys[k]), "w": w, "h": h, "score": float(s[k, i]), "fg_score": float(f[k, i]), "bg_score": float(g[k, i])} for k, i in hits]
        return found, int(free.sum()), int(asked.sum() - free.sum())

    seeds, scored, skipped = good(xs, ys, CONFIG.coarse)
    fine = []
    reach = CONFIG.refine_reach
    for seed in suppress(seeds, CONFIG.coarse_limit):
        around = [list(range(max(least, seed[k] - reach), min(most, seed[k] + reach) + 1, CONFIG.refine_step)) for k, least, most in (("x", left, right), ("y", top, bottom))]
        fine += good(*around, CONFIG.final)[0]
    return {"candidates": suppress(fine, CONFIG.final_limit), "coarse_passed": len(seeds), "scored": scored, "skipped": skipped}


def _times(r: dict, scale: float) -> dict:
    return {**r, **{k: r[k] * scale for k in ("x", "y", "w", "h")}}


def _whole(r: dict, scale: float) -> dict:
    """A box of a scaled plane in whole pixels of what was scaled."""
    return {**r, **{k: int(half_up(r[k] / scale)) for k in ("x", "y")}, **{k: max(1, int(half_up(r[k] / scale))) for k in ("w", "h")}}


class SearchPage:
    """The analysed page of an image and the plane, maybe smaller still, on which its templates are sought."""

    def __init__(self, rgba: np.ndarray):
        page, self.page_scale = analysed(rgba)
        height, width = page.shape[:2]
        self.scale = min(1.0, CONFIG.template_width / width, float(np.sqrt(CONFIG.template_pixels / (width * height))))
        if self.scale >= CONFIG.scale_snap:
            self.scale = 1.0
        else:
            w, h = max(1, int(half_up(width * self.scale))), max(1, int(half_up(height * self.scale)))
            page, self.scale = resize(page, w, h), w / width
        self.plane = Plane(grey_plane(page, boost=True))


def rescue(page: SearchPage, templates: list[dict], existing: list[dict], regions: list[dict]) -> tuple[list[dict], dict]:
    """Places that a target's templates find and no box covers: around text regions first, then anywhere.

    Boxes go in and out in the image's own pixels. They are merged and accepted on the analysed page; the search
    is on a plane of it that may be smaller still. Only what is found is rounded, boxes and regions are scaled as they are.
    """
    plane, scale, page_scale = page.plane, page.scale, page.page_scale
    accepted: list[dict] = []
    taken = [_times(b, page_scale) for b in existing]
    areas = [_times(r, page_scale) for r in regions if r["w"] > 0 and r["h"] > 0]
    totals = {"passes": 0, "scored": 0, "skipped": 0, "coarse_passed": 0}
    for name, area in [("文字領域優先", areas), ("全画面補完", [])] if areas else [("全画面", [])]:
        if len(accepted) >= CONFIG.rescue_limit:
            break
        totals["passes"] += 1
        merged = []
        for t in templates:
            found = search(plane, t, [_times(r, scale) for r in area], [_times(b, scale) for b in taken])
            for k in ("scored", "skipped", "coarse_passed"):
                totals[k] += found[k]
            merged += [{**(_whole(c, scale) if scale != 1.0 else c), "target_height": t["target_height"], "skew": t["skew"]} for c in found["candidates"]]
        for c in suppress(merged, CONFIG.merged_limit):
            if c["score"] < CONFIG.rescue[0] or c["fg_score"] < CONFIG.rescue[1] or c["bg_score"] < CONFIG.rescue[2] or _any(overlaps_box, c["x"], c["y"], c["w"], c["h"], taken).any():
                continue
            accepted.append({**_whole(c, page_scale), "pass": name})
            taken.append({k: c[k] for k in ("x", "y", "w", "h")})
            if len(accepted) >= CONFIG.rescue_limit:
                break
    return accepted, totals


def template_points(alpha: np.ndarray, most: tuple[int, int] = (165, 145)) -> tuple[list, list]:
    """Sample points of a rendered target: opaque ones and clear ones, each thinned evenly to about ``most``."""
    out = []
    for hit, n in ((alpha >= 95, most[0]), (alpha <= 12, most[1])):
        ys, xs = np.nonzero(hit)
        step = max(1, -(-len(xs) // n))
        out.append(list(zip(xs[::step].tolist(), ys[::step].tolist())))
    return out[0], out[1]


def make_template(rgba: np.ndarray, target_height: int, skew: float = 0.0) -> dict:
    """Template of a target drawn on a clear ground: cropped to what is visible, scaled to the height, sampled."""
    ys, xs = np.nonzero(rgba[..., 3] >= 70)
    if not len(xs):
        return {"w": 0, "h": 0, "samples": [], "bg_samples": [], "target_height": target_height, "skew": skew}
    shown = rgba[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1]
    width = max(1, int(half_up(shown.shape[1] * target_height / shown.shape[0])))
    fg, bg = template_points(resize(shown, width, target_height)[..., 3])
    return {"w": width, "h": target_height, "samples": fg, "bg_samples": bg, "target_height": target_height, "skew": skew}


def make_templates(drawn: DataFrame) -> DataFrame:
    """drawn: (target_id, width, height, data: RGBA on a clear ground, target_height, skew) -> the templates table."""
    point = "array<struct<x:int,y:int>>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for at in range(0, len(whole), PIECE):
                out = []
                for r in whole.iloc[at : at + PIECE].itertuples(index=False):
                    t = make_template(pixels(r.data, r.width, r.height), r.target_height, r.skew)
                    out.append((r.target_id, r.target_height, r.skew, t["w"], t["h"], *[[{"x": x, "y": y} for x, y in t[k]] for k in ("samples", "bg_samples")]))
                yield pd.DataFrame(out, columns=["target_id", "target_height", "skew", "w", "h", "samples", "bg_samples"])

    return drawn.mapInPandas(run, f"target_id string, target_height int, skew double, w int, h int, samples {point}, bg_samples {point}")


def template_variants(heights: DataFrame, skews: tuple[float, ...] = (0.0,)) -> DataFrame:
    """(.., heights array) -> one row per height and skew."""
    return heights.withColumn("height", F.explode("heights")).withColumn("skew", F.explode(F.array(*[F.lit(float(s)) for s in skews])))


def template_heights(matches: DataFrame, near: DataFrame, scales: DataFrame | None = None) -> DataFrame:
    """(image_id, target_id, heights, basis, origin, sample_count) from the median height of hits, else of strong near ones.

    ``scales`` (image_id, scale) turns heights into those of the analysed image; without it they stay.
    """
    tall = lambda b: (b["y1"] - b["y0"]).cast("double")
    exact = matches.select("image_id", "target_id", tall(F.col("box")).alias("h"), F.lit(0).alias("k"))
    strong = near.filter((F.length("candidate") == F.length("target")) & (F.levenshtein("target", "candidate") == 1) & (F.col("similarity") >= CONFIG.vote_similarity))
    rows = exact.unionByName(strong.select("image_id", "target_id", tall(F.col("box")).alias("h"), F.lit(1).alias("k")))
    if scales is not None:
        rows = rows.join(scales.select("image_id", F.col("scale").alias("_s")), "image_id").withColumn("h", F.col("h") * F.col("_s"))
    rows = rows.filter("h > 0")
    rows = rows.groupBy("image_id", "target_id", "k").agg(F.collect_list("h").alias("hs")).withColumn("basis", median_of(F.col("hs")))
    best = rows.groupBy("image_id", "target_id").agg(F.min_by(F.struct("k", "basis", F.size("hs").alias("n")), "k").alias("b"))
    centre = F.greatest(F.lit(22.0), F.least(F.lit(40.0), col_half_up(F.col("b.basis"))))
    low, high = F.greatest(F.lit(22.0), centre - 1), F.least(F.lit(40.0), centre + 1)
    return best.select("image_id", "target_id", F.array(low, high).cast("array<int>").alias("heights"), "b.basis", F.when(F.col("b.k") == 0, F.lit("exact")).otherwise(F.lit("near")).alias("origin"), F.col("b.n").alias("sample_count"))


def rescue_search(images: DataFrame, asked: DataFrame) -> DataFrame:
    """asked: (image_id, target_id, templates, existing, regions), arrays each -> one row of every (image, target).

    ``accepted`` has the boxes found, ``rescue_limit`` at most; the others count passes over the page, positions
    scored, positions skipped since something covers them already, and positions that passed the coarse search.
    All that is asked of an image meets its pixels once: one page and one plane serve all its targets.
    """
    box = "x:double,y:double,w:double,h:double,score:double,fg_score:double,bg_score:double,pass:string"
    gathered = asked.groupBy("image_id").agg(F.collect_list(F.struct("target_id", "templates", "existing", "regions")).alias("asked"))
    rows = images.select("image_id", "width", "height", "data").join(gathered, "image_id")

    def plain(v) -> list[dict]:
        return [x.asDict(True) if hasattr(x, "asDict") else dict(x) for x in (v if v is not None else [])]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                out, page = [], SearchPage(pixels(r.data, r.width, r.height))
                for q in plain(r.asked):
                    templates = plain(q["templates"])
                    for t in templates:
                        for k in ("samples", "bg_samples"):
                            t[k] = [(p["x"], p["y"]) for p in plain(t[k])]
                    accepted, totals = rescue(page, templates, plain(q["existing"]), plain(q["regions"]))
                    boxes = [{n: a[n] if n == "pass" else float(a[n]) for n in ("x", "y", "w", "h", "score", "fg_score", "bg_score", "pass")} for a in accepted]
                    out.append({"image_id": r.image_id, "target_id": q["target_id"], **totals, "accepted": boxes})
                yield pd.DataFrame(out, columns=["image_id", "target_id", "passes", "scored", "skipped", "coarse_passed", "accepted"])

    return rows.mapInPandas(run, f"image_id string, target_id string, passes bigint, scored bigint, skipped bigint, coarse_passed bigint, accepted array<struct<{box}>>")


def accepted_boxes(found: DataFrame) -> DataFrame:
    """The boxes of ``rescue_search``, one row each, in the order of acceptance."""
    return found.select("image_id", "target_id", F.posexplode("accepted").alias("ord", "b")).select("image_id", "target_id", "ord", "b.*")


def rescue_boxes(images: DataFrame, asked: DataFrame) -> DataFrame:
    """The accepted boxes of every (image, target)."""
    return accepted_boxes(rescue_search(images, asked))
