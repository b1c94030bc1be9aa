"""Manual edits: hit tests, and the replay of an event log to stamps (``gestures`` makes the events).

An image's edits depend on their order, so each image's log is replayed alone; images run in parallel. Rows are dealt by
image and sorted, and a task replays one image after another as they pass: most logs are short, and a call for each would
cost more than the log.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import hypot

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.config import CONFIG
from ..functions.rects import manual_rect
from ..functions.schemas import STAMPS
from .cells import extent, meet

DEFAULT_STYLE = {"mode": "black", "color": "#1a1a1a"}


def clamp(v: float, low: float, high: float) -> float:
    return max(low, min(high, v))


def moved(box: dict, dx: float, dy: float, width: float, height: float) -> dict:
    return {**box, "x": max(0, min(width - box["w"], box["x"] + dx)), "y": max(0, min(height - box["h"], box["y"] + dy))}


def resized(box: dict, handle: str, dx: float, dy: float, width: float, height: float) -> dict:
    """The opposite corner stays; no side gets shorter than the least size; the image holds the box."""
    least = CONFIG.min_manual_size
    out = dict(box)
    for near, far, at, size, d in (("w", "e", "x", "w", dx), ("n", "s", "y", "h", dy)):
        if far in handle:
            out[size] = box[size] + d
        if near in handle:
            out[at], out[size] = box[at] + d, box[size] - d
        if out[size] < least:
            if near in handle:
                out[at] = box[at] + box[size] - least
            out[size] = least
    out["x"] = max(0, min(width - out["w"], out["x"]))
    out["y"] = max(0, min(height - out["h"], out["y"]))
    return out


def trace_height(display_scale: float) -> float:
    """Height of a traced band: 32 pixels of the display, 32 to 44 of the image."""
    return clamp(32 / max(0.0001, display_scale), 32, 44)


def drawn(x0: float, y0: float, x1: float, y1: float, trace: float | None, height: float) -> dict:
    """Box of a drag; ``trace``: height of the band, if the drag traces a line."""
    if trace is not None:
        return {"x": min(x0, x1), "y": max(0, min(height - trace, y0 - trace / 2)), "w": abs(x1 - x0), "h": trace}
    return {"x": min(x0, x1), "y": min(y0, y1), "w": abs(x1 - x0), "h": abs(y1 - y0)}


CORNERS = (("nw", 0, 0), ("ne", 1, 0), ("sw", 0, 1), ("se", 1, 1))


def handle_at(x: float, y: float, stamp: dict, radius: float) -> tuple[str, float] | None:
    """The nearest corner within the radius, the first of equals."""
    dx, dy = x - stamp["x"], y - stamp["y"]
    if (abs(dx) > radius and abs(dx - stamp["w"]) > radius) or (abs(dy) > radius and abs(dy - stamp["h"]) > radius):
        return None  # on one axis alone every corner is too far
    name, least = None, radius
    for k, i, j in CORNERS:
        d = hypot(x - stamp["x"] - i * stamp["w"], y - stamp["y"] - j * stamp["h"])
        if d < least or (d == least and name is None):
            name, least = k, d
    return (name, least) if name else None


def hit_test(x: float, y: float, stamps: list[dict], radius: float = CONFIG.hit_radius) -> tuple[int, str, str | None] | None:
    """(index, "resize" or "move", corner): the nearest corner of all, a later stamp of equals, else the topmost box."""
    best = None
    for i in reversed(range(len(stamps))):
        h = handle_at(x, y, stamps[i], radius)
        if h and (best is None or h[1] < best[2]):
            best = (i, h[0], h[1])
    if best:
        return best[0], "resize", best[1]
    for i in reversed(range(len(stamps))):
        s = stamps[i]
        if s["x"] - radius <= x <= s["x"] + s["w"] + radius and s["y"] - radius <= y <= s["y"] + s["h"] + radius:
            return i, "move", None
    return None


def hit_test_rows(points: DataFrame, stamps: DataFrame, radius: float = CONFIG.hit_radius) -> DataFrame:
    """points (image_id, point_id, x, y) -> what each would grab: stamp_ix, kind, handle. Points meet the stamps in reach by grid cells."""
    corners = F.array(*[F.struct(F.lit(n).alias("handle"), F.lit(i).alias("o"), (F.col("s.x") + a * F.col("s.w")).alias("cx"), (F.col("s.y") + b * F.col("s.h")).alias("cy")) for i, (n, a, b) in enumerate((("nw", 0, 0), ("ne", 1, 0), ("sw", 0, 1), ("se", 1, 1)))])
    x, y = F.col("x"), F.col("y")
    at, reach = extent(x, y, x, y), extent(x - radius, y - radius, x + F.col("w") + radius, y + F.col("h") + radius)
    both = meet(points.select("image_id", "point_id", "x", "y"), stamps.select("image_id", "stamp_ix", "x", "y", "w", "h"), ["image_id"], at, reach)
    both = both.select("image_id", "l.point_id", "l.x", "l.y", "r.stamp_ix", F.struct("r.x", "r.y", "r.w", "r.h").alias("s"))
    both = both.withColumn("c", F.transform(corners, lambda c: F.struct(F.hypot(F.col("x") - c["cx"], F.col("y") - c["cy"]).alias("d"), c["o"].alias("o"), c["handle"].alias("handle"))))
    both = both.withColumn("c", F.array_min("c"))
    inside = (F.col("x") >= F.col("s.x") - radius) & (F.col("x") <= F.col("s.x") + F.col("s.w") + radius) & (F.col("y") >= F.col("s.y") - radius) & (F.col("y") <= F.col("s.y") + F.col("s.h") + radius)
    # Corners first, by distance; then boxes; later stamps win ties.
    grab = F.when(F.col("c.d") <= radius, F.struct(F.lit(0).alias("k"), F.col("c.d").alias("d"), (-F.col("stamp_ix")).alias("o"), F.col("c.o").alias("corner"), F.col("c.handle").alias("handle"))).when(inside, F.struct(F.lit(1).alias("k"), F.lit(0.0).alias("d"), (-F.col("stamp_ix")).alias("o"), F.lit(0).alias("corner"), F.lit(None).cast("string").alias("handle")))
    hits = both.withColumn("g", grab).filter(F.col("g").isNotNull()).groupBy("image_id", "point_id").agg(F.min("g").alias("g"))
    return hits.select("image_id", "point_id", (-F.col("g.o")).cast("int").alias("stamp_ix"), F.when(F.col("g.k") == 0, F.lit("resize")).otherwise(F.lit("move")).alias("kind"), "g.handle")


class Editor:
    """Stamps and undo steps of one image."""

    def __init__(self, width: float, height: float, stamps: list[dict] | None = None):
        self.width, self.height = width, height
        self.stamps = list(stamps or [])
        self.undo_steps: list[list[dict]] = []

    def _remember(self) -> None:
        self.undo_steps = [*self.undo_steps, list(self.stamps)][-CONFIG.undo_limit :]  # no stamp is changed in place

    def _add(self, box: dict, style: dict | None) -> None:
        self._remember()
        self.stamps.append({**box, "kind": "manual", "style": style or dict(DEFAULT_STYLE)})

    def apply(self, op: str, e: dict) -> None:
        """``add`` and ``place`` (a copy of the last manual stamp, centred), ``move``, ``resize``, ``delete``, ``undo``, ``reset``, ``detect``.

        ``detect`` stands for an automatic run: it drops the history and leaves one empty step, so that one
        undo removes all that the run added; its stamps follow as ``ocr`` events. An edit of a stamp that is
        not there does nothing.
        """
        at = e.get("stamp_ix")
        there = at is not None and 0 <= at < len(self.stamps)
        if op == "add":
            if e["w"] >= CONFIG.min_manual_size and e["h"] >= CONFIG.min_manual_size:
                self._add({k: e[k] for k in "xywh"}, e.get("style"))
        elif op == "place":
            last = next((s for s in reversed(self.stamps) if s["kind"] == "manual"), None)
            if last:
                box = {"x": e["x"] - last["w"] / 2, "y": e["y"] - last["h"] / 2, "w": last["w"], "h": last["h"]}
                self._add(moved(box, 0, 0, self.width, self.height), e.get("style"))
        elif op in ("move", "resize") and there:
            self._remember()
            change = moved(self.stamps[at], e["dx"], e["dy"], self.width, self.height) if op == "move" else resized(self.stamps[at], e["handle"], e["dx"], e["dy"], self.width, self.height)
            self.stamps[at] = change
        elif op == "delete" and there:
            self._remember()
            del self.stamps[at]
        elif op == "undo" and self.undo_steps:
            self.stamps = self.undo_steps.pop()
        elif op == "reset":
            self.stamps, self.undo_steps = [], []
        elif op == "detect":
            self.stamps, self.undo_steps = [], [[]]
        elif op == "ocr":
            self.stamps.append({k: e[k] for k in "xywh"} | {"kind": "ocr", "style": e.get("style") or dict(DEFAULT_STYLE)})


def columns(batch: pa.RecordBatch) -> list[list]:
    """Columns as lists; a fractional number that is missing is NaN."""
    whole = (pa.types.is_integer, pa.types.is_boolean, pa.types.is_string)
    plain = lambda c: pa.types.is_floating(c.type) or (c.null_count == 0 and any(is_kind(c.type) for is_kind in whole))
    return [c.to_numpy(zero_copy_only=False).tolist() if plain(c) else c.to_pylist() for c in batch.columns]


def _records(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows as dictionaries."""
    return (dict(zip(batch.schema.names, r)) for r in zip(*columns(batch)))


def in_turn(rows: DataFrame, schema: str, begin: Callable, feed: Callable, end: Callable) -> DataFrame:
    """Feeds each image's rows (image_id, seq, ...), in the order of ``seq``, to a state of its own.

    ``begin(row)`` makes the state, ``feed(state, row)`` and ``end(state, image_id)`` give rows of ``schema``. A task holds one state.
    """
    # A number and a key of its own: Spark would join partitions by their bytes, of which there are few for the work they make.
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)
    dealt = rows.repartition(parts, F.xxhash64("image_id")).sortWithinPartitions("image_id", "seq")
    kind = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, image = None, None
        for b in batches:
            out = []
            for r in _records(b):
                if state is None or r["image_id"] != image:
                    if state is not None:
                        out += end(state, image)
                    state, image = begin(r), r["image_id"]
                out += feed(state, r)
            yield pa.RecordBatch.from_pylist(out, kind)
        if state is not None:
            yield pa.RecordBatch.from_pylist(list(end(state, image)), kind)

    return dealt.mapInArrow(run, schema)


def replay(events: DataFrame, images: DataFrame) -> DataFrame:
    """Edit events and image sizes -> the stamps that remain, in order."""
    rows = events.join(images.select("image_id", "width", "height"), "image_id")

    def feed(own: Editor, e: dict) -> list[dict]:
        own.apply(e["op"], e)
        return []

    return in_turn(rows, STAMPS, lambda e: Editor(float(e["width"]), float(e["height"])), feed, lambda own, image: [{"image_id": image, "stamp_ix": i, **s} for i, s in enumerate(own.stamps)])


def painted(stamps: DataFrame) -> DataFrame:
    """Stamps with the rectangle that is painted: an automatic one's own, a hand-drawn one's widened."""
    r = manual_rect(F.struct("x", "y", "w", "h"))
    by_hand = F.col("kind") == "manual"
    rows = stamps.withColumn("_r", r)
    return rows.withColumns({k: F.when(by_hand, F.col(f"_r.{k}")).otherwise(F.col(k)) for k in "xywh"}).drop("_r")


def canvas_point(client_x: Column, client_y: Column, left: Column, top: Column, scale_x: Column, scale_y: Column, touch: Column) -> Column:
    """Pointer position in image pixels; a finger draws 40 display pixels above where it touches."""
    lift = F.when(touch, F.lit(40.0)).otherwise(F.lit(0.0))
    return F.struct(((client_x - left) / scale_x).alias("x"), ((client_y - top - lift) / scale_y).alias("y"))


def pointer_summary(pointers: Column) -> Column:
    """Distance of the first two of an array of points, and the centre of all."""
    a, b = F.get(pointers, F.lit(0)), F.get(pointers, F.lit(1))
    mean = lambda k: F.aggregate(F.transform(pointers, lambda p: p[k]), F.lit(0.0), lambda x, y: x + y) / F.size(pointers)
    return F.struct(F.coalesce(F.hypot(a["x"] - b["x"], a["y"] - b["y"]), F.lit(0.0)).alias("distance"), mean("x").alias("x"), mean("y").alias("y"))
