"""Pointers to edits: what a person does to an image with fingers and a mouse, as edit events.

A ``Session`` is what is open on one image: the pointers that are down, what they hold (a box being drawn, a copy being
placed, a stamp being moved or resized), the chosen stamp, and the ``Editor`` with stamps and undo steps. What an
event means depends on where the stamps are by then, so an image's events are fed in order; images are independent.
``edit_events`` feeds a table of pointer events at once, ``streaming.sessions`` a stream of them, both this session.

An edit becomes one event when its hold ends: where the pointer was lifted, or, if the hold is broken off (a second
pointer, a cancelled or lost one, a button let go outside), where it was last moved to, if it was. Until then ``shown``
has it. While two or more pointers are down, and until all are lifted, nothing is drawn or edited.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import hypot, isnan

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.config import CONFIG
from ..functions.schemas import EDIT_EVENTS
from .edits import Editor, canvas_point, drawn, hit_test, in_turn, trace_height

#: The kinds of pointer events; the last three come from buttons. Others do nothing.
KINDS = ("down", "move", "up", "lost", "cancel", "double", "delete", "undo", "reset")
#: Columns of a pointer event that a session reads, as ``located`` makes them.
EVENT = "seq long, kind string, pointer_id int, pointer_type string, is_primary boolean, buttons int, x double, y double, raw_x double, raw_y double, draw_x double, draw_y double, radius double, band double, stamping boolean, style struct<mode:string,color:string>"
EVENT_NAMES = [c.strip().split()[0] for c in EVENT.split(", ") if not c.startswith("color")]


@dataclass
class Hold:
    """What the only pointer that is down is doing."""

    what: str  # draw, place, move or resize
    x: float
    y: float
    at: int | None = None  # the stamp that is edited
    handle: str | None = None
    dx: float | None = None  # how far it was moved, if it was
    dy: float | None = None
    band: float | None = None  # height of a traced band


@dataclass
class Session:
    editor: Editor
    down: dict[int, tuple[float, float]] = field(default_factory=dict)
    hold: Hold | None = None
    blocked: bool = False
    chosen: int | None = None

    def feed(self, e: dict) -> list[dict]:
        """The edits that an event completes, already applied."""
        handler = getattr(self, f"_{e['kind']}", None) if e["kind"] in KINDS else None
        return handler(e) if handler else []

    def shown(self) -> list[dict]:
        """The stamps, with an edit that is still open."""
        h = self.hold
        if h is None or h.what not in ("move", "resize") or h.dx is None:
            return self.editor.stamps
        preview = Editor(self.editor.width, self.editor.height, self.editor.stamps)
        preview.apply(h.what, vars(h) | {"stamp_ix": h.at})
        return preview.stamps

    def _apply(self, e: dict, op: str, **what) -> list[dict]:
        what = {"op": op, "style": e["style"], **what}
        self.editor.apply(op, what)
        return [what]

    def _release(self, e: dict, x: float | None = None, y: float | None = None) -> list[dict]:
        """Ends a hold; an edit is completed at (x, y), or where it was last moved to."""
        h, self.hold = self.hold, None
        if h is None or h.what not in ("move", "resize"):
            return []
        dx, dy = (h.dx, h.dy) if x is None else (x - h.x, y - h.y)
        return [] if dx is None else self._apply(e, h.what, stamp_ix=h.at, handle=h.handle, dx=dx, dy=dy)

    def _down(self, e: dict) -> list[dict]:
        out = []
        if e["pointer_type"] == "touch" and e["is_primary"]:  # the first finger of a touch: what is left of others is stale
            self.down.clear()
            out, self.blocked = self._release(e), False
        self.down[e["pointer_id"]] = (e["x"], e["y"])
        if len(self.down) > 1:
            self.blocked = True
            return out + self._release(e)
        stamps = self.editor.stamps
        hit = hit_test(e["raw_x"], e["raw_y"], stamps, e["radius"])
        self.chosen = hit[0] if hit else None
        if hit:
            self.hold = Hold(hit[1], e["raw_x"], e["raw_y"], hit[0], hit[2])
        elif e["stamping"] and any(s["kind"] == "manual" for s in stamps):
            self.hold = Hold("place", e["x"], e["y"])
        else:
            self.hold = Hold("draw", e["draw_x"], e["draw_y"], band=e["band"])
        return out

    def _move(self, e: dict) -> list[dict]:
        editing = self.hold is not None and self.hold.what in ("move", "resize")
        if editing and e["pointer_type"] == "mouse" and e["buttons"] == 0:  # the button was let go outside
            self.down.pop(e["pointer_id"], None)
            return self._release(e)
        if e["pointer_id"] in self.down:
            self.down[e["pointer_id"]] = (e["x"], e["y"])
        if editing and not self.blocked:
            self.hold.dx, self.hold.dy = e["raw_x"] - self.hold.x, e["raw_y"] - self.hold.y
        return []

    def _up(self, e: dict) -> list[dict]:
        self.down.pop(e["pointer_id"], None)
        if self.blocked or self.down:
            self.blocked = self.blocked and bool(self.down)
            return self._release(e)
        h = self.hold
        if h is None:
            return []
        out = self._release(e, e["raw_x"], e["raw_y"])
        if h.what == "place" and hypot(e["x"] - h.x, e["y"] - h.y) < CONFIG.tap_reach:
            out = self._apply(e, "place", x=e["raw_x"], y=e["raw_y"])
        elif h.what == "draw":
            box = drawn(h.x, h.y, e["draw_x"], e["draw_y"], h.band, self.editor.height)
            out = self._apply(e, "add", **box) if min(box["w"], box["h"]) >= CONFIG.min_manual_size else []
        return out

    def _lost(self, e: dict) -> list[dict]:
        self.down.pop(e["pointer_id"], None)
        if e["pointer_type"] == "touch":
            self.blocked = self.blocked and bool(self.down)
            return []
        editing = self.hold is not None and self.hold.what in ("move", "resize")
        return self._release(e) if editing and e["pointer_type"] == "mouse" else []

    def _cancel(self, e: dict) -> list[dict]:
        self.down.pop(e["pointer_id"], None)
        self.blocked = self.blocked and bool(self.down)
        return self._release(e)

    def _remove(self, e: dict) -> list[dict]:
        at, self.chosen = self.chosen, None
        return self._apply(e, "delete", stamp_ix=at) if at is not None and at < len(self.editor.stamps) else []

    def _double(self, e: dict) -> list[dict]:
        """Twice on the chosen stamp deletes it."""
        out = self._release(e)
        hit = hit_test(e["raw_x"], e["raw_y"], self.editor.stamps, e["radius"])
        return out + (self._remove(e) if hit and hit[0] == self.chosen else [])

    def _delete(self, e: dict) -> list[dict]:
        out = self._release(e)
        self.down.clear()
        self.blocked = False
        return out + self._remove(e)

    def _undo(self, e: dict) -> list[dict]:
        out = self._release(e)
        if not self.editor.undo_steps:
            return out
        self.chosen = None
        return out + self._apply(e, "undo")

    def _reset(self, e: dict) -> list[dict]:
        self.down, self.hold, self.blocked, self.chosen = {}, None, False, None
        return self._apply(e, "reset")


def located(pointers: DataFrame) -> DataFrame:
    """Pointer events (``schemas.POINTERS``) -> with the points of the image that they mean, and what their size is there.

    (raw_x, raw_y) is where the pointer is, (draw_x, draw_y) where it draws: a finger draws above where it touches.
    radius: how far a corner is grabbed from; band: height of a traced band, null unless the event's mode traces.
    """
    where = lambda touch: canvas_point(F.col("x"), F.col("y"), F.col("left"), F.col("top"), F.col("scale_x"), F.col("scale_y"), touch)
    rows = pointers.withColumns({"_raw": where(F.lit(False)), "_draw": where(F.coalesce(F.col("pointer_type") == "touch", F.lit(False)))})
    band = F.greatest(F.lit(32.0), F.least(F.lit(44.0), 32 / F.greatest(F.lit(0.0001), F.col("base_scale"))))
    return rows.withColumns(
        {
            "raw_x": F.col("_raw.x"), "raw_y": F.col("_raw.y"), "draw_x": F.col("_draw.x"), "draw_y": F.col("_draw.y"),
            "radius": CONFIG.hit_radius / F.greatest(F.lit(0.0001), F.least("scale_x", "scale_y")),
            "band": F.when(F.col("mode") == "trace", band), "stamping": F.coalesce("stamping", F.lit(False)),
        }
    ).select("image_id", *EVENT_NAMES)


def style(value: dict | tuple | None) -> dict | None:
    """A style as a dictionary, however Spark hands it over."""
    return value if value is None or isinstance(value, dict) else dict(zip(("mode", "color"), value))


def event(row: dict) -> dict:
    """A row of ``EVENT`` as a session takes it."""
    return row | {"style": style(row["style"]), "band": None if row["band"] is None or isnan(row["band"]) else row["band"]}


def edit_events(pointers: DataFrame, images: DataFrame) -> DataFrame:
    """Pointer events and image sizes -> edit events, for ``edits.replay``.

    Each image's events are fed to a session of its own, in the order of ``seq``. A repeated
    ``seq`` is a repeated event and counts once. An event that ends an edit and does something more becomes two, so
    an edit's ``seq`` is twice its event's, and one more for the second.
    """
    rows = located(pointers).join(images.select("image_id", "width", "height"), "image_id")

    def begin(e: dict) -> list:
        return [Session(Editor(float(e["width"]), float(e["height"]))), None]

    def feed(own: list, e: dict) -> list[dict]:
        if e["seq"] == own[1]:
            return []
        own[1] = e["seq"]
        return [{"image_id": e["image_id"], "seq": 2 * e["seq"] + k, **made} for k, made in enumerate(own[0].feed(event(e)))]

    return in_turn(rows, EDIT_EVENTS, begin, feed, lambda own, image: [])
