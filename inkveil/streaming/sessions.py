"""Editing sessions as a stateful stream: pointer events in, the stamps of the images they touch out.

Each image has a state of its own (``transformWithState``): the pointers that are down, what they hold, the stamps, the
undo steps, and events that came before their turn. A batch costs what its images' states and its events cost,
not what was done to them before. ``seq`` counts an image's events from 0 without gaps: an event waits in the state until
those before it are there, and one that was taken before is a repetition and changes nothing, so files may come
split, repeated and out of order. ``EditLogs`` does the same for edit events, whose ``seq`` may have gaps.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.schemas import STYLE
from ..operators.edits import Editor, columns
from ..operators.gestures import EVENT_NAMES, Hold, Session, event, located, style

STAMP = f"x double, y double, w double, h double, kind string, style {STYLE}"
_STAMP_STRUCT = f"struct<x:double,y:double,w:double,h:double,kind:string,style:{STYLE}>"
EDIT = f"op string, stamp_ix int, x double, y double, w double, h double, dx double, dy double, handle string, style {STYLE}"
EDIT_NAMES = ["op", "stamp_ix", "x", "y", "w", "h", "dx", "dy", "handle", "style"]
#: Events of a batch that a task holds to put those of an image into one row.
HELD = 100_000
#: What a batch gives: of each image that it touches, how many events were taken, and all stamps; an image without any has one row without stamp_ix.
SESSION_STAMPS = f"image_id string, taken long, stamp_ix int, {STAMP}"


def _plain(stamp: tuple) -> dict:
    """A stored stamp; what a state gives back is read by position."""
    return {**dict(zip(("x", "y", "w", "h", "kind"), stamp)), "style": style(stamp[5])}


def _row(stamp: dict) -> tuple:
    style = stamp["style"]
    return (*(float(stamp[k]) for k in "xywh"), stamp["kind"], style and (style["mode"], style["color"]))


def _put(state, rows: list[tuple]) -> None:
    state.put(rows) if rows else state.clear()


def _opened(width: float, height: float, kept: bytes | None) -> Session:
    session = Session(Editor(width, height))
    if kept is not None:
        session.blocked, session.chosen, hold, session.down, session.editor.stamps, session.editor.undo_steps = pickle.loads(kept)
        session.hold = hold and Hold(*hold)
    return session


def _closed(session: Session) -> bytes:
    """What ``_opened`` takes. Undo steps share their stamps, which are written once."""
    hold = session.hold and tuple(vars(session.hold).values())
    return pickle.dumps((session.blocked, session.chosen, hold, session.down, session.editor.stamps, session.editor.undo_steps))


def _shown(image_id: str, taken: int, stamps: list[dict]) -> Iterator[Row]:
    for s in [(i, *_row(s)) for i, s in enumerate(stamps)] or [(None,) * 7]:
        yield Row(image_id=image_id, taken=taken, stamp_ix=s[0], x=s[1], y=s[2], w=s[3], h=s[4], kind=s[5], style=s[6])


class Sessions(StatefulProcessor):
    """The session of each image between batches; a row is an event.

    Every access to the state is a call to the JVM, and each field of a typed row is converted on both sides. So an image
    has one value for its session and one list for its events that wait, both pickled from plain lists, tuples and dictionaries.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "taken long, session binary")
        self.waiting = handle.getListState("waiting", "events binary")

    def _events(self, row: Row) -> list[tuple]:
        return [tuple(row[n] for n in EVENT_NAMES)]

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        taken, kept = self.open.get() or (0, None)
        parts = [pickle.loads(p[0]) for p in self.waiting.get()]
        early = {e[0] for p in parts for e in p}
        for r in rows:
            width, height = float(r["width"]), float(r["height"])
            parts.append(self._events(r))
        ready = {e[0]: e for p in parts for e in p if e[0] >= taken}
        session = None
        while taken in ready:
            session = session or _opened(width, height, kept)
            session.feed(event(dict(zip(EVENT_NAMES, ready.pop(taken)))))
            taken += 1
        if ready.keys() != early:
            later = [[ready.pop(e[0]) for e in p if e[0] in ready] for p in parts]
            _put(self.waiting, [(pickle.dumps(p),) for p in later if p])
        if session is not None:
            self.open.update((taken, _closed(session)))
            yield from _shown(key[0], taken, session.shown())

    def close(self) -> None:
        pass


class BundledSessions(Sessions):
    """The same; a row is what a batch has of an image's events, as ``bundles`` makes them."""

    def _events(self, row: Row) -> list[tuple]:
        return pickle.loads(row["events"])


class EditLogs(StatefulProcessor):
    """The stamps of each image after its edit events, its log, and the last event taken.

    Events may come in any order and repeatedly: one that belongs before others makes the image's own log, and
    no other's, be replayed.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq long")
        self.stamps = handle.getListState("stamps", STAMP)
        self.undo = handle.getListState("undo", f"stamps array<{_STAMP_STRUCT}>")
        self.log = handle.getMapState("log", "seq long", EDIT)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        width = height = None
        fresh = {}
        for r in rows:
            width, height = float(r["width"]), float(r["height"])
            if r["seq"] not in fresh and not self.log.containsKey((r["seq"],)):
                fresh[r["seq"]] = e = tuple(r[n] for n in EDIT_NAMES)
                self.log.updateValue((r["seq"],), e)
        if not fresh:
            return
        last = self.last.get()[0] if self.last.exists() else None
        editor = Editor(width, height)
        if last is None or min(fresh) > last:
            editor.stamps = [_plain(s) for s in self.stamps.get()]
            editor.undo_steps = [[_plain(s) for s in step[0]] for step in self.undo.get()]
        else:
            fresh = {k[0]: tuple(e) for k, e in self.log.iterator()}
        for _, e in sorted(fresh.items()):
            e = dict(zip(EDIT_NAMES, e))
            editor.apply(e["op"], e | {"style": style(e["style"])})
        last = max(fresh)
        self.last.update((last,))
        _put(self.stamps, [_row(s) for s in editor.stamps])
        _put(self.undo, [([_row(s) for s in step],) for step in editor.undo_steps])
        yield from _shown(key[0], last, editor.stamps)

    def close(self) -> None:
        pass


def edit_stamps(events: DataFrame, images: DataFrame) -> DataFrame:
    """A stream of edit events (``schemas.EDIT_EVENTS``) and static image sizes -> ``SESSION_STAMPS``, ``taken`` being the last ``seq``."""
    rows = events.join(images.select("image_id", "width", "height"), "image_id")
    return rows.groupBy("image_id").transformWithState(EditLogs(), SESSION_STAMPS, "Update", "None")


def bundles(rows: DataFrame) -> DataFrame:
    """Rows of ``EVENT`` with their image's size -> fewer rows: of up to ``HELD`` events that a task reads, those of an image in one.

    The state operator reads its rows cell by cell, and a call for each group of a batch would cost more than that.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = {}, 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"image_id": i, "width": w, "height": h, "events": pickle.dumps(own)} for i, (w, h, own) in held.items()], kind)

        for b in batches:
            for image, width, height, *e in zip(*columns(b.select(["image_id", "width", "height", *EVENT_NAMES]))):
                held.setdefault(image, (width, height, []))[2].append(tuple(e))
            n += b.num_rows
            if n >= HELD:
                yield made()
                held, n = {}, 0
        if held:
            yield made()

    kind = pa.schema([("image_id", pa.string()), ("width", pa.float64()), ("height", pa.float64()), ("events", pa.binary())])
    sized = rows.withColumns({k: F.col(k).cast("double") for k in ("width", "height")})
    return sized.repartition("image_id").mapInArrow(pack, "image_id string, width double, height double, events binary")


def session_stamps(pointers: DataFrame, images: DataFrame) -> DataFrame:
    """A stream of pointer events (``schemas.POINTERS``) and static image sizes -> ``SESSION_STAMPS``, in update mode."""
    rows = located(pointers).join(images.select("image_id", "width", "height"), "image_id")
    return bundles(rows).groupBy("image_id").transformWithState(BundledSessions(), SESSION_STAMPS, "Update", "None")


def write_batches(stamps: DataFrame, out_path: str, checkpoint: str):
    """Starts a query that writes ``SESSION_STAMPS`` to one Parquet folder a batch; a repeated batch overwrites its own.

    The state store is RocksDB's, which ``transformWithState`` needs; the session's setting is left as it was.
    """
    conf, key = stamps.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key, None)
    conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        writer = stamps.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
        return writer.foreachBatch(lambda rows, number: rows.write.mode("overwrite").parquet(f"{out_path}/batch={number}")).start()
    finally:
        conf.set(key, before) if before else conf.unset(key)


def latest(stamps: DataFrame) -> DataFrame:
    """Rows of ``SESSION_STAMPS`` of all batches -> the stamps of each image after its last events."""
    newest = stamps.groupBy("image_id").agg(F.max("taken").alias("taken"))
    return stamps.join(newest, ["image_id", "taken"]).filter("stamp_ix IS NOT NULL").drop("taken").dropDuplicates(["image_id", "stamp_ix"])
