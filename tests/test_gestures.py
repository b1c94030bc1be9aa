"""Pointers to edits: what sessions make of them, in one batch and as a stream that is split, repeated and out of order."""

import random

import pytest

from inkveil.functions import schemas
from inkveil.functions.config import CONFIG
from inkveil.operators import edits, gestures
from inkveil.streaming import intake, sessions

SIZE = (700, 400)


def pointer(seq, kind, x=0.0, y=0.0, pid=1, image="i", touch=False, mode="free", stamping=False, buttons=1, scale=1.0, style=None):
    return (image, seq, kind, pid, "touch" if touch else "mouse", pid == 1, buttons, float(x), float(y), 0.0, 0.0, scale, scale, 1.0, mode, stamping, style)


def images(spark, ids):
    return spark.createDataFrame([(i, *SIZE) for i in ids], "image_id string, width int, height int")


def edits_of(spark, rows):
    got = gestures.edit_events(spark.createDataFrame(rows, schemas.POINTERS), images(spark, {r[0] for r in rows}))
    return [(r.seq, r.op, r.stamp_ix, r.x, r.y, r.w, r.h, r.dx, r.dy, r.handle) for r in got.orderBy("image_id", "seq").collect()]


def numbered(*events):
    return [pointer(i, *e[:3], **(e[3] if len(e) > 3 else {})) for i, e in enumerate(events)]


ADD = (0, "add", None, 100.0, 100.0, 200.0, 100.0, None, None, None)


def test_draw_trace_place_and_fingers(spark):
    stamp = {"stamping": True}
    rows = numbered(
        ("down", 100, 100), ("move", 200, 150), ("up", 300, 200),  # a box
        ("down", 10, 10, {"mode": "trace"}), ("up", 60, 300, {"mode": "trace"}),  # a band at the image's top
        ("down", 500, 300, {**stamp}), ("up", 503, 305, {**stamp}),  # a copy of the band
        ("down", 600, 20, {**stamp}), ("up", 600, 32, {**stamp}),  # moved too far
        ("down", 600, 200, {"touch": True}), ("up", 640, 250, {"touch": True}),  # a finger draws 40 above
        ("down", 400, 390), ("up", 403, 395),  # too small
    )
    assert edits_of(spark, rows) == [
        (4, *ADD[1:]), (8, "add", None, 10.0, 0.0, 50.0, 32.0, None, None, None), (12, "place", None, 503.0, 305.0, None, None, None, None, None),
        (20, "add", None, 600.0, 160.0, 40.0, 50.0, None, None, None),
    ]


def test_move_resize_and_ends(spark):
    box = [("down", 100, 100), ("up", 300, 200)]
    move = lambda k, dx, dy, ix=0: (k, "move", ix, None, None, None, None, dx, dy, None)
    cases = {
        "moved": ([("down", 200, 150), ("move", 210, 150), ("up", 220, 155)], [move(8, 20.0, 5.0)]),
        "held and lifted in place": ([("down", 200, 150), ("up", 200, 150)], [move(6, 0.0, 0.0)]),
        "a corner": ([("down", 305, 195), ("up", 315, 190)], [(6, "resize", 0, None, None, None, None, 10.0, -5.0, "se")]),
        "cancelled after a move": ([("down", 200, 150), ("move", 190, 150), ("cancel", 100, 100)], [move(8, -10.0, 0.0)]),
        "cancelled at once": ([("down", 200, 150), ("cancel", 100, 100)], []),
        "a second finger ends it": ([("down", 200, 150), ("move", 190, 150), ("down", 9, 9, {"pid": 2}), ("move", 0, 0), ("up", 1, 1), ("up", 9, 9, {"pid": 2})], [move(8, -10.0, 0.0)]),
        "let go outside": ([("down", 200, 150), ("move", 190, 150), ("move", 0, 0, {"buttons": 0}), ("up", 5, 5)], [move(8, -10.0, 0.0)]),
        "lost": ([("down", 200, 150), ("move", 190, 150), ("lost", 0, 0), ("up", 5, 5)], [move(8, -10.0, 0.0)]),
        "blocked until all are lifted": ([("down", 600, 300), ("down", 9, 9, {"pid": 2}), ("up", 650, 350), ("down", 600, 300), ("up", 650, 350), ("up", 9, 9, {"pid": 2})], []),
        "twice on it": ([("down", 200, 150), ("up", 200, 150), ("double", 200, 150)], [move(6, 0.0, 0.0), (8, "delete", 0, *[None] * 7)]),
        "twice elsewhere": ([("down", 200, 150), ("up", 200, 150), ("double", 600, 350)], [move(6, 0.0, 0.0)]),
        "the delete button": ([("down", 200, 150), ("move", 205, 150), ("delete",)], [move(8, 5.0, 0.0), (9, "delete", 0, *[None] * 7)]),
        "delete without a choice": ([("delete",)], []),
        "undo, then nothing is chosen": ([("down", 200, 150), ("up", 200, 150), ("undo",), ("delete",)], [move(6, 0.0, 0.0), (8, "undo", *[None] * 8)]),
        "reset": ([("reset",), ("undo",)], [(4, "reset", *[None] * 8)]),
        "a new touch clears what is stale": ([("down", 9, 9, {"pid": 2, "touch": True}), ("down", 200, 150, {"touch": True}), ("up", 210, 150, {"touch": True})], [move(8, 10.0, 0.0)]),
        "an unknown kind": ([("wheel", 1, 1)], []),
    }
    rows = []
    for name, (events, _) in cases.items():
        rows += [(name, *r[1:]) for r in numbered(*[e if len(e) > 1 else (e[0], 0, 0) for e in box + events])]
    got = gestures.edit_events(spark.createDataFrame(rows, schemas.POINTERS), images(spark, cases)).collect()
    for name, (_, want) in cases.items():
        own = sorted((r.seq, r.op, r.stamp_ix, r.x, r.y, r.w, r.h, r.dx, r.dy, r.handle) for r in got if r.image_id == name)
        assert own == [(2, *ADD[1:]), *want], name


def test_corners_are_grabbed_within_display_pixels(spark):
    rows = numbered(("down", 50, 50, {"scale": 0.5}), ("up", 150, 100, {"scale": 0.5}), ("down", 31, 49, {"scale": 0.5}), ("up", 26, 49, {"scale": 0.5}))
    assert [(o, h, dx) for _, o, *_, dx, _, h in edits_of(spark, rows)] == [("add", None, None), ("resize", "nw", -10.0)]


def random_pointers(rng, n_images, n):
    rows = []
    for i in range(n_images):
        seq = 0
        while seq < n:
            kind = rng.choice(["drag"] * 8 + ["tap", "two", "undo", "undo", "double", "delete", "cancel", "reset"])
            x, y, opts = rng.randrange(700), rng.randrange(400), {"touch": rng.random() < 0.4, "mode": rng.choice(["free", "trace"]), "stamping": rng.random() < 0.3, "style": rng.choice([None, ("blur", "#123456")])}
            if kind in ("undo", "double", "delete") or (kind == "reset" and rng.random() < 0.2):
                rows.append(pointer(seq, kind, x, y, image=f"i{i}", **opts))
                seq += 1
                continue
            steps = [("down", x, y, 1)]
            if kind == "two":
                steps += [("down", x + 5, y, 2), ("up", x, y, rng.choice([1, 2])), ("lost", x, y, 1), ("up", x, y, 2)]
            for _ in range(rng.randrange(4) if kind != "tap" else 0):
                x, y = x + rng.randrange(-80, 80), y + rng.randrange(-80, 80)
                steps.append(("move", x, y, 1))
            steps += [("cancel" if kind == "cancel" else "up", x, y, 1), ("lost", x, y, 1)]
            for k, a, b, pid in steps:
                rows.append(pointer(seq, k, a, b, pid, f"i{i}", buttons=int(rng.random() < 0.95), **opts))
                seq += 1
    return rows


def stamps_of(df):
    return sorted((r.image_id, r.stamp_ix, r.x, r.y, r.w, r.h, r.kind, r.style["mode"]) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_batch(spark, tmp_path, seed):
    """Events in files that split gestures, come out of order, twice, and over two runs of the query."""
    rng = random.Random(seed)
    rows = random_pointers(rng, 12, 120)
    sizes = images(spark, {r[0] for r in rows})
    want = stamps_of(edits.replay(gestures.edit_events(spark.createDataFrame(rows, schemas.POINTERS), sizes), sizes))
    assert len(want) > 20
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    parts = [[] for _ in range(8)]
    for r in rows:
        parts[rng.randrange(8)].append(r)
        if rng.random() < 0.2:
            parts[rng.randrange(8)].append(r)
    for half in (parts[:5], parts[5:]):
        for p in half:
            spark.createDataFrame(p, schemas.POINTERS).coalesce(1).write.mode("append").parquet(source)
        intake.pointer_stream(spark, source, sizes, out, check, 2).awaitTermination(120)
    assert stamps_of(sessions.latest(spark.read.parquet(out))) == want


def test_open_edit_is_shown(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    rows = numbered(("down", 100, 100), ("up", 300, 200), ("down", 200, 150), ("move", 210, 155))
    spark.createDataFrame(rows, schemas.POINTERS).write.parquet(source)
    intake.pointer_stream(spark, source, images(spark, ["i"]), out, check).awaitTermination(60)
    assert stamps_of(sessions.latest(spark.read.parquet(out))) == [("i", 0, 110.0, 105.0, 200.0, 100.0, "manual", "black")]


def test_edit_stream_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for i in range(10):
        for seq in sorted(rng.sample(range(400), 90)):
            op = rng.choice(["add"] * 4 + ["move", "resize", "place", "delete", "undo", "ocr"] + ["detect"] * (rng.random() < 0.1))
            d = lambda m: float(rng.randrange(m))
            rows.append((f"i{i}", seq, op, rng.randrange(4), d(600), d(300), d(90), d(60), d(90) - 45, d(60) - 30, rng.choice(["nw", "ne", "sw", "se"]), None))
    sizes = images(spark, {r[0] for r in rows})
    want = stamps_of(edits.replay(spark.createDataFrame(rows, schemas.EDIT_EVENTS), sizes))
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    rows += rng.sample(rows, 100)
    rng.shuffle(rows)
    for k in range(4):
        spark.createDataFrame(rows[k::4], schemas.EDIT_EVENTS).coalesce(1).write.mode("append").parquet(source)
    intake.edit_stream(spark, source, sizes, out, check, 1).awaitTermination(120)
    assert stamps_of(sessions.latest(spark.read.parquet(out))) == want and len(want) > 20


def test_undo_steps_are_limited_in_sessions():
    session = gestures.Session(edits.Editor(*map(float, SIZE)))
    base = {"pointer_id": 1, "pointer_type": "mouse", "is_primary": True, "buttons": 1, "radius": 0.0, "band": None, "stamping": False, "style": None}
    for i in range(60):
        for kind, d in (("down", 0), ("up", 5)):
            at = {"x": 10.0 * i + d, "y": 6.0 * i + d}
            session.feed({**base, "kind": kind, **at, "raw_x": at["x"], "raw_y": at["y"], "draw_x": at["x"], "draw_y": at["y"]})
    for _ in range(70):
        session.feed({**base, "kind": "undo"})
    assert len(session.editor.stamps) == 60 - CONFIG.undo_limit


def test_logs_are_replayed_on_all_cores_without_a_call_each(spark):
    """3,000 logs of two rows, out of order, one row repeated."""
    from inkveil.functions import schemas
    from inkveil.operators import edits

    log = [(str(i), q, "add", None, 5.0 * q, 1.0, 10.0 + i % 7, 8.0, None, None, None, None) for i in range(3000) for q in (2, 1)]
    images = spark.createDataFrame([(str(i), 400, 200) for i in range(3000)], "image_id string, width int, height int")
    got = edits.replay(spark.createDataFrame(log, schemas.EDIT_EVENTS), images)
    assert "FlatMapGroups" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted((r["image_id"], r["stamp_ix"], r["x"], r["w"]) for r in got.collect()) == sorted((str(i), k, 5.0 * (k + 1), 10.0 + i % 7) for i in range(3000) for k in (0, 1))


def test_waiting_events_cost_no_call_each():
    """A hundred events that come before their turn are kept by one call, and taken by one more."""
    from inkveil.streaming import sessions

    calls = []

    class State:
        def __init__(self):
            self.held = []

        def exists(self):
            return bool(self.held)

        def get(self):
            calls.append("get")
            return self.held if not self.held or isinstance(self.held, list) else tuple(self.held)

        def put(self, rows):
            calls.append("put")
            self.held = list(rows)

        def update(self, row):
            self.held = tuple(row)

        def clear(self):
            self.held = []

    class Handle:
        getValueState = getListState = lambda self, *a: State()

    s = sessions.Sessions()
    s.init(Handle())
    row = lambda seq: {n: None for n in sessions.EVENT_NAMES} | {"seq": seq, "kind": "move", "width": 10, "height": 10}
    assert list(s.handleInputRows(("i",), iter(row(q) for q in range(100, 0, -1)), None)) == []
    assert len(calls) <= 8 and len(s.waiting.held) == 100
    assert [r["taken"] for r in s.handleInputRows(("i",), iter([row(0)]), None)] == [101]
    assert len(calls) <= 16 and not s.waiting.held


def test_a_batch_hands_over_bundles_of_an_images_events(spark, monkeypatch):
    """One row an image instead of one an event; with little room several, with the same events."""
    import pickle

    rows = random_pointers(random.Random(3), 5, 60)
    sized = gestures.located(spark.createDataFrame(rows, schemas.POINTERS)).join(images(spark, {r[0] for r in rows}), "image_id")
    number = lambda v: v if v == v else None
    want = sorted((r["image_id"], r["seq"], r["kind"], r["raw_x"], r["band"], r["style"] and r["style"]["mode"]) for r in sized.collect())
    for room, least, most in ((1000, 5, 5), (40, 6, 100)):
        monkeypatch.setattr(sessions, "HELD", room)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
        try:
            got = sessions.bundles(sized).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert least <= len(got) <= most and {(r["width"], r["height"]) for r in got} == {SIZE}
        events = [(r["image_id"], dict(zip(sessions.EVENT_NAMES, e))) for r in got for e in pickle.loads(r["events"])]
        assert sorted((i, e["seq"], e["kind"], e["raw_x"], number(e["band"]), e["style"] and e["style"]["mode"]) for i, e in events) == want


def test_a_session_is_kept_by_one_call_and_its_stamps_once():
    """60 boxes, half of them moved, 50 undo steps: three accesses to the state, and no copy of a stamp for each step."""
    calls = []

    class State:
        held = None

        def __getattr__(self, name):
            def call(*value):
                calls.append(name)
                if name in ("put", "update"):
                    self.held = value[0]
                return self.held if name != "get" or self.held is not None else []

            return call

    class Handle:
        getValueState = getListState = lambda self, *a: State()

    s = sessions.Sessions()
    s.init(Handle())
    base = {n: None for n in sessions.EVENT_NAMES} | {"pointer_id": 1, "pointer_type": "mouse", "is_primary": True, "buttons": 1, "radius": 0.0, "stamping": False, "width": 700, "height": 400}
    at = lambda x, y: dict.fromkeys(("x", "raw_x", "draw_x"), x) | dict.fromkeys(("y", "raw_y", "draw_y"), y)
    drag = lambda x, y, d: [base | {"kind": "down"} | at(x, y), base | {"kind": "up"} | at(x + d, y + d)]
    rows = sum([drag(10.0 * i, 6.0 * i, 5.0) for i in range(60)] + [drag(10.0 * i + 2, 6.0 * i + 2, 1.0) for i in range(30)], [])
    rows = [r | {"seq": n} for n, r in enumerate(rows)]
    shown = list(s.handleInputRows(("i",), iter(rows), None))
    assert len(calls) <= 4 and shown[0]["taken"] == 180 and len(shown) == 60 and shown[0]["x"] == 1.0
    taken, session = s.open.held
    assert taken == 180 and len(session) < 20_000
    back = sessions._opened(700.0, 400.0, session)
    assert len(back.editor.undo_steps) == CONFIG.undo_limit and back.editor.undo_steps[-1][3] is back.editor.stamps[3]
