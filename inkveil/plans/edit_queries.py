"""Manual edits as queries: replay of event logs, gestures in a batch and as a stream, and their SQL.

The SQL replays each image's log by a recursive query whose rows are (image, step, stamps, undo steps, chosen stamp).
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import schemas
from ..functions.plan import shared_folder
from ..operators import edits, gestures
from ..streaming import intake, sessions

HANDLES = ("nw", "ne", "sw", "se")


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _edits(spark, sf_dir):
    pick = lambda m: (F.col("event_id") * 7919 % m)
    op = F.get(F.array(*[F.lit(o) for o in ("add", "add", "place", "move", "resize", "undo", "delete", "add")]), pick(8).cast("int"))
    handle = F.get(F.array(*[F.lit(h) for h in HANDLES]), pick(4).cast("int"))
    d = lambda c: c.cast("double")
    return _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("image_id"), F.col("event_id").alias("seq"), op.alias("op"), pick(3).cast("int").alias("stamp_ix"), d(pick(300)).alias("x"), d(pick(170)).alias("y"), d(2 + pick(50)).alias("w"), d(2 + pick(40)).alias("h"), d(pick(61) - 30).alias("dx"), d(pick(53) - 26).alias("dy"), handle.alias("handle"), F.lit(None).cast(schemas.STYLE).alias("style"))


def _shown(stamps):
    return stamps.select("image_id", F.col("stamp_ix").cast("long").alias("stamp_ix"), "x", "y", "w", "h", "kind")


def edit_replay(spark, sf_dir):
    log = _edits(spark, sf_dir)
    images = log.select("image_id").distinct().select("image_id", F.lit(400).alias("width"), F.lit(200).alias("height"))
    return _shown(edits.replay(log, images))


def _pointers(spark, sf_dir):
    """Four pointer events for each row of ``events``: a drag, a drag that is cancelled, two fingers, or a button."""
    p = F.col("event_id") * 7919
    rows = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("image_id"), p.alias("p"), (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("n"))
    tap = F.col("p") % 16
    dx = F.when(tap.isin(8, 9), F.col("p") % 19 - 9).otherwise(F.col("p") % 121 - 60)
    dy = F.when(tap.isin(8, 9), F.col("p") % 7 - 3).otherwise(F.col("p") % 87 - 43)
    step = lambda j, kind, part=0, pid=1: F.struct(F.lit(j).alias("j"), F.lit(kind).alias("kind"), F.lit(part).alias("part"), F.lit(pid).alias("pointer_id"))
    drag = lambda end: F.array(step(0, "down"), step(1, "move", 1), step(2, "move", 2), step(3, end, 2))
    button = lambda kind: F.array(step(0, kind), *[step(j, "move") for j in (1, 2, 3)])
    two = F.array(step(0, "down"), step(1, "down", 0, 2), step(2, "up"), step(3, "up", 0, 2))
    steps = F.when(tap < 10, drag("up")).when(tap == 10, drag("cancel")).when(tap == 11, two).when(tap < 14, button("undo")).when(tap == 14, button("double")).otherwise(button("delete"))
    rows = rows.withColumns({"dx": dx, "dy": dy, "tap": tap, "s": F.explode(steps)})
    at = lambda start, d: (start + F.when(F.col("s.part") == 1, F.floor(d / 2)).when(F.col("s.part") == 2, d).otherwise(0)).cast("double")
    return rows.select(
        "image_id", (F.col("n") * 4 + F.col("s.j")).cast("long").alias("seq"), "s.kind", "s.pointer_id", F.when(F.col("p") % 3 == 0, F.lit("touch")).otherwise(F.lit("mouse")).alias("pointer_type"), (F.col("s.pointer_id") == 1).alias("is_primary"), F.lit(1).alias("buttons"),
        at(F.col("p") % 400, F.col("dx")).alias("x"), at(F.floor(F.col("p") / 400) % 220, F.col("dy")).alias("y"), F.lit(10.0).alias("left"), F.lit(20.0).alias("top"), F.lit(0.5).alias("scale_x"), F.lit(0.5).alias("scale_y"), F.lit(0.8).alias("base_scale"),
        F.when(F.col("tap").isin(6, 7), F.lit("trace")).otherwise(F.lit("free")).alias("mode"), F.col("tap").isin(8, 9).alias("stamping"), F.lit(None).cast(schemas.STYLE).alias("style"),
    )


def _sizes(spark, sf_dir):
    return _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("image_id")).distinct().select("image_id", F.lit(700).alias("width"), F.lit(400).alias("height"))


def gesture_stamps(spark, sf_dir):
    p = _pointers(spark, sf_dir)
    sizes = _sizes(spark, sf_dir)
    return _shown(edits.replay(gestures.edit_events(p, sizes), sizes))


def gesture_stream(spark, sf_dir):
    """The same events as a stream of files that part gestures, are not in order, and repeat a tenth of the events."""
    folder = f"{shared_folder(spark)}/gestures-{uuid.uuid4().hex}"
    twice = F.explode(F.when(F.col("seq") % 10 == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    _pointers(spark, sf_dir).withColumn("again", twice).drop("again").repartition(6).write.option("parquet.block.size", 8 << 20).parquet(f"{folder}/in")  # many row groups a file, so that all cores read it
    _sizes(spark, sf_dir).write.parquet(f"{folder}/sizes")
    intake.pointer_stream(spark, f"{folder}/in", spark.read.parquet(f"{folder}/sizes"), f"{folder}/out", f"{folder}/state", 2).awaitTermination()
    return _shown(sessions.latest(spark.read.parquet(f"{folder}/out")))


BOX = "STRUCT(x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE)"
#: One step of a log: (k, n, stamps, undo, chosen, op, ix, x, y, w, h, dx, dy, handle) -> the next state. Sizes: {width}, {height}.
STEP = """
SELECT k, n,
  CASE WHEN op = 'undo' THEN CASE WHEN len(undo) > 0 THEN undo[len(undo)] ELSE stamps END
       WHEN op = 'add' AND w >= 4 AND h >= 4 THEN list_append(stamps, {{'x': x, 'y': y, 'w': w, 'h': h}})
       WHEN op = 'place' AND len(stamps) > 0 THEN list_append(stamps, {{'x': greatest(0, least({width} - l.w, x - l.w / 2)), 'y': greatest(0, least({height} - l.h, y - l.h / 2)), 'w': l.w, 'h': l.h}})
       WHEN op = 'delete' AND there THEN list_concat(stamps[1:ix], stamps[ix + 2:])
       WHEN op IN ('move', 'resize') AND there THEN list_concat(list_append(stamps[1:ix], {{'x': greatest(0, least({width} - nw, nx)), 'y': greatest(0, least({height} - nh, ny)), 'w': nw, 'h': nh}}), stamps[ix + 2:])
       ELSE stamps END AS stamps,
  CASE WHEN op = 'undo' THEN undo[1:len(undo) - 1]
       WHEN (op = 'add' AND w >= 4 AND h >= 4) OR (op = 'place' AND len(stamps) > 0) OR (op IN ('delete', 'move', 'resize') AND there) THEN list_append(undo, stamps)[-50:]
       ELSE undo END AS undo, chosen
FROM (SELECT *, CASE WHEN op = 'move' THEN b.x + dx WHEN east THEN b.x WHEN b.w - dx < 4 THEN b.x + b.w - 4 ELSE b.x + dx END AS nx, CASE WHEN op = 'move' THEN b.y + dy WHEN south THEN b.y WHEN b.h - dy < 4 THEN b.y + b.h - 4 ELSE b.y + dy END AS ny,
    CASE WHEN op = 'move' THEN b.w WHEN east THEN greatest(4, b.w + dx) ELSE greatest(4, b.w - dx) END AS nw, CASE WHEN op = 'move' THEN b.h WHEN south THEN greatest(4, b.h + dy) ELSE greatest(4, b.h - dy) END AS nh
  FROM (SELECT *, stamps[ix + 1] AS b, stamps[len(stamps)] AS l, ix >= 0 AND ix < len(stamps) AS there, handle IN ('ne', 'se') AS east, handle IN ('sw', 'se') AS south FROM ({source})))
"""
#: Of the states of all steps, the stamps of the last one.
LAST = "SELECT k AS image_id, (i - 1)::BIGINT AS stamp_ix, stamps[i].x AS x, stamps[i].y AS y, stamps[i].w AS w, stamps[i].h AS h, 'manual' AS kind FROM (SELECT k, stamps, unnest(range(1, len(stamps) + 1)) AS i FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC) = 1))"
START = f"SELECT DISTINCT k, 0::BIGINT AS n, []::{BOX}[] AS stamps, []::{BOX}[][] AS undo, (-1)::BIGINT AS chosen FROM e"

EDIT_REPLAY = f"""
WITH RECURSIVE e AS (
  SELECT user_id::VARCHAR AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, ['add', 'add', 'place', 'move', 'resize', 'undo', 'delete', 'add'][p % 8 + 1] AS op, p % 3 AS ix, (p % 300)::DOUBLE AS x, (p % 170)::DOUBLE AS y,
    (2 + p % 50)::DOUBLE AS w, (2 + p % 40)::DOUBLE AS h, (p % 61 - 30)::DOUBLE AS dx, (p % 53 - 26)::DOUBLE AS dy, ['nw', 'ne', 'sw', 'se'][p % 4 + 1] AS handle FROM (SELECT *, event_id * 7919 AS p FROM events)),
s AS ({START} UNION ALL {STEP.format(width=400, height=200, source="SELECT e.*, stamps, undo, chosen FROM s JOIN e ON e.k = s.k AND e.n = s.n + 1")})
{LAST}
"""

#: What a row of ``events`` does as a gesture, given the stamps that its image has by then.
GESTURE = """
SELECT k, n, stamps, undo,
  CASE WHEN tap < 12 THEN hit WHEN tap < 14 AND len(undo) > 0 THEN -1 WHEN tap = 14 AND hit = chosen THEN -1 WHEN tap = 15 THEN -1 ELSE chosen END AS chosen,
  CASE WHEN tap < 11 AND hit >= 0 THEN CASE WHEN corner IS NULL THEN 'move' ELSE 'resize' END WHEN tap IN (10, 11) THEN 'none' WHEN tap IN (8, 9) AND len(stamps) > 0 THEN CASE WHEN sqrt(dx * dx + dy * dy) < 12 THEN 'place' ELSE 'none' END
       WHEN tap < 10 THEN 'add' WHEN tap < 14 THEN 'undo' WHEN tap = 15 OR (hit = chosen AND hit >= 0) THEN 'delete' ELSE 'none' END AS op,
  CASE WHEN tap = 15 THEN chosen ELSE hit END AS ix,
  CASE WHEN tap IN (8, 9) AND len(stamps) > 0 THEN x0 + 2 * dx ELSE least(x0, x0 + 2 * dx) END AS x,
  CASE WHEN tap IN (8, 9) AND len(stamps) > 0 THEN y0 + 2 * dy WHEN tap IN (6, 7) THEN greatest(0, least(360, y0 - lift - 20)) ELSE least(y0, y0 + 2 * dy) - lift END AS y,
  abs(2 * dx) AS w, CASE WHEN tap IN (6, 7) THEN 40 ELSE abs(2 * dy) END AS h, 2 * dx AS dx, 2 * dy AS dy, ['nw', 'ne', 'sw', 'se'][corner + 1] AS handle
FROM (SELECT *, CASE WHEN c IS NOT NULL THEN -c.o ELSE coalesce(inside, -1) END AS hit, c.c AS corner FROM (
  SELECT e.*, stamps, undo, chosen,
    list_sort(list_filter(flatten(list_transform(range(len(stamps)), lambda i: list_transform([0, 1, 2, 3], lambda c: {
      'd': sqrt(pow(x0 - stamps[i + 1].x - c % 2 * stamps[i + 1].w, 2) + pow(y0 - stamps[i + 1].y - c // 2 * stamps[i + 1].h, 2)), 'o': -i, 'c': c}))), lambda q: q.d <= 60))[1] AS c,
    list_max(list_filter(range(len(stamps)), lambda i: x0 >= stamps[i + 1].x - 60 AND x0 <= stamps[i + 1].x + stamps[i + 1].w + 60 AND y0 >= stamps[i + 1].y - 60 AND y0 <= stamps[i + 1].y + stamps[i + 1].h + 60)) AS inside
  FROM s JOIN e ON e.k = s.k AND e.n = s.n + 1))
"""
GESTURES = f"""
WITH RECURSIVE e AS (
  SELECT k, n, tap, ((p % 400 - 10) * 2)::DOUBLE AS x0, ((p // 400 % 220 - 20) * 2)::DOUBLE AS y0, CASE WHEN p % 3 = 0 THEN 80 ELSE 0 END AS lift,
    (CASE WHEN tap IN (8, 9) THEN p % 19 - 9 ELSE p % 121 - 60 END)::DOUBLE AS dx, (CASE WHEN tap IN (8, 9) THEN p % 7 - 3 ELSE p % 87 - 43 END)::DOUBLE AS dy
  FROM (SELECT user_id::VARCHAR AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_id * 7919 AS p, event_id * 7919 % 16 AS tap FROM events)),
s AS ({START} UNION ALL {STEP.format(width=700, height=400, source=GESTURE)})
{LAST}
"""

QUERIES = {"edit_replay": edit_replay, "gesture_stamps": gesture_stamps, "gesture_stream": gesture_stream}
ORACLES = {"edit_replay": EDIT_REPLAY, "gesture_stamps": GESTURES, "gesture_stream": GESTURES}
