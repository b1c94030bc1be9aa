"""A whole run as a query: two passes, several lines, readings in rounds, regions; and the pictures that readings get.

The provider's replies are derived from the requests by arithmetic, the same in the SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import schemas
from ..functions.plan import let, spread
from ..operators import rescue
from ..sources import ocr
from . import pipeline
from .pixel_queries import _image, _images_named

TARGETS = ["blue", "small", "widget", "red", "hot"]
WIDTH, HEIGHT = 400, 200
#: (pass, line, y on the page, x offset on the page, text): how a name is read in the SQL; the same as columns below.
LINES = (
    (0, 0, 50, 0, "CASE WHEN p_partkey % 3 = 0 THEN translate(p_name, 'uaeo', 'nocu') ELSE p_name END"),
    (0, 1, 250, 0, "CASE WHEN p_partkey % 2 = 0 THEN translate(p_name, 'ie', 'lc') ELSE translate(p_name, 'rt', 'nf') END"),
    (1, 0, 52, 2, "CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE translate(p_name, 'aeiou', 'oocuu') END"),
)


def _parts(spark, sf_dir):
    return spread(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name"))


def spelled(text: Column, y: int, dx: int) -> Column:
    """A read line: words of ten-pixel characters, 12 high; every seventh part's symbols are unusable."""
    wide = F.when(F.col("p_partkey") % 7 == 0, F.lit(0)).otherwise(F.lit(9))
    box = lambda a, b: F.struct(a.cast("double").alias("x0"), F.lit(float(y)).alias("y0"), b.cast("double").alias("x1"), F.lit(y + 12.0).alias("y1"))

    def words(ws):
        start = lambda i: F.aggregate(F.slice(ws, F.lit(1), i), F.lit(dx), lambda a, w: a + (F.length(w) + 1) * 10)

        def word(w, at):
            symbols = F.transform(F.split(w, ""), lambda c, j: F.struct(c.alias("text"), box(at + j * 10, at + j * 10 + wide).alias("bbox")))
            return F.struct(w.alias("text"), box(at, at + F.length(w) * 10 - 1).alias("bbox"), symbols.alias("symbols"))

        return F.transform(F.filter(ws, lambda w: w != ""), lambda w, i: let(start(i), lambda at: word(w, at)))

    return F.struct(let(F.split(text, " "), words).alias("words"))


def _pages(parts):
    p, name = F.col("p_partkey"), F.col("p_name")
    texts = [F.when(p % 3 == 0, F.translate(name, "uaeo", "nocu")).otherwise(name), F.when(p % 2 == 0, F.translate(name, "ie", "lc")).otherwise(F.translate(name, "rt", "nf")), F.when(p % 5 == 0, name).otherwise(F.translate(name, "aeiou", "oocuu"))]
    lines = [spelled(t, y, dx) for t, (_, _, y, dx, _) in zip(texts, LINES)]
    page = lambda ix, variant, own: F.struct(F.lit(ix).alias("pass_ix"), F.lit(variant).alias("pass"), F.array(*own).alias("lines"))
    rows = parts.select(p.cast("string").alias("image_id"), F.explode(F.array(page(0, "contrast", lines[:2]), page(1, "color", lines[2:]))).alias("g"))
    return rows.select("image_id", "g.pass", "g.pass_ix", F.lit(2.0).alias("scale"), F.lit(0.0).alias("off_x"), F.lit(0.0).alias("off_y"), F.lit("").alias("text"), "g.lines")


def _provider(parts):
    """Readings of a group contain the target at one step of the ladder, or fail; those of regions spell the part's name."""
    names = parts.select(F.col("p_partkey").cast("string").alias("_i"), F.array(spelled(F.col("p_name"), 50, 0)).alias("lines"))

    def provide(requests):
        image = F.col("image_id").cast("bigint")
        rows = requests.join(names, F.col("image_id") == F.col("_i"))
        asked = F.col("kind") == "refine"
        text = F.when(asked & ((image * 3 + F.col("group_ix")) % 8 == F.col("attempt_ix")), F.concat(F.lit("x "), "target_id")).otherwise(F.lit("zz"))
        error = F.when(asked & (image % 11 == 0), F.lit("ERROR: none"))
        return rows.select("request_id", text.alias("text"), F.when(~asked, F.col("lines")).alias("lines"), error.alias("error"))

    return provide


def _stages(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    images = parts.select(F.col("p_partkey").cast("string").alias("image_id"), F.lit("").alias("path"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), F.lit(None).cast("binary").alias("data"))
    regions = images.filter("CAST(image_id AS BIGINT) % 4 = 0").select("image_id", F.lit(0).alias("region_ix"), F.lit(10.0).alias("x"), F.lit(150.0).alias("y"), F.lit(300.0).alias("w"), F.lit(20.0).alias("h"))
    targets = spark.createDataFrame([(w, w) for w in TARGETS], schemas.TARGETS)
    return pipeline.stages(images, targets, _pages(parts), _provider(parts), regions)


def full_run(spark, sf_dir):
    return _stages(spark, sf_dir)["stamps"].select("image_id", "target_id", F.col("stamp_ix").cast("long").alias("stamp_ix"), "source", "x", "y", "w", "h")


def refine_rounds(spark, sf_dir):
    """Of each group that is read again: how many readings were asked, and the step that confirmed it, if any."""
    s = _stages(spark, sf_dir)
    key = ["image_id", "target_id", "group_ix"]
    asked = s["requests"].groupBy(*key).agg(F.count("*").alias("readings"))
    return asked.join(s["refined"].select(*key, F.col("attempt_ix").cast("long").alias("step")), key, "left").select("image_id", "target_id", F.col("group_ix").cast("long").alias("group_ix"), "readings", "step")


def _full_sql(units: str, near_group: str) -> str:
    """The run up to the boxes. units: SQL of one line's characters, with ``part`` as its source; near_group: the step of the clusters' fold."""
    own = lambda text: "(" + units.replace("FROM part,", f"FROM (SELECT p_partkey, {text} AS p_name FROM part),") + ")"
    line = lambda ix, at, y, dx, text: f"SELECT image_id, {ix} AS pass_ix, {at} AS line_ix, {y / 2}::DOUBLE AS y0, {y / 2 + 6}::DOUBLE AS y1, string_agg(ch, '' ORDER BY unit_ix) AS text, list(x0 + {dx / 2} ORDER BY unit_ix) AS xs, list(x1 + {dx / 2} ORDER BY unit_ix) AS xe FROM {own(text)} GROUP BY image_id"
    lines = " UNION ALL ".join(line(*x) for x in LINES)
    region = line(0, 0, 350, 20, "p_name").replace(" GROUP BY image_id", " WHERE image_id::BIGINT % 4 = 0 GROUP BY image_id")
    hits = lambda name, source: f"""{name} AS (SELECT image_id, pass_ix, line_ix, y0, y1, target, at_, xs[at_ + 1] AS x0, xe[at_ + length(target)] AS x1 FROM (SELECT *, (list_sum(list_transform(parts[1:j], lambda q: length(q))) + (j - 1) * length(target))::BIGINT AS at_
  FROM (SELECT *, unnest(generate_series(1, len(parts)::BIGINT - 1)) AS j FROM (SELECT *, string_split(text, target) AS parts FROM {source}, t WHERE contains(text, target)))))"""  # noqa: E731
    return f"""
WITH t(target) AS (VALUES {", ".join(f"('{w}')" for w in TARGETS)}),
l AS ({lines}), lr AS ({region}),
{hits("exact", "l")}, {hits("local", "lr")},
w AS (SELECT image_id, pass_ix, line_ix, y0, y1, target, text, i, n, substr(text, i + 1, n) AS c, xs[i + 1] AS l, xe[i + n] AS r, string_split(target, '') AS ta, string_split(substr(text, i + 1, n), '') AS ca
  FROM l, t, unnest(generate_series(0, length(text)::BIGINT - 1)) AS a(i), unnest(generate_series(greatest(1, length(target)::BIGINT - 2), length(target)::BIGINT + 2)) AS b(n) WHERE i + n <= length(text)),
f AS (SELECT *, len(list_filter(ta, lambda q: list_contains(ca, q)))::BIGINT AS exact_chars FROM w WHERE len(list_filter(ta, lambda q: list_contains(ca, q))) >= greatest(2, ceil(length(target) * 0.5))),
x AS (SELECT *, greatest(1 - levenshtein(target, c)::DOUBLE / greatest(length(target), n), LCS::DOUBLE / greatest(length(target), n)) AS similarity FROM f),
z AS (SELECT * FROM x WHERE similarity >= 0.5 QUALIFY row_number() OVER (PARTITION BY image_id, target, pass_ix, text, floor(l * 2 + 0.5), floor(r * 2 + 0.5) ORDER BY similarity DESC, exact_chars DESC, abs(n - length(target)), line_ix, i, n) = 1),
near AS (SELECT *, pass_ix * 100 + row_number() OVER (PARTITION BY image_id, target, pass_ix ORDER BY similarity DESC, exact_chars DESC, abs(n - length(target)), line_ix, i, n) AS rank FROM z QUALIFY rank <= pass_ix * 100 + 60),
fold AS (SELECT image_id, target, list_reduce(list_transform(b, lambda v: [v]), lambda acc, b: {near_group}) AS gs
    FROM (SELECT image_id, target, list({{'x0': l, 'y0': y0, 'x1': r, 'y1': y1, 'n': [rank]}} ORDER BY rank) AS b FROM near WHERE similarity < 0.999 GROUP BY ALL)),
aged AS (SELECT image_id, target, generate_subscripts(gs, 1) AS age, unnest(gs) AS g FROM fold),
member AS (SELECT image_id, target, age, g.x0 AS gx0, g.y0 AS gy0, g.x1 AS gx1, g.y1 AS gy1, unnest(g.n) AS rank FROM aged),
m AS (SELECT member.*, c, similarity, l, r, y0, y1, exact_chars FROM member JOIN near USING (image_id, target, rank)),
ranked AS (SELECT image_id, target, age, row_number() OVER (PARTITION BY image_id, target ORDER BY max(similarity) DESC, age) - 1 AS group_ix FROM m GROUP BY image_id, target, age),
g AS (SELECT m.*, group_ix, length(target) = 3 AND length(c) = 3 AND levenshtein(target, c) = 1 AND similarity >= 0.66::DOUBLE AS votes FROM m JOIN ranked USING (image_id, target, age)),
spots AS (SELECT image_id, target, c, count(DISTINCT group_ix) AS spots FROM g WHERE votes GROUP BY ALL),
open AS (SELECT * FROM g WHERE group_ix < 8 AND NOT EXISTS (SELECT 1 FROM exact e WHERE e.image_id = g.image_id AND e.target = g.target AND abs((gx0 + gx1) / 2 - (e.x0 + e.x1) / 2) <= greatest(24, greatest(gx1 - gx0, e.x1 - e.x0, 1) * 0.55::DOUBLE)
    AND abs((gy0 + gy1) / 2 - (e.y0 + e.y1) / 2) <= greatest(24, greatest(gy1 - gy0, e.y1 - e.y0, 1) * 0.7::DOUBLE))),
able AS (SELECT *, levenshtein(target, c) AS distance, count(*) FILTER (votes) OVER (PARTITION BY image_id, target, group_ix, c) AS same_spot FROM open WHERE length(c) = length(target) AND length(target) >= 3 AND levenshtein(target, c) <= 1),
strong AS (SELECT able.* FROM able LEFT JOIN spots USING (image_id, target, c) WHERE CASE WHEN length(target) = 3 THEN votes AND (same_spot >= 2 OR coalesce(spots, 0) >= 2) ELSE similarity >= 0.72::DOUBLE END),
accepted AS (SELECT * FROM strong QUALIFY row_number() OVER (PARTITION BY image_id, target, group_ix ORDER BY CASE WHEN length(target) = 3 THEN 0 ELSE distance END, similarity DESC, rank) = 1),
best AS (SELECT * FROM open WHERE NOT EXISTS (SELECT 1 FROM accepted a WHERE a.image_id = open.image_id AND a.target = open.target AND a.group_ix = open.group_ix) QUALIFY row_number() OVER (PARTITION BY image_id, target, group_ix ORDER BY similarity DESC, rank) = 1),
steps AS (SELECT best.*, attempt, image_id::BIGINT % 11 <> 0 AND (image_id::BIGINT * 3 + group_ix) % 8 = attempt AS says FROM best, (VALUES (0, false), (1, false), (2, true), (3, false), (4, false), (5, false)) AS v(attempt, weak) WHERE NOT weak OR similarity < 0.7::DOUBLE OR exact_chars <= 2),
settled AS (SELECT *, min(attempt) FILTER (says) OVER (PARTITION BY image_id, target, group_ix) AS step FROM steps),
refined AS (SELECT * FROM settled WHERE attempt = step)"""


FULL_END = """,
box AS (SELECT image_id, target, 0 AS s, pass_ix AS o, line_ix AS o1, at_ AS o2, x0, y0, x1, y1, 'OCR' AS source FROM exact UNION ALL SELECT image_id, target, 1, group_ix, 0, 0, gx0, gy0, gx1, gy1, '再OCR' FROM refined
  UNION ALL SELECT image_id, target, 2, group_ix, 0, 0, l, y0, r, y1, '近似候補救出' FROM accepted UNION ALL SELECT image_id, target, 3, pass_ix, line_ix, at_, x0, y0, x1, y1, '局所OCR' FROM local),
kept AS (SELECT image_id, target, list_reduce(list_transform(b, lambda v: [v]), lambda acc, v: CASE WHEN len(list_filter(acc, lambda q: least(q.w * q.h, v[1].w * v[1].h) > 0 AND
  greatest(0, least(q.x + q.w, v[1].x + v[1].w) - greatest(q.x, v[1].x)) * greatest(0, least(q.y + q.h, v[1].y + v[1].h) - greatest(q.y, v[1].y)) / least(q.w * q.h, v[1].w * v[1].h) > 0.45::DOUBLE)) > 0 THEN acc ELSE list_append(acc, v[1]) END) AS k
  FROM (SELECT image_id, target, list({'x': x0, 'y': y0, 'w': x1 - x0, 'h': y1 - y0, 'source': source} ORDER BY s, o, o1, o2) AS b FROM box GROUP BY ALL)),
p AS (SELECT image_id, target, generate_subscripts(k, 1) - 1 AS stamp_ix, unnest(k) AS b FROM kept),
v AS (SELECT *, greatest(2, floor(b.h * 0.08::DOUBLE + 0.5)) AS e FROM p),
e AS (SELECT *, greatest(0, floor(b.x - e + 0.5)) AS x0, greatest(0, floor(b.y - e + 0.5)) AS y0, least(400, floor(b.x + b.w + e + 0.5)) AS x1, least(200, floor(b.y + b.h + e + 0.5)) AS y1 FROM v)
SELECT image_id, target AS target_id, stamp_ix::BIGINT AS stamp_ix, b.source AS source, x0::DOUBLE AS x, y0::DOUBLE AS y, greatest(1, x1 - x0)::DOUBLE AS w, greatest(1, y1 - y0)::DOUBLE AS h FROM e
"""
ROUNDS_END = """
SELECT image_id, target AS target_id, group_ix::BIGINT AS group_ix, count(*) FILTER (step IS NULL OR attempt <= step) AS readings, any_value(step)::BIGINT AS step FROM settled GROUP BY image_id, target, group_ix
"""


def reading_pictures(spark, sf_dir):
    """Windows of the enlarged page (``ocr``) and of the analysed page of an image 2,000 pixels wide, as they are handed to a reading."""
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    small = _image(suppliers, "s_suppkey", 12, 6, lambda k, j: [(k * 7 + j // 12 * 3 + j % 12 * n) % 6 * 50 for n in (1, 2, 5)])
    wide = _image(suppliers, "s_suppkey", 2000, 2, lambda k, j: [(k * 5 + j % 2000 // n + j // 2000) % 9 * 28 for n in (3, 4, 7)])
    wide = wide.withColumn("image_id", F.concat(F.lit("w"), "image_id"))
    named = _images_named(suppliers, "s_suppkey")
    wide_named = named.select(F.concat(F.lit("w"), "image_id").alias("image_id"), F.lit(2000).alias("width"), F.lit(2).alias("height"))
    d = lambda c: c.cast("double")
    i = F.regexp_replace("image_id", "w", "").cast("bigint")
    window = F.struct(d(i % 11).alias("x0"), d(i % 5).alias("y0"), d(i % 11 + 5 + i % 9).alias("x1"), d(i % 5 + 4 + i % 3).alias("y1"))
    asked = named.select("image_id", F.lit("ocr").alias("variant"), F.lit(3.0).alias("zoom"), window.alias("crop"))
    boxes = wide_named.select("image_id", F.lit(0).alias("region_ix"), d(2 * (i % 700)).alias("x"), F.lit(0.0).alias("y"), d(2 * (6 + i % 5)).alias("w"), F.lit(2.0).alias("h"))
    regions = rescue.region_requests(boxes, wide_named).select("image_id", "variant", d(F.col("zoom")).alias("zoom"), "crop")
    got = ocr.pictures(asked.union(regions).withColumn("request_id", F.concat_ws("/", "image_id", "variant")), small.union(wide))
    return got.select("request_id", F.col("width").cast("long").alias("w"), F.col("height").cast("long").alias("h"), F.hex("data").alias("pixels"))


# A stretched row lies between two of its source: value = low + (high - low) * part, rounded half up once both ways are done.
READING_PICTURES = """
WITH o AS (SELECT s_suppkey AS k, j % 12 AS x, j // 12 AS y, (s_suppkey * 7 + j // 12 * 3 + j % 12) % 6 * 50 AS r, (s_suppkey * 7 + j // 12 * 3 + j % 12 * 2) % 6 * 50 AS g, (s_suppkey * 7 + j // 12 * 3 + j % 12 * 5) % 6 * 50 AS b FROM supplier, unnest(generate_series(0, 71)) AS s(j)),
pg AS (SELECT k, px, py, greatest(0, least(11, (px + 0.5::DOUBLE) / 2.5 - 0.5)) AS ax, greatest(0, least(5, (py + 0.5::DOUBLE) / 2.5 - 0.5)) AS ay FROM (SELECT s_suppkey AS k FROM supplier), unnest(generate_series(0, 29)) AS u(px), unnest(generate_series(0, 14)) AS v(py)),
page AS (SELECT pg.k, px AS x, py AS y, SAMPLES(o) FROM pg JOIN o ON o.k = pg.k AND abs(o.x - ax) < 1 AND abs(o.y - ay) < 1 GROUP BY pg.k, px, py),
a AS (SELECT s_suppkey AS k, x, 0::BIGINT AS y, MEANS FROM supplier, unnest(generate_series(0, 999)) AS s(x), unnest(generate_series(0, 1)) AS i(i), unnest(generate_series(0, 1)) AS j(j) GROUP BY s_suppkey, x),
q AS (SELECT s_suppkey AS k, s_suppkey || '/ocr' AS id, s_suppkey % 11 AS x0, s_suppkey % 5 AS y0, least(30, s_suppkey % 11 + 5 + s_suppkey % 9) - s_suppkey % 11 AS w, least(15, s_suppkey % 5 + 4 + s_suppkey % 3) - s_suppkey % 5 AS h, 3 AS z FROM supplier
  UNION ALL SELECT s_suppkey, 'w' || s_suppkey || '/analysed', s_suppkey % 700, 0, 6 + s_suppkey % 5, 1, 2 FROM supplier),
c AS (SELECT q.*, i, greatest(0, least(w - 1, (i % (w * z) + 0.5::DOUBLE) / z - 0.5)) + x0 AS ax, greatest(0, least(h - 1, (i // (w * z) + 0.5::DOUBLE) / z - 0.5)) + y0 AS ay FROM q, unnest(generate_series(0, w * z * h * z - 1)) AS s(i)),
src AS (SELECT k, 3 AS z, x, y, r, g, b FROM page UNION ALL SELECT k, 2, x, y, r, g, b FROM a),
d AS (SELECT c.id, c.w * c.z AS w, c.h * c.z AS h, c.i, SAMPLES(o) FROM c JOIN src o ON o.k = c.k AND o.z = c.z AND abs(o.x - ax) < 1 AND abs(o.y - ay) < 1 GROUP BY c.id, c.w, c.h, c.z, c.i)
SELECT id AS request_id, w::BIGINT AS w, h::BIGINT AS h, string_agg(printf('%02X%02X%02XFF', r, g, b), '' ORDER BY i) AS pixels FROM d GROUP BY id, w, h
"""
READING_PICTURES = READING_PICTURES.replace("SAMPLES(o)", ", ".join(f"floor(sum(o.{c} * (1 - abs(o.x - ax)) * (1 - abs(o.y - ay))) + 0.5)::BIGINT AS {c}" for c in "rgb"))
READING_PICTURES = READING_PICTURES.replace("MEANS", ", ".join(f"floor(avg((s_suppkey * 5 + (2 * x + i) // {n} + j) % 9 * 28) + 0.5)::BIGINT AS {c}" for c, n in zip("rgb", (3, 4, 7))))

QUERIES = {"full_run": full_run, "refine_rounds": refine_rounds, "reading_pictures": reading_pictures}


def oracles(units: str, group_step: str, lcs: str) -> dict[str, str]:
    """The SQL; its parts for characters, clusters and subsequences are those of the other queries."""
    run = _full_sql(units, group_step.replace("'n': g.n + 1", "'n': list_concat(g.n, b[1].n)")).replace("LCS::", lcs.format(a="ta", b="ca") + "::")
    return {"full_run": run + FULL_END, "refine_rounds": run + ROUNDS_END, "reading_pictures": READING_PICTURES}
