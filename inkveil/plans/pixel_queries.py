"""The pixel, region and template operators as queries, with equal SQL.

The tables hold no images: small ones are made from their columns by plain arithmetic, the same in the SQL.
Resampled and blurred pixels are not comparable byte by byte and stay out; sizes are compared instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import schemas
from ..functions.plan import spread
from ..operators import raster, templates
from ..operators.glyphs import draw_templates
from ..sources import ocr


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Pixels that are made at a time.
PIXELS = 1 << 18
IMAGE = "image_id string, path string, width int, height int, data binary"


def _images_named(rows: DataFrame, key: str) -> DataFrame:
    """(image_id): the images of ``_image`` by name, where no pixels are needed."""
    return rows.select(F.col(key).cast("string").alias("image_id"))


def _image(rows: DataFrame, key: str, width: int, height: int, rgb) -> DataFrame:
    """rows with a key -> images; ``rgb`` gives three arrays of whole numbers from 0 to 255 for a column of keys and a row of pixels' numbers.

    Few rows become many pixels: they are dealt over all cores first, and made some images at a time.
    """
    j = np.arange(width * height)
    step = max(1, PIXELS // len(j))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                n = part.num_rows
                data = np.full((n, len(j), 4), 255, np.uint8)
                for c, v in enumerate(rgb(part.column(1).to_numpy()[:, None], j[None, :])):
                    data[..., c] = v
                columns = [part.column(0), pa.array([""] * n), pa.array([width] * n, pa.int32()), pa.array([height] * n, pa.int32()), pa.array([d.tobytes() for d in data], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["image_id", "path", "width", "height", "data"])

    return spread(rows.select(F.col(key).cast("string").alias("image_id"), F.col(key).cast("bigint").alias("k"))).mapInArrow(run, IMAGE)


def _noise(k: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (k * 37 + j * 53) % 256, (k * 91 + j * 29) % 256, (k * 13 + j * j * 71) % 256


NOISE = "(s_suppkey * 37 + j * 53) % 256 AS r, (s_suppkey * 91 + j * 29) % 256 AS g, (s_suppkey * 13 + j * j * 71) % 256 AS b"
LUMA = "(r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE)"


def _small(spark, sf_dir: str, width: int = 8, height: int = 6) -> DataFrame:
    return _image(table(spark, sf_dir, "supplier"), "s_suppkey", width, height, _noise)


def pixel_variants(spark, sf_dir):
    images = _small(spark, sf_dir)
    parts = [raster.apply_kernel(images, v).select("image_id", F.lit(v).alias("variant"), F.hex("data").alias("pixels")) for v in raster.VARIANTS]
    return reduce(DataFrame.unionByName, parts)


PIXEL_VARIANTS = f"""
WITH p AS (SELECT s_suppkey, j, {NOISE} FROM supplier, unnest(generate_series(0, 47)) AS s(j)),
l AS (SELECT *, {LUMA} AS y FROM p),
v AS (SELECT s_suppkey, j, 'source' AS variant, r, g, b FROM l
  UNION ALL SELECT s_suppkey, j, 'invert', 255 - r, 255 - g, 255 - b FROM l
  UNION ALL SELECT s_suppkey, j, n, q, q, q FROM (SELECT s_suppkey, j, n, CASE n WHEN 'gray' THEN floor(y + 0.5) WHEN 'contrast' THEN greatest(0, least(255, floor((y - 128) * 1.65::DOUBLE + 128 + 0.5)))
    WHEN 'bin180' THEN CASE WHEN y >= 180 THEN 255 ELSE 0 END WHEN 'bin220' THEN CASE WHEN y >= 220 THEN 255 ELSE 0 END
    ELSE CASE WHEN greatest(r, g, b) - least(r, g, b) < 32 THEN 255 ELSE floor(y + 0.5) END END::BIGINT AS q FROM l, (VALUES ('gray'), ('contrast'), ('bin180'), ('bin220'), ('color')) AS n(n)))
SELECT s_suppkey::VARCHAR AS image_id, variant, string_agg(printf('%02X%02X%02XFF', r, g, b), '' ORDER BY j) AS pixels FROM v GROUP BY ALL
"""


def grey_planes(spark, sf_dir):
    images = _small(spark, sf_dir)
    parts = [raster.grey_planes(images, boost).select("image_id", F.lit(boost).alias("boost"), F.hex("data").alias("plane")) for boost in (False, True)]
    return reduce(DataFrame.unionByName, parts)


GREY_PLANES = f"""
WITH p AS (SELECT s_suppkey, j, {NOISE} FROM supplier, unnest(generate_series(0, 47)) AS s(j)),
l AS (SELECT s_suppkey, j, floor({LUMA} + 0.5) AS y FROM p),
v AS (SELECT s_suppkey, j, boost, CASE WHEN boost THEN greatest(0, least(255, floor((y - 128) * 1.52::DOUBLE + 128 + 0.5))) ELSE y END::BIGINT AS y FROM l, (VALUES (false), (true)) AS b(boost))
SELECT s_suppkey::VARCHAR AS image_id, boost, string_agg(printf('%02X', y), '' ORDER BY j) AS plane FROM v GROUP BY ALL
"""


def crop_pictures(spark, sf_dir):
    """Windows of the images as they are handed to a reading, at their own size within a white border."""
    images = _small(spark, sf_dir)
    k = F.col("image_id").cast("bigint")
    d = lambda c: c.cast("double")
    crop = F.struct(d(k % 3).alias("x0"), d(k % 2).alias("y0"), d(k % 3 + 2 + k % 4).alias("x1"), d(k % 2 + 3 + k % 2).alias("y1"))
    asked = _images_named(table(spark, sf_dir, "supplier"), "s_suppkey").select("image_id", crop.alias("crop")).withColumn("variant", F.explode(F.array(*[F.lit(v) for v in ("source", "bin180", "invert")])))
    asked = asked.select("image_id", F.concat_ws("/", "image_id", "variant").alias("request_id"), "variant", F.lit(1.0).alias("zoom"), F.lit(2).alias("border"), "crop")
    got = ocr.pictures(asked, images)
    return got.select("request_id", F.col("width").cast("long").alias("w"), F.col("height").cast("long").alias("h"), F.hex("data").alias("pixels"))


CROP_PICTURES = f"""
WITH p AS (SELECT s_suppkey, j % 8 AS x, j // 8 AS y, {NOISE} FROM supplier, unnest(generate_series(0, 47)) AS s(j)),
q AS (SELECT s_suppkey, s_suppkey % 3 AS x0, s_suppkey % 2 AS y0, 2 + s_suppkey % 4 AS w, 3 + s_suppkey % 2 AS h FROM supplier),
v AS (SELECT q.*, variant, (i % (w + 4))::BIGINT AS x, i // (w + 4) AS y, i FROM q, (VALUES ('source'), ('bin180'), ('invert')) AS n(variant), unnest(generate_series(0, (w + 4) * (h + 4) - 1)) AS s(i)),
c AS (SELECT v.s_suppkey, variant, w, h, i, {LUMA} AS l, r, g, b FROM v LEFT JOIN p ON p.s_suppkey = v.s_suppkey AND p.x = v.x0 + v.x - 2 AND p.y = v.y0 + v.y - 2 AND v.x BETWEEN 2 AND w + 1 AND v.y BETWEEN 2 AND h + 1),
d AS (SELECT s_suppkey, variant, w, h, i, CASE WHEN r IS NULL THEN 'FFFFFFFF' WHEN variant = 'source' THEN printf('%02X%02X%02XFF', r, g, b) WHEN variant = 'invert' THEN printf('%02X%02X%02XFF', 255 - r, 255 - g, 255 - b)
    WHEN l >= 180 THEN 'FFFFFFFF' ELSE '000000FF' END AS px FROM c)
SELECT s_suppkey || '/' || variant AS request_id, w + 4 AS w, h + 4 AS h, string_agg(px, '' ORDER BY i) AS pixels FROM d GROUP BY s_suppkey, variant, w, h
"""


def page_pictures(spark, sf_dir):
    """Sizes of the pages that are read: scaled down to the analysed page, up for reading, within a border."""
    images = _image(table(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 0"), "s_suppkey", 20, 9, _noise).unionByName(_image(table(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 1"), "s_suppkey", 1250, 3, _noise))
    got = ocr.page_pictures(images)
    return got.select("image_id", F.col("pass_ix").cast("long").alias("pass_ix"), "variant", F.col("width").cast("long").alias("w"), F.col("height").cast("long").alias("h"))


PAGE_PICTURES = """
WITH i AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 20 ELSE 1250 END AS w, CASE WHEN s_suppkey % 2 = 0 THEN 9 ELSE 3 END AS h FROM supplier),
a AS (SELECT *, least(1, 1000 / w, sqrt(2.5e6 / (w * h))) AS s FROM i),
b AS (SELECT *, CASE WHEN s >= 0.995 THEN 1 ELSE s END AS t FROM a),
c AS (SELECT s_suppkey, greatest(1, floor(w * t + 0.5)) AS aw, greatest(1, floor(h * t + 0.5)) AS ah FROM b),
d AS (SELECT *, greatest(1.8::DOUBLE, least(2.5::DOUBLE, sqrt(11e6 / (aw * ah)))) AS o FROM c)
SELECT s_suppkey::VARCHAR AS image_id, pass_ix, variant, (floor(aw * o + 0.5) + 2 * floor(10 * o + 0.5))::BIGINT AS w, (floor(ah * o + 0.5) + 2 * floor(10 * o + 0.5))::BIGINT AS h FROM d, (VALUES (0::BIGINT, 'contrast'), (1::BIGINT, 'color')) AS p(pass_ix, variant)
"""


def covered_pixels(spark, sf_dir):
    """Every image with two stamps: a plain one, then one in the colour of its surroundings."""
    images, named = _small(spark, sf_dir, 24, 16), _images_named(table(spark, sf_dir, "supplier"), "s_suppkey")
    k = F.col("image_id").cast("bigint")
    d = lambda c: c.cast("double")
    style = F.when(k % 3 == 0, F.struct(F.lit("color").alias("mode"), F.lit("#3366cc").alias("color"))).otherwise(F.struct(F.lit("black").alias("mode"), F.lit("#1a1a1a").alias("color")))
    one = named.select("image_id", F.lit(0).alias("stamp_ix"), (k % 9 + 3 + k % 2 * 0.5).cast("double").alias("x"), d(k % 5 + 2).alias("y"), F.lit(5.0).alias("w"), F.lit(4.0).alias("h"), style.cast(schemas.STYLE).alias("style"))
    ground = F.struct(F.lit("bg").alias("mode"), F.lit(None).cast("string").alias("color"))
    two = named.select("image_id", F.lit(1).alias("stamp_ix"), d(k % 13 + 6).alias("x"), (k % 7 + 4.5).cast("double").alias("y"), F.lit(4.0).alias("w"), F.lit(3.5).alias("h"), ground.cast(schemas.STYLE).alias("style"))
    return raster.render(images, one.unionByName(two), encode=False).select("image_id", F.hex("data").alias("pixels"))


COVERED_PIXELS = f"""
WITH p AS (SELECT s_suppkey, j, j % 24 AS px, j // 24 AS py, {NOISE} FROM supplier, unnest(generate_series(0, 383)) AS s(j)),
q AS (SELECT *, s_suppkey % 9 + 3 + s_suppkey % 2 * 0.5::DOUBLE AS ax, s_suppkey % 5 + 2 AS ay, s_suppkey % 13 + 6 AS bx, s_suppkey % 7 + 4.5::DOUBLE AS by_ FROM p),
ring AS (SELECT s_suppkey, floor(avg(r) + 0.5)::BIGINT AS mr, floor(avg(g) + 0.5)::BIGINT AS mg, floor(avg(b) + 0.5)::BIGINT AS mb FROM q WHERE px >= floor(bx - 6) AND px < ceil(bx + 10) AND py >= floor(by_ - 6) AND py < ceil(by_ + 3.5 + 6)
    AND NOT (px >= bx AND px < bx + 4 AND py >= by_ AND py < by_ + 3.5) GROUP BY s_suppkey),
o AS (SELECT s_suppkey, j, CASE WHEN px >= floor(bx + 0.5) AND px < floor(bx + 4.5) AND py >= floor(by_ + 0.5) AND py < floor(by_ + 4) THEN printf('%02X%02X%02XFF', mr, mg, mb)
    WHEN px >= floor(ax + 0.5) AND px < floor(ax + 5.5) AND py >= ay AND py < ay + 4 THEN CASE WHEN s_suppkey % 3 = 0 THEN '3366CCFF' ELSE '000000FF' END ELSE printf('%02X%02X%02XFF', r, g, b) END AS c FROM q JOIN ring USING (s_suppkey))
SELECT s_suppkey::VARCHAR AS image_id, string_agg(c, '' ORDER BY j) AS pixels FROM o GROUP BY s_suppkey
"""

BAND_W, BAND_H = 100, 120


def text_bands(spark, sf_dir):
    """Regions of images with a dark and a light bar on a ground that is neither."""

    def rgb(k, j):
        x, y = j % BAND_W, j // BAND_W
        dark = (x >= k % 31 + 5) & (x < k % 31 + 5 + 20 + k % 29) & (y >= k % 17 + 4) & (y < k % 17 + 9 + k % 11)
        light = (x >= k % 23 + 2) & (x < k % 23 + 32 + k % 37) & (y >= k % 41 + 50) & (y < k % 41 + 58 + k % 13)
        v = np.where(dark, 20, np.where(light, 250, 200))
        return v, v, v

    found = raster.detect_regions(_image(table(spark, sf_dir, "supplier"), "s_suppkey", BAND_W, BAND_H, rgb))
    return found.select("image_id", F.col("region_ix").cast("long").alias("region_ix"), "x", "y", "w", "h", "mode", "density")


TEXT_BANDS = f"""
WITH s AS (SELECT s_suppkey AS k FROM supplier),
b AS (SELECT k, 0 AS o, 'dark' AS mode, k % 31 + 5 AS a, k % 31 + 25 + k % 29 AS z, k % 17 + 4 AS t, k % 17 + 9 + k % 11 AS e FROM s UNION ALL SELECT k, 1, 'light', k % 23 + 2, k % 23 + 32 + k % 37, k % 41 + 50, k % 41 + 58 + k % 13 FROM s),
c AS (SELECT *, (a + 1) // 2 AS l, (z + 1) // 2 - 1 AS r, (t + 1) // 2 AS f, (e + 1) // 2 - 1 AS g FROM b),
d AS (SELECT *, greatest(0, f * 2 - 10) AS y0, least({BAND_H}, (g + 1) * 2 + 10) AS y1, greatest(0, l * 2 - 14) AS x0, least({BAND_W}, r * 2 + 14) AS x1, (r - l + 1) * (g - f + 1) AS n FROM c WHERE r - l + 1 >= 3 AND r > l AND g >= f),
h AS (SELECT k, o, mode, x0::DOUBLE AS x, y0::DOUBLE AS y, (x1 - x0)::DOUBLE AS w, (y1 - y0)::DOUBLE AS h, n / greatest(1, (x1 - x0) * (y1 - y0) / 4.0::DOUBLE) AS density FROM d WHERE y1 - y0 BETWEEN 14 AND 110 AND x1 - x0 BETWEEN 35 AND {BAND_W}),
m AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY density DESC, o) AS p FROM h),
kept AS (SELECT m.* FROM m LEFT JOIN m AS q ON q.k = m.k AND q.p < m.p WHERE q.k IS NULL OR NOT greatest(0, least(m.x + m.w, q.x + q.w) - greatest(m.x, q.x)) * greatest(0, least(m.y + m.h, q.y + q.h) - greatest(m.y, q.y)) > least(m.w * m.h, q.w * q.h) * 0.45::DOUBLE)
SELECT k::VARCHAR AS image_id, row_number() OVER (PARTITION BY k ORDER BY p) - 1 AS region_ix, x, y, w, h, mode, density FROM kept
"""


def template_scores(spark, sf_dir):
    """Grey values from an embedding as a plane; its upper half as text points, its lower half as background."""
    e = spread(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    grey = F.transform("embedding", lambda v: (F.floor(F.abs(v.cast("double")) * 1000) % 256).cast("bigint"))
    data = F.unhex(F.array_join(F.transform(grey, lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    points = lambda a, z: F.transform(F.sequence(F.lit(a), F.lit(z)), lambda i: F.struct((i % 8).cast("int").alias("x"), F.floor(i / 8).cast("int").alias("y")))
    rows = e.select(F.col("vec_id").alias("id"), F.lit(8).alias("width"), F.lit(8).alias("height"), data.alias("data"), F.lit(0).alias("x"), F.lit(0).alias("y"), points(0, 31).alias("samples"), points(32, 63).alias("bg_samples"))
    return templates.score_positions(rows).withColumnRenamed("id", "vec_id")


TEMPLATE_SCORES = """
WITH g AS (SELECT vec_id, list_transform(embedding, lambda v: floor(abs(v::DOUBLE) * 1000)::BIGINT % 256) AS v FROM embeddings),
s AS (SELECT vec_id, len(list_filter(v[1:32], lambda q: q >= 95 AND q <= 235)) / 32.0::DOUBLE AS f, len(list_filter(v[33:64], lambda q: q <= 84)) / 32.0::DOUBLE AS b FROM g)
SELECT vec_id, f AS fg_score, b AS bg_score, f * 0.72::DOUBLE + b * 0.28::DOUBLE AS score FROM s
"""


def template_samples(spark, sf_dir):
    """Templates of targets drawn with the opacity that an embedding gives; two corners are opaque."""
    e = spread(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    last = F.size("embedding") - 1
    alpha = F.transform("embedding", lambda v, i: F.when((i == 0) | (i == last), F.lit(255).cast("bigint")).otherwise((F.floor(F.abs(v.cast("double")) * 1000) % 256).cast("bigint")))
    data = F.unhex(F.array_join(F.transform(alpha, lambda v: F.concat(F.lit("000000"), F.lpad(F.hex(v), 2, "0"))), ""))
    drawn = e.select(F.col("vec_id").cast("string").alias("target_id"), F.lit(8).alias("width"), F.lit(8).alias("height"), data.alias("data"), F.lit(8).alias("target_height"), F.lit(0.0).alias("skew"))
    t = templates.make_templates(drawn)
    show = lambda c: F.array_join(F.transform(c, lambda p: F.concat_ws(":", p["x"].cast("string"), p["y"].cast("string"))), " ")
    return t.select("target_id", F.col("w").cast("long").alias("w"), F.col("h").cast("long").alias("h"), show("samples").alias("samples"), show("bg_samples").alias("bg_samples"))


TEMPLATE_SAMPLES = """
WITH p AS (SELECT vec_id, i - 1 AS j, CASE WHEN i IN (1, len(embedding)) THEN 255 ELSE floor(abs(embedding[i]::DOUBLE) * 1000)::BIGINT % 256 END AS a FROM embeddings, unnest(generate_series(1, len(embedding)::BIGINT)) AS s(i))
SELECT vec_id::VARCHAR AS target_id, 8::BIGINT AS w, 8::BIGINT AS h, coalesce(string_agg((j % 8) || ':' || (j // 8), ' ' ORDER BY j) FILTER (a >= 95), '') AS samples, coalesce(string_agg((j % 8) || ':' || (j // 8), ' ' ORDER BY j) FILTER (a <= 12), '') AS bg_samples FROM p GROUP BY vec_id
"""


GLYPH_H = 7


def drawn_templates(spark, sf_dir):
    """Templates of names, drawn from glyphs that follow from a character's code, upright and slanted by a pixel a row."""
    n = table(spark, sf_dir, "nation").select(F.lower(F.regexp_replace("n_name", "[^A-Za-z]", "")).alias("target")).unionByName(table(spark, sf_dir, "supplier").select(F.concat(F.lit("ab"), F.translate(F.conv(F.col("s_suppkey").cast("string"), 10, 26), "0123456789ABCDEFGHIJKLMNOP", "abcdefghijklmnopqrstuvwxyz")).alias("target"))).distinct()
    targets = spread(n.select(F.col("target").alias("target_id"), "target"))
    code = F.ascii("ch")
    width = (4 + code % 3).cast("int")
    letters = spark.range(26).select(F.char(F.col("id") + 97).alias("ch"))
    # The frame is opaque, so that nothing is cut off.
    alpha = lambda j: F.when((j % width == 0) | (F.floor(j / width) % (GLYPH_H - 1) == 0), F.lit(200).cast("bigint")).otherwise((code * 7 + j * j * 31 + j * 17) % 256)
    data = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), width * GLYPH_H - 1), lambda j: F.concat(F.lit("000000"), F.lpad(F.hex(alpha(j).cast("bigint")), 2, "0"))), ""))
    glyphs = letters.select("ch", width.alias("width"), F.lit(GLYPH_H).alias("height"), (width + 1).alias("advance"), data.alias("data"))
    variants = spark.createDataFrame([(GLYPH_H, 0.0), (GLYPH_H, 1.0)], "target_height int, skew double")
    t = draw_templates(targets, glyphs, variants)
    show = lambda c: F.array_join(F.transform(c, lambda p: F.concat_ws(":", p["x"].cast("string"), p["y"].cast("string"))), " ")
    return t.select("target_id", "skew", F.col("w").cast("long").alias("w"), F.col("h").cast("long").alias("h"), show("samples").alias("samples"), show("bg_samples").alias("bg_samples"))


DRAWN_TEMPLATES = f"""
WITH RECURSIVE d(k, v, s) AS (SELECT s_suppkey, s_suppkey, '' FROM supplier UNION ALL SELECT k, v // 26, chr((97 + v % 26)::INTEGER) || s FROM d WHERE v > 0),
t AS (SELECT DISTINCT target FROM (SELECT lower(regexp_replace(n_name, '[^A-Za-z]', '', 'g')) AS target FROM nation UNION ALL SELECT 'ab' || CASE WHEN s = '' THEN 'a' ELSE s END FROM d WHERE v = 0)),
c AS (SELECT target, i, ascii(target[i]) AS code, 4 + ascii(target[i]) % 3 AS width FROM t, unnest(generate_series(1, length(target)::BIGINT)) AS s(i)),
p AS (SELECT *, coalesce(sum(width + 1) OVER (PARTITION BY target ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_ FROM c),
px AS (SELECT target, at_ + j % width AS x, j // width AS y, CASE WHEN j % width = 0 OR j // width % {GLYPH_H - 1} = 0 THEN 200 ELSE (code * 7 + j * j * 31 + j * 17) % 256 END AS a FROM p, unnest(generate_series(0, width * {GLYPH_H} - 1)) AS s(j)),
z AS (SELECT target, skew, max(x + CASE WHEN skew > 0 THEN y ELSE 0 END) FILTER (a >= 70) + 1 AS w FROM px, (VALUES (0.0::DOUBLE), (1.0::DOUBLE)) AS v(skew) GROUP BY target, skew),
g AS (SELECT target, skew, w, gx AS x, gy AS y FROM z, unnest(generate_series(0, w::BIGINT - 1)) AS s(gx), unnest(generate_series(0, {GLYPH_H - 1})) AS r(gy)),
q AS (SELECT g.target, g.skew, g.w, g.x, g.y, coalesce(px.a, 0) AS a FROM g LEFT JOIN px ON px.target = g.target AND px.y = g.y AND px.x = g.x - CASE WHEN g.skew > 0 THEN g.y ELSE 0 END),
o AS (SELECT *, row_number() OVER (PARTITION BY target, skew, a >= 95, a <= 12 ORDER BY y, x) - 1 AS r, count(*) OVER (PARTITION BY target, skew, a >= 95, a <= 12) AS n FROM q)
SELECT target AS target_id, skew, w::BIGINT AS w, {GLYPH_H}::BIGINT AS h, coalesce(string_agg(x || ':' || y, ' ' ORDER BY y, x) FILTER (a >= 95 AND r % greatest(1, ceil(n / 165.0))::BIGINT = 0), '') AS samples,
  coalesce(string_agg(x || ':' || y, ' ' ORDER BY y, x) FILTER (a <= 12 AND r % greatest(1, ceil(n / 145.0))::BIGINT = 0), '') AS bg_samples FROM o GROUP BY target, skew, w
"""


def _boxes(spark, sf_dir):
    d = lambda c: c.cast("double")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("ord"), F.col("l_returnflag").alias("flag"), d(F.col("l_partkey") % 160).alias("x"), d(F.col("l_suppkey") % 90).alias("y"), F.col("l_quantity").alias("w"), (10.0 + F.col("l_linenumber")).alias("h"))


BOXES = "SELECT l_orderkey AS image_id, l_linenumber AS ord, l_returnflag AS flag, (l_partkey % 160)::DOUBLE AS x, (l_suppkey % 90)::DOUBLE AS y, l_quantity AS w, 10.0::DOUBLE + l_linenumber AS h FROM lineitem"


def region_boxes(spark, sf_dir):
    """Boxes whose centre is in or near a text region of their image, where it has any."""
    d = lambda c: c.cast("double")
    regions = table(spark, sf_dir, "orders").filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("image_id"), d(F.col("o_custkey") % 120).alias("x"), d(F.col("o_orderkey") % 60).alias("y"), d(20 + F.col("o_custkey") % 40).alias("w"), F.lit(22.0).alias("h"))
    return templates.touches_region(_boxes(spark, sf_dir), regions).select("image_id", "ord")


REGION_BOXES = f"""
WITH b AS ({BOXES}), r AS (SELECT o_orderkey AS image_id, (o_custkey % 120)::DOUBLE AS x, (o_orderkey % 60)::DOUBLE AS y, (20 + o_custkey % 40)::DOUBLE AS w, 22.0::DOUBLE AS h FROM orders WHERE o_orderkey % 3 <> 0)
SELECT b.image_id, ord FROM b LEFT JOIN r USING (image_id) WHERE r.image_id IS NULL OR (b.x + b.w / 2 BETWEEN r.x - 18 AND r.x + r.w + 18 AND b.y + b.h / 2 BETWEEN r.y - 18 AND r.y + r.h + 18)
"""


def free_positions(spark, sf_dir):
    """Template positions that no covered box of their image overlaps."""
    b = _boxes(spark, sf_dir)
    return templates.uncovered(b.filter("flag <> 'R'"), b.filter("flag = 'R'")).select("image_id", "ord")


FREE_POSITIONS = f"""
WITH b AS ({BOXES})
SELECT image_id, ord FROM b WHERE flag <> 'R' AND NOT EXISTS (SELECT 1 FROM b k WHERE k.image_id = b.image_id AND k.flag = 'R' AND k.w > 0 AND k.h > 0
  AND least(k.x + k.w, b.x + b.w) > greatest(k.x, b.x) AND least(k.y + k.h, b.y + b.h) > greatest(k.y, b.y)
  AND (least(k.x + k.w, b.x + b.w) - greatest(k.x, b.x)) * (least(k.y + k.h, b.y + b.h) - greatest(k.y, b.y)) / least(greatest(1, k.w * k.h), greatest(1, b.w * b.h)) >= 0.35::DOUBLE)
"""


def template_heights(spark, sf_dir):
    """The two heights of each image's templates, from its exact hits or else its strong near ones, by skew."""
    b = _boxes(spark, sf_dir).withColumn("box", F.struct(F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("w")).alias("y1")))
    b = b.withColumn("target_id", F.lit("t"))
    near = b.filter("flag = 'A'").select("image_id", "target_id", "box", F.lit("abc").alias("target"), F.when(F.col("ord") % 2 == 0, F.lit("abd")).otherwise(F.lit("xyc")).alias("candidate"), F.lit(0.67).alias("similarity"))
    heights = templates.template_heights(b.filter("flag = 'R'"), near)
    return templates.template_variants(heights, (0.0, 0.25)).select("image_id", F.col("height").cast("long").alias("height"), "skew", "basis", "origin", F.col("sample_count").cast("long").alias("sample_count"))


TEMPLATE_HEIGHTS = f"""
WITH b AS ({BOXES}), r AS (SELECT image_id, CASE flag WHEN 'R' THEN 0 ELSE 1 END AS k, y + w - y AS h FROM b WHERE w > 0 AND (flag = 'R' OR (flag = 'A' AND ord % 2 = 0))),
g AS (SELECT image_id, k, median(h) AS basis, count(*) AS sample_count FROM r GROUP BY image_id, k QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY k) = 1),
c AS (SELECT *, greatest(22, least(40, floor(basis + 0.5))) AS m FROM g)
SELECT image_id, height::BIGINT AS height, skew, basis, CASE k WHEN 0 THEN 'exact' ELSE 'near' END AS origin, sample_count FROM c, unnest([greatest(22, m - 1), least(40, m + 1)]) AS a(height), (VALUES (0.0::DOUBLE), (0.25::DOUBLE)) AS v(skew)
"""

QUERIES = {
    "pixel_variants": pixel_variants, "grey_planes": grey_planes, "crop_pictures": crop_pictures, "page_pictures": page_pictures, "covered_pixels": covered_pixels, "text_bands": text_bands,
    "template_scores": template_scores, "drawn_templates": drawn_templates, "template_samples": template_samples, "region_boxes": region_boxes, "free_positions": free_positions, "template_heights": template_heights,
}

ORACLES = {
    "pixel_variants": PIXEL_VARIANTS, "grey_planes": GREY_PLANES, "crop_pictures": CROP_PICTURES, "page_pictures": PAGE_PICTURES, "covered_pixels": COVERED_PIXELS, "text_bands": TEXT_BANDS,
    "template_scores": TEMPLATE_SCORES, "drawn_templates": DRAWN_TEMPLATES, "template_samples": TEMPLATE_SAMPLES, "region_boxes": REGION_BOXES, "free_positions": FREE_POSITIONS, "template_heights": TEMPLATE_HEIGHTS,
}
