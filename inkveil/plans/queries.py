"""The engine's operators as queries over the given tables, with equal SQL where SQL can express them.

The tables hold no images, so boxes, characters and grey values are derived from their columns by plain
arithmetic: the queries check what the operators mean, not how well a page is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import schemas
from ..functions.plan import spread
from ..functions.numbers import analysis_scale, median_of, ocr_scale, median_or_zero, scaled_size, template_scale
from ..functions.rects import add_visual_rect, manual_rect
from ..functions.spatial import cluster
from ..functions.text import near_scores, normalize, ocr_language, output_name, shorten, squeeze
from ..operators import edits, groups, history, match, rescue, suppress, templates, units
from . import edit_queries, metrics, pipeline, pixel_queries, run_queries

NORMAL = r"lower(regexp_replace({}, '[^\p{{L}}\p{{N}}\p{{Hiragana}}\p{{Katakana}}\p{{Han}}]', '', 'g'))"
TARGETS = ["the", "and", "license", "tion", "queue"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _targets(spark: SparkSession, words: list[str]) -> DataFrame:
    return match.normal_targets(spark.createDataFrame([(w, w) for w in words], schemas.TARGETS))


def norm_len_by_lang(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents").select("lang", "text")).select("lang", F.length(normalize(F.col("text"))).alias("n"))
    return d.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n").alias("chars"), F.max("n").alias("longest"))


def exact_hits(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_ix", "line"))
    lines = d.withColumn("text", normalize(F.col("line"))).filter(F.col("text") != "").select("doc_id", "line_ix", "text")
    hits = match.target_places(lines, _targets(spark, TARGETS)).groupBy("doc_id", "line_ix", "target").agg(F.count("*").alias("n"))
    return hits.groupBy("doc_id", "target").agg(F.sum("n").cast("long").alias("hits"), F.count("*").alias("lines"))


def near_pairs(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("a"))
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b"))
    both = p.join(q, "p_partkey").withColumns(near_scores(F.col("a"), F.col("b")))
    return both.select("p_partkey", "edit_similarity", "sequence_similarity", "similarity", F.col("exact_chars").cast("long").alias("exact_chars"))


LCS = """list_reduce(list_transform({a}, lambda c: [c]), lambda before, x: list_reduce(list_transform(range(len({b})), lambda j: [j]), lambda acc, j:
  list_append(acc, CASE WHEN x[1] = {b}[j[1] + 1] THEN before[j[1] + 1] + 1 ELSE greatest(before[j[1] + 2], acc[len(acc)]) END), [0]), list_transform(range(len({b}) + 1), lambda z: 0))"""
LCS_LENGTH = "(" + LCS + ")[len({b}) + 1]"


def _boxes(spark, sf_dir):
    """Seven boxes at most an order."""
    x, y = (F.col("l_partkey") % 60).cast("double"), (F.col("l_suppkey") % 30).cast("double")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ord"), F.col("l_returnflag").alias("flag"), x.alias("x"), y.alias("y"), F.col("l_quantity").alias("w"), (10.0 + F.col("l_linenumber")).alias("h"))


BOXES = """SELECT l_orderkey AS k, l_linenumber AS ord, l_returnflag AS flag, (l_partkey % 60)::DOUBLE AS x, (l_suppkey % 30)::DOUBLE AS y, l_quantity AS w, 10.0::DOUBLE + l_linenumber AS h FROM lineitem"""


def spatial_distinct(spark, sf_dir):
    return suppress.suppress(_boxes(spark, sf_dir).drop("flag"), ["k"], ["ord"])


def _corner(prefix=""):
    c = lambda n: F.col(prefix + n)
    return F.struct(c("x").alias("x0"), c("y").alias("y0"), (c("x") + c("w")).alias("x1"), (c("y") + c("h")).alias("y1"))


def proximity_anti(spark, sf_dir):
    b = _boxes(spark, sf_dir).withColumn("x", F.col("x") * 4).withColumn("y", F.col("y") * 8)
    b = b.select("k", "ord", "flag", _corner().alias("box"))
    return groups.untouched(b.filter("flag <> 'R'"), b.filter("flag = 'R'"), ["k"], ["k", "ord", "box"]).select("k", "ord")


def cluster_groups(spark, sf_dir):
    b = _boxes(spark, sf_dir).withColumn("x", F.col("x") * 3).withColumn("y", F.col("y") * 4)
    packed = b.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("ord", _corner().alias("box")))).alias("items"))
    g = packed.select("k", F.posexplode(cluster(F.col("items"))).alias("age", "g"))
    return g.select("k", F.col("age").cast("long").alias("age"), "g.box.x0", "g.box.y0", "g.box.x1", "g.box.y1", F.size("g.ixs").cast("long").alias("members"))


GROUP_STEP = """CASE WHEN list_position(list_transform(acc, lambda g: NEAR), true) IS NULL OR list_position(list_transform(acc, lambda g: NEAR), true) = 0
  THEN list_append(acc, b[1]) ELSE list_transform(acc, lambda g, i: CASE WHEN i = list_position(list_transform(acc, lambda g: NEAR), true)
  THEN {'x0': least(g.x0, b[1].x0), 'y0': least(g.y0, b[1].y0), 'x1': greatest(g.x1, b[1].x1), 'y1': greatest(g.y1, b[1].y1), 'n': g.n + 1} ELSE g END) END""".replace(
    "NEAR",
    "abs((g.x0 + g.x1) / 2 - (b[1].x0 + b[1].x1) / 2) <= greatest(28, greatest(g.x1 - g.x0, b[1].x1 - b[1].x0, 1) * 0.45) AND abs((g.y0 + g.y1) / 2 - (b[1].y0 + b[1].y1) / 2) <= greatest(28, greatest(g.y1 - g.y0, b[1].y1 - b[1].y0, 1) * 0.65)",
)


def vote_consensus(spark, sf_dir):
    """Readings of a three-character target in five groups of each customer's orders."""
    o = table(spark, sf_dir, "orders")
    reading = F.get(F.array(*[F.lit(c) for c in ("abd", "abe", "xbc", "ab", "abcd", "abc", "axx")]), (F.col("o_orderkey") % 7).cast("int"))
    m = F.struct(F.lit("abc").alias("target"), reading.alias("candidate"), F.when(F.length(reading) == 3, F.lit(2 / 3)).otherwise(F.lit(0.5)).alias("similarity"))
    g = o.groupBy(F.col("o_custkey").alias("image_id"), (F.floor(F.col("o_orderkey") / 7) % 5).alias("group_ix")).agg(F.collect_list(m).alias("members"))
    v = groups.votes(g.withColumn("target_id", F.lit("t")))
    return v.select("image_id", "candidate", "spots")


NAMES = ("ネ", "る", "ー", "a")


def _hits(spark, sf_dir):
    """Two-character hits: a first and a second box side by side."""
    li = table(spark, sf_dir, "lineitem")
    n = lambda c, m: (F.col(c) % m).cast("double")
    x, y, w1, w2, h = 20 + n("l_partkey", 300), 10 + n("l_suppkey", 200), 4 + n("l_partkey", 37), 4 + n("l_suppkey", 41), 9 + n("l_orderkey", 31)
    pick = lambda c: F.get(F.array(*[F.lit(v) for v in NAMES]), (F.col(c) % 4).cast("int"))
    split = F.when(F.col("l_linenumber") % 3 == 0, F.lit("word-split")).otherwise(F.lit("symbol"))
    unit = lambda ch, a, b: F.struct(ch.alias("ch"), F.struct(a.alias("x0"), y.alias("y0"), b.alias("x1"), (y + h).alias("y1")).alias("bbox"), ch.alias("raw"), split.alias("bbox_source"))
    source = F.when(F.col("l_linenumber") % 2 == 0, F.lit("局所OCR")).otherwise(F.lit("OCR"))
    return li.select("l_orderkey", "l_linenumber", F.struct(x.alias("x"), y.alias("y"), (w1 + w2).alias("w"), h.alias("h")).alias("box"), F.array(unit(pick("l_orderkey"), x, x + w1), unit(pick("l_suppkey"), x + w1, x + w1 + w2)).alias("symbols"), source.alias("source"))


def visual_rects(spark, sf_dir):
    rows = add_visual_rect(_hits(spark, sf_dir), F.col("box"), F.col("symbols"), F.col("source"), F.lit(330), F.lit(215))
    return rows.select("l_orderkey", "l_linenumber", "rect.x", "rect.y", "rect.w", "rect.h")


VISUAL = """
WITH a AS (SELECT l_orderkey, l_linenumber, (20 + l_partkey % 300)::DOUBLE AS x, (10 + l_suppkey % 200)::DOUBLE AS y, (4 + l_partkey % 37)::DOUBLE AS w1, (4 + l_suppkey % 41)::DOUBLE AS w2,
    (9 + l_orderkey % 31)::DOUBLE AS h, l_orderkey % 4 < 2 AND l_suppkey % 4 < 2 AS short, l_linenumber % 3 = 0 AS split, l_linenumber % 2 = 0 AS local FROM lineitem),
b AS (SELECT *, w1 + w2 AS w0, (w1 + w2) / 2 AS mw FROM a),
c AS (SELECT *, CASE WHEN short AND split AND w0 > h * 2 * 1.18::DOUBLE THEN greatest(1, h * 2 * 1.18::DOUBLE) ELSE w0 END AS wp FROM b),
d AS (SELECT *, CASE WHEN short AND local AND h > mw * 1.2::DOUBLE THEN y + h / 2 - mw * 1.2::DOUBLE / 2 ELSE y END AS ys, CASE WHEN short AND local AND h > mw * 1.2::DOUBLE THEN mw * 1.2::DOUBLE ELSE h END AS hs,
    CASE WHEN short AND local AND wp > mw * 2 * 1.22::DOUBLE THEN greatest(1, mw * 2 * 1.22::DOUBLE) ELSE wp END AS ws FROM c),
e AS (SELECT *, hs * 2 * 1.02::DOUBLE AS ex FROM d),
f AS (SELECT *, CASE WHEN short AND ws < ex * 0.78::DOUBLE THEN greatest(0, x - greatest(0, ex - ws) * 0.7::DOUBLE) ELSE x END AS xn, CASE WHEN short AND (ws < ex * 0.78::DOUBLE OR ws > ex * 1.3::DOUBLE) THEN ex ELSE ws END AS wn FROM e),
g AS (SELECT *, greatest(2, floor(hs * 0.08::DOUBLE + 0.5)) AS ev FROM f),
k AS (SELECT *, CASE WHEN short THEN greatest(4, floor(hs * 0.16::DOUBLE + 0.5)) ELSE ev END AS le, CASE WHEN short THEN CASE WHEN split THEN 1 ELSE 0 END ELSE ev END AS ri FROM g),
m AS (SELECT l_orderkey, l_linenumber, greatest(0, floor(xn - le + 0.5)) AS x0, greatest(0, floor(ys - ev + 0.5)) AS y0, least(330, floor(xn + wn + ri + 0.5)) AS x1, least(215, floor(ys + hs + ev + 0.5)) AS y1 FROM k)
SELECT l_orderkey, l_linenumber, x0::DOUBLE AS x, y0::DOUBLE AS y, greatest(1, x1 - x0)::DOUBLE AS w, greatest(1, y1 - y0)::DOUBLE AS h FROM m
"""


def manual_rects(spark, sf_dir):
    b = _boxes(spark, sf_dir).withColumn("r", manual_rect(F.struct("x", "y", "w", "h")))
    return b.select("k", "ord", "r.x", "r.y", "r.w", "r.h")


def _name_lines(spark, sf_dir, read=F.col):
    """Part names as read lines: words of ten-pixel characters; every seventh part's symbols are unusable."""
    p = spread(table(spark, sf_dir, "part")).withColumn("p_name", read("p_name"))
    ws = F.split(F.col("p_name"), " ")
    start = lambda i: F.aggregate(F.slice(ws, F.lit(1), i), F.lit(0), lambda a, w: a + F.length(w) + 1) * 10.0
    box = lambda a, b: F.struct(a.cast("double").alias("x0"), F.lit(50.0).alias("y0"), b.cast("double").alias("x1"), F.lit(62.0).alias("y1"))
    broken = F.col("p_partkey") % 7 == 0

    def word(w, i):
        symbols = F.transform(F.split(w, ""), lambda c, j: F.struct(c.alias("text"), box(start(i) + j * 10, start(i) + j * 10 + F.when(broken, F.lit(0)).otherwise(F.lit(9))).alias("bbox")))
        return F.struct(w.alias("text"), box(start(i), start(i) + F.length(w) * 10 - 1).alias("bbox"), symbols.alias("symbols"))

    lines = F.array(F.struct(F.transform(F.filter(ws, lambda w: w != ""), word).alias("words")))
    return p.select(F.col("p_partkey").cast("string").alias("image_id"), F.lit("contrast").alias("pass"), F.lit(0).alias("pass_ix"), F.lit(2.0).alias("scale"), F.lit(0.0).alias("off_x"), F.lit(0.0).alias("off_y"), F.col("p_name").alias("text"), lines.alias("lines"))


def _name_images(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("image_id"), F.lit(400).alias("width"), F.lit(80).alias("height"))


NAME_TARGETS = ["green", "part", "blue", "steel"]


def flatten_units(spark, sf_dir):
    u = units.line_units(_name_lines(spark, sf_dir)).select("image_id", F.posexplode("units").alias("unit_ix", "u"))
    return u.select("image_id", F.col("unit_ix").cast("long").alias("unit_ix"), "u.ch", "u.bbox_source", "u.bbox.x0", "u.bbox.x1")


UNITS = """
WITH w AS (SELECT p_partkey, i, string_split(p_name, ' ') AS ws FROM part, unnest(generate_series(1, len(string_split(p_name, ' ')))) AS s(i)),
v AS (SELECT p_partkey, i, ws[i] AS word, coalesce(list_sum(list_transform(ws[1:i - 1], lambda q: length(q) + 1)), 0) * 10 AS at_ FROM w),
c AS (SELECT p_partkey, i, j, at_, word, p_partkey % 7 = 0 AS broken, {normal} AS norm FROM v, unnest(generate_series(0, length(word)::BIGINT - 1)) AS s(j)),
d AS (SELECT *, CASE WHEN broken THEN substr(norm, j + 1, 1) ELSE {char} END AS ch FROM c)
SELECT p_partkey::VARCHAR AS image_id, row_number() OVER (PARTITION BY p_partkey ORDER BY i, j) - 1 AS unit_ix, ch, CASE WHEN broken THEN 'word-split' ELSE 'symbol' END AS bbox_source,
  (CASE WHEN broken THEN at_ + (length(word) * 10 - 1)::DOUBLE * j / length(norm) ELSE at_ + j * 10 END) / 2.0::DOUBLE AS x0,
  (CASE WHEN broken THEN at_ + (length(word) * 10 - 1)::DOUBLE * (j + 1) / length(norm) ELSE at_ + j * 10 + 9 END) / 2.0::DOUBLE AS x1
FROM d WHERE ch <> ''
""".format(normal=NORMAL.format("word"), char=NORMAL.format("substr(word, j + 1, 1)"))


def near_topk(spark, sf_dir):
    lines = units.line_units(_name_lines(spark, sf_dir))
    near = match.near_candidates(lines, _targets(spark, NAME_TARGETS), limit=5)
    return near.select("image_id", "target", F.col("rank").cast("long").alias("rank"), "candidate", "similarity", F.col("exact_chars").cast("long").alias("exact_chars"), F.col("start_index").cast("long").alias("start_index"))


NEAR_TOPK = f"""
WITH t(target) AS (VALUES {", ".join(f"('{w}')" for w in NAME_TARGETS)}),
u AS ({UNITS}),
l AS (SELECT image_id, string_agg(ch, '' ORDER BY unit_ix) AS text, list(x0 ORDER BY unit_ix) AS xs, list(x1 ORDER BY unit_ix) AS xe FROM u GROUP BY image_id),
w AS (SELECT image_id, target, text, i, n, substr(text, i + 1, n) AS c, xs[i + 1] AS l, xe[i + n] AS r FROM l, t, unnest(generate_series(0, length(text)::BIGINT - 1)) AS a(i), unnest(generate_series(greatest(1, length(target)::BIGINT - 2), length(target)::BIGINT + 2)) AS b(n) WHERE i + n <= length(text)),
s AS (SELECT *, string_split(target, '') AS ta, string_split(c, '') AS ca FROM w),
x AS (SELECT *, 1 - levenshtein(target, c)::DOUBLE / greatest(length(target), n) AS ed, {LCS_LENGTH.format(a="ta", b="ca")}::DOUBLE / greatest(length(target), n) AS sq, len(list_filter(ta, lambda q: list_contains(ca, q)))::BIGINT AS exact_chars FROM s),
y AS (SELECT *, greatest(ed, sq) AS similarity FROM x WHERE greatest(ed, sq) >= 0.5 AND exact_chars >= CASE WHEN length(target) <= 2 THEN length(target) ELSE greatest(2, ceil(length(target) * 0.5)) END),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY image_id, target, text, floor(l * 2 + 0.5), floor(r * 2 + 0.5) ORDER BY similarity DESC, exact_chars DESC, abs(n - length(target)), i, n) = 1)
SELECT image_id, target, row_number() OVER (PARTITION BY image_id, target ORDER BY similarity DESC, exact_chars DESC, abs(n - length(target)), i, n) AS rank, c AS candidate, similarity, exact_chars, i AS start_index FROM z QUALIFY rank <= 5
"""


#: Of three characters and more: one misreading of a short one is accepted only where it occurs twice.
RUN_TARGETS = ["blue", "small", "widget", "red", "hot"]


def _misread(name: str):
    """Every third name is read with wrong vowels, every fifth stands twice in its line."""
    text = F.when(F.col("p_partkey") % 3 == 0, F.translate(name, "uaeo", "nocu")).otherwise(F.col(name))
    return F.when(F.col("p_partkey") % 5 == 0, F.concat_ws(" ", text, text)).otherwise(text)


def _run(spark, sf_dir):
    images = _name_images(spark, sf_dir)
    targets = spark.createDataFrame([(w, w) for w in RUN_TARGETS], schemas.TARGETS)
    return pipeline.stages(images, targets, _name_lines(spark, sf_dir, _misread))


RUN_UNITS = UNITS.replace(
    "FROM part,",
    "FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN t || ' ' || t ELSE t END AS p_name FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN translate(p_name, 'uaeo', 'nocu') ELSE p_name END AS t FROM part)),",
)
# Near candidates as in near_topk, 60 a line; clusters, votes and acceptance follow.
RUN = f"""
WITH t(target) AS (VALUES {", ".join(f"('{w}')" for w in RUN_TARGETS)}),
u AS ({RUN_UNITS}),
l AS (SELECT image_id, string_agg(ch, '' ORDER BY unit_ix) AS text, list(x0 ORDER BY unit_ix) AS xs, list(x1 ORDER BY unit_ix) AS xe FROM u GROUP BY image_id),
o AS (SELECT image_id, target, xs, xe, unnest(generate_series(1, len(parts)::BIGINT - 1)) AS j, parts FROM (SELECT image_id, target, xs, xe, string_split(text, target) AS parts FROM l, t WHERE contains(text, target))),
exact AS (SELECT image_id, target, at_, xs[at_ + 1] AS x0, xe[at_ + length(target)] AS x1 FROM (SELECT *, (list_sum(list_transform(parts[1:j], lambda q: length(q))) + (j - 1) * length(target))::BIGINT AS at_ FROM o)),
w AS (SELECT image_id, target, text, i, n, substr(text, i + 1, n) AS c, xs, xe, xs[i + 1] AS l, xe[i + n] AS r FROM l, t, unnest(generate_series(0, length(text)::BIGINT - 1)) AS a(i), unnest(generate_series(greatest(1, length(target)::BIGINT - 2), length(target)::BIGINT + 2)) AS b(n) WHERE i + n <= length(text)),
s AS (SELECT *, string_split(target, '') AS ta, string_split(c, '') AS ca FROM w),
f AS (SELECT *, len(list_filter(ta, lambda q: list_contains(ca, q)))::BIGINT AS exact_chars FROM s WHERE len(list_filter(ta, lambda q: list_contains(ca, q))) >= greatest(2, ceil(length(target) * 0.5))),
x AS (SELECT *, greatest(1 - levenshtein(target, c)::DOUBLE / greatest(length(target), n), {LCS_LENGTH.format(a="ta", b="ca")}::DOUBLE / greatest(length(target), n)) AS similarity FROM f),
z AS (SELECT * FROM x WHERE similarity >= 0.5 QUALIFY row_number() OVER (PARTITION BY image_id, target, text, floor(l * 2 + 0.5), floor(r * 2 + 0.5) ORDER BY similarity DESC, exact_chars DESC, abs(n - length(target)), i, n) = 1),
near AS (SELECT *, row_number() OVER (PARTITION BY image_id, target ORDER BY similarity DESC, exact_chars DESC, abs(n - length(target)), i, n) AS rank FROM z QUALIFY rank <= 60),
fold AS (SELECT image_id, target, list_reduce(list_transform(b, lambda v: [v]), lambda acc, b: {GROUP_STEP.replace("'n': g.n + 1", "'n': list_concat(g.n, b[1].n)")}) AS gs
    FROM (SELECT image_id, target, list({{'x0': l, 'y0': 25.0::DOUBLE, 'x1': r, 'y1': 31.0::DOUBLE, 'n': [rank]}} ORDER BY rank) AS b FROM near WHERE similarity < 0.999 GROUP BY ALL)),
aged AS (SELECT image_id, target, generate_subscripts(gs, 1) AS age, unnest(gs) AS g FROM fold),
member AS (SELECT image_id, target, age, g.x0 AS gx0, g.x1 AS gx1, unnest(g.n) AS rank FROM aged),
m AS (SELECT member.*, c, similarity, l, r, i, n, xs, xe, exact_chars FROM member JOIN near USING (image_id, target, rank)),
ranked AS (SELECT image_id, target, age, row_number() OVER (PARTITION BY image_id, target ORDER BY max(similarity) DESC, age) - 1 AS group_ix FROM m GROUP BY image_id, target, age),
g AS (SELECT m.*, group_ix, length(target) = 3 AND length(c) = 3 AND levenshtein(target, c) = 1 AND similarity >= 0.66::DOUBLE AS votes FROM m JOIN ranked USING (image_id, target, age)),
spots AS (SELECT image_id, target, c, count(DISTINCT group_ix) AS spots FROM g WHERE votes GROUP BY ALL),
open AS (SELECT * FROM g WHERE group_ix < 8 AND NOT EXISTS (SELECT 1 FROM exact e WHERE e.image_id = g.image_id AND e.target = g.target AND abs((gx0 + gx1) / 2 - (e.x0 + e.x1) / 2) <= greatest(24, greatest(gx1 - gx0, e.x1 - e.x0, 1) * 0.55::DOUBLE))),
able AS (SELECT *, levenshtein(target, c) AS distance, count(*) FILTER (votes) OVER (PARTITION BY image_id, target, group_ix, c) AS same_spot FROM open WHERE length(c) = length(target) AND length(target) >= 3 AND levenshtein(target, c) <= 1),
strong AS (SELECT able.*, count(*) OVER (PARTITION BY image_id, target, group_ix) AS strong_count FROM able LEFT JOIN spots USING (image_id, target, c)
    WHERE CASE WHEN length(target) = 3 THEN votes AND (same_spot >= 2 OR coalesce(spots, 0) >= 2) ELSE similarity >= 0.72::DOUBLE END),
accepted AS (SELECT * FROM strong QUALIFY row_number() OVER (PARTITION BY image_id, target, group_ix ORDER BY CASE WHEN length(target) = 3 THEN 0 ELSE distance END, similarity DESC, rank) = 1)
"""
FAST_RECOVERY = RUN + "SELECT image_id, target AS target_id, c AS candidate, distance::BIGINT AS distance, similarity, strong_count FROM accepted"
DETECT_AND_COVER = (
    RUN
    + """,
box AS (SELECT image_id, target, 0 AS s, at_ AS o, x0 AS x, x1 - x0 AS w, 'OCR' AS source FROM exact UNION ALL SELECT image_id, target, 1, group_ix, l, r - l, '近似候補救出' FROM accepted),
kept AS (SELECT image_id, target, list_reduce(list_transform(b, lambda v: [v]), lambda acc, v: CASE WHEN len(list_filter(acc, lambda q: least(q.w, v[1].w) > 0 AND
  greatest(0, least(q.x + q.w, v[1].x + v[1].w) - greatest(q.x, v[1].x)) / least(q.w, v[1].w) > 0.45::DOUBLE)) > 0 THEN acc ELSE list_append(acc, v[1]) END) AS k
  FROM (SELECT image_id, target, list({'x': x, 'w': w, 'source': source} ORDER BY s, o) AS b FROM box GROUP BY ALL)),
p AS (SELECT image_id, target, generate_subscripts(k, 1) - 1 AS stamp_ix, unnest(k) AS b FROM kept),
e AS (SELECT image_id, target, stamp_ix, b.source AS source, greatest(0, floor(b.x - 2 + 0.5)) AS x0, least(400, floor(b.x + b.w + 2 + 0.5)) AS x1 FROM p)
SELECT image_id, target AS target_id, stamp_ix::BIGINT AS stamp_ix, source, x0::DOUBLE AS x, 23.0::DOUBLE AS y, greatest(1, x1 - x0)::DOUBLE AS w, 10.0::DOUBLE AS h FROM e"""
)

LADDER = "(VALUES (0, 'source', 7, false), (1, 'ocr', 7, false), (2, 'source', 8, true), (3, 'bin180', 7, false), (4, 'bin220', 7, false), (5, 'invert', 7, false)) AS v(attempt, variant, psm, weak)"
REFINE_REQUESTS = (
    RUN
    + f""",
best AS (SELECT * FROM open WHERE NOT EXISTS (SELECT 1 FROM accepted a WHERE a.image_id = open.image_id AND a.target = open.target AND a.group_ix = open.group_ix) QUALIFY row_number() OVER (PARTITION BY image_id, target, group_ix ORDER BY similarity DESC, rank) = 1),
pad AS (SELECT *, greatest(30, floor((r - l) * 2 * 0.65::DOUBLE + 0.5)) / 2 AS px, xs[greatest(0, i - 2) + 1] AS a0, xe[least(len(xs), i + n + 2)] AS a1 FROM best),
crop AS (SELECT *, variant = 'ocr' AS page, greatest(0, floor(CASE WHEN variant = 'ocr' THEN 2 * (a0 - px) ELSE a0 - px END)) AS x0, least(CASE WHEN variant = 'ocr' THEN 1000 ELSE 400 END, ceil(CASE WHEN variant = 'ocr' THEN 2 * (a1 + px) ELSE a1 + px END)) AS x1 FROM pad, {LADDER})
SELECT image_id || '/' || target || '/' || group_ix || '/' || attempt AS request_id, variant, psm::BIGINT AS psm, x0::DOUBLE AS x0, CASE WHEN page THEN 20 ELSE 10 END::DOUBLE AS y0, x1::DOUBLE AS x1, CASE WHEN page THEN 92 ELSE 46 END::DOUBLE AS y1 FROM crop WHERE x1 > x0 AND (NOT weak OR similarity < 0.7::DOUBLE OR exact_chars <= 2)"""
)
_COUNTED = {
    "matches": "exact", "near": "near", "groups": "ranked", "open": "(SELECT DISTINCT image_id, target, group_ix FROM open)", "accepted": "accepted", "boxes": "p", "stamps": "p",
}
# The run up to the stamps.
_HEAD = DETECT_AND_COVER[: DETECT_AND_COVER.index("SELECT image_id, target AS target_id, stamp_ix")]
STAGE_METRICS = _HEAD + " UNION ALL ".join(
    f"SELECT image_id, target AS target_id, '{stage}' AS stage, count(*) AS rows FROM {name} GROUP BY ALL" for stage, name in _COUNTED.items()
)
_SKIPPED = "(SELECT * FROM ranked r WHERE group_ix < 8 AND NOT EXISTS (SELECT 1 FROM open q WHERE q.image_id = r.image_id AND q.target = r.target AND q.group_ix = r.group_ix))"
_COUNTERS = {"'hits'": "exact", "'near'": "near", "'groups'": "ranked", "'groups_skipped'": _SKIPPED, "'groups_recovered'": "accepted", "'covered:' || source": "e"}
RUN_COUNTERS = _HEAD + " UNION ALL ".join(f"SELECT image_id, target AS target_id, {name} AS counter, count(*)::BIGINT AS value FROM {rows} GROUP BY ALL" for name, rows in _COUNTERS.items())
RUN_OVERLAY = (
    _HEAD
    + """SELECT image_id, target AS target_id, stamp_ix::BIGINT AS stamp_ix, x0::DOUBLE AS x, greatest(1, x1 - x0)::DOUBLE AS w, CASE source WHEN 'OCR' THEN '#22aa55' ELSE '#8e44ad' END AS color, source || ': ' || target AS label FROM e"""
)
GROUP_SUMMARY = (
    RUN
    + """SELECT image_id, target AS target_id, group_ix, arg_min(c, (1 - similarity, rank)) AS candidate, max(similarity) AS similarity, count(*) AS candidate_count, 1::BIGINT AS mode_count, any_value(gx0) AS x0, any_value(gx1) AS x1 FROM g GROUP BY image_id, target, group_ix"""
)


def group_summary(spark, sf_dir):
    g = groups.summary(_run(spark, sf_dir)["groups"])
    long = lambda c: F.col(c).cast("long").alias(c)
    return g.select("image_id", "target_id", long("group_ix"), "best.candidate", "best.similarity", long("candidate_count"), long("mode_count"), "box.x0", "box.x1")


def flatten_pages(spark, sf_dir):
    """Lines of a page that was read with an offset; two symbols in turn carry the label of both, and every seventh part's second symbols stand too far left."""
    p = spread(table(spark, sf_dir, "part"))
    ws = F.split(F.col("p_name"), " ")
    start = lambda i: F.aggregate(F.slice(ws, F.lit(1), i), F.lit(0), lambda a, w: a + F.length(w) + 1) * 10.0 + 5
    box = lambda a, b: F.struct(a.cast("double").alias("x0"), F.lit(53.0).alias("y0"), b.cast("double").alias("x1"), F.lit(66.0).alias("y1"))

    def word(w, i):
        def symbol(c, j):
            left = F.when((F.col("p_partkey") % 7 == 0) & (j == 1), F.lit(-6)).otherwise(F.lit(0))
            return F.struct(F.substring(w, j - j % 2 + 1, F.lit(2)).alias("text"), box(start(i) + j * 10 + left, start(i) + j * 10 + 9).alias("bbox"))

        return F.struct(w.alias("text"), box(start(i), start(i) + F.length(w) * 10 - 1).alias("bbox"), F.transform(F.split(w, ""), symbol).alias("symbols"))

    lines = F.array(F.struct(F.transform(F.filter(ws, lambda w: w != ""), word).alias("words")))
    pages = p.select(F.col("p_partkey").cast("string").alias("image_id"), F.lit("color").alias("pass"), F.lit(1).alias("pass_ix"), F.lit(2.5).alias("scale"), F.lit(5.0).alias("off_x"), F.lit(3.0).alias("off_y"), F.col("p_name").alias("text"), lines.alias("lines"))
    u = units.line_units(pages).select("image_id", F.posexplode("units").alias("unit_ix", "u"))
    return u.select("image_id", F.col("unit_ix").cast("long").alias("unit_ix"), "u.ch", "u.bbox_source", "u.bbox.x0", "u.bbox.y0", "u.bbox.x1", "u.bbox.y1")


FLATTEN_PAGES = """
WITH w AS (SELECT p_partkey, i, string_split(p_name, ' ') AS ws FROM part, unnest(generate_series(1, len(string_split(p_name, ' ')))) AS s(i)),
v AS (SELECT p_partkey, i, ws[i] AS word, coalesce(list_sum(list_transform(ws[1:i - 1], lambda q: length(q) + 1)), 0) * 10 AS at_ FROM w),
c AS (SELECT p_partkey, i, j, at_, word, substr(word, (j - j % 2 + 1)::BIGINT, 2) AS label, p_partkey % 7 = 0 AND length(word) > 1 AS broken FROM v, unnest(generate_series(0, length(word)::BIGINT - 1)) AS s(j)),
n AS (SELECT *, coalesce(label <> lag(label) OVER k, true) AS fresh FROM c WINDOW k AS (PARTITION BY p_partkey, i ORDER BY j)),
r AS (SELECT *, j - max(CASE WHEN fresh THEN j END) OVER (PARTITION BY p_partkey, i ORDER BY j ROWS UNBOUNDED PRECEDING) AS place FROM n)
SELECT p_partkey::VARCHAR AS image_id, row_number() OVER (PARTITION BY p_partkey ORDER BY i, j) - 1 AS unit_ix,
  CASE WHEN broken THEN substr(word, j + 1, 1) WHEN length(label) > 1 THEN substr(label, least(place, length(label) - 1)::BIGINT + 1, 1) ELSE label END AS ch, CASE WHEN broken THEN 'word-split' ELSE 'symbol' END AS bbox_source,
  (CASE WHEN broken THEN at_ + (length(word) * 10 - 1)::DOUBLE * j / length(word) ELSE at_ + j * 10 END) / 2.5::DOUBLE AS x0, 50 / 2.5::DOUBLE AS y0,
  (CASE WHEN broken THEN at_ + (length(word) * 10 - 1)::DOUBLE * (j + 1) / length(word) ELSE at_ + j * 10 + 9 END) / 2.5::DOUBLE AS x1, 63 / 2.5::DOUBLE AS y1 FROM r
"""


def pointer_points(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    d = lambda c, m: (F.col(c) % m).cast("double")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    at = edits.canvas_point(d("o_custkey", 400), d("o_orderkey", 300), F.lit(12.0), F.lit(7.0), F.lit(0.5), F.lit(0.25), F.col("o_orderkey") % 2 == 0)
    s = edits.pointer_summary(F.array(point(d("o_custkey", 50), d("o_orderkey", 40)), point(d("o_orderkey", 33), d("o_custkey", 21))))
    return o.select("o_orderkey", at.alias("p"), s.alias("s")).select("o_orderkey", "p.x", "p.y", "s.distance", F.col("s.x").alias("cx"), F.col("s.y").alias("cy"))


POINTER_POINTS = """
WITH o AS (SELECT o_orderkey, (o_custkey % 400)::DOUBLE AS px, (o_orderkey % 300)::DOUBLE AS py, o_custkey % 50 AS ax, o_orderkey % 40 AS ay, o_orderkey % 33 AS bx, o_custkey % 21 AS by_ FROM orders)
SELECT o_orderkey, (px - 12) / 0.5::DOUBLE AS x, (py - 7 - CASE WHEN o_orderkey % 2 = 0 THEN 40 ELSE 0 END) / 0.25::DOUBLE AS y, sqrt(((ax - bx) * (ax - bx) + (ay - by_) * (ay - by_))::DOUBLE) AS distance, (ax + bx)::DOUBLE / 2 AS cx, (ay + by_)::DOUBLE / 2 AS cy FROM o
"""


def edit_sequences(spark, sf_dir):
    """A short log for each customer: a box drawn, moved, resized, another drawn or too small, one deleted, a step undone."""
    k = F.col("c_custkey")
    d = lambda c: c.cast("double")
    none = F.lit(None).cast("double")
    e = lambda seq, op, when=F.lit(True), x=none, y=none, w=none, h=none, dx=none, dy=none, handle=F.lit(None).cast("string"): F.when(when, F.struct(F.lit(seq).cast("long").alias("seq"), F.lit(op).alias("op"), x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), dx.alias("dx"), dy.alias("dy"), handle.alias("handle")))
    log = F.array(
        e(1, "add", x=d(k % 200), y=d(k % 100), w=d(10 + k % 50), h=d(8 + k % 30)),
        e(2, "move", dx=d(k * 7 % 121 - 60), dy=d(k * 11 % 91 - 45)),
        e(3, "resize", dx=d(k * 3 % 81 - 40), dy=d(k * 5 % 61 - 30), handle=F.get(F.array(*[F.lit(h) for h in ("nw", "ne", "sw", "se")]), (k % 4).cast("int"))),
        e(4, "add", x=F.lit(5.0), y=F.lit(5.0), w=F.when(k % 2 == 1, F.lit(6.0)).otherwise(F.lit(3.0)), h=F.lit(20.0)),
        e(5, "delete", k % 4 == 0),
        e(6, "undo", k % 3 == 0),
    )
    rows = spread(table(spark, sf_dir, "customer").select("c_custkey")).select(k.cast("string").alias("image_id"), F.filter(log, lambda x: x.isNotNull()).alias("log")).select("image_id", F.explode("log").alias("e"))
    rows = rows.select("image_id", "e.seq", "e.op", F.lit(0).alias("stamp_ix"), "e.x", "e.y", "e.w", "e.h", "e.dx", "e.dy", "e.handle", F.lit(None).cast(schemas.STYLE).alias("style"))
    images = rows.select("image_id").distinct().select("image_id", F.lit(300).alias("width"), F.lit(150).alias("height"))
    return edits.replay(rows, images).select("image_id", F.col("stamp_ix").cast("long").alias("stamp_ix"), "x", "y", "w", "h", "kind")


EDIT_SEQUENCES = """
WITH a AS (SELECT c_custkey AS k, c_custkey % 200 AS x, c_custkey % 100 AS y, 10 + c_custkey % 50 AS w, 8 + c_custkey % 30 AS h, c_custkey * 3 % 81 - 40 AS dx, c_custkey * 5 % 61 - 30 AS dy FROM customer),
m AS (SELECT k, dx, dy, w, h, greatest(0, least(300 - w, x + k * 7 % 121 - 60)) AS x, greatest(0, least(150 - h, y + k * 11 % 91 - 45)) AS y FROM a),
s AS (SELECT *, greatest(4, CASE WHEN k % 2 = 1 THEN w + dx ELSE w - dx END) AS nw, greatest(4, CASE WHEN k % 4 >= 2 THEN h + dy ELSE h - dy END) AS nh FROM m),
r AS (SELECT *, greatest(0, least(300 - nw, CASE WHEN k % 2 = 1 THEN x ELSE x + w - nw END)) AS nx, greatest(0, least(150 - nh, CASE WHEN k % 4 >= 2 THEN y ELSE y + h - nh END)) AS ny FROM s),
o AS (SELECT k, 0 AS ix, nx AS x, ny AS y, nw AS w, nh AS h FROM r WHERE k % 2 = 1 OR (k % 4 = 0 AND k % 3 = 0) OR (k % 4 = 2 AND k % 3 <> 0)
  UNION ALL SELECT k, 0, x, y, w, h FROM r WHERE k % 4 = 2 AND k % 3 = 0 UNION ALL SELECT k, 1, 5, 5, 6, 20 FROM r WHERE k % 2 = 1 AND k % 3 <> 0)
SELECT k::VARCHAR AS image_id, ix::BIGINT AS stamp_ix, x::DOUBLE AS x, y::DOUBLE AS y, w::DOUBLE AS w, h::DOUBLE AS h, 'manual' AS kind FROM o
"""


def detect_and_cover(spark, sf_dir):
    s = _run(spark, sf_dir)["stamps"]
    return s.select("image_id", "target_id", F.col("stamp_ix").cast("long").alias("stamp_ix"), "source", "x", "y", "w", "h")


def stage_metrics(spark, sf_dir):
    return metrics.stage_metrics(_run(spark, sf_dir))


def run_counters(spark, sf_dir):
    return metrics.counters(_run(spark, sf_dir))


def run_overlay(spark, sf_dir):
    return metrics.overlay(_run(spark, sf_dir)).select("image_id", "target_id", F.col("stamp_ix").cast("long").alias("stamp_ix"), "x", "w", "color", "label")


def refine_requests(spark, sf_dir):
    s = _run(spark, sf_dir)
    left = s["open"].join(s["accepted"].select("image_id", "target_id", "group_ix"), ["image_id", "target_id", "group_ix"], "left_anti")
    return rescue.refine_requests(left, _name_images(spark, sf_dir)).select("request_id", "variant", F.col("psm").cast("long").alias("psm"), "crop.x0", "crop.y0", "crop.x1", "crop.y1")


def fast_recovery(spark, sf_dir):
    return _run(spark, sf_dir)["accepted"].select("image_id", "target_id", "candidate", F.col("distance").cast("long").alias("distance"), "similarity", "strong_count")


def mru_history(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.concat_ws("-", "event_type", (F.col("event_id") % 11).cast("string")).alias("value"), F.col("event_id").alias("seq"))
    h = history.recent_targets(e, ["user_id"])
    return h.select("user_id", "value", "last_seq", F.col("position").cast("long").alias("position"))


def preferences(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("text", F.when(F.col("event_id") % 5 == 0, F.lit("{broken")).when(F.col("event_id") % 7 == 0, F.lit(None).cast("string")).otherwise(F.col("props")))
    got = history.read_json(F.col("text"), "k bigint", F.struct(F.lit(-1).cast("long").alias("k")))
    return e.select("event_id", got["k"].alias("k"), history.write_json(F.struct(got["k"].alias("k"))).alias("saved"))


def hit_tests(spark, sf_dir):
    b = _boxes(spark, sf_dir).select(F.col("k").alias("image_id"), (F.col("ord") - 1).alias("stamp_ix"), (F.col("x") * 5).alias("x"), (F.col("y") * 5).alias("y"), "w", "h")
    points = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"), F.col("o_orderkey").alias("point_id"), (F.col("o_custkey") % 300).cast("double").alias("x"), (F.col("o_orderkey") % 150).cast("double").alias("y"))
    h = edits.hit_test_rows(points, b, 12.0)
    return h.select("image_id", F.col("stamp_ix").cast("long").alias("stamp_ix"), "kind", "handle")


HIT_TESTS = f"""
WITH s AS (SELECT k, ord - 1 AS ix, x * 5 AS x, y * 5 AS y, w, h FROM ({BOXES})),
p AS (SELECT o_orderkey AS k, (o_custkey % 300)::DOUBLE AS px, (o_orderkey % 150)::DOUBLE AS py FROM orders),
c AS (SELECT p.k, ix, name, o, sqrt(power(px - x - a * w, 2) + power(py - y - b * h, 2)) AS d, px >= x - 12 AND px <= x + w + 12 AND py >= y - 12 AND py <= y + h + 12 AS inside
    FROM p JOIN s USING (k), (VALUES ('nw', 0, 0, 0), ('ne', 1, 1, 0), ('sw', 2, 0, 1), ('se', 3, 1, 1)) AS q(name, o, a, b)),
g AS (SELECT k, ix, 0 AS kind, d, name, o FROM c WHERE d <= 12 UNION ALL SELECT DISTINCT k, ix, 1, 0, NULL, 0 FROM c WHERE inside)
SELECT k AS image_id, ix::BIGINT AS stamp_ix, CASE kind WHEN 0 THEN 'resize' ELSE 'move' END AS kind, name AS handle FROM g
QUALIFY row_number() OVER (PARTITION BY k ORDER BY g.kind, d, ix DESC, o) = 1
"""


def median_heights(spark, sf_dir):
    b = _boxes(spark, sf_dir).groupBy("k").agg(F.collect_list(F.when(F.col("ord") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("w"))).alias("v"))
    return b.select("k", median_of(F.col("v")).alias("median"), median_or_zero(F.filter("v", lambda v: v > 40)).alias("high"))


def scan_grids(spark, sf_dir):
    a, b = F.col("p_size").cast("int"), (F.col("p_size") + F.col("p_partkey") % 90).cast("int")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(templates.scan_grids(a, b, 6, 3), ",").alias("positions"))


def scales(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (300 + F.col("p_partkey") * 7 % 4000).alias("w"), (200 + F.col("p_partkey") * 13 % 5000).alias("h"))
    a = analysis_scale(F.col("w"), F.col("h"))
    p = p.withColumn("analysis", a).withColumns({"aw": scaled_size(F.col("w"), F.col("analysis")), "ah": scaled_size(F.col("h"), F.col("analysis"))})
    return p.select("p_partkey", "analysis", F.col("aw").cast("long").alias("aw"), F.col("ah").cast("long").alias("ah"), ocr_scale(F.col("aw"), F.col("ah")).alias("ocr"), template_scale(F.col("w"), F.col("h")).alias("template"))


def text_rules(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    name = F.concat_ws(".", F.substring("text", 1, 12), F.when(F.col("turn") % 2 == 0, F.lit("png")))
    return c.select("conv_id", "turn", ocr_language(F.col("text")).alias("language"), shorten(squeeze(F.col("text"))).alias("short"), output_name(F.regexp_replace(name, "\n", " ")).alias("file"))


QUERIES = {
    "norm_len_by_lang": norm_len_by_lang, "exact_hits": exact_hits, "near_pairs": near_pairs, "spatial_distinct": spatial_distinct, "proximity_anti": proximity_anti,
    "cluster_groups": cluster_groups, "vote_consensus": vote_consensus, "visual_rects": visual_rects, "manual_rects": manual_rects, "flatten_units": flatten_units,
    "near_topk": near_topk, "detect_and_cover": detect_and_cover, "stage_metrics": stage_metrics, "refine_requests": refine_requests, "fast_recovery": fast_recovery,
    "mru_history": mru_history, "preferences": preferences, "hit_tests": hit_tests, "median_heights": median_heights,
    "scan_grids": scan_grids, "scales": scales, "text_rules": text_rules, "group_summary": group_summary,
    "flatten_pages": flatten_pages, "pointer_points": pointer_points, "edit_sequences": edit_sequences,
    "run_counters": run_counters, "run_overlay": run_overlay,
} | pixel_queries.QUERIES | edit_queries.QUERIES | run_queries.QUERIES

ORACLES = {
    "norm_len_by_lang": f"SELECT lang, count(*) AS docs, sum(n)::BIGINT AS chars, max(n)::BIGINT AS longest FROM (SELECT lang, length({NORMAL.format('text')}) AS n FROM documents) GROUP BY lang",
    "exact_hits": f"""
WITH l AS (SELECT doc_id, {NORMAL.format('x')} AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents)),
t(target) AS (VALUES {", ".join(f"('{w}')" for w in TARGETS)})
SELECT doc_id, target, sum((length(l.t) - length(replace(l.t, target, ''))) // length(target))::BIGINT AS hits, count(*) AS lines FROM l JOIN t ON contains(l.t, target) GROUP BY ALL""",
    "near_pairs": f"""
WITH p AS (SELECT p_partkey, lower(p_name) AS n FROM part), b AS (SELECT p.p_partkey, p.n AS a, q.n AS b, string_split(p.n, '') AS ca, string_split(q.n, '') AS cb FROM p JOIN p q ON q.p_partkey = p.p_partkey + 1),
s AS (SELECT p_partkey, 1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)) AS edit_similarity, {LCS_LENGTH.format(a="ca", b="cb")}::DOUBLE / greatest(len(ca), len(cb)) AS sequence_similarity,
  len(list_filter(ca, lambda c: list_contains(cb, c)))::BIGINT AS exact_chars FROM b)
SELECT p_partkey, edit_similarity, sequence_similarity, greatest(edit_similarity, sequence_similarity) AS similarity, exact_chars FROM s""",
    "spatial_distinct": f"""
WITH g AS (SELECT k, list({{'ord': ord, 'x': x, 'y': y, 'w': w, 'h': h}} ORDER BY ord, x, y, w, h) AS b FROM ({BOXES}) GROUP BY k),
r AS (SELECT k, list_reduce(list_transform(b, lambda v: [v]), lambda acc, v: CASE WHEN len(list_filter(acc, lambda q: least(q.w * q.h, v[1].w * v[1].h) > 0 AND
  greatest(0, least(q.x + q.w, v[1].x + v[1].w) - greatest(q.x, v[1].x)) * greatest(0, least(q.y + q.h, v[1].y + v[1].h) - greatest(q.y, v[1].y)) / least(q.w * q.h, v[1].w * v[1].h) > 0.45::DOUBLE)) > 0
  THEN acc ELSE list_append(acc, v[1]) END) AS kept FROM g)
SELECT k, s.ord AS ord, s.x AS x, s.y AS y, s.w AS w, s.h AS h FROM (SELECT k, unnest(kept) AS s FROM r)""",
    "proximity_anti": f"""
WITH b AS (SELECT k, ord, flag, x * 4 AS x, y * 8 AS y, w, h FROM ({BOXES}))
SELECT k, ord FROM b a WHERE flag <> 'R' AND NOT EXISTS (SELECT 1 FROM b e WHERE e.k = a.k AND e.flag = 'R'
  AND abs(a.x + a.w / 2 - e.x - e.w / 2) <= greatest(24, greatest(a.w, e.w, 1) * 0.55::DOUBLE) AND abs(a.y + a.h / 2 - e.y - e.h / 2) <= greatest(24, greatest(a.h, e.h, 1) * 0.7::DOUBLE))""",
    "cluster_groups": f"""
WITH g AS (SELECT k, list({{'x0': x * 3, 'y0': y * 4, 'x1': x * 3 + w, 'y1': y * 4 + h, 'n': 1}} ORDER BY ord, x, y, w, h) AS b FROM ({BOXES}) GROUP BY k),
r AS (SELECT k, list_reduce(list_transform(b, lambda v: [v]), lambda acc, b: {GROUP_STEP}) AS gs FROM g),
u AS (SELECT k, generate_subscripts(gs, 1) - 1 AS age, unnest(gs) AS s FROM r)
SELECT k, age::BIGINT AS age, s.x0 AS x0, s.y0 AS y0, s.x1 AS x1, s.y1 AS y1, s.n::BIGINT AS members FROM u""",
    "vote_consensus": """
SELECT o_custkey AS image_id, ['abd', 'abe', 'xbc', 'ab', 'abcd', 'abc', 'axx'][o_orderkey % 7 + 1] AS candidate, count(DISTINCT (o_orderkey // 7) % 5) AS spots FROM orders WHERE o_orderkey % 7 < 3 GROUP BY ALL""",
    "visual_rects": VISUAL,
    "manual_rects": f"""
SELECT k, ord, greatest(0, x - p - 6) AS x, greatest(0, y - p - 2) AS y, w + p AS w, h + 2 * (p + 2) AS h FROM (SELECT *, greatest(4, floor(least(w, h) * 0.12::DOUBLE + 0.5)) AS p FROM ({BOXES}))""",
    "flatten_units": UNITS,
    "near_topk": NEAR_TOPK,
    "detect_and_cover": DETECT_AND_COVER,
    "fast_recovery": FAST_RECOVERY,
    "refine_requests": REFINE_REQUESTS,
    "stage_metrics": STAGE_METRICS,
    "run_counters": RUN_COUNTERS,
    "run_overlay": RUN_OVERLAY,
    "group_summary": GROUP_SUMMARY,
    "flatten_pages": FLATTEN_PAGES,
    "pointer_points": POINTER_POINTS,
    "edit_sequences": EDIT_SEQUENCES,
    "mru_history": """
SELECT user_id, value, max(event_id) AS last_seq, row_number() OVER (PARTITION BY user_id ORDER BY max(event_id) DESC, value) AS position
FROM (SELECT user_id, event_id, concat_ws('-', event_type, (event_id % 11)::VARCHAR) AS value FROM events) GROUP BY user_id, value QUALIFY position <= 5""",
    "preferences": """
SELECT event_id, k, '{"k":' || k || '}' AS saved FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 OR props IS NULL THEN -1 ELSE (props::JSON ->> 'k')::BIGINT END AS k FROM events)""",
    "hit_tests": HIT_TESTS,
    "median_heights": f"SELECT k, median(w) FILTER (ord % 4 <> 0) AS median, coalesce(median(w) FILTER (ord % 4 <> 0 AND w > 40), 0) AS high FROM ({BOXES}) GROUP BY k",
    "scan_grids": """
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_append(range(p_size + 3, p_size + p_partkey % 90 + 1, 6), p_size + p_partkey % 90))), ',') AS positions FROM part""",
    "scales": """
WITH p AS (SELECT p_partkey, (300 + p_partkey * 7 % 4000)::DOUBLE AS w, (200 + p_partkey * 13 % 5000)::DOUBLE AS h FROM part),
a AS (SELECT *, least(1, 1000 / w, sqrt(2.5e6 / (w * h))) AS s, least(1, 900 / w, sqrt(1.8e6 / (w * h))) AS t FROM p),
b AS (SELECT *, CASE WHEN s >= 0.995 THEN 1 ELSE s END AS analysis, CASE WHEN t >= 0.995 THEN 1 ELSE greatest(1, floor(w * t + 0.5)) / w END AS template FROM a),
c AS (SELECT *, greatest(1, floor(w * analysis + 0.5)) AS aw, greatest(1, floor(h * analysis + 0.5)) AS ah FROM b)
SELECT p_partkey, analysis, aw::BIGINT AS aw, ah::BIGINT AS ah, greatest(1.8, least(2.5, sqrt(11e6 / (aw * ah)))) AS ocr, template FROM c""",
    "text_rules": r"""
WITH c AS (SELECT conv_id, turn, text, regexp_replace(text, '\s+', ' ', 'g') AS s, replace(substr(text, 1, 12) || CASE WHEN turn % 2 = 0 THEN '.png' ELSE '' END, chr(10), ' ') AS f FROM conversations)
SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]') THEN 'jpn' ELSE 'eng' END AS language, CASE WHEN length(s) > 55 THEN substr(s, 1, 55) || '…' ELSE s END AS short,
  coalesce(nullif(regexp_replace(f, '\.[^.]+$', ''), ''), 'redacted') || '_redacted.png' AS file FROM c""",
} | pixel_queries.ORACLES | edit_queries.ORACLES | run_queries.oracles(UNITS, GROUP_STEP, LCS_LENGTH)
