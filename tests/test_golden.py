"""Hand-computed cases: rectangles, fuzzy scores, suppression, scales, pixels, units."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkveil.functions import numbers, rects, schemas, text
from inkveil.operators import match, raster, units
from inkveil.operators.suppress import suppress

SYMBOLS = f"array<{schemas.UNIT}>"


def unit(ch, x0, y0, x1, y1, source="symbol"):
    return (ch, (float(x0), float(y0), float(x1), float(y1)), ch, source)


RECTS = [
    ("G1", [unit("ね", 100, 50, 120, 72), unit("る", 121, 50, 140, 72)], "OCR", (96, 48, 44, 26)),
    ("G2", [unit("ね", 100, 50, 109, 72), unit("る", 110, 50, 120, 72)], "OCR", (79, 48, 48, 26)),
    ("G3", [unit("ね", 100, 50, 140, 72, "word-split"), unit("る", 140, 50, 180, 72, "word-split")], "OCR", (96, 48, 57, 26)),
    ("G4", [unit("ね", 100, 40, 120, 90), unit("る", 121, 40, 141, 90)], "局所OCR", (96, 51, 45, 28)),
    ("G5", [unit("b", 10, 10, 22, 30), unit("o", 23, 10, 36, 30), unit("b", 37, 10, 50, 30)], "OCR", (8, 8, 44, 24)),
    ("G6", [unit("ね", 100, 50, 130, 72), unit("る", 131, 50, 165, 72)], "OCR", (96, 48, 49, 26)),
]


def test_visual_rects(spark):
    df = spark.createDataFrame([(i, (0.0, 0.0, 1.0, 1.0), s, o) for i, s, o, _ in RECTS], f"id string, box struct<x:double,y:double,w:double,h:double>, symbols {SYMBOLS}, source string")
    got = {r.id: tuple(r.rect) for r in rects.add_visual_rect(df, F.col("box"), F.col("symbols"), F.col("source"), F.lit(1000), F.lit(800)).collect()}
    assert got == {i: tuple(map(float, want)) for i, _, _, want in RECTS}


def test_manual_rects(spark):
    df = spark.createDataFrame([((100.0, 50.0, 40.0, 20.0),), ((100.0, 50.0, 200.0, 80.0),)], "b struct<x:double,y:double,w:double,h:double>")
    assert [tuple(r[0]) for r in df.select(rects.manual_rect(F.col("b"))).collect()] == [(90, 44, 44, 32), (84, 38, 210, 104)]


@pytest.mark.parametrize(
    "target,candidate,distance,edit,seq,exact,least,near",
    [
        ("ゆーざー", "めーざー", 1, 0.75, 0.75, 3, 2, True),
        ("ゆーざー", "ゆーゴー", 1, 0.75, 0.75, 3, 2, True),
        ("コカゲ", "コカグ", 1, 2 / 3, 2 / 3, 2, 2, True),
        ("ねる", "ねこ", 1, 0.5, 0.5, 1, 2, False),
        ("あ", "あい", 1, 0.5, 0.5, 1, 1, True),
        ("ねる", "ねる", 0, 1, 1, 2, 2, True),
    ],
)
def test_fuzzy(spark, target, candidate, distance, edit, seq, exact, least, near):
    t, c = F.col("t"), F.col("c")
    r = spark.createDataFrame([(target, candidate)], "t string, c string").withColumns(text.near_scores(t, c)).select("*", F.levenshtein(t, c).alias("d"), text.least_shared(t).alias("least"), text.is_near(t).alias("near")).first()
    assert (r.d, r.exact_chars, r.least, r.near) == (distance, exact, least, near)
    assert r.edit_similarity == pytest.approx(edit) and r.sequence_similarity == pytest.approx(seq)


BOXES = [
    ([(0, 0, 10, 10), (5, 0, 10, 10), (10, 0, 10, 10)], 0.45, [0, 2]),
    ([(5, 0, 10, 10), (0, 0, 10, 10), (10, 0, 10, 10)], 0.45, [0]),
    ([(0, 0, 10, 10), (5.5, 0, 10, 10)], 0.45, [0, 1]),
    ([(0, 0, 10, 0), (0, 0, 10, 10), (0, 0, 10, 0)], 0.45, [0, 1, 2]),
]


@pytest.mark.parametrize("boxes,rule,kept", BOXES)
def test_suppression(spark, boxes, rule, kept):
    df = spark.createDataFrame([("k", i, *map(float, b)) for i, b in enumerate(boxes)], "k string, ord int, x double, y double, w double, h double")
    assert sorted(r.ord for r in suppress(df, ["k"], ["ord"], rule).collect()) == kept
    assert sorted(r.ord for r in suppress(df, ["k"], ["ord"], rule, limit=1).collect()) == kept[:1]


def test_scales(spark):
    df = spark.createDataFrame([(1170, 2532), (800, 600), (1003, 500), (3000, 4000)], "w int, h int")
    a = df.withColumn("s", numbers.analysis_scale(F.col("w"), F.col("h")))
    a = a.withColumns({"aw": numbers.scaled_size(F.col("w"), F.col("s")), "ah": numbers.scaled_size(F.col("h"), F.col("s"))})
    got = [(round(r.s, 6), r.aw, r.ah, round(r.o, 6)) for r in a.select("*", numbers.ocr_scale(F.col("aw"), F.col("ah")).alias("o")).collect()]
    assert got == [(0.854701, 1000, 2164, 2.254591), (1, 800, 600, 2.5), (1, 1003, 500, 2.5), (0.333333, 1000, 1333, 2.5)]


def test_pixels():
    p = np.array([[[200, 100, 50, 255]]], np.uint8)
    value = lambda name: tuple(raster.VARIANTS[name](p)[0, 0, :3].tolist())
    assert [value(v) for v in ("gray", "contrast", "color", "bin180", "invert")] == [(124,) * 3, (122,) * 3, (124,) * 3, (0,) * 3, (55, 155, 205)]


def word(t, box, symbols):
    return (t, tuple(map(float, box)), [(c, tuple(map(float, b))) for c, b in symbols])


def page(*lines, scale=1.0, off=(0.0, 0.0), image="i", ix=0):
    return (image, "contrast", ix, scale, *off, "", [(list(ws),) for ws in lines])


def test_units(spark):
    lone = word("㍻", (0, 0, 10, 10), [("㍻", (0, 0, 10, 10))])
    bad = word("ねる", (100, 50, 140, 72), [("ね", (100, 50, 120, 72)), ("る", (121, 50, 121, 72))])
    run = word("㍻㍻", (0, 0, 21, 10), [("㍻", (0, 0, 10, 10)), ("㍻", (11, 0, 21, 10))])
    df = spark.createDataFrame([page([lone], [bad], [run], []), page([bad], scale=2.0, off=(10.0, 20.0), image="j"), ("k", "contrast", 0, 1.0, 0.0, 0.0, None, None)], schemas.OCR_PAGES)
    got = {(r.image_id, r.line_ix): (r.text, [(u.ch, tuple(u.bbox), u.bbox_source) for u in r.units]) for r in units.line_units(df).collect()}
    assert got[("i", 0)][0] == "平" and got[("i", 2)][0] == "平成"
    assert got[("i", 1)][1] == [("ね", (100, 50, 120, 72), "word-split"), ("る", (120, 50, 140, 72), "word-split")]
    assert got[("j", 0)][1][0][1] == (45, 15, 55, 26)
    assert len(got) == 4


def test_exact_search_does_not_overlap(spark):
    w = word("ababa", (0, 0, 50, 10), [(c, (10 * i, 0, 10 * i + 9, 10)) for i, c in enumerate("ababa")])
    lines = units.line_units(spark.createDataFrame([page([w])], schemas.OCR_PAGES))
    hits = match.exact_matches(lines, match.normal_targets(spark.createDataFrame([("t", "A.b a"), ("none", "!")], schemas.TARGETS))).collect()
    assert [(h.at, tuple(h.box)) for h in hits] == [(0, (0, 0, 29, 10))]


@pytest.mark.parametrize("raw,want", [("Ａｂ－Ｃ ー々〇・!", "abcー々〇"), (None, ""), ("ｶﾞ", "ガ"), ("é", "é"), ("é", "é"), ("x̵", "x")])
def test_normalize(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "s string").select(text.normalize(F.col("s")).alias("n"))
    assert df.first().n == want
