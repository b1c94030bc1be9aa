"""Drawing a string from glyphs, slanting it, and templates of it."""

import numpy as np
import pytest

from inkveil.operators import glyphs, templates


def glyph(width, height, value=255):
    a = np.zeros((height, width, 4), np.uint8)
    a[..., 3] = value
    return a


def test_glyphs_stand_side_by_side():
    a, b = glyph(3, 2, 200), glyph(2, 4, 90)
    got = glyphs.line([(a, 4), (b, 2)])[..., 3]
    assert got.tolist() == [[200, 200, 200, 0, 90, 90]] * 2 + [[0, 0, 0, 0, 90, 90]] * 2
    over = glyphs.line([(a, 2), (b, 2)])[..., 3]
    assert over[0].tolist() == [200, 200, 200, 90]


@pytest.mark.parametrize("skew,rows", [(0.0, [[8, 8, 0]] * 3), (1.0, [[8, 8, 0, 0, 0], [0, 8, 8, 0, 0], [0, 0, 8, 8, 0]]), (0.5, [[8, 8, 0, 0], [4, 8, 4, 0], [0, 8, 8, 0]]), (-1.0, [[0, 0, 8, 8, 0], [0, 8, 8, 0, 0], [8, 8, 0, 0, 0]])])
def test_slant(skew, rows):
    assert glyphs.slanted(glyph(2, 3, 8), skew)[..., 3].tolist() == rows


def test_templates_of_targets(spark):
    table = spark.createDataFrame([(c, w, 6, w + 1, bytearray(glyph(w, 6).tobytes())) for c, w in (("a", 3), ("b", 5))], "ch string, width int, height int, advance int, data binary")
    targets = spark.createDataFrame([("1", "ab"), ("2", "ba"), ("3", "abc"), ("4", "a")], "target_id string, target string")
    variants = spark.createDataFrame([(12, 0.0), (6, 0.5)], "target_height int, skew double")
    got = {(r.target_id, r.target_height): r for r in glyphs.draw_templates(targets, table, variants).collect()}
    assert set(got) == {(t, h) for t in ("1", "2", "4") for h in (12, 6)}  # no glyph for c
    assert (got["1", 12].w, got["1", 12].h) == (18, 12) and (got["4", 6].w, got["4", 6].skew) == (6, 0.5)
    want = templates.make_template(glyphs.slanted(glyphs.line([(glyph(5, 6), 6), (glyph(3, 6), 4)]), 0.5), 6, 0.5)
    assert [(p.x, p.y) for p in got["2", 6].samples] == want["samples"] and want["bg_samples"]
