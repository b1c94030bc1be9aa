"""Template search: bit planes against point by point counts, grids, overlap rules, one plane an image."""

import numpy as np
import pytest

from inkveil.functions import schemas
from inkveil.functions.config import CONFIG
from inkveil.operators import raster, templates

ASKED = "image_id string, target_id string, templates array<struct<target_height:int,skew:double,w:int,h:int,samples:array<struct<x:int,y:int>>,bg_samples:array<struct<x:int,y:int>>>>, existing array<struct<x:double,y:double,w:double,h:double>>, regions array<struct<x:double,y:double,w:double,h:double>>"


def template(rng, w, h, n):
    points = lambda: [(int(rng.integers(w)), int(rng.integers(h))) for _ in range(n)]
    return {"w": w, "h": h, "samples": points(), "bg_samples": points(), "target_height": h, "skew": 0.0}


@pytest.mark.parametrize("w,h,n", [(5, 4, 9), (63, 8, 165), (64, 8, 60), (65, 9, 60), (150, 12, 300), (20, 10, 0)])
def test_bit_counts_equal_point_by_point(w, h, n):
    rng = np.random.default_rng(w)
    grey = rng.integers(0, 256, (40, 230), dtype=np.uint8)
    t = template(rng, w, h, n)
    xs, ys = np.arange(0, 230 - w + 1, 3), np.arange(0, 40 - h + 1, 2)
    got = templates.Plane(grey).score(xs, ys, t)
    for k, y in enumerate(ys):
        for i, x in enumerate(xs):
            f = sum(CONFIG.gray_text[0] <= grey[y + b, x + a] <= CONFIG.gray_text[1] for a, b in t["samples"]) / max(1, n)
            g = sum(grey[y + b, x + a] <= CONFIG.gray_background for a, b in t["bg_samples"]) / max(1, n)
            assert (got[0][k, i], got[1][k, i], got[2][k, i]) == (f * 0.72 + g * 0.28, f, g)


@pytest.mark.parametrize("boxes,kept", [([(0, 0, 10, 10), (5.5, 0, 10, 10)], 1), ([(0, 0, 10, 10), (6.5, 0, 10, 10)], 2)])
def test_candidates_overlap_strictly(boxes, kept):
    assert len(templates.suppress([{**dict(zip("xywh", b)), "score": 1 - k / 10} for k, b in enumerate(boxes)], 9)) == kept


def test_covered_boxes_overlap_at_the_threshold():
    box = lambda *b: dict(zip("xywh", b))
    assert templates.overlaps_box(6.5, 0, 10, 10, box(0, 0, 10, 10)) and not templates.overlaps_box(6.6, 0, 10, 10, box(0, 0, 10, 10))
    assert not templates.overlaps_box(0, 0, 10, 10, box(0, 0, 10, 0)) and not templates.overlaps_box(10, 0, 10, 10, box(0, 0, 10, 10))
    asked, free = templates.open_positions([0, 100], [0, 50], 10, 10, [box(90, 0, 20, 10)], [box(100, 0, 10, 10)])
    assert asked.tolist() == [[False, True], [False, False]] and free.tolist() == [[False, False], [False, False]]
    asked, free = templates.open_positions([0, 100], [0], 10, 10, [], [])
    assert asked.all() and free.all()


def test_an_image_meets_its_pixels_once_for_all_targets(spark):
    rng = np.random.default_rng(8)
    a = np.full((120, 200, 4), 20, np.uint8)
    shape = [(i, j) for i in range(0, 40, 2) for j in (0, 6, 12)]
    ground = [(i, j) for i in range(1, 40, 3) for j in (3, 9)]
    for x, y in ((60, 40), (120, 80)):
        for i, j in shape:
            a[y + j, x + i, :3] = 150
    images = spark.createDataFrame([("i", "p", 200, 120, bytearray(a.tobytes()))], schemas.IMAGES)
    t = (14, 0.0, 40, 14, shape, ground)
    asked = [("i", f"t{k}", [t], [], []) for k in range(100)] + [("i", "none", [(14, 0.0, 40, 14, [(int(v), 0) for v in rng.integers(40, size=20)], [(1, 5)])], [], [])]
    found = templates.rescue_search(images, spark.createDataFrame(asked, ASKED))
    got = {r.target_id: sorted((b.x, b.y) for b in r.accepted) for r in found.collect()}
    assert len(got) == 101 and all(v for k, v in got.items() if k != "none") and got["t0"] == got["t99"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("collect_list") > plan.index("Join")  # what is asked is gathered below the join to the pixels
    page = templates.SearchPage(raster.pixels(a.tobytes(), 200, 120))
    alone, _ = templates.rescue(page, [{**dict(zip(("target_height", "skew", "w", "h", "samples", "bg_samples"), t))}], [], [])
    assert sorted((b["x"], b["y"]) for b in alone) == got["t7"]


def test_boxes_against_lists_of_boxes(spark):
    schema = "image_id string, x double, y double, w double, h double"
    boxes = spark.createDataFrame([("i", 0.0, 0.0, 10.0, 10.0), ("i", 200.0, 0.0, 10.0, 10.0), ("j", 0.0, 0.0, 10.0, 10.0)], schema)
    other = spark.createDataFrame([("i", 190.0, 0.0, 30.0, 10.0)], schema)
    assert sorted((r.image_id, r.x) for r in templates.touches_region(boxes, other).collect()) == [("i", 200.0), ("j", 0.0)]
    assert sorted((r.image_id, r.x) for r in templates.uncovered(boxes, other).collect()) == [("i", 0.0), ("j", 0.0)]
