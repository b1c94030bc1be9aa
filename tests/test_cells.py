"""Pairs by grid cells against all pairs; suppression in rounds against the plain fold."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkveil.functions.spatial import touches_exact
from inkveil.operators import cells, groups, suppress

BOX = "k string, ord int, x double, y double, w double, h double"


def boxes(rng, n, side, sizes, keys="ab"):
    return [(rng.choice(keys), i, rng.randrange(side) / 2, rng.randrange(side) / 2, float(rng.choice(sizes)), float(rng.choice(sizes))) for i in range(n)]


def own_extent():
    return cells.extent(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h"))


def test_pairs_equal_all_pairs_and_are_compared_in_proportion(spark):
    rng = random.Random(1)
    left, right = boxes(rng, 300, 4000, [0, 1, 7, 40, 700]), boxes(rng, 300, 4000, [0, 3, 16, 90])
    left += [("a", 900, -50.0, -3.5, 60.0, 4.0), ("a", 901, None, 0.0, 1.0, 1.0), ("b", 902, float("nan"), 0.0, 1.0, 1.0), (None, 903, 0.0, 0.0, 5.0, 5.0)]
    met = cells.meet(spark.createDataFrame(left, BOX), spark.createDataFrame(right, BOX), ["k"], own_extent(), own_extent())
    got = sorted((r.l.ord, r.r.ord) for r in met.collect())
    share = lambda p, q: p[2] is not None and p[2] <= q[2] + q[4] and q[2] <= p[2] + p[4] and p[3] <= q[3] + q[5] and q[3] <= p[3] + p[5]
    assert got == sorted((p[1], q[1]) for p in left for q in right if p[0] == q[0] and share(p, q))
    assert 0 < len(got) < len(left) * len(right) / 20
    assert cells.meet(spark.createDataFrame([], BOX), spark.createDataFrame(right, BOX), ["k"], own_extent(), own_extent()).count() == 0


def test_untouched_equals_the_join_on_all_pairs(spark):
    rng = random.Random(2)
    df = spark.createDataFrame(boxes(rng, 400, 3000, [2, 30, 150]), BOX).withColumn("box", F.struct(F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1")))
    rows, hits = df.filter("ord % 3 > 0"), df.filter("ord % 3 = 0")
    plain = rows.join(hits.select(F.col("k").alias("_k"), F.col("box").alias("_b")), (F.col("k") == F.col("_k")) & touches_exact(F.col("box"), F.col("_b")), "left_anti")
    want = sorted(r.ord for r in plain.collect())
    assert sorted(r.ord for r in groups.untouched(rows, hits, ["k"], ["k", "ord"]).collect()) == want and 0 < len(want) < rows.count()


def fold(rows, threshold):
    """The definition, box by box."""
    kept = []
    for r in sorted(rows, key=lambda r: r[1]):
        for q in kept:
            if q[0] != r[0] or min(q[4] * q[5], r[4] * r[5]) <= 0:
                continue
            shared = max(0, min(q[2] + q[4], r[2] + r[4]) - max(q[2], r[2])) * max(0, min(q[3] + q[5], r[3] + r[5]) - max(q[3], r[3]))
            if shared / min(q[4] * q[5], r[4] * r[5]) > threshold:
                break
        else:
            kept.append(r)
    return sorted(kept)


@pytest.mark.parametrize("size", [40, 64])
def test_rounds_equal_the_fold(spark, monkeypatch, size):
    monkeypatch.setattr(suppress, "FOLD", 3)
    monkeypatch.setattr(suppress, "ROUND", size)
    rng = random.Random(size)
    rows = boxes(rng, 250, 300, [0, 4, 10, 30]) + [("a", 1000 + i, 20.0, 20.0, 10.0, 10.0) for i in range(30)]
    df = spark.createDataFrame(rows, BOX)
    assert sorted(map(tuple, suppress.suppress(df, ["k"], ["ord"]).collect())) == fold(rows, 0.45)
    few = sorted(r.ord for r in suppress.suppress(df, ["k"], ["ord"], limit=5).collect())
    assert few == sorted(r[1] for k in "ab" for r in sorted((q for q in fold(rows, 0.45) if q[0] == k), key=lambda q: q[1])[:5])


def test_a_hundred_thousand_boxes_of_one_image(spark):
    """By rounds, compared with a fold that looks up the boxes of the cells around."""
    rng = np.random.default_rng(3)
    n = 100_000
    x, y = rng.integers(0, 2000, n) / 2, rng.integers(0, 2000, n) / 2
    w, h = rng.choice([4.0, 6.0, 9.0], n), rng.choice([4.0, 6.0, 9.0], n)
    table = {}
    kept = []
    for i in range(n):
        cell = (int(x[i] // 16), int(y[i] // 16))
        near = [j for a in (-1, 0, 1) for b in (-1, 0, 1) for j in table.get((cell[0] + a, cell[1] + b), ())]
        if all(max(0, min(x[j] + w[j], x[i] + w[i]) - max(x[j], x[i])) * max(0, min(y[j] + h[j], y[i] + h[i]) - max(y[j], y[i])) / min(w[j] * h[j], w[i] * h[i]) <= 0.45 for j in near):
            kept.append(i)
            table.setdefault(cell, []).append(i)
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame({"k": "a", "ord": np.arange(n), "x": x, "y": y, "w": w, "h": h}))
    assert sorted(r.ord for r in suppress.suppress(df, ["k"], ["ord"]).select("ord").collect()) == kept
