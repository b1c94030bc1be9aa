"""Whitening against exact integers and NumPy on the whole table, odd vectors, hot and flat cases."""

import math
from fractions import Fraction

import numpy as np
import pytest

from inkveil.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, component int, n string"


def brute(vectors):
    """(n, deviations, explained, absolute whitened values) of the integers of clean vectors, covariances from exact sums."""
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors]
    n, dims = len(x), len(x[0])
    sums = [sum(r[d] for r in x) for d in range(dims)]
    dev = [sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x]
    q = [[n * a - s for a, s in zip(r, sums)] for r in x]  # n times the centred integers
    o = np.array(q, object)
    v = np.array([[float(Fraction(int(c), n**3)) for c in row] for row in o.T.dot(o)])
    e, own = np.linalg.eigh(v)
    e, own = e[::-1], own[:, ::-1]
    k = min(8, dims)
    w = np.array([[float(Fraction(int(c), n)) for c in r] for r in q]) @ own[:, :k] / np.sqrt(np.maximum(e[:k], 1e-300))
    return n, dev, e[:k] / v.trace(), w


def check(rows, ids, vectors):
    n, dev, explained, w = brute(vectors)
    by = {}
    for r in rows:
        by.setdefault(r.vec_id, []).append(r)
    assert len(rows) == len(ids) * w.shape[1] and set(by) == set(ids)
    signs = None
    got = np.array([[r.whitened for r in sorted(by[i], key=lambda r: r.component)] for i in ids])
    signs = np.sign((got * w).sum(axis=0))
    assert np.abs(got * signs - w).max() < 1e-8
    for i, d in zip(ids, dev):
        for r in by[i]:
            assert (r.n, r.deviation) == (n, d)
            assert abs(r.explained - explained[r.component - 1]) <= 1e-10 * explained[0]
            assert r.identity_error < 1e-9


def test_whole_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = table.collect()
    check(whitening.whiten(table).collect(), [r.vec_id for r in vectors], [r.embedding for r in vectors])


def test_odd_vectors(spark):
    rng = np.random.default_rng(1)
    good = [(i, rng.normal(size=5).astype(np.float32).tolist()) for i in range(40)]
    good += [(100, good[0][1]), (101, [3.0] * 5), (102, [-0.0, 1e-30, 5.0, -7.25, 2.5])]
    bad = [(200, None), (201, []), (202, [1.0, None, 2.0, 3.0, 4.0]), (203, [float("nan")] * 5), (204, [float("inf"), 1.0, 1.0, 1.0, 1.0]), (205, [1.0, 2.0]), (206, [float("-inf")] * 5)]
    table = spark.createDataFrame([(i, v, 7, "x") for i, v in good + bad], SCHEMA).repartition(5)
    check(whitening.whiten(table).collect(), [i for i, _ in good], [v for _, v in good])


def test_null_and_repeated_ids_and_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(None, rng.normal(size=3).tolist(), 1, "x") for _ in range(4)] + [(1, rng.normal(size=3).tolist(), 1, "x")] * 2
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 18 and sum(r.vec_id is None for r in got) == 12 and {r.component for r in got} == {1, 2, 3} and {r.n for r in got} == {6}


@pytest.mark.parametrize("rows", [[(1, [0.5, 0.25], 1, "x")], [(1, [0.5, 0.25], 1, "x"), (2, [0.5, 0.25], 1, "x")]])
def test_no_variance(spark, rows):
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 2 * len(rows)
    assert all((r.whitened, r.explained, r.identity_error, r.deviation) == (None, None, None, 0) for r in got)


def test_some_components_without_variance(spark):
    rows = [(i, [float(i), 2.0 * i, 1.0], 1, "x") for i in range(10)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in got) and max(r.identity_error for r in got) < 1e-9


def test_huge_entries_saturate(spark):
    rows = [(1, [1e38, 1.0], 1, "x"), (2, [-1e38, 1.0], 1, "x"), (3, [0.0, 1.0], 1, "x")]
    got = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1] == got[2] == whitening.MAX_LONG and got[3] < 2**63


def test_exact_deviations_beyond_a_long():
    x = np.array([[5, 10**15], [7, 3]], np.int64)
    sums = (12, 10**15 + 3)
    assert whitening.deviations(x, 2, sums).tolist() == [min(whitening.MAX_LONG, sum((2 * a - s) ** 2 for a, s in zip(r, sums))) for r in x.tolist()]
    assert whitening.deviations(x[:, :1], 2, sums[:1]).tolist() == [4, 4]


def test_empty_table(spark):
    for rows in ([], [(1, None, 1, "x")]):
        assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).count() == 0
