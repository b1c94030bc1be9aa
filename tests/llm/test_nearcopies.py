import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from inkveil.llm import nearcopies, simhash

SCHEMA = "doc_id bigint, text string, s string, n int"


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def likeness(x, y):
    return len(x & y) / len(x | y) if x | y else 1.0


def brute_kept(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if likeness(sets[i], sets[j]) >= 0.8:
                parent[find(i)] = find(j)
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(k)
    return sorted((min((k for k in g if k is not None), default=None) for g in groups.values()), key=str)


def planted(rng, groups, copies, edits):
    """Texts of 60 to 300 words, each with copies in which a few words are others."""
    rows = []
    for _ in range(groups):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 300))]
        rows.append(" ".join(words))
        for _ in range(copies):
            other = list(words)
            for _ in range(rng.randrange(1, 2 + len(words) // edits)):
                other[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(other))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_stage_finds_planted_near_copies(spark, sf_dir):
    rows = planted(random.Random(1), 150, 1, 60)
    pairs = len(rows) - len(brute_kept(rows))
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], SCHEMA)
    kept = sorted((r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()), key=str)
    recall = (len(rows) - len(kept)) / pairs
    print(f"{pairs} planted pairs at 0.8 or more: recall {recall:.3f}; op6's values: {(len(rows) - simhash.keep_one(docs).count()) / pairs:.3f}")
    assert pairs > 100
    assert kept == brute_kept(rows)


@pytest.mark.parametrize("large,tile", [(32, 512), (2, 3)])
def test_components_of_crowded_groups_match_brute_force(spark, monkeypatch, large, tile):
    monkeypatch.setattr(nearcopies, "LARGE", large)
    monkeypatch.setattr(nearcopies, "TILE", tile)
    rows = planted(random.Random(2), 4, 45, 25)
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], SCHEMA)
    got = sorted((r.doc_id for r in nearcopies.keep_one(docs).collect()), key=str)
    assert got == brute_kept(rows)
    assert 4 < len(got) < len(rows)


def test_nulls_empty_short_repeats_and_columns(spark):
    texts = [None, "", " \t\n", "One", "ONE", "a b", "a  b", "b a", "x " * 3000, "q w e r t y " * 500]
    rows = list(enumerate(texts)) + [(3, "One"), (3, "One"), (None, "only null id"), (None, "a b")]
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], SCHEMA)
    out = nearcopies.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == brute_kept(rows)
    assert nearcopies.keep_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize("spread", [20, 1])
def test_candidates_are_all_fingerprints_in_reach(spark, monkeypatch, spread):
    """Fingerprints alone decide which nodes meet, in whatever tiles: families at set distances, of sizes that allow 4/5 or don't."""
    monkeypatch.setattr(nearcopies, "SPREAD", spread)
    rng = np.random.default_rng(3)
    rows, prints = [], []
    for g in range(60):
        base, size = rng.integers(0, 2, 256, np.uint8), int(rng.integers(1, 400))
        for flips, n in ((0, size), (int(rng.integers(1, 66)), max(1, size * 9 // 10)), (100, size), (3, 2 * size)):
            bits = base.copy()
            # Spread evenly over the words, so that each word is in reach if all are.
            bits[np.arange(flips) * 64 % 256 + np.arange(flips) // 4] ^= 1
            prints.append(np.packbits(bits).view(np.uint64))
            rows.append((len(rows) + 1, n, *prints[-1].view(np.int64).tolist()))
    parent = {r[0]: r[0] for r in rows}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, x in enumerate(rows):
        for j, y in enumerate(rows[:i]):
            if np.bitwise_count(prints[i] ^ prints[j]).sum() <= nearcopies.RADIUS and 5 * min(x[1], y[1]) >= 4 * max(x[1], y[1]):
                p, q = sorted((find(x[0]), find(y[0])))
                parent[q] = p
    want = {k: find(k) for k in parent}
    docs = spark.createDataFrame(rows, "s bigint, n int, " + ", ".join(f"{f} bigint" for f in nearcopies.PRINTS))
    got = {r.node: r.root for r in nearcopies.groups_of_prints(docs).collect()}
    assert got == {k: v for k, v in want.items() if sum(v == x for x in want.values()) > 1}
    assert 60 < len(got) < len(rows)


def test_fingerprints_follow_likeness_and_dense_tiles_give_a_forest():
    rng = np.random.default_rng(4)
    far = []
    for _ in range(50):
        h = rng.integers(0, 2**64, 100, np.uint64)
        far.append(int(np.bitwise_count(nearcopies.fingerprint(h[:90]) ^ nearcopies.fingerprint(h[10:])).sum()))
    assert 33 < np.mean(far) < 46 and max(far) <= nearcopies.RADIUS
    n = 3000
    columns = {"t": np.zeros(n, np.int32), "u": np.zeros(n, np.int32), "side": np.zeros(n, np.int32), "s": np.arange(n), "n": np.full(n, 9, np.int32)}
    table = pa.table(columns | {f: np.full(n, 7) for f in nearcopies.PRINTS})
    out = nearcopies._near_prints(table)
    assert out.num_rows == n - 1
    assert len(set(out.column("a").to_pylist()) | set(out.column("b").to_pylist())) == n
