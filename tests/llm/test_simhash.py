import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from inkveil.llm import simhash

SCHEMA = "doc_id bigint, text string, source string, fp int, root string"


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints, radius=2):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                parent[find(i)] = find(j)
    roots = [find(i) for i in range(len(ids))]
    return [min((ids[j] for j in range(len(ids)) if roots[j] == r and ids[j] is not None), default=None) for r in roots]


def test_fingerprints_and_components_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    prints = [brute_print(r.text) for r in rows]
    want = sorted((r.doc_id, f"{p:016x}", c) for r, p, c in zip(rows, prints, brute_components([r.doc_id for r in rows], prints)))
    got = sorted(tuple(r) for r in simhash.near_duplicates(docs).collect())
    assert got == want


def test_nulls_empty_long_repeats_and_clashing_names(spark):
    texts = [None, "", " \t\n", "One", "ONE", "É é A", "a b", "a  b", "x " * 3000, "x " * 3000, "q w e r t y " * 500]
    rows = [(i, t, "s", 7, "r") for i, t in enumerate(texts)] + [(3, "One", "s", 7, "r"), (None, "only null id", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    prints = [brute_print(r[1]) for r in rows]
    want = sorted(((r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, brute_components([r[0] for r in rows], prints))), key=str)
    assert sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=str) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({c for *_, c in want if c is not None})


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.keep_one(docs).count() == 0


@pytest.mark.parametrize("tile", [2, 8])
def test_crowded_blocks_lose_no_link(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = random.Random(tile)
    seeds = [rng.getrandbits(64) for _ in range(3)]
    prints = {0}
    for s in seeds:
        for _ in range(60):
            p = s
            for _ in range(rng.randrange(5)):
                p ^= 1 << rng.randrange(64)
            prints.add(p)
    prints = sorted(prints)
    df = spark.createDataFrame([(int(np.array([p], np.uint64).view(np.int64)[0]),) for p in prints], "fp bigint")
    from inkveil.llm.graph import components

    got = {r.node & (2**64 - 1): r.root for r in components(simhash.links(df)).collect()}
    signed = [int(np.array([p], np.uint64).view(np.int64)[0]) for p in prints]
    want = brute_components(signed, prints)
    assert [got.get(p, s) for p, s in zip(prints, signed)] == want
