"""Exact dedup against its SQL; fingerprints against their definition; collisions, huge texts, odd rows."""

import hashlib
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from inkveil.llm import exactdedup

SCHEMA = "doc_id bigint, text string, keep_id string, fp int, raw string, rid bigint"


def plain(raw, base):
    h = 0
    for b in raw:
        h = (h * base + b + 1) % exactdedup.PRIME
    return h


@pytest.mark.parametrize("chunk", [1, 7, 1 << 16])
def test_fingerprint_is_the_polynomial_and_composes(monkeypatch, chunk):
    monkeypatch.setattr(exactdedup, "CHUNK", chunk)
    exactdedup._powers.cache_clear()
    rng = random.Random(3)
    for n in (0, 1, 6, 7, 8, 100, 1000):
        raw = rng.randbytes(n)
        want = tuple(plain(raw, b) for b in exactdedup.BASES)
        assert exactdedup.polynomials(raw) == want
        k = rng.randrange(n + 1)
        assert exactdedup.join_prints(exactdedup.polynomials(raw[:k]), exactdedup.polynomials(raw[k:]), n - k) == want
    exactdedup._powers.cache_clear()
    assert exactdedup.polynomials(b"\0") != exactdedup.polynomials(b"\0\0")


def brute(rows):
    """(id, keep_id, group_size, sha) of every row, and (sha -> rows kept)."""
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    top = {t: max((i for i in g if i is not None), default=None) for t, g in groups.items()}
    return sorted(((i, top[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=str)


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1, None, 2) for i, t in rows], SCHEMA)
    got = exactdedup.exact_groups(docs).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(rows)
    kept = [(r.text_sha256, r.doc_id) for r in got if r.kept]
    assert len(kept) == len({t or "" for _, t in rows}) and all(r.doc_id == r.keep_id for r in got if r.kept)


ODD = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "a"), (None, "b"), (None, "b"), (4, "A"), (5, "a "), (6, "é" * 50), (7, "é" * 50), (8, "\0"), (9, "\0\0"), (-1, "é" * 50), (10, "z" * 300_000), (11, "z" * 300_000), (12, "z" * 299_999 + "y")]


def test_odd_rows(spark):
    check(spark, ODD)
    assert exactdedup.exact_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_colliding_fingerprints_are_told_apart_by_chunks(spark, monkeypatch):
    """All texts of a length share a fingerprint: rounds go on until every group is one text; groups are salted."""

    def same(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([1] * b.num_rows, pa.int64())], names=[*b.schema.names[:-1], "fp"])

    monkeypatch.setattr(exactdedup, "_print_texts", same)
    monkeypatch.setattr(exactdedup, "CHUNK", 3)
    monkeypatch.setattr(exactdedup, "SALTED", 2)
    rng = random.Random(5)
    check(spark, [(i, "".join(rng.choice("ab") for _ in range(rng.choice((4, 7))))[: rng.randrange(8)]) for i in range(60)] + ODD[:10])


def test_huge_texts_are_hashed_as_segments(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, "".join(rng.choice("abcdé") for _ in range(n))) for i, n in enumerate((0, 1, 9, 10, 11, 40, 99, 100, 101, 1000))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").select("doc_id", F.col("text").cast("binary").alias("raw"))
    want = {(r.doc_id, r.n_bytes, r.fp) for r in exactdedup.fingerprints(docs, 0).collect()}
    monkeypatch.setattr(exactdedup, "HUGE", 10)
    monkeypatch.setattr(exactdedup, "SEGMENT", 7)
    assert {(r.doc_id, r.n_bytes, r.fp) for r in exactdedup.fingerprints(docs, 2000).collect()} == want and len(want) == len(rows)
    check(spark, ODD[:10] + rows + [(i + 100, t) for i, t in rows])


def test_whole_table_matches_sql(spark, sf_dir):
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    con = duckdb.connect()
    con.register("documents", docs)
    rel = con.sql(exactdedup.ORACLE)
    got = exactdedup.exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert sorted(map(tuple, got.select(*rel.columns).collect())) == sorted(rel.fetchall())


def test_rows_that_stay_keep_their_columns(spark):
    rows = [(1, "a", "k", 1, None, 1), (2, "a", "l", 2, "x", 2), (2, "a", "m", 3, None, 3), (None, "B", None, 4, None, 4), (4, "b", None, 5, None, 5), (5, None, None, 6, None, 6)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = exactdedup.dedup_rows(docs, normal=F.lower)
    assert out.schema == docs.schema
    got = sorted((r.doc_id, r.text) for r in out.collect())
    assert got == [(2, "a"), (4, "b"), (5, None)]
