"""Composition by pieces: what comes out, and what is held as Python strings."""

import unicodedata

import pyarrow as pa

from inkveil.functions import text


def test_composed_of_mixed_pieces(monkeypatch):
    monkeypatch.setattr(text, "PIECE", 3)
    rows = ["abc", None, "ｱｲ", "ｱｲ", "é", "", "①", None, None, None, "x"]
    assert text.composed(pa.array(rows, pa.string())).to_pylist() == [r and unicodedata.normalize("NFKC", r) for r in rows]
    assert text.composed(pa.array(rows, pa.string()).slice(2, 4)).to_pylist() == ["アイ", "アイ", "é", ""]
    assert text.composed(pa.array([], pa.string())).to_pylist() == []


def test_only_a_piece_is_composed_at_a_time(monkeypatch):
    seen = []
    real = unicodedata.normalize
    monkeypatch.setattr(text.unicodedata, "normalize", lambda form, t: seen.append(t) or real(form, t))
    got = text.composed(pa.array(["plain"] * 1000 + ["①"] * 1000, pa.string()))
    assert got.to_pylist() == ["plain"] * 1000 + ["1"] * 1000
    assert len(seen) <= 6  # each distinct string once a piece


def test_arrays_keep_nulls(spark):
    rows = spark.createDataFrame([(1, ["ｱ", None]), (2, []), (3, None), (4, ["a"])], "k int, s array<string>").coalesce(1)
    got = {r["k"]: r["c"] for r in rows.select("k", text.nfkc_each("s").alias("c")).collect()}
    assert got == {1: ["ア", None], 2: [], 3: None, 4: ["a"]}
