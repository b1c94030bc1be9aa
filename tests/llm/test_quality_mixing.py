"""Quality rules and mixing against their SQL, on the given tables and on odd rows."""

import duckdb
import pandas as pd
import pytest

from inkveil.llm import mixing, quality

ODD = [
    (1, None, "s"), (2, "", "s"), (3, " \t\x0b\n", None), (4, "a b c d e " * 30, "s"), (5, "a b c d e " * 30, "s"), (5, "a b c d e " * 30, "s"),
    (None, "the of and to in a is that it was for on", "t"), (6, "x\n \nx\nx y\n\nx y", "t"), (7, "w " * 5000, "big"), (8, "é#\U0001f600$ ok", "Ä"), (9, "one two three four five six seven eight nine ten", ""),
]


def compare(got, sql, pdf):
    con = duckdb.connect()
    con.register("documents", pdf)
    rel = con.sql(sql)
    norm = lambda rows: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)
    assert norm(map(tuple, got.select(*rel.columns).collect())) == norm(rel.fetchall())


@pytest.mark.parametrize("op,sql", [(quality.quality, quality.ORACLE), (mixing.mix, mixing.ORACLE)])
def test_matches_sql(spark, sf_dir, op, sql):
    pdf = pd.read_parquet(f"{sf_dir}/documents.parquet")
    compare(op(spark.read.parquet(f"{sf_dir}/documents.parquet")), sql, pdf)


@pytest.mark.parametrize("op,sql", [(quality.quality, quality.ORACLE), (mixing.mix, mixing.ORACLE)])
def test_odd_rows(spark, op, sql):
    pdf = pd.DataFrame(ODD, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in ODD], "doc_id bigint, text string, source string, n_words int, h string, size int")
    compare(op(docs), sql, pdf)
    assert op(docs.limit(0)).count() == 0


def test_mix_comes_near_its_targets_and_keeps_caps(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    assert (rows.taken <= 3 * rows["size"]).all()
    for _, own in rows.groupby("source"):
        assert abs(own.taken.sum() - own.target.iloc[0]) <= own["size"].max()


def test_a_small_source_stops_at_its_cap(spark):
    rows = [(i, "a b c", "a") for i in range(50)] + [(100, "x", "b"), (101, "x y", "b"), (102, "x", "c")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    by = {r.doc_id: r for r in got}
    assert (by[100].target, by[101].taken, by[102].target) == (9.0, 6, 3.0)
    assert by[0].target == 150 + 3 + 1 - 9 - 3
