"""The audit against its SQL, and against applying every order to every document."""

import re
from itertools import permutations

import duckdb
import pandas as pd

from inkveil.llm import filteraudit

DOCS = "doc_id bigint, text string, lang string, part int, fails string, n int, sha string"
LABELS = "doc_id bigint, quality int, toxic int, n string"


def audit(docs, labels):
    """The definition: one pass over the documents for each order."""
    rows = []
    for i, t, part in docs:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        own = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t))}
        own["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        rows.append((part or "", {f for f in own if own[f]}, any(j == i is not None and q == 1 for j, q, _ in labels), any(j == i is not None and x == 1 for j, _, x in labels)))
    out = {}
    for order in map("".join, permutations("ABCDE")):
        for part in {r[0] for r in rows}:
            left = [r for r in rows if r[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                removed = [r for r in left if f in r[1]]
                out[part, order, step] = [len(left) - len(removed), len(removed), sum(f in r[1] for r in gone), sum(r[0] == part and r[1] == {f} for r in rows), sum(r[2] for r in removed), sum(r[3] for r in removed)]
                left = [r for r in left if f not in r[1]]
                gone += removed
    for (part, order, step), x in out.items():
        x.append(sum(out[part, o, o.index(order[step - 1]) + 1][1] for o in map("".join, permutations("ABCDE"))))
    return {k: tuple(x) for k, x in out.items()}


def result(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def long_text(k):
    return " ".join(f"w{k}x{j}" for j in range(120))


def odd():
    docs = [(1, None, "a"), (2, "", "a"), (3, long_text(1), "a"), (4, long_text(1), "b"), (4, long_text(1), "b"), (3, long_text(1), None), (None, long_text(1), ""), (None, "x", "c"), (5, long_text(2).upper(), "a"), (6, long_text(3) + " #", "b")]
    docs += [(7, "the " * 100, "b"), (8, "A" + "b" * 9, "b"), (9, "AA" + "b" * 9, "b"), (10, "é" * 99 + " É", "b"), (11, long_text(4) + "\x1c$", "a"), (12, " ".join(f"v{j % 80}" for j in range(100)), "a"), (13, " ".join(f"v{j % 79}" for j in range(100)), "a"), (-5, "x", "a")]
    labels = [(1, 1, 0), (2, 1, 1), (2, None, None), (3, 0, 1), (4, 1, None), (None, 1, 1), (5, 1, 1), (6, 1, 0), (6, 0, 1), (99, 1, 1)]
    return docs, labels


def test_odd_rows_match_every_order_and_sql(spark):
    docs, labels = odd()
    want = audit(docs, labels)
    d = spark.createDataFrame([(*r, 1, "x", 2, "y") for r in docs], DOCS)
    n = spark.createDataFrame([(*r, "x") for r in labels], LABELS)
    got = filteraudit.filter_audit(d, n)
    assert result(got) == want and len(want) == 600 * 4 and got.count() == len(want)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text", "lang"]).astype({"doc_id": "Int64"}))
    con.register("labels", pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]).astype("Int64"))
    rel = con.sql(filteraudit.ORACLE)
    assert sorted(map(tuple, got.select(*rel.columns).collect())) == sorted(rel.fetchall())


def test_whole_table_matches_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = con.sql(filteraudit.ORACLE)
    got = filteraudit.filter_audit(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels")))
    assert sorted(map(tuple, got.select(*rel.columns).collect())) == sorted(rel.fetchall())


def test_edges_are_eighty_a_part(spark):
    kinds = spark.createDataFrame([("p", 0b10110, 3, 1, 0), ("p", 0, 5, 0, 2), ("q", 31, 1, 0, 0)], "part string, fails int, n bigint, n_good bigint, n_toxic bigint")
    edges = filteraudit.lattice_edges(kinds)
    assert edges.groupBy("part").count().collect()[0]["count"] == edges.groupBy("part").count().collect()[1]["count"] == 80
    r = edges.filter("part = 'p' AND applied = 4 AND next = 1").first()
    assert (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost) == (5, 0, 3, 0, 0, 0)


def test_empty_tables(spark):
    d, n = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert filteraudit.filter_audit(d, n).count() == 0
    one = spark.createDataFrame([(1, "x", "a", 1, "x", 2, "y")], DOCS)
    assert filteraudit.filter_audit(one, n).count() == 600
