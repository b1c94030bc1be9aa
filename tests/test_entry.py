"""Every query of the engine beside its SQL, on the smallest tables; the entry point."""

import duckdb
import pytest

import __spark_entry__ as entry
from inkveil.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, sql, name):
    got = queries.QUERIES[name](spark, sf_dir)
    if name not in queries.ORACLES:
        assert got.count() > 0
        return
    rel = sql.sql(queries.ORACLES[name])
    assert sorted(rel.columns) == sorted(got.columns)
    plain = lambda rows: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=repr)
    want = plain(rel.fetchall())
    assert want and plain(map(tuple, got.select(*rel.columns).collect())) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(entry.queries()) and set(queries.ORACLES) <= set(entry.oracle_sql())
