"""Filter interaction audit: what each order of a set of filters removes, from the edges of their lattice.

Filters are applied one after the other. What the next one, ``f``, removes depends on the *set* of those already
applied, not on their order: an edge (subset, f) of the lattice of subsets. Five filters have 80 edges, and each
of the 120 orders is a path of 5 of them. Documents are counted by part, the set of filters that they fail, and labels
(a bounded number of rows for each part, summed up before any shuffle); each count goes to the 80 edges; the edges,
summed, are joined to the 600 steps of all orders. No document meets an order.

Filters: A under 100 words; B ``100 * distinct words < 80 * words``; C ``100 * [A-Z] characters > 10 * code points``; D
any of ``#$%&*|``; E the text of a smaller id anywhere in the table. Texts are measured in Arrow batches
(memory follows the longest text); E compares SHA-256 digests: rows meet the least id of a text that stands there more than
once, in an equality join of narrow rows, broadcast if it is small, otherwise split by Spark where skewed.

Null text: empty. Words are maximal runs of ``[^\\x20\\x09-\\x0D]``, case-sensitive. Null part: the empty string. A null id is not
smaller than any other, none is smaller than it, and it has no labels. Rows repeated with id and text count each, and
aren't copies of one another. Labels repeated for an id hold if any row says so; null labels don't. An empty table has no
parts and gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, small

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
_SYMBOLS = b"#$%&*|"
_CAPITALS = bytes(range(0x41, 0x5B))
_INNER = bytes(range(0x80, 0xC0))  # bytes of a character after its first
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")

#: The same rows by walking every order with every kind of document.
ORACLE = """
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), measured AS (
  SELECT doc_id, part, t, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w,
         min(doc_id) OVER (PARTITION BY t) AS first_id FROM docs
), failing AS (
  SELECT doc_id, part,
         CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > first_id THEN 'E' ELSE '' END AS fails
  FROM measured
), marked AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), kinds AS (
  SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS n_good, sum(coalesce(toxic, 0)) AS n_toxic
  FROM failing LEFT JOIN marked USING (doc_id) GROUP BY part, fails
), orders(o) AS (
  SELECT '' UNION ALL SELECT o || l FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(l) WHERE NOT contains(o, l)
), steps AS (
  SELECT o, s::INT AS step, o[s:s] AS f, o[1:s - 1] AS before FROM orders, range(1, 6) r(s) WHERE length(o) = 5
), counted AS (
  SELECT part, o AS filter_order, step, f,
         coalesce(sum(n) FILTER (translate(fails, before || f, '') = fails), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (contains(fails, f) AND translate(fails, before, '') = fails), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (contains(fails, f) AND translate(fails, before, '') <> fails), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (fails = f), 0)::BIGINT AS unique_fails,
         coalesce(sum(n_good) FILTER (contains(fails, f) AND translate(fails, before, '') = fails), 0)::BIGINT AS good_lost,
         coalesce(sum(n_toxic) FILTER (contains(fails, f) AND translate(fails, before, '') = fails), 0)::BIGINT AS toxic_lost
  FROM kinds, steps GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counted
"""


def failed(raw: bytes) -> int:
    """The filters A to D that a text fails, as bits."""
    words = raw.split()  # of bytes: exactly the white space above
    n = len(words)
    characters = len(raw.translate(None, _INNER))
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    symbols = len(raw.translate(None, _SYMBOLS)) < len(raw)
    return (n < LEAST_WORDS) | (100 * len(set(words)) < LEAST_DISTINCT * n) << 1 | (100 * capitals > MOST_CAPITALS * characters) << 2 | symbols << 3


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fails = pa.array([failed(raw) for raw in b.column(3).to_pylist()], pa.int32())
        yield pa.RecordBatch.from_arrays([*b.columns[:3], fails], names=["_id", "part", "sha", "fails"])


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(_id, part, fails): of every row, the filters that it fails, as bits from A on."""
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(raw, 256)).alias("sha"), raw.alias("raw"))
    kind = rows.schema["_id"].dataType.simpleString()
    rows = cut(rows.mapInArrow(_measure, f"_id {kind}, part string, sha binary, fails int"))
    first = cut(rows.groupBy("sha").agg(F.count("*").alias("n"), F.min("_id").alias("least")).filter("n > 1").select("sha", "least"))
    again = F.coalesce(F.col("_id") > F.col("least"), F.lit(False)).cast("int")
    return rows.join(small(first), "sha", "left").select("_id", "part", F.col("fails").bitwiseOR(F.shiftleft(again, 4)).alias("fails"))


def _total(value: Column, when: Column) -> Column:
    return F.sum(F.when(when, value).otherwise(0)).cast("long")


def lattice_edges(kinds: DataFrame) -> DataFrame:
    """(part, fails, n, n_good, n_toxic) -> (part, applied, next, counts...): the sums of every edge of the lattice."""
    edges = [F.struct(F.lit(s).alias("applied"), F.lit(f).alias("next")) for f in range(len(FILTERS)) for s in range(1 << len(FILTERS)) if not s >> f & 1]
    at = kinds.select("*", F.inline(F.array(*edges)))
    bit = F.expr("shiftleft(1, next)")
    alive = F.col("fails").bitwiseAND(F.col("applied")) == 0
    fails = F.col("fails").bitwiseAND(bit) != 0
    return at.groupBy("part", "applied", "next").agg(
        _total(F.col("n"), alive & ~fails).alias("kept"),
        _total(F.col("n"), alive & fails).alias("removed"),
        _total(F.col("n"), ~alive & fails).alias("redundant"),
        _total(F.col("n"), F.col("fails") == bit).alias("unique_fails"),
        _total(F.col("n_good"), alive & fails).alias("good_lost"),
        _total(F.col("n_toxic"), alive & fails).alias("toxic_lost"),
    )


def paths(spark) -> DataFrame:
    """(filter_order, step, applied, next): the steps of every order; 600 rows, whatever the input."""
    rows = [("".join(FILTERS[f] for f in order), k + 1, sum(1 << f for f in order[:k]), order[k]) for order in permutations(range(len(FILTERS))) for k in range(len(FILTERS))]
    return spark.createDataFrame(rows, "filter_order string, step int, applied int, next int")


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step: counts of documents, and the filter's removals over all orders."""
    says = lambda c: F.max((F.coalesce(F.col(c), F.lit(0)) == 1).cast("int"))
    marked = labels.select(F.col("doc_id").alias("_marked"), "quality", "toxic").filter("_marked IS NOT NULL").groupBy("_marked").agg(says("quality").alias("good"), says("toxic").alias("bad"))
    rows = failures(docs, id_col, text_col, part_col)
    rows = rows.join(marked, F.col("_id") == F.col("_marked"), "left")
    kinds = rows.groupBy("part", "fails").agg(F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("n_good"), F.sum(F.coalesce("bad", F.lit(0))).alias("n_toxic"))
    edges = lattice_edges(kinds)
    walked = edges.join(F.broadcast(paths(docs.sparkSession)), ["applied", "next"])
    shapley = F.sum("removed").over(Window.partitionBy("part", "next")).alias("shapley")
    return walked.select("part", "filter_order", "step", *COUNTS, shapley)
