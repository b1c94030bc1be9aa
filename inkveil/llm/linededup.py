"""Line dedup: later copies of repeated runs of lines are deleted, the first copy stays.

Main path: built-in functions only. A text is split at ``\\n``; the lines that hold a word form its sequence
of line ids. A line is deleted if it lies in a run of consecutive lines of at least ``min_words`` words that
also stands earlier: in a document of smaller id, or further up in the same one. Lines without a word are
skipped when runs are compared and go with a deleted run that they lie inside of.

Suffixes of the line sequences are ranked by distributed prefix doubling. A line's rank is its place among all
lines, sorted by a 128-bit hash; a suffix's rank by 2, 4, 8, ... lines is that of the pair of its rank by half
as many and that of the suffix as far ahead, numbered across range partitions, so no group of equal ranks is
ever in one task. Suffixes that share their first lines with no other drop out of a round. A longest-common-prefix
interval of depth m, the suffixes that share m lines or more, is named by the ranks of the two power-of-two
stretches that make up the m lines (exact: equal ranks are equal lines). Every repeated run of ``min_words`` words
is made up of the shortest such runs that begin or end at one of its lines, so intervals deeper than ``min_words``
lines need not be told apart and ``log2(min_words)`` doublings do; overlapping runs join up to the maximal ones. All
copies of a run but the first in its interval are deleted, from its first line to its last.

Counts are pre-aggregated before each shuffle; joins back are on cut tables, so Spark can split the rows of a very
common line. Null or empty text: one line, nothing deleted. A null id comes after all others. Rows that share an
id are told apart by a hash of their text; rows that share both keep or lose the same lines, and the first copy
among rows of one id is that of the smallest (text hash, line). An empty table gives an empty result. Other
columns are ignored by ``line_dedup`` and carried by ``dedup_rows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, cut

MIN_WORDS = 10
DOC = ["_id", "_th"]


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """(_id, _th, p, i, ahead, back, alone, h1, h2): the lines with words, p their number among these, i among all.

    ``ahead`` and ``back``: lines of the shortest run of two or more from or to this one with ``min_words`` words,
    0 if there is none; ``alone``: whether the line has so many by itself.
    """
    t = F.coalesce(F.col("_text"), F.lit(""))
    df = docs.select("_id", F.xxhash64(t).alias("_th"), F.split(t, "\n").alias("_l"))
    counts = F.transform("_l", lambda x, i: F.struct(i.alias("i"), F.regexp_count(x, F.lit(f"[^{SPACE}]+")).alias("w"), F.xxhash64(x).alias("h1"), F.xxhash64(F.lit("second"), x).alias("h2")))
    df = df.select(*DOC, F.filter(counts, lambda x: x["w"] > 0).alias("_c"))
    df = df.select(*DOC, "_c", F.transform("_c", lambda x: F.least(x["w"], F.lit(min_words))).alias("_w"))

    def lines(at: Column, step: int) -> Column:
        total = F.get("_w", at)
        run = None
        for m in range(2, max(2, min_words) + 1):
            total = total + F.get("_w", at + step * (m - 1))  # null past either end
            run = F.when(total >= min_words, F.lit(m)) if run is None else run.when(total >= min_words, F.lit(m))
        return F.coalesce(run, F.lit(0))

    each = F.transform("_c", lambda x, p: F.struct(p.alias("p"), x["i"].alias("i"), lines(p, 1).alias("ahead"), lines(p, -1).alias("back"), (x["w"] >= min_words).alias("alone"), x["h1"].alias("h1"), x["h2"].alias("h2")))
    return df.select(*DOC, F.explode(each).alias("x")).select(*DOC, "x.*")


def _ranked(counts: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys, n -> keys and their rank: how many suffixes come before, by the order of the keys."""
    parts = cut(counts.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.sum("n").alias("_size"))
    # A row for each partition.
    before = sizes.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.join(F.broadcast(before), F.col("_part") == F.col("_p"))
    return parts.select(*keys, (F.col("_before") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias(name))


def _suffixes(docs: DataFrame, min_words: int) -> tuple[DataFrame, int]:
    """The repeated lines with their suffixes' ranks r0, r1, ... by 1, 2, 4, ... lines, and how many of these there are.

    A rank is null where no other suffix shares so many lines.
    """
    lines = _lines(docs, min_words)
    t = F.coalesce(F.col("_text"), F.lit(""))
    every = docs.select(F.explode(F.split(t, "\n")).alias("x")).select(F.xxhash64("x").alias("h1"), F.xxhash64(F.lit("second"), "x").alias("h2"))
    known = _ranked(every.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1"), ["h1", "h2"], "r0")
    known = cut(known.withColumnsRenamed({"h1": "_h1", "h2": "_h2"}))
    rows = lines.join(known, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))).drop("h1", "h2", "_h1", "_h2")
    k = 0
    while 2 << k <= max(2, min_words):
        ahead = Window.partitionBy(*DOC).orderBy("p").rangeBetween(1 << k, 1 << k)
        rows = cut(rows.withColumn("s", F.max(f"r{k}").over(ahead)))
        pairs = rows.filter(f"r{k} IS NOT NULL AND s IS NOT NULL").groupBy(f"r{k}", "s").agg(F.count("*").alias("n")).filter("n > 1")
        k += 1
        pairs = cut(_ranked(pairs, [f"r{k - 1}", "s"], f"r{k}").withColumnsRenamed({f"r{k - 1}": "_r", "s": "_s"}))
        rows = rows.join(pairs, (F.col(f"r{k - 1}") == F.col("_r")) & (F.col("s") == F.col("_s")), "left").drop("s", "_r", "_s")
    return rows, k + 1


def _runs(docs: DataFrame, min_words: int) -> DataFrame:
    """(_id, _th, m, x, y, a, b): the shortest sufficient runs of m repeated lines, their interval (m, x, y), as raw lines a to b."""
    rows, levels = _suffixes(docs, min_words)
    # The lines of a document are as many as the document has.
    ranks = [f"r{k}" for k in range(levels)]
    docs_ = rows.groupBy(*DOC).agg(F.array_sort(F.array_distinct(F.collect_list(F.struct("p", "i", "ahead", "back", "alone", *ranks)))).alias("_s"))

    def interval(at: Column, m: Column) -> Column:
        """The run of m lines from element ``at`` on; null unless all its lines are there and repeated together."""
        first, last = F.get("_s", at), F.get("_s", at + m - 1)
        x = y = F.lit(None).cast("bigint")
        for k in range(levels):
            here = (m >= 1 << k) & (m < 2 << k)
            x = F.when(here, first[f"r{k}"]).otherwise(x)
            y = F.when(here, F.get("_s", at + m - (1 << k))[f"r{k}"]).otherwise(y)
        whole = (m > 0) & (last["p"] - first["p"] == m - 1) & x.isNotNull() & y.isNotNull()
        return F.when(whole, F.struct(m.alias("m"), x.alias("x"), y.alias("y"), first["i"].alias("a"), last["i"].alias("b")))

    def all_of(e: Column, j: Column) -> Column:
        return F.array(interval(j, F.when(e["alone"], F.lit(1)).otherwise(F.lit(0))), interval(j, e["ahead"]), interval(j - e["back"] + 1, e["back"]))

    found = docs_.select(*DOC, F.explode(F.array_distinct(F.flatten(F.transform("_s", all_of)))).alias("x"))
    return found.filter("x IS NOT NULL").select(*DOC, "x.*")


def deleted(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(_id, _th, _gone): the sorted numbers of the lines to delete, of each text that has any."""
    runs = cut(_runs(docs, min_words))
    firsts = runs.groupBy("m", "x", "y").agg(F.min("_id").alias("_first"), F.count("*").alias("n")).filter("n > 1")
    firsts = cut(firsts.select(F.col("m").alias("_m"), F.col("x").alias("_x"), F.col("y").alias("_y"), "_first"))
    many = cut(runs.join(firsts, (F.col("m") == F.col("_m")) & (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y"))))
    later = many.filter(F.col("_first") < F.col("_id")).union(many.filter(F.col("_first").isNotNull() & F.col("_id").isNull()))
    own = many.filter(F.col("_first").eqNullSafe(F.col("_id")))
    own = own.withColumn("_r", F.rank().over(Window.partitionBy("m", "x", "y", "_id").orderBy("_th", "a"))).filter("_r > 1").drop("_r")
    gone = later.union(own).groupBy(*DOC).agg(F.collect_set(F.struct("a", "b")).alias("_ab"))
    return gone.select(*DOC, F.array_sort(F.array_distinct(F.flatten(F.transform("_ab", lambda x: F.sequence(x["a"], x["b"]))))).alias("_gone"))


def _deduped(docs: DataFrame, rows: DataFrame, min_words: int) -> DataFrame:
    """rows: _id, _text and more; adds _lines, _gone, _kept (line numbers) and _out (the remaining text)."""
    gone = deleted(docs, min_words).select(F.col("_id").alias("_gid"), F.col("_th").alias("_gth"), "_gone")
    t = F.coalesce(F.col("_text"), F.lit(""))
    out = rows.withColumn("_th", F.xxhash64(t)).join(gone, F.col("_id").eqNullSafe(F.col("_gid")) & (F.col("_th") == F.col("_gth")), "left")
    out = out.withColumn("_lines", F.split(t, "\n"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    out = out.withColumn("_kept", F.when(F.col("_gone").isNotNull(), kept))
    left = F.array_join(F.transform("_kept", lambda i: F.get("_lines", i)), "\n")
    return out.withColumn("_out", F.when(F.col("_kept").isNull(), t).otherwise(left))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: id, number of lines, of deleted lines, of deleted runs, SHA-256 of the rest."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    out = _deduped(rows, rows, min_words)
    gone = F.coalesce("_gone", F.array().cast("array<int>"))
    runs = F.size(F.filter(F.transform(gone, lambda x, i: F.when(i == 0, F.lit(True)).otherwise(x > F.get(gone, i - 1) + 1)), lambda x: x))
    return out.select(
        F.col("_id").alias(id_col),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("n_removed"),
        runs.cast("long").alias("n_runs"),
        F.sha2(F.col("_out").cast("binary"), 256).alias("kept_sha256"),
    )


def dedup_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with their remaining text, all columns kept; those of which nothing remains go.

    ``length_col``, if there is such a column, is set to the code points of the remaining text.
    """
    light = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = _deduped(light, rows, min_words).filter(F.col("_gone").isNull() | (F.length(F.translate("_out", " \t\n\x0b\f\r", "")) > 0))
    new = F.when(F.col("_gone").isNull(), F.col(f"_row.{text_col}")).otherwise(F.col("_out"))
    columns = []
    for field in docs.schema.fields:
        c = F.col(f"_row.`{field.name}`")
        if field.name == text_col:
            c = new
        elif field.name == length_col:
            c = F.when(F.col("_gone").isNull(), c).otherwise(F.length("_out")).cast(field.dataType)
        columns.append(c.alias(field.name))
    return out.select(*columns)


ORACLE = f"""
WITH t AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents),
d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l, row_number() OVER (ORDER BY doc_id NULLS LAST, text) AS r FROM t),
x AS (SELECT r, i, l[i] AS line, len(regexp_extract_all(l[i], '[^{SPACE}]+')) AS w FROM d, unnest(generate_series(1, len(l)::BIGINT)) AS s(i)),
c AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY i) AS p FROM x WHERE w > 0),
same AS (SELECT a.r, a.p, a.i, a.w, b.r AS r0, a.p - b.p AS apart FROM c a JOIN c b ON a.line = b.line AND (b.r < a.r OR (b.r = a.r AND b.p < a.p))),
isle AS (SELECT *, p - row_number() OVER (PARTITION BY r, r0, apart ORDER BY p) AS n FROM same),
run AS (SELECT DISTINCT r, min(i) AS a, max(i) AS b FROM isle GROUP BY r, r0, apart, n HAVING sum(w) >= {MIN_WORDS}),
gone AS (SELECT DISTINCT r, i FROM run, unnest(generate_series(a, b)) AS s(i)),
n AS (SELECT r, count(*) AS n_removed, count(*) FILTER (fresh) AS n_runs FROM (SELECT r, i, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + 1, true) AS fresh FROM gone) GROUP BY r),
k AS (SELECT x.r, string_agg(x.line, chr(10) ORDER BY x.i) AS rest FROM x LEFT JOIN gone USING (r, i) WHERE gone.r IS NULL GROUP BY x.r)
SELECT o.doc_id, len(d.l)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_runs, 0)::BIGINT AS n_runs, sha256(coalesce(rest, '')) AS kept_sha256
FROM documents o JOIN d ON o.doc_id IS NOT DISTINCT FROM d.doc_id AND coalesce(o.text, '') = d.text LEFT JOIN n USING (r) LEFT JOIN k USING (r)
"""
