"""Mixing sources to target weights by nested hash thresholds.

A document's size is its number of words. Sources, ordered by code point with null last, weigh 1, 2, 3,
1, 2, 3, ... and share all sizes; a source's target stops at ``max_repeats`` times its size and the excess
is shared again by weight until no target is above its cap.

A target is a number of whole passes plus a rest. The rest is met by a threshold on a hash of the
document id: sizes are summed by source and hash bucket, cumulated, and only the bucket in which the
budget falls is split further (``LEVEL_BITS`` more bits of the hash at a time) until it is one hash value.
The threshold goes to the side of that value that is nearer to the budget. Nothing is sorted by document:
the histograms have at most ``sources * 2 ** LEVEL_BITS`` rows, each pre-aggregated before its shuffle, so
a source with a third of the corpus is a handful of rows per task.

Nulls: a null text has size 0, a null source is a source, a null id hashes as the empty string. Rows that
share an id are taken alike. Empty texts are taken 0 words (and pass through ``mix_rows`` like any row of
their source). An empty table gives an empty result. Other columns are ignored by ``mix`` and carried by
``mix_rows``. All arithmetic on targets is in a fixed order, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, cut, small

LEVEL_BITS = 10
HASH_BITS = 60
MAX_REPEATS = 3


def size_of(text: Column) -> Column:
    """Number of maximal runs of non-space: the words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def hash_of(key: Column) -> Column:
    """60 bits of the MD5 of the id's text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size) with one row a source -> the same and ``weight``, ``target``.

    Works on one row per distinct source. A source is capped once its share by weight passes its cap; the
    caps are found in the order of cap / weight by running sums, so the excess is reshared in one pass.
    """
    s = sizes.withColumn("_n", F.col("source").isNull().cast("int"))
    s = s.withColumn("weight", (F.row_number().over(Window.orderBy("_n", "source")) - 1) % 3 + 1)
    s = s.withColumn("_cap", max_repeats * F.col("source_size"))
    order = Window.orderBy(F.col("_cap") / F.col("weight"), "_n", "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns(
        {
            "_left": F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("_cap").over(before), F.lit(0)),
            "_wleft": F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    # Capped: cap <= its share of what the sources before it leave. The first that is not sets the level.
    s = s.withColumn("_open", F.col("_cap") * F.col("_wleft") > F.col("_left") * F.col("weight"))
    first = order.rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumns({"_l": F.first(F.when(F.col("_open"), F.col("_left")), True).over(first), "_w": F.first(F.when(F.col("_open"), F.col("_wleft")), True).over(first)})
    target = F.when(F.col("_w").isNull(), F.col("_cap").cast("double")).otherwise(F.col("_l").cast("double") * F.col("weight") / F.col("_w"))
    return s.select("source", "source_size", "weight", target.alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """Nested thresholds on ``h``: (source, cut), so that documents with ``h < cut`` sum up to nearly ``budget``.

    rows: (source, h, size) of all documents; budgets: (source, budget). Each round splits only the bucket
    that holds the budget; a larger budget of the same source never gets a lower cut.
    """
    state = budgets.filter(F.col("budget") > 0).select(F.col("source").alias("_s"), "budget", F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("below"))
    shift = HASH_BITS
    while shift > 0:
        shift -= LEVEL_BITS
        joined = rows.join(small(state), F.col("source").eqNullSafe(F.col("_s")))
        inside = F.shiftright("h", shift + LEVEL_BITS) == F.shiftright("base", shift + LEVEL_BITS)
        if shift + LEVEL_BITS < HASH_BITS:
            joined = joined.filter(inside)
        hist = joined.groupBy("_s", "budget", "base", "below", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("n"))
        run = Window.partitionBy("_s").orderBy("b")
        hist = hist.withColumn("upto", F.col("below") + F.sum("n").over(run)).withColumn("under", F.col("upto") - F.col("n"))
        # The bucket in which the budget falls: the first whose running sum reaches it.
        found = hist.filter((F.col("under") < F.col("budget")) & (F.col("upto") >= F.col("budget")))
        state = cut(found.groupBy("_s").agg(F.min_by(F.struct("budget", "b", "under", "n"), "b").alias("x")).select("_s", F.col("x.budget").alias("budget"), F.shiftleft("x.b", shift).alias("base"), F.col("x.under").alias("below"), F.col("x.n").alias("n")))
    over = F.col("below") + F.col("n") - F.col("budget")
    return state.select(F.col("_s").alias("source"), F.when(over < F.col("budget") - F.col("below"), F.col("base") + 1).otherwise(F.col("base")).alias("cut"))


def _planned(docs: DataFrame, id_col: str, text_col: str, source_col: str, keep: bool, max_repeats: int) -> DataFrame:
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if keep else []
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"), hash_of(F.col(id_col)).alias("h"), *whole)
    # Only these three narrow columns are kept for the histogram rounds: texts are read once more at the end.
    light = cut(rows.select("source", "h", "size"))
    sizes = targets(light.groupBy("source").agg(F.sum("size").alias("source_size")), max_repeats)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    sizes = cut(sizes.withColumn("passes", F.least(passes, F.lit(max_repeats))))
    budgets = sizes.select("source", (F.col("target") - F.col("passes") * F.col("source_size")).alias("budget"))
    cuts = thresholds(light, budgets)
    plan = cut(sizes.join(cuts.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").select(F.col("source").alias("_src"), "source_size", "target", "passes", F.coalesce("cut", F.lit(0)).alias("cut")))
    out = rows.join(small(plan), F.col("source").eqNullSafe(F.col("_src")))
    return out.withColumn("times", (F.col("passes") + (F.col("h") < F.col("cut")).cast("long")).cast("int"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per document: id, size, its source's size and target, the words that the mix takes of it."""
    out = _planned(docs, id_col, text_col, source_col, False, max_repeats)
    return out.select(F.col("_id").alias(id_col), "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"), F.col("times").alias("repeats"))


def mix_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The mixed corpus: each document as often as it is taken, with all its columns."""
    out = _planned(docs, id_col, text_col, source_col, True, max_repeats)
    return out.filter("times > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_k")).select("_row.*")


ORACLE = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
o AS (SELECT *, 3 * source_size AS cap, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER k, 0) AS l, sum(weight) OVER () - coalesce(sum(weight) OVER k, 0) AS w
    FROM s WINDOW k AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT l, w FROM o WHERE cap * w > l * weight ORDER BY cap / weight, source NULLS LAST LIMIT 1),
t AS (SELECT o.source, o.source_size, CASE WHEN f.w IS NULL OR o.cap * o.w <= o.l * o.weight THEN o.cap::DOUBLE ELSE f.l::DOUBLE * o.weight / f.w END AS target
    FROM o LEFT JOIN f ON true),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END AS passes FROM t),
e AS (SELECT d.*, p.source_size, p.target, p.passes, p.target - p.passes * p.source_size AS budget FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
g AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(size) OVER (PARTITION BY source, h) AS n FROM e)
SELECT doc_id, size, source_size, target,
  (size * (passes + CASE WHEN budget > 0 AND (upto < budget OR (upto - n < budget AND upto - budget < budget - (upto - n))) THEN 1 ELSE 0 END))::BIGINT AS taken,
  (passes + CASE WHEN budget > 0 AND (upto < budget OR (upto - n < budget AND upto - budget < budget - (upto - n))) THEN 1 ELSE 0 END)::INTEGER AS repeats
FROM g
"""
