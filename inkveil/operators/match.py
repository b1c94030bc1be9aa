"""Exact and near search of targets in lines of characters.

Targets are collected up to a bound (``MOST_TARGETS`` rows, ``MOST_CHARACTERS`` in all) and go to where the lines lie: exact ones as an
automaton that reads every line once for all of them, near ones as an index of gapped pairs that names the targets a line
is looked at for. More of them meet the lines by an equality join of narrow rows, on one of the target's runs of three characters or
on the same pairs. Either way only windows that can reach the threshold are scored, in bulk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.automaton import find
from ..functions.bulk import near_windows
from ..functions.config import CONFIG
from ..functions.filterindex import candidates, pair_keys, target_keys
from ..functions.numbers import half_up
from ..functions.text import normalize, occurrences

#: Most targets, and most characters of them together, that go to where the lines lie.
MOST_TARGETS = 20_000
MOST_CHARACTERS = 400_000
LINE = ["image_id", "pass", "pass_ix", "line_ix"]


def normal_targets(targets: DataFrame) -> DataFrame:
    """(target_id, target_raw) -> with ``target``; targets of which nothing remains go."""
    return targets.withColumn("target", normalize(F.col("target_raw"))).filter(F.col("target") != "").select("target_id", "target")


def box_of(units: Column) -> Column:
    side = lambda k, f: f(units["bbox"][k])
    return F.struct(side("x0", F.array_min).alias("x0"), side("y0", F.array_min).alias("y0"), side("x1", F.array_max).alias("x1"), side("y1", F.array_max).alias("y1"))


#: Characters on either side of a near window that another reading of it sees.
CONTEXT = 2
#: Characters of a run by which lines and many targets meet; shorter targets meet whole.
GRAM = 3


def _grams(text: Column, n: int) -> Column:
    last = F.length(text) - n + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def bounded(targets: DataFrame) -> list[tuple[str, str]] | None:
    """(target_id, target) of the targets, if they keep the bound; one job."""
    rows = targets.select("target_id", "target", F.length("target").alias("n"))
    rows = rows.limit(MOST_TARGETS + 1).collect()
    return [(r["target_id"], r["target"]) for r in rows] if len(rows) <= MOST_TARGETS and sum(r["n"] for r in rows) <= MOST_CHARACTERS else None


def _numbered(spark, few: list[tuple[str, str]]) -> tuple[list[str], DataFrame]:
    """The distinct targets, and (target_ix, target_id, target): which ids stand for each of them."""
    texts = sorted({t for _, t in few})
    place = {t: k for k, t in enumerate(texts)}
    return texts, F.broadcast(spark.createDataFrame([(place[t], i, t) for i, t in few], "target_ix int, target_id string, target string"))


def target_places(lines: DataFrame, targets: DataFrame) -> DataFrame:
    """Lines (with ``text``) -> one row per occurrence of a target: their columns, target_id, target, at (from 0)."""
    few = bounded(targets)
    if few is not None:
        texts, ids = _numbered(lines.sparkSession, few)
        found = lines.withColumn("_f", F.explode(find(F.col("text"), texts)))
        return found.withColumns({"target_ix": F.col("_f.target_ix"), "at": F.col("_f.at")}).drop("_f").join(ids, "target_ix").drop("target_ix")
    # Of a target's runs the one of smallest hash: targets that begin alike do not all meet at one key.
    wanted = targets.select("target_id", "target")
    own = F.when(F.length("target") <= GRAM, F.col("target")).otherwise(F.array_min(F.transform(_grams(F.col("target"), GRAM), lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g"))))["g"])
    runs = F.array_distinct(F.concat(*[_grams(F.col("text"), n) for n in range(1, GRAM + 1)]))
    seen = lines.withColumn("_g", F.explode(runs)).join(wanted.withColumn("_g", own), "_g")
    return seen.filter(F.contains("text", "target")).drop("_g").withColumn("at", F.explode(occurrences(F.col("text"), F.col("target"))))


def exact_matches(lines: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per occurrence: image, target, pass, line, the characters and their box, in reading order."""
    found = target_places(lines, targets)
    symbols = F.slice("units", F.col("at") + 1, F.length("target"))
    return found.select(*LINE, "target_id", "target", F.col("text").alias("line_text"), "at", symbols.alias("symbols"), box_of(symbols).alias("box"))


def near_pairs(lines: DataFrame, targets: DataFrame) -> DataFrame:
    """The lines for each target that they may hold a near match of: their columns, target_id, target."""
    few = bounded(targets)
    if few is not None:
        texts, ids = _numbered(lines.sparkSession, few)
        return lines.withColumn("target_ix", F.explode(candidates(F.col("text"), texts))).join(ids, "target_ix").drop("target_ix")
    wanted = targets.select("target_id", "target", F.explode(target_keys(F.col("target"))).alias("_k"))
    able = lines.select(*LINE, F.explode(pair_keys(F.col("text"), True)).alias("_k")).join(wanted, "_k").select(*LINE, "target_id", "target").distinct()
    return lines.join(able, LINE)


def near_candidates(lines: DataFrame, targets: DataFrame, limit: int = CONFIG.near_limit) -> DataFrame:
    """Windows of a line that resemble a target: the best of each place, ``limit`` of a page pass and target.

    Of the line's characters only two boxes go on: the window's (``box``) and that with ``CONTEXT`` characters on either side (``around``).
    """
    # A line's characters go along as the sides of their boxes only.
    sides = ("x0", "y0", "x1", "y1")
    narrow = lines.select(*LINE, "text", "scale", F.size("units").alias("_size"), *[F.col("units")["bbox"][k].alias(f"_{k}") for k in sides])
    rows = near_pairs(narrow, targets).withColumn("_w", F.explode(near_windows(F.col("target"), F.col("text"))))
    rows = rows.withColumns({"start_index": F.col("_w.start"), "len": F.col("_w.len"), "exact_chars": F.col("_w.shared")})
    most = F.greatest("len", F.length("target"))
    rows = rows.withColumns({"edit_similarity": 1 - F.col("_w.distance") / most, "sequence_similarity": F.col("_w.common") / most}).drop("_w")
    rows = rows.withColumns({"similarity": F.greatest("edit_similarity", "sequence_similarity"), "candidate": F.substring(F.col("text"), F.col("start_index") + 1, F.col("len"))})
    order = [F.desc("similarity"), F.desc("exact_chars"), F.abs(F.col("len") - F.length("target")), "line_ix", "start_index", "len"]
    # One of each place: the boxes are rounded in the page's own scale.
    start, end = F.col("start_index"), F.least(F.col("_size"), F.col("start_index") + F.col("len"))
    edge = lambda i, k: half_up(F.get(f"_{k}", i) * F.col("scale"))
    first, last = F.greatest(F.lit(0), start - CONTEXT), F.least(F.col("_size"), end + CONTEXT)
    outer = lambda a, b: F.struct(*[(F.array_min if k[1] == "0" else F.array_max)(F.slice(f"_{k}", a + 1, b - a)).alias(k) for k in sides])
    rows = rows.withColumns({"_l": edge(start, "x0"), "_r": edge(end - 1, "x1"), "box": outer(start, end), "around": outer(first, last)})
    keys = ["image_id", "pass_ix", "target_id"]
    rows = rows.drop("_size", *[f"_{k}" for k in sides]).repartition(*keys)  # once for both windows: what a page holds of a target is bounded
    rows = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, "text", "_l", "_r").orderBy(*order))).filter("_rn = 1")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= limit)
    return rows.select(*LINE, "target_id", "target", "rank", "candidate", "similarity", "edit_similarity", "sequence_similarity", "exact_chars", F.col("text").alias("line_text"), "start_index", "scale", "box", "around")
