"""Near candidates to groups, votes and recovered hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.config import CONFIG
from ..functions.plan import sealed
from ..functions.spatial import cluster, touches_exact
from .cells import around, meet

KEY = ["image_id", "target_id"]


def group_candidates(near: DataFrame) -> DataFrame:
    """One row per group of near candidates: image, target, group_ix, box, members (in order).

    Candidates that equal the target are left out. A group of (image, target) holds at most
    ``near_limit`` candidates a pass, so its array is bounded. group_ix counts by best similarity, then age.
    """
    near = near.filter(F.col("similarity") < CONFIG.identical)
    member = F.struct("pass_ix", "rank", "pass", "candidate", "similarity", "exact_chars", "line_text", "scale", "box", "around", "target")
    packed = near.groupBy(*KEY).agg(F.array_sort(F.collect_list(member)).alias("items"))
    rows = packed.select(*KEY, "items", F.posexplode(cluster(F.col("items"))).alias("_age", "g"))
    rows = sealed(rows.select(*KEY, "_age", "g", "items"), {"box": F.col("g.box"), "members": F.transform("g.ixs", lambda i: F.get("items", i))}).drop("g", "items")
    rows = rows.withColumn("best_similarity", F.array_max(F.transform("members", lambda m: m["similarity"])))
    return rows.withColumn("group_ix", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("best_similarity"), "_age")) - 1).drop("_age")


def representative(members: Column) -> Column:
    """The member of best similarity, the first of equals."""
    best = F.array_max(F.transform(members, lambda m: m["similarity"]))
    return F.get(F.filter(members, lambda m: m["similarity"] == best), F.lit(0))


def summary(groups: DataFrame) -> DataFrame:
    """Counts of each group beside its representative."""
    return groups.select(
        *KEY, "group_ix", "box", representative(F.col("members")).alias("best"), F.size("members").alias("candidate_count"),
        F.size(F.array_distinct(F.transform("members", lambda m: m["pass_ix"]))).alias("mode_count"),
    )


def untouched(rows: DataFrame, hits: DataFrame, keys: list[str], ids: list[str]) -> DataFrame:
    """The rows whose ``box`` is near no hit's ``box`` of the same keys (``touches_exact``); ``ids`` name a row. Boxes meet by grid cells."""
    reach = around(F.col("box"), CONFIG.touch_gap, CONFIG.touch_width, CONFIG.touch_height)
    near = meet(rows.select(*dict.fromkeys([*keys, *ids, "box"])), hits.select(*keys, "box"), keys, reach, reach).filter(touches_exact(F.col("l.box"), F.col("r.box")))
    return rows.join(near.select(*[F.col(f"l.{k}").alias(k) for k in ids]).distinct(), ids, "left_anti").select(*rows.columns)


def open_groups(groups: DataFrame, matches: DataFrame, slots: int = CONFIG.group_slots) -> DataFrame:
    """The first ``slots`` groups that touch no exact hit; those that do still use up a slot."""
    return untouched(groups.filter(F.col("group_ix") < slots), matches, KEY, [*KEY, "group_ix"])


def votes(groups: DataFrame) -> DataFrame:
    """(image, target, candidate, spots): in how many groups a three-character target is misread the same way."""
    m = groups.select(*KEY, "group_ix", F.explode("members").alias("m")).select(*KEY, "group_ix", "m.*")
    m = m.filter((F.length("target") == 3) & (F.length("candidate") == 3) & (F.levenshtein("target", "candidate") == 1) & (F.col("similarity") >= CONFIG.vote_similarity))
    return m.groupBy(*KEY, "candidate").agg(F.countDistinct("group_ix").alias("spots"))


def fast_recovery(open_: DataFrame, groups: DataFrame) -> DataFrame:
    """Groups accepted without another reading: one character misread, and enough evidence.

    Of a three-character target the same misreading must occur twice in the group or in two groups; a longer
    one needs a similarity of ``recovery_similarity``.
    """
    m = open_.select(*KEY, "group_ix", F.posexplode("members").alias("_o", "m")).select(*KEY, "group_ix", "_o", "m.*")
    m = m.withColumn("distance", F.levenshtein("target", "candidate"))
    m = m.filter((F.length("candidate") == F.length("target")) & (F.length("target") >= 3) & (F.col("distance") <= 1))
    three = F.length("target") == 3
    voting = three & (F.col("distance") == 1) & (F.col("similarity") >= CONFIG.vote_similarity)
    same_spot = F.count(F.when(voting, 1)).over(Window.partitionBy(*KEY, "group_ix", "candidate"))
    m = m.withColumn("same_spot", same_spot).join(votes(groups), [*KEY, "candidate"], "left").withColumn("spots", F.coalesce("spots", F.lit(0)))
    strong = F.when(three, voting & ((F.col("same_spot") >= CONFIG.vote_least) | (F.col("spots") >= CONFIG.vote_least))).otherwise(F.col("similarity") >= CONFIG.recovery_similarity)
    m = m.filter(strong)
    order = Window.partitionBy(*KEY, "group_ix").orderBy(F.when(three, F.lit(0)).otherwise(F.col("distance")), F.desc("similarity"), "_o")
    every = Window.partitionBy(*KEY, "group_ix")
    m = m.withColumns({"_rn": F.row_number().over(order), "strong_count": F.count("*").over(every), "distinct_strong": F.size(F.collect_set("candidate").over(every))}).filter("_rn = 1")
    return m.select(*KEY, "group_ix", "candidate", "similarity", "distance", "exact_chars", "line_text", "pass", "box", "strong_count", "distinct_strong", "spots", F.lit("近似候補救出").alias("recovery"))
