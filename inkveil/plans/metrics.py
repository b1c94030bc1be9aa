"""What each step of a run did, as tables: the batch form of a diagnosis screen."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.config import CONFIG, SOURCES
from ..operators.groups import summary

KEY = ["image_id", "target_id"]
#: The colour of a covering rectangle's frame, by where the rectangle comes from.
FRAME_COLORS = {"OCR": "#22aa55", "再OCR": "#8e44ad", "近似候補救出": "#8e44ad", "局所OCR": "#2f80ed", "イタリック救出": "#f59e0b"}


def stage_metrics(stages: dict[str, DataFrame]) -> DataFrame:
    """(image_id, target_id, stage, rows) for the step tables that have both keys."""
    parts = [df.groupBy("image_id", "target_id").agg(F.count("*").alias("rows")).select("image_id", "target_id", F.lit(name).alias("stage"), "rows") for name, df in stages.items() if {"image_id", "target_id"} <= set(df.columns)]
    return reduce(DataFrame.unionByName, parts)


def counters(stages: dict[str, DataFrame]) -> DataFrame:
    """(image_id, target_id, counter, value) of what a run tried, left out and found; counters of 0 have no row.

    hits and near count places of all passes; groups_skipped are groups of the first slots that touch an exact hit
    and get no other reading; groups_attempted are those for which one is asked; groups_confirmed those that it
    confirms. The template counters are of the search's positions. covered:<source> counts the final rectangles.
    """
    one = F.lit(1).cast("bigint")
    said = lambda df, name, value=one: df.select(*KEY, name.alias("counter") if isinstance(name, Column) else F.lit(name).alias("counter"), value.alias("value"))
    slots = F.col("group_ix") < CONFIG.group_slots
    parts = [
        said(stages["matches"], "hits"), said(stages["near"], "near"), said(stages["groups"], "groups"),
        # The slots that are not open any more.
        said(stages["groups"].filter(slots), "groups_skipped"), said(stages["open"], "groups_skipped", -one),
        said(stages["accepted"], "groups_recovered"), said(stages["stamps"], F.concat(F.lit("covered:"), "source")),
    ]
    if "requests" in stages:
        parts += [said(stages["requests"].select(*KEY, "group_ix").distinct(), "groups_attempted"), said(stages["requests"], "readings_asked"), said(stages["refined"], "groups_confirmed")]
    if "local" in stages:
        parts.append(said(stages["local"], "region_hits"))
    if "italic_search" in stages:
        found = stages["italic_search"]
        parts += [said(found, f"template_{k}", F.col(k)) for k in ("passes", "scored", "skipped", "coarse_passed")]
        parts.append(said(found, "template_accepted", F.size("accepted").cast("bigint")))
    return reduce(DataFrame.unionByName, parts).groupBy(*KEY, "counter").agg(F.sum("value").alias("value")).filter("value <> 0")


class Watch:
    """The totals of ``counters`` over all images, counted while the step tables are written: no job of its own.

    Given to ``pipeline.stages``, which shows it each step table before it is written.
    """

    def __init__(self) -> None:
        self._seen: list[Observation] = []

    def __call__(self, stage: str, df: DataFrame) -> DataFrame:
        every = F.count(F.lit(1))
        first = lambda condition: F.count(F.when(condition, 1))
        counted = {
            "matches": {"hits": every}, "near": {"near": every}, "open": {"groups_open": every}, "accepted": {"groups_recovered": every}, "refined": {"groups_confirmed": every}, "local": {"region_hits": every},
        }
        if stage == "groups":
            own = {"groups": every, "groups_first": first(F.col("group_ix") < CONFIG.group_slots)}
        elif stage == "requests":
            own = {"readings_asked": every, "groups_attempted": first(F.col("first"))}
        elif stage == "italic_search":
            own = {f"template_{k}": F.sum(k) for k in ("passes", "scored", "skipped", "coarse_passed")} | {"template_accepted": F.sum(F.size("accepted"))}
        elif stage == "stamps":
            own = {f"covered:{s}": first(F.col("source") == s) for s in SOURCES}
        else:
            own = counted[stage]
        seen = Observation()
        self._seen.append(seen)
        return df.observe(seen, *[v.cast("bigint").alias(k) for k, v in own.items()])

    def totals(self) -> dict[str, int]:
        """Counter -> value; counters of 0 are left out."""
        out: dict[str, int] = {}
        for seen in self._seen:
            for k, v in seen.get.items():
                out[k] = out.get(k, 0) + (v or 0)
        out["groups_skipped"] = out.pop("groups_first", 0) - out.pop("groups_open", 0)
        return {k: v for k, v in out.items() if v}


def overlay(stages: dict[str, DataFrame]) -> DataFrame:
    """The final rectangles as coloured frames: (image_id, target_id, stamp_ix, x, y, w, h, color, label).

    Labels give the source and the target; of template hits the source and the score.
    """
    s = stages["stamps"].select(*KEY, "stamp_ix", "x", "y", "w", "h", "source")
    color = F.create_map(*[F.lit(v) for pair in FRAME_COLORS.items() for v in pair])
    s = s.join(stages["targets"].select("target_id", "target"), "target_id", "left")
    label = F.concat("source", F.lit(": "), "target")
    if "italic" in stages:
        # A template hit's place among the stamps counts from a million on.
        scores = stages["italic"].select(*KEY, (F.lit(1_000_000) + F.col("ord")).cast("int").alias("stamp_ix"), F.col("score").alias("_score"))
        s = s.join(scores, [*KEY, "stamp_ix"], "left")
        label = F.when(F.col("_score").isNotNull(), F.format_string("%s %.2f", "source", "_score")).otherwise(label)
    return s.select(*KEY, "stamp_ix", "x", "y", "w", "h", F.coalesce(color[F.col("source")], F.lit(FRAME_COLORS[SOURCES[0]])).alias("color"), label.alias("label"))


def stage_times(stages: dict[str, DataFrame]) -> DataFrame:
    """(stage, rows, seconds) of making each step table, one after the other.

    A step table that is not stored is made from the last stored ones before it, whose own making is not in its time.
    """
    took = []
    for name, df in stages.items():
        began = time.monotonic()
        rows = df.count()
        took.append((name, rows, time.monotonic() - began))
    return stages["stamps"].sparkSession.createDataFrame(took, "stage string, rows bigint, seconds double")


def report(stages: dict[str, DataFrame]) -> DataFrame:
    """One line of text per stamp: where it comes from and what it covers."""
    text = F.format_string("%s #%d %s (%.0f, %.0f, %.0f, %.0f)", "target_id", "stamp_ix", "source", "x", "y", "w", "h")
    return stages["stamps"].select("image_id", "target_id", "stamp_ix", text.alias("line"))


def full_report(stages: dict[str, DataFrame]) -> DataFrame:
    """(image_id, target_id, section, at, line): the text of a diagnosis, in the order of section and at.

    Sections: 1 hits with their lines, 2 groups of near candidates, 3 recovered groups, 4 confirmed groups, 5 hits in
    regions, 6 template hits, 7 final rectangles, 8 counters. ``at`` orders the lines of a section.
    """
    # Numbers for ordering are padded, since lines of all sections share one column.
    place = lambda *ks: F.concat_ws("/", *[F.lpad(F.col(k).cast("string"), 10, "0") for k in ks])
    whole = lambda b, k: F.round(F.col(f"{b}.{k}")).cast("bigint")
    box = lambda b: [whole(b, k) for k in ("x0", "y0", "x1", "y1")]
    lines = lambda df, section, at, text: df.select(*KEY, F.lit(section).alias("section"), at.alias("at"), text.alias("line"))
    hit = F.format_string("%s: \"%s\" at (%d, %d)-(%d, %d)", "pass", "line_text", *box("box"))
    g = summary(stages["groups"]).join(stages["open"].select(*KEY, "group_ix", F.lit(True).alias("_open")), [*KEY, "group_ix"], "left")
    state = F.when(F.col("_open"), "open").when(F.col("group_ix") < CONFIG.group_slots, "has a hit").otherwise("beyond the slots")
    parts = [
        lines(stages["matches"], 1, place("pass_ix", "line_ix", "at"), hit),
        lines(g, 2, place("group_ix"), F.format_string("group %d: %d candidates of %d passes, best \"%s\" %.0f %%, %s", "group_ix", "candidate_count", "mode_count", "best.candidate", F.col("best.similarity") * 100, state)),
        lines(stages["accepted"], 3, place("group_ix"), F.format_string("group %d: \"%s\", distance %d, %.0f %%", "group_ix", "candidate", "distance", F.col("similarity") * 100)),
        lines(report(stages), 7, place("stamp_ix"), F.col("line")),
        lines(counters(stages), 8, F.col("counter"), F.format_string("%s: %d", "counter", "value")),
    ]
    if "refined" in stages:
        parts.append(lines(stages["refined"], 4, place("group_ix"), F.format_string("group %d: \"%s\" read as the target at step %d", "group_ix", "candidate", "attempt_ix")))
    if "local" in stages:
        parts.append(lines(stages["local"], 5, place("pass_ix", "line_ix", "at"), hit))
    if "italic" in stages:
        parts.append(lines(stages["italic"], 6, place("ord"), F.format_string("%s: score %.3f, text %.3f, ground %.3f", "pass", "score", "fg_score", "bg_score")))
    return reduce(DataFrame.unionByName, parts)
