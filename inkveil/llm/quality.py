"""Quality rules: one table of thresholds compiled into a single Spark projection.

Main path: built-in functions only. Per document, from the whole text:

* ``n_words``, ``word_chars``: words and their code points;
* ``n_symbols``: characters of ``[#*$%&|<>]``;
* ``n_dup_lines``: lines with a word that equal an earlier line;
* ``n_repeat_words``: words inside 5-word windows that occur at least twice in the text. Windows are
  compared by a 64-bit hash of their words; only texts with a repeated window pay for a sort.
* ``n_stop_words``, ``n_lines``: stop words in any of the four languages, lines with a word.

``base_failed``: fewer than 10 words, or over 20 % of the words in repeated windows. ``kept``: the base
held and every rule of the table holds. Null or empty text: all counts 0, ``base_failed``, not kept.
Null ids, repeated rows and ties are independent rows; an empty table gives an empty result; other
columns of the input are ignored by ``quality`` and carried untouched by ``quality_filter``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, words

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "au aux dans des du elle est et il je la le les ne nous on pas pour que qui se sur un une vous "
    "auf das dem den der des die ein eine er es für im ist mit nicht sich sie und von zu "
    "con de del el en las lo los no para por se su una y"
).split()
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\f\r"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """``low <= value <= high``, judged only where ``n_words >= from_words``."""

    name: str
    value: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


#: The threshold table. ``value`` is a Spark SQL expression over the counts.
RULES = (
    Rule("length", "n_words", low=10),
    Rule("word_length", "word_chars / n_words", low=2, high=20),
    Rule("symbols", "n_symbols / n_words", high=0.10),
    Rule("stop_words", "n_stop_words / n_words", low=0.02, from_words=50),
    Rule("duplicate_lines", "n_dup_lines / n_lines", high=0.30, from_words=50),
)


def _repeat_words(ws: Column) -> Column:
    """Words covered by the 5-word windows that occur twice or more."""
    n = F.size(ws)
    hashes = F.transform(ws, lambda w: F.xxhash64(w))
    windows = F.when(
        n >= WINDOW,
        F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(*[F.element_at(F.col("_h"), (i + j).cast("int")) for j in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))
    return hashes, windows


def _measured(df: DataFrame, text: str) -> DataFrame:
    """Adds the counts to ``df``, whose other columns stay; ``text`` names its text column."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("_w", words(t))
    hashes, windows = _repeat_words(F.col("_w"))
    df = df.withColumn("_h", hashes).withColumn("_g", windows)
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, WHITE, "")) > 0)
    stops = STOP_WORDS + [s.capitalize() for s in STOP_WORDS]
    # Starts of repeated windows, ascending: neighbours of equal hash in the sorted (hash, start) pairs.
    pairs = F.array_sort(F.transform(F.col("_g"), lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

    def starts(p: Column) -> Column:
        near = lambda i, k: F.coalesce(F.get(p, i + k)["g"] == F.get(p, i)["g"], F.lit(False))
        flagged = F.transform(p, lambda x, i: F.when(near(i, -1) | near(i, 1), x["i"]))
        return F.array_sort(F.filter(flagged, lambda x: x.isNotNull()))

    def covered(d: Column) -> Column:
        return F.aggregate(
            F.transform(d, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(d, j + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("bigint"), lambda a, x: a + x
        )

    has_repeat = F.size(F.array_distinct("_g")) < F.size("_g")
    df = df.withColumn("_p", F.when(has_repeat, pairs))
    df = df.withColumn("_d", F.when(F.col("_p").isNotNull(), starts(F.col("_p"))))
    df = df.withColumn("_lines", lines)
    return df.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.translate(t, WHITE, "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.when(F.col("_d").isNotNull(), covered(F.col("_d"))).otherwise(F.lit(0)).cast("long"),
            "n_stop_words": F.size(F.filter(F.col("_w"), lambda w: w.isin(stops))).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
        }
    ).drop("_w", "_h", "_g", "_p", "_d", "_lines")


def _verdict(df: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    df = df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    ok = ~F.col("base_failed")
    for r in rules:
        v = F.expr(f"CASE WHEN n_words > 0 THEN {r.value} ELSE 0 END")
        holds = F.lit(True)
        if r.low is not None:
            holds = holds & (v >= r.low)
        if r.high is not None:
            holds = holds & (v <= r.high)
        ok = ok & (holds | (F.col("n_words") < r.from_words))
    return df.withColumn("kept", ok)


def _sealed(df: DataFrame) -> DataFrame:
    """``df`` with ``kept`` behind a generator of one row: a filter on it is not pushed down.

    Pushed through the projections it would repeat every expression that it stands on, many times over.
    """
    others = [c for c in df.columns if c != "kept"]
    return df.select(*others, F.inline(F.array(F.struct("kept"))))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: its id, the counts, ``base_failed`` and ``kept``."""
    df = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    df = _verdict(_measured(df, "_text"), rules)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_stop_words", "n_lines"]
    return df.select(F.col("_id").alias(id_col), *names)


def quality_filter(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The kept documents with all their columns, whatever these are named."""
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text_col).alias("_text"))
    return _sealed(_verdict(_measured(df, "_text"), rules).select("_row", "kept")).filter("kept").select("_row.*")


ORACLE = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, x, regexp_extract_all(x, '[^{SPACE}]+') AS ws,
        list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^{SPACE}]')) AS ls, row_number() OVER () AS r FROM t),
g AS (SELECT r, i, list_aggregate(ws[i:i+4], 'string_agg', ' ') AS g FROM w, unnest(generate_series(1, len(ws)::BIGINT - 4)) AS s(i)),
d AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
c AS (SELECT r, sum(least(5, coalesce(n - i, 5)))::BIGINT AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS n FROM d) GROUP BY r),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(x, '[{SPACE}]', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(x, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
        len(list_filter(ws, lambda s: list_contains([{", ".join(repr(s) for s in STOP_WORDS + [s.capitalize() for s in STOP_WORDS])}], s)))::BIGINT AS n_stop_words,
        len(ls)::BIGINT AS n_lines FROM w LEFT JOIN c USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars BETWEEN 2 * n_words AND 20 * n_words AND n_symbols / n_words <= 0.10
    AND (n_words < 50 OR n_stop_words / n_words >= 0.02) AND (n_words < 50 OR n_dup_lines / n_lines <= 0.30) AS kept,
  n_stop_words, n_lines FROM b
"""
