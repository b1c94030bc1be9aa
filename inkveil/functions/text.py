"""Text rules: normalisation, similarity, search of a target in a line of characters."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .bulk import pair
from .config import CONFIG

_DROP = r"[^\p{L}\p{N}\p{IsHiragana}\p{IsKatakana}\p{IsHan}]"


#: Strings that are composed at a time.
PIECE = 256


def composed(strings: pa.Array) -> pa.Array:
    """Unicode compatibility composition, for which Spark has no built-in, of strings; of a piece each distinct one once, and none of plain ASCII.

    Beside what comes in and goes out, only a piece is held as Python strings.
    """
    done = []
    for at in range(0, len(strings), PIECE):
        part = strings.slice(at, PIECE)
        if not pc.all(pc.string_is_ascii(part)).as_py() and part.null_count < len(part):
            d = part.dictionary_encode()
            part = pa.array([unicodedata.normalize("NFKC", t) for t in d.dictionary.to_pylist()], strings.type).take(d.indices)
        done.append(part)
    return pa.concat_arrays(done) if done else strings


@F.arrow_udf(StringType())
def nfkc(s: pa.Array) -> pa.Array:
    return composed(s)


@F.arrow_udf(ArrayType(StringType()))
def nfkc_each(s: pa.Array) -> pa.Array:
    """``nfkc`` of every string of an array."""
    sizes = s.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
    return pa.ListArray.from_arrays(ends, composed(s.flatten()), mask=s.is_null() if s.null_count else None)


def strip_marks(s: Column) -> Column:
    """Lower case of the letters, digits, kana and ideographs; everything else goes."""
    return F.lower(F.regexp_replace(F.coalesce(s, F.lit("")), _DROP, ""))


def normalize(s: Column, composed: bool = False) -> Column:
    """The form in which texts and targets are compared. ``composed``: the input is known to be NFKC already."""
    return strip_marks(s if composed else nfkc(F.coalesce(s, F.lit(""))))


def characters(s: Column) -> Column:
    """The code points of a string."""
    return F.when(F.length(s) > 0, F.split(s, "")).otherwise(F.array().cast("array<string>"))


def ocr_language(target: Column) -> Column:
    return F.when(target.rlike(r"[぀-ヿ㐀-䶿一-鿿]"), F.lit("jpn")).otherwise(F.lit("eng"))


def least_shared(target: Column) -> Column:
    n = F.length(target)
    return F.when(n <= 2, n).otherwise(F.greatest(F.lit(2), F.ceil(n * 0.5).cast("int")))


def near_scores(target: Column, candidate: Column) -> dict[str, Column]:
    """Of two strings that aren't both empty; ``exact_chars``: how many of the target's characters, repeats counted, the candidate holds."""
    most = F.greatest(F.length(target), F.length(candidate))
    score = lambda p: F.struct((1 - p["distance"] / most).alias("edit"), (p["common"] / most).alias("sequence"), p["shared"].alias("shared"))
    both = score(pair(target, candidate))
    return {"edit_similarity": both["edit"], "sequence_similarity": both["sequence"], "similarity": F.greatest(both["edit"], both["sequence"]), "exact_chars": both["shared"]}


def is_near(target: Column) -> Column:
    """Over the columns of ``near_scores``."""
    return (F.col("similarity") >= CONFIG.min_similarity) & (F.col("exact_chars") >= least_shared(target))


def occurrences(text: Column, target: Column) -> Column:
    """Starts (from 0, in code points) of the target's occurrences, left to right, none overlapping another.

    A split at the literal target finds exactly these; each start follows from the lengths of what is between.
    """
    parts = F.transform(F.split(text, F.concat(F.lit("\\Q"), target, F.lit("\\E")), -1), lambda p: F.length(p))
    step = lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + F.length(target) + n))
    inner = F.slice(parts, F.lit(2), F.size(parts) - 2)
    found = F.aggregate(inner, F.array(F.get(parts, F.lit(0))), step)
    return F.when((F.length(target) > 0) & F.contains(text, target), found).otherwise(F.array().cast("array<int>"))


def squeeze(s: Column) -> Column:
    return F.regexp_replace(s, r"\s+", " ")


def shorten(s: Column, length: int = 55) -> Column:
    return F.when(F.length(s) > length, F.concat(F.substring(s, 1, length), F.lit("…"))).otherwise(s)


def output_name(name: Column) -> Column:
    """File name of the covered image: the last extension gives way to ``_redacted.png``."""
    stem = F.regexp_replace(F.coalesce(name, F.lit("")), r"\.[^.]+$", "")
    return F.concat(F.when(stem == "", F.lit("redacted")).otherwise(stem), F.lit("_redacted.png"))
