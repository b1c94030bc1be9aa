"""Nested OCR pages to positioned characters: one row per line, its characters as an array.

A line stays a row: its words and symbols are nested arrays, bounded by what a line can hold, so flattening
needs no shuffle. Only the compatibility composition (no Spark built-in) leaves the JVM, on flat string arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.config import NAME_CHARACTER
from ..functions.plan import let, sealed
from ..functions.schemas import BBOX
from ..functions.text import nfkc_each, strip_marks


def shift_boxes(lines: Column, dx: Column, dy: Column) -> Column:
    """Subtracts an offset from every box of the nested lines."""

    def move(b: Column) -> Column:
        return F.when(b.isNotNull(), F.struct((b["x0"] - dx).alias("x0"), (b["y0"] - dy).alias("y0"), (b["x1"] - dx).alias("x1"), (b["y1"] - dy).alias("y1")))

    symbol = lambda s: F.struct(s["text"].alias("text"), move(s["bbox"]).alias("bbox"))
    word = lambda w: F.struct(w["text"].alias("text"), move(w["bbox"]).alias("bbox"), F.transform(w["symbols"], symbol).alias("symbols"))
    return F.transform(lines, lambda x: F.struct(F.transform(x["words"], word).alias("words")))


def scale_box(b: Column, scale: Column) -> Column:
    return F.struct(*[(b[k] / scale).alias(k) for k in ("x0", "y0", "x1", "y1")])


def symbols_valid(word_box: Column, kept: Column) -> Column:
    """Whether a word's symbols follow each other, fill the word, and have plausible sizes."""

    def placed(boxes: Column) -> Column:
        first, last = F.get(boxes, F.lit(0)), F.element_at(boxes, -1)
        sized = F.forall(boxes, lambda b: (b["x1"] > b["x0"]) & (b["y1"] > b["y0"]))
        before = lambda i: F.when(i == 0, word_box["x0"] - 1).otherwise(F.get(boxes, i - 1)["x1"])
        ordered = F.forall(F.transform(boxes, lambda b, i: b["x0"] >= before(i) - 2), lambda x: x)
        width = F.greatest(F.lit(1.0), word_box["x1"] - word_box["x0"])
        filled = (first["x0"] - word_box["x0"] <= width * 0.25) & (word_box["x1"] - last["x1"] <= width * 0.25)
        return sized & ordered & filled

    def uneven(widths: Column) -> Column:
        n = F.size(widths)
        half = F.floor(n / 2).cast("int")
        median = F.when(n % 2 == 1, F.get(widths, half)).otherwise((F.get(widths, half - 1) + F.get(widths, half)) / 2)
        most = F.element_at(widths, -1)
        return F.when(n <= 3, most / F.greatest(F.lit(1.0), F.get(widths, F.lit(0))) > 2.20).otherwise((median > 0) & (most > median * 2.20))

    def odd(names: Column) -> Column:
        flat = F.exists(names, lambda b: (b["x1"] - b["x0"]) / F.greatest(F.lit(1.0), b["y1"] - b["y0"]) > 1.80)
        widths = F.array_sort(F.transform(names, lambda b: b["x1"] - b["x0"]))
        return F.when(F.size(names) >= 2, flat | let(widths, uneven)).otherwise(F.lit(False))

    names = F.transform(F.filter(kept, lambda s: (F.length(s["norm"]) == 1) & s["norm"].rlike(NAME_CHARACTER)), lambda s: s["bbox"])
    valid = let(F.transform(kept, lambda s: s["bbox"]), placed) & ~let(names, odd)
    return F.when(word_box.isNotNull() & (F.size(kept) > 0), valid).otherwise(F.lit(False))


def _units_of_word(word: Column, norm: Column) -> Column:
    """Characters of one word; ``norm``: struct of its normalised text and those of its symbols. What a lambda reads is bound: else it is made again for each element."""
    symbols = F.filter(F.zip_with(F.coalesce(word["symbols"], F.array().cast("array<struct<text:string,bbox:" + BBOX + ">>")), norm["symbols"], lambda s, n: F.struct(s["text"].alias("text"), s["bbox"].alias("bbox"), n.alias("norm"))), lambda s: s["bbox"].isNotNull())
    b, n = word["bbox"], F.length(norm["text"])

    def chosen(raw: Column) -> Column:
        kept = F.filter(raw, lambda s: s["norm"] != "")

        def place(s: Column, i: Column) -> Column:
            # Place in the run of neighbours with the same label of several characters.
            starts = F.filter(F.sequence(F.lit(0), i), lambda j: (j == 0) | (F.get(raw, j - 1)["norm"] != s["norm"]))
            at = F.least(i - F.array_max(starts), F.length(s["norm"]) - 1)
            ch = F.when(F.length(s["norm"]) > 1, F.substring(s["norm"], at + 1, F.lit(1))).otherwise(s["norm"])
            return F.struct(ch.alias("ch"), s["bbox"].alias("bbox"), s["text"].alias("raw"), F.lit("symbol").alias("bbox_source"))

        direct = F.filter(F.transform(raw, place), lambda u: u["ch"] != "")
        part = lambda i: b["x0"] + (b["x1"] - b["x0"]) * i / n
        cut = F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.struct(
                F.substring(norm["text"], i + 1, F.lit(1)).alias("ch"),
                F.struct(part(i).alias("x0"), b["y0"].alias("y0"), part(i + 1).alias("x1"), b["y1"].alias("y1")).alias("bbox"),
                word["text"].alias("raw"),
                F.lit("word-split").alias("bbox_source"),
            ),
        )
        none = F.filter(direct, lambda u: F.lit(False))
        return F.when(let(kept, lambda k: symbols_valid(b, k)), direct).when(b.isNotNull() & (n > 0), cut).otherwise(none)

    return let(symbols, chosen)


def line_units(pages: DataFrame) -> DataFrame:
    """OCR pages -> (image_id, pass, pass_ix, line_ix, units, text), boxes in the image's own pixels.

    A page's boxes are shifted by its offset and divided by its scale here, once; ``scale`` stays for the crops.
    Lines without characters are dropped. Null lines, words or symbols count as empty.
    """
    one = pages.select("image_id", "pass", "pass_ix", "scale", "off_x", "off_y", F.posexplode("lines").alias("line_ix", "line"))
    shifted = F.get(shift_boxes(F.array("line"), F.col("off_x"), F.col("off_y")), F.lit(0))
    one = sealed(one, {"words": F.filter(shifted["words"], lambda w: w.isNotNull())}).drop("off_x", "off_y", "line").filter(F.size("words") > 0)
    # One flat array of the word's text and its symbols' texts for all words, composed in one call.
    flat = F.flatten(F.transform("words", lambda w: F.concat(F.array(F.coalesce(w["text"], F.lit(""))), F.coalesce(F.transform(w["symbols"], lambda s: F.coalesce(s["text"], F.lit(""))), F.array().cast("array<string>")))))
    one = one.withColumn("_flat", nfkc_each(flat))
    one = sealed(one, {"_flat": F.transform("_flat", strip_marks)})
    sizes = F.transform("words", lambda w: F.greatest(F.lit(0), F.coalesce(F.size(w["symbols"]), F.lit(0))) + 1)
    one = one.withColumn("_ends", F.transform(F.sequence(F.lit(1), F.size("words")), lambda k: F.aggregate(F.slice(sizes, F.lit(1), k), F.lit(0), lambda a, x: a + x)))
    starts = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("_ends"), i - 1))
    one = one.withColumn("_norm", F.transform("words", lambda w, i: F.struct(F.get(F.col("_flat"), starts(i)).alias("text"), F.slice(F.col("_flat"), starts(i) + 2, F.get(F.col("_ends"), i) - starts(i) - 1).alias("symbols"))))
    one = sealed(one, {"units": F.flatten(F.zip_with("words", "_norm", _units_of_word))})
    scaled = F.transform("units", lambda u: F.struct(u["ch"].alias("ch"), scale_box(u["bbox"], F.col("scale")).alias("bbox"), u["raw"].alias("raw"), u["bbox_source"].alias("bbox_source")))
    one = sealed(one.drop("words", "_flat", "_norm", "_ends"), {"units": scaled}).filter(F.size("units") > 0)
    return one.select("image_id", "pass", "pass_ix", "scale", "line_ix", "units", F.array_join(F.transform("units", lambda u: u["ch"]), "").alias("text"))
