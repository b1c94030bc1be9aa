"""Exact dedup by composable polynomial fingerprints, settled by comparing chunks.

The fingerprint of a byte string ``s`` is ``sum((s[i] + 1) * base ** (n - 1 - i))`` modulo the prime 2^31 - 1, for
two bases, kept in one long. It composes: the fingerprint of ``a + b`` is that of ``a`` shifted by ``base ** len(b)``
plus that of ``b``. A text is hashed by chunks of ``CHUNK`` bytes, each one integer dot product with the powers.
A huge text (more than ``HUGE`` bytes) is cut into segments that are rows of their own: they are dealt over tasks,
hashed in parallel, shifted by the bytes that follow them and added up.

Equal fingerprints prove nothing yet. Texts with the fingerprint and length of another one are candidates; the rest
is unique. Of each group of candidates the row that would stay stands for it, and every other row is compared with it
chunk by chunk: rows of chunks meet the representative's chunk of the same index in an equality join, so no task
holds two whole texts. Rows that differ form what is left of the group, and the next round elects a representative
among them, until nothing is left (one round, unless fingerprints collide). A hot group is salted: the representative is
repeated for every ``SALTED`` rows of its group. Rows are never paired with one another.

The texts are scanned twice, first for fingerprints alone; only candidates' texts are written and shuffled.

Null text: equal to the empty text. Of equal texts the row with the largest id stays; a null id is smaller than all
others. Rows repeated with id and text: exactly one of them stays. Empty table: empty result. Other columns are
ignored by ``exact_groups`` and carried by ``dedup_rows``, whatever their names. Memory follows the longest text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small

PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 362_436_069)
#: Bytes of a chunk: 2^16 * 2^8 * 2^31 stays below 2^63.
CHUNK = 1 << 16
#: Bytes from which on a text is hashed as segments in parallel, and bytes of a segment.
HUGE = 16 << 20
SEGMENT = 1 << 20
#: Rows of a group that are compared with one copy of its representative.
SALTED = 512

#: The same rows from the definition.
ORACLE = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""


@lru_cache(None)
def _powers(base: int) -> np.ndarray:
    """The powers of a base, the highest first: of a chunk's last bytes, the last ones."""
    out = [1]
    for _ in range(CHUNK - 1):
        out.append(out[-1] * base % PRIME)
    return np.array(out[::-1], np.int64)


def join_prints(a: tuple[int, ...], b: tuple[int, ...], length: int) -> tuple[int, ...]:
    """The fingerprints of a string from those of its beginning, and of its end of ``length`` bytes."""
    return tuple((x * pow(base, length, PRIME) + y) % PRIME for x, y, base in zip(a, b, BASES))


def polynomials(raw: bytes) -> tuple[int, ...]:
    """The fingerprints of a byte string, one for each base."""
    out = (0,) * len(BASES)
    for at in range(0, len(raw), CHUNK):
        chunk = np.frombuffer(raw, np.uint8, min(CHUNK, len(raw) - at), at).astype(np.int64) + 1
        own = tuple(int(chunk @ _powers(b)[CHUNK - len(chunk) :]) % PRIME for b in BASES)
        out = join_prints(out, own, len(chunk)) if at else own
    return out


def _print_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(..., raw) -> (..., fp): the last column's fingerprint in its place."""
    for b in batches:
        prints = [polynomials(raw) for raw in b.column(b.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([x << 31 | y for x, y in prints], pa.int64())], names=[*b.schema.names[:-1], "fp"])


def _print_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, after, raw) -> (row, h0, h1): a segment's fingerprints shifted by the ``after`` bytes behind it."""
    for b in batches:
        prints = [join_prints(polynomials(raw), (0, 0), after) for after, raw in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([p[k] for p in prints], pa.int64()) for k in (0, 1))], names=["row", "h0", "h1"])


def _segments(raw: Column, size: int) -> Column:
    """array<(ix, part)>: a binary in parts of ``size`` bytes; one empty part of an empty one."""
    last = F.floor((F.octet_length(raw) - 1) / size)
    ix = F.sequence(F.lit(0), F.greatest(last, F.lit(0)).cast("int"))
    return F.transform(ix, lambda k: F.struct(k.alias("ix"), F.substring(raw, k * size + 1, F.lit(size)).alias("part")))


def fingerprints(rows: DataFrame, longest: int) -> DataFrame:
    """Rows with a binary ``raw`` of up to ``longest`` bytes -> the same rows with ``n_bytes`` and ``fp`` in its place."""
    rest = [c for c in rows.columns if c != "raw"]
    rows = rows.withColumn("n_bytes", F.octet_length("raw").cast("long"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*rest, "n_bytes").schema)
    plain = rows if longest <= HUGE else rows.filter(F.col("n_bytes") <= HUGE)
    plain = plain.select(*rest, "n_bytes", "raw").mapInArrow(_print_texts, f"{kinds}, fp bigint")
    if longest <= HUGE:
        return plain
    huge = rows.filter(F.col("n_bytes") > HUGE).withColumn("row", F.monotonically_increasing_id())
    parts = huge.select("row", "n_bytes", F.inline(_segments(F.col("raw"), SEGMENT)))
    parts = parts.select("row", F.greatest(F.col("n_bytes") - (F.col("ix") + 1).cast("long") * SEGMENT, F.lit(0)).alias("after"), "part").repartition("row", "after")
    sums = parts.mapInArrow(_print_segments, "row bigint, h0 bigint, h1 bigint").groupBy("row").agg(F.sum("h0").alias("h0"), F.sum("h1").alias("h1"))
    fp = F.shiftleft(F.col("h0") % PRIME, 31).bitwiseOR(F.col("h1") % PRIME)
    return plain.union(huge.select("row", *rest, "n_bytes").join(sums, "row").select(*rest, "n_bytes", fp.alias("fp")))


def _same(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (rid, _id, n_bytes, fp, raw) -> those told apart now as (rid, rep, keep_id) and the rows left over.

    Rows equal to their group's representative are told apart; each group has one at least.
    """
    top = F.max(F.struct(F.col("_id").isNotNull().alias("some"), "_id", "rid"))
    heads = cut(rows.groupBy("fp", "n_bytes").agg(top.alias("top"), F.count("*").alias("n")))
    heads = heads.select("fp", "n_bytes", F.col("top.rid").alias("rep"), F.col("top._id").alias("keep_id"), F.ceil(F.col("n") / SALTED).cast("int").alias("salts"))
    dealt = rows.join(small(heads), ["fp", "n_bytes"])
    parts = F.inline(_segments(F.col("raw"), CHUNK))
    others = dealt.filter("rid != rep").withColumn("salt", F.pmod(F.xxhash64("rid"), F.col("salts")).cast("int")).select("rid", "rep", "keep_id", "salt", parts)
    shown = dealt.filter("rid = rep").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("rep", "salt", parts)
    shown = shown.select("rep", "salt", "ix", F.col("part").alias("shown"))
    met = others.join(shown, ["rep", "salt", "ix"]).groupBy("rid", "rep", "keep_id").agg(F.bool_and(F.col("part") == F.col("shown")).alias("same"))
    met = cut(met)
    equal = met.filter("same").select("rid", "rep", "keep_id").union(heads.select(F.col("rep").alias("rid"), "rep", "keep_id"))
    return equal, met.filter("NOT same").select("rid")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normal: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per document: id, keep_id (of the row that stays), group_size, kept, text_sha256.

    ``normal``: what is done to a text (a string column, never null) before it is compared; nothing by default.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    raw = (normal(text) if normal else text).cast("binary")
    rows = docs.select(F.col(id_col).alias("_id"), raw.alias("raw"))
    longest = rows.agg(F.coalesce(F.max(F.octet_length("raw")), F.lit(0))).first()[0]
    prints = cut(fingerprints(rows.select("_id", F.sha2("raw", 256).alias("sha"), "raw"), longest))
    shared = cut(prints.groupBy("fp", "n_bytes").agg(F.count("*").alias("_n")).filter("_n > 1").select("fp", "n_bytes"))
    shared = small(shared)
    alone = prints.join(shared, ["fp", "n_bytes"], "left_anti")
    out = alone.select(F.col("_id").alias(id_col), F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    # The texts once more: those of candidates are written, with a number for each row.
    again = fingerprints(rows.select("_id", F.col("raw").alias("_text"), "raw"), longest).withColumnRenamed("_text", "raw")
    left = cut(again.join(shared, ["fp", "n_bytes"], "left_semi").select(F.monotonically_increasing_id().alias("rid"), "_id", "n_bytes", "fp", "raw"))
    names = left.select("rid", "_id", F.sha2("raw", 256).alias("sha"))
    while not left.isEmpty():
        equal, differ = _same(left)
        sizes = equal.groupBy("rep").agg(F.count("*").alias("group_size"))
        told = equal.join(small(cut(sizes)), "rep").join(names, "rid")
        out = out.union(told.select(F.col("_id").alias(id_col), "keep_id", "group_size", (F.col("rid") == F.col("rep")).alias("kept"), F.col("sha").alias("text_sha256")))
        left = cut(left.join(differ, "rid", "left_semi"))
    return out


def dedup_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normal: Callable[[Column], Column] | None = None) -> DataFrame:
    """The rows that stay, with all their columns."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    stays = exact_groups(docs, id_col, text_col, normal).filter("kept").select(F.col(id_col).alias("_keep_id"), F.col("text_sha256").alias("_keep_sha"))
    sha = F.sha2((normal(text) if normal else text).cast("binary"), 256)
    out = docs.join(stays, F.col(id_col).eqNullSafe(F.col("_keep_id")) & (sha == F.col("_keep_sha")), "left_semi")
    keys = docs.select(F.col(id_col).alias("_keep_id"), sha.alias("_keep_sha"))
    twice = cut(keys.groupBy("_keep_id", "_keep_sha").agg(F.count("*").alias("n")).filter("n > 1").drop("n"))
    if twice.isEmpty():
        return out
    # Rows that share id and text would all stay: one of them does.
    on = F.col(id_col).eqNullSafe(F.col("_keep_id")) & (sha == F.col("_keep_sha"))
    whole = out.join(twice, on, "left_semi").select(F.struct(*[F.col(f"`{c}`") for c in out.columns]).alias("row"), F.col(id_col).alias("i"), sha.alias("h"))
    return out.join(twice, on, "left_anti").union(whole.groupBy("i", "h").agg(F.first("row").alias("row")).select("row.*"))
