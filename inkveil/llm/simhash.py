"""SimHash near-duplicates by tiled exact comparison.

Fingerprint: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, 3-word shingles joined by one space (fewer
words: the whole sequence; none: zero), XXH64 with seed 42 of each, repeats included; a bit is 1 if it is set
in over half of the hashes. Computed in Arrow batches, text by text, so memory follows the longest text.

Links (``radius`` or fewer differing bits) are found between *distinct* fingerprints, so a group of exact
copies is one row. Two fingerprints within radius r agree on at least one of r + 1 slices of their bits;
every fingerprint goes once to the block of each of its slices. A block's rows are laid out in tiles of
``TILE`` fingerprints, in the order of their population counts. Each pair of tiles is compared exactly by
exclusive-or and bit counts in numpy, unless the tiles' population counts are further apart than the radius.
A tile pair emits no more links than a spanning forest of what it linked. A block of one tile is compared
whole; one of many tiles spreads over tasks by tile, each reading the tiles from its own on that are within
the radius, so a huge block neither meets in one task nor loses a link.

Nulls and empty texts: fingerprint zero, linked like any other. A null id takes part in links and is only
smallest in a component whose ids are all null. Repeated rows give repeated result rows. An empty table
gives an empty result; other columns are ignored by ``near_duplicates`` and carried by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, shuffle_partitions
from .graph import components

SHINGLE = 3
RADIUS = 2
SEED = 42
TILE = 1024


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and exactly the white space above
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxh64_intdigest(b" ".join(words), SEED)]
    else:
        # One joined buffer; a shingle is the slice from a word's start to the end of the word two further on.
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = [xxh64_intdigest(joined[i:j], SEED) for i, j in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())]
    return majority(np.array(hashes, dtype="<u8"))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        counts += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((2 * counts > len(h)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(t) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64), pa.int64())], names=["_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, fp): the fingerprint of every row as a signed long."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(_fingerprints, f"_id {kind}, fp bigint")


def _forest(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the pairs of a and b (sorted by population count) within radius."""
    near = np.bitwise_count(a[:, None] ^ b[None, :]) <= radius
    i, j = np.nonzero(near)
    x, y = a[i], b[j]
    keep = x != y
    x, y = x[keep], y[keep]
    if len(x) <= len(a) + len(b):
        return x, y
    nodes, inverse = np.unique(np.concatenate((x, y)), return_inverse=True)
    u, v = inverse[: len(x)], inverse[len(x) :]
    parent = list(range(len(nodes)))

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    took = []
    for k, (p, q) in enumerate(zip(u.tolist(), v.tolist())):
        p, q = find(p), find(q)
        if p != q:
            parent[p] = q
            took.append(k)
    return x[took], y[took]


def _compare(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """_forest of two sorted arrays, in squares of TILE, skipping those with population counts too far apart."""
    found = [(np.zeros(0, np.uint64),) * 2]
    pa_, pb = np.bitwise_count(a).astype(int), np.bitwise_count(b).astype(int)
    for s in range(0, len(a), TILE):
        for t in range(0, len(b), TILE):
            lo, hi, lo2, hi2 = pa_[s], pa_[min(s + TILE, len(a)) - 1], pb[t], pb[min(t + TILE, len(b)) - 1]
            if lo2 - hi <= radius and lo - hi2 <= radius:
                found.append(_forest(a[s : s + TILE], b[t : t + TILE], radius))
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _histogram(rows: DataFrame, radius: int) -> DataFrame:
    """Rows by block and population count, of the blocks of two or more; ``all``: the block's rows."""
    w = Window.partitionBy("k", "v")
    hist = rows.groupBy("k", "v", "pop").agg(F.count("*").alias("n"))
    return cut(hist.withColumn("all", F.sum("n").over(w)).filter("all > 1"))


def _whole(radius: int):
    """Compares the blocks of a table, each whole."""

    def compare(table: pa.Table) -> pa.Table:
        k, v = table.column("k").to_numpy(), table.column("v").to_numpy()
        fp, pop = table.column("fp").to_numpy().view(np.uint64), table.column("pop").to_numpy()
        order = np.lexsort((fp, pop, v, k))
        k, v, fp = k[order], v[order], fp[order]
        edges = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (v[1:] != v[:-1]), [True])))
        size = np.diff(edges)
        found = [(np.zeros(0, np.uint64),) * 2]
        # Blocks of up to 16 rows: all at once, each row against those up to 15 further on. Others: by tiles.
        block = np.repeat(np.arange(len(size)), size)
        for d in range(1, min(16, len(fp))):
            ok = (block[d:] == block[:-d]) & (size[block[d:]] <= 16)
            ok &= np.bitwise_count(fp[d:] ^ fp[:-d]) <= radius
            found.append((fp[:-d][ok], fp[d:][ok]))
        for b in np.flatnonzero(size > 16):
            x = fp[edges[b] : edges[b + 1]]
            found.append(_compare(x, x, radius))
        a, b = np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return compare


def _by_pairs_of_tiles(rows: DataFrame, large: DataFrame, radius: int) -> DataFrame:
    """Links of blocks of many tiles: each pair of tiles that is near enough is one group.

    The rows of a population count are dealt to tiles by hash, so no sort is needed to lay them out.
    """
    tiles = large.select("k", "v", "pop", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))
    mine = rows.join(tiles, ["k", "v", "pop"]).withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    left = tiles.select("k", "v", "pop", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    right = left.select("k", "v", F.col("pop").alias("pop2"), F.col("tile").alias("tile2"))
    near = left.withColumn("to", F.explode(F.sequence(F.col("pop"), F.col("pop") + radius)))
    pairs = near.join(right.withColumn("to", F.col("pop2")), ["k", "v", "to"]).filter((F.col("pop2") > F.col("pop")) | (F.col("tile2") >= F.col("tile")))
    pairs = cut(pairs.select("k", "v", "pop", "tile", "pop2", "tile2", F.xxhash64("k", "v", "pop", "tile", "pop2", "tile2").alias("pair")))
    one = mine.join(pairs, ["k", "v", "pop", "tile"]).select("pair", F.lit(0).alias("side"), "fp")
    two = mine.withColumnsRenamed({"pop": "pop2", "tile": "tile2"}).join(pairs, ["k", "v", "pop2", "tile2"]).select("pair", F.lit(1).alias("side"), "fp")

    def compare(table: pa.Table) -> pa.Table:
        fp, side = table.column("fp").to_numpy().view(np.uint64), table.column("side").to_numpy()
        x, y = _compare(_sorted(fp[side == 0]), _sorted(fp[side == 1]), radius)
        return pa.table({"a": pa.array(x.view(np.int64)), "b": pa.array(y.view(np.int64))})

    return one.union(two).groupBy("pair").applyInArrow(lambda t: compare(t), "a bigint, b bigint")


def _sorted(fp: np.ndarray) -> np.ndarray:
    return fp[np.lexsort((fp, np.bitwise_count(fp)))]


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) whose components are those of all pairs within radius."""
    parts = radius + 1
    cuts = [64 * k // parts for k in range(parts + 1)]

    def bits(col, low: int, high: int):
        return F.shiftrightunsigned(F.shiftleft(col, 64 - high), 64 - high + low)

    slices = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), bits(F.col("fp"), cuts[k], cuts[k + 1]).alias("v")) for k in range(parts)]))
    rows = prints.select("fp", F.bit_count("fp").alias("pop"), slices.alias("s")).select("s.k", "s.v", "fp", "pop")
    hist = _histogram(rows, radius)
    few = hist.filter(F.col("all") <= 4 * TILE).select("k", "v").distinct()
    whole = rows.join(few, ["k", "v"], "left_semi")
    large = hist.filter(F.col("all") > 4 * TILE)
    crowded = None
    if not large.isEmpty():
        # A crowded block: its rows agree on slice k, so those within radius agree on a slice of the other bits too.
        within = rows.join(large.select("k", "v").distinct(), ["k", "v"], "left_semi")
        again = []
        for k in range(parts):
            turned = F.shiftleft("fp", 64 - cuts[k + 1]).bitwiseOR(F.shiftrightunsigned("fp", cuts[k + 1])) if cuts[k + 1] < 64 else F.col("fp")
            rest = 64 - (cuts[k + 1] - cuts[k])
            again += [F.when(F.col("k") == k, F.struct(F.lit(parts + parts * k + j).alias("k"), F.xxhash64("v", bits(turned, rest * j // parts, rest * (j + 1) // parts)).alias("v"))) for j in range(parts)]
        sub = within.select("fp", "pop", F.explode(F.filter(F.array(*again), lambda x: x.isNotNull())).alias("s")).select("s.k", "s.v", "fp", "pop")
        hist2 = _histogram(sub, radius)
        whole = whole.union(sub.join(hist2.filter(F.col("all") <= 4 * TILE).select("k", "v").distinct(), ["k", "v"], "left_semi"))
        large2 = hist2.filter(F.col("all") > 4 * TILE)
        if not large2.isEmpty():
            crowded = _by_pairs_of_tiles(sub, large2, radius)
    bins = 4 * shuffle_partitions(prints.sparkSession) + (hist.agg(F.sum("n")).first()[0] or 0) // 20_000
    whole = whole.withColumn("bin", F.pmod(F.xxhash64("k", "v"), F.lit(bins)))
    compare = _whole(radius)
    out = whole.groupBy("bin").applyInArrow(lambda t: compare(t), "a bigint, b bigint")
    return out if crowded is None else out.union(crowded)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per document: id, fingerprint (hex), component id (the smallest id reachable)."""
    prints = cut(fingerprints(docs, id_col, text_col))
    first = cut(prints.groupBy("fp").agg(F.min("_id").alias("_first")))
    linked = components(links(first.select("fp"), radius))
    # Component: the smallest id among the first ids of its fingerprints.
    member = first.join(linked, first["fp"] == linked["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "_first")
    least = member.groupBy("root").agg(F.min("_first").alias("component_id"))
    named = cut(member.join(least, "root").select(F.col("fp").alias("_fp"), "component_id"))
    out = prints.join(named, prints["fp"] == named["_fp"])
    return out.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One document of each component, the one with the smallest id, with all its columns."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.md5(text).alias("_md5"))
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.fromiter((fingerprint(t) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(prints.view(np.int64), pa.int64())], names=["_id", "_md5", "fp"])

    prints = cut(rows.mapInArrow(run, f"_id {kind}, _md5 string, fp bigint"))
    first = cut(prints.groupBy("fp").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_md5")).alias("_first"), F.count("*").alias("n")))
    linked = components(links(first.select("fp"), radius))
    member = first.join(linked, first["fp"] == linked["node"], "left").select(F.coalesce("root", "fp").alias("root"), "_first")
    keep = member.groupBy("root").agg(F.min("_first").alias("x")).select(F.col("x._id").alias("_k"), F.col("x._md5").alias("_m"))
    out = docs.join(cut(keep), F.col(id_col).eqNullSafe(F.col("_k")) & (F.md5(text) == F.col("_m")), "left_semi")
    # Rows repeated with id and text: only then must whole rows be compared.
    if not prints.groupBy("_id", "_md5").count().filter("count > 1").isEmpty():
        out = out.dropDuplicates([id_col, text_col])
    return out
