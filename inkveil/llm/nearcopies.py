"""SimHash near-dedup at a likeness: near copies of 5-word Jaccard likeness 0.8 or more.

The pipeline's near-duplicate stage. Words as in ``simhash``; a text is the set of XXH64 hashes of its
``SHINGLE``-word shingles (fewer words: the whole sequence; none: the empty set). Its SimHash has ``WORDS`` words of
64 bits: the majority of each bit over the hashes, and over further mixes of them. Texts are linked if their
Jaccard likeness is 4/5 or more; one document of each connected component stays.

Equal sets are one node. All fingerprints meet in tiles, compared by exclusive-or and bit counts, except those whose
sets are too different in size to be alike: fingerprints are laid out by set size and cut into tiles at quantiles, and
a tile meets those whose sizes allow 4/5. Two that differ in ``RADIUS`` bits or fewer are candidates. At likeness 0.8 a
bit differs with probability 0.15, so 39 of 256 bits do, and over 68 in fewer than one pair in a million; of
two unrelated texts 128 do. (Sets of four and five hashes, 0.19: one in 1,000. Wider than op6's 64 bits, since within reach in these are
three unrelated pairs in a hundred.) A tile pair counts word by word: after each, pairs beyond ``REACH`` go, by five standard deviations.

A tile pair emits a spanning forest of its candidates, so a dense group never emits all its pairs. The forests'
components are groups: only within one can candidates be. Candidates of a group are compared on their whole
sets in whole numbers, so no pair below 0.8 is linked. Groups of up to ``LARGE`` nodes
compare all candidates. A larger group first compares its nodes with three of them; what these leave in different
components is compared by pairs of tiles of ``TILE`` nodes, spread over tasks, each emitting a spanning forest.

Time: comparing tiles grows with the square of the number of different texts (some nanoseconds a pair whose sizes
match). Tiles grow with its root, so each fingerprint is sent to a number of tiles that grows with the root only.

A null id is only kept in a component whose ids are all null. Rows repeated with id and text stay once. An
empty table gives an empty result; all columns are carried.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small
from .graph import components

SHINGLE = 5
SEED = 42
#: Words of a fingerprint, and most bits in which two candidates differ: of the first word, of the first two, and so on.
WORDS = 4
REACH = (24, 40, 54, 68)
RADIUS = REACH[-1]
#: Fingerprints of a tile are this many times the root of their number.
SPREAD = 20
LARGE = 32
TILE = 512

PRINTS = [f"f{k}" for k in range(WORDS)]
_STEP = np.arange(WORDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - SHINGLE + 1)
    return np.unique(np.array([xxh64_intdigest(joined[i:j], SEED) for i, j in zip(starts[:n].tolist(), ends[-n:].tolist())], np.uint64))


def fingerprint(h: np.ndarray) -> np.ndarray:
    """The SimHash of a set of hashes, ``WORDS`` words: of each bit the majority, the first word's of the hashes themselves."""
    votes = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(h), 4096):
        x = h[at : at + 4096, None] + _STEP
        x[:, 1:] = (x[:, 1:] ^ (x[:, 1:] >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x[:, 1:] = (x[:, 1:] ^ (x[:, 1:] >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x[:, 1:] ^= x[:, 1:] >> np.uint64(31)
        bits = np.unpackbits(x.view(np.uint8), axis=1)
        votes += (np.ones(len(bits), np.float32) @ bits.astype(np.float32)).astype(np.int64)
    return np.packbits(2 * votes > len(h)).view(np.uint64)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh64_intdigest

    for b in batches:
        sets = [shingles(t) for t in b.column(1).to_pylist()]
        node = np.fromiter((xxh64_intdigest(h.tobytes(), SEED) for h in sets), np.uint64, len(sets))
        prints = np.array([fingerprint(h) for h in sets], np.uint64).reshape(-1, WORDS).view(np.int64)
        columns = [b.column(0), b.column(2), pa.array(node.view(np.int64)), pa.array([len(h) for h in sets], pa.int32()), *(pa.array(f) for f in prints.T.copy())]
        yield pa.RecordBatch.from_arrays(columns, names=["_id", "_md5", "s", "n", *PRINTS])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingles(t).view(np.int64) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["s", "set"])


def _alike(shared, m, n):
    """Jaccard likeness of 4/5 or more, of sets of m and n members that share ``shared``."""
    return 9 * shared >= 4 * (m + n)


def _sizes_allow(m: Column, n: Column) -> Column:
    return 5 * F.least(m, n) >= 4 * F.greatest(m, n)


def _words(table: pa.Table) -> np.ndarray:
    """The fingerprints of a table, one row for each word."""
    return np.array([table.column(f).to_numpy() for f in PRINTS]).view(np.uint64)


def _near_prints(table: pa.Table) -> pa.Table:
    """A spanning forest of the candidates between the fingerprints of side 0 and side 1; of a tile with itself side 0 only."""
    table = table.sort_by("n")
    side, node, size, f = table.column("side").to_numpy(), table.column("s").to_numpy(), table.column("n").to_numpy().astype(np.int64), _words(table)
    itself = table.column("t")[0] == table.column("u")[0]
    left = np.flatnonzero(side == 0)
    right = left if itself else np.flatnonzero(side == 1)
    n, first = size[right], f[0][right]
    label = np.arange(len(node))
    bits, counts = np.empty(32 * 2048, np.uint64), np.empty(32 * 2048, np.uint8)
    a, b = [node[:0]], [node[:0]]
    for at in range(0, len(left), 32):
        rows = left[at : at + 32]
        lo, hi = np.searchsorted(5 * n, 4 * size[rows[0]]), np.searchsorted(4 * n, 5 * size[rows[-1]], "right")
        for on in range(max(lo, at) if itself else lo, hi, 2048):
            wide = min(2048, hi - on)
            x, c = (k[: len(rows) * wide].reshape(len(rows), wide) for k in (bits, counts))
            np.bitwise_count(np.bitwise_xor(f[0][rows][:, None], first[None, on : on + wide], out=x), out=c)
            found = np.flatnonzero(c <= REACH[0])
            i, j = np.divmod(found, wide)
            i, j, far = rows[i], right[on + j], c.ravel()[found]
            ok = label[i] != label[j]
            for word in range(1, WORDS):
                i, j = i[ok], j[ok]
                far = far[ok] + np.bitwise_count(f[word][i] ^ f[word][j])  # at most 54 + 64
                ok = far <= REACH[word]
            i, j = i[ok], j[ok]
            ok = 5 * np.minimum(size[i], size[j]) >= 4 * np.maximum(size[i], size[j])
            i, j = i[ok], j[ok]
            while len(i):  # links the first row with every component that it is a candidate of
                mine = i == i[0]
                roots, k = np.unique(label[j[mine]], return_index=True)
                a.append(np.repeat(node[i[0]], len(k)))
                b.append(node[j[mine][k]])
                label[label == roots[0] if len(roots) == 1 else np.isin(label, roots)] = label[i[0]]
                ok = label[i] != label[j]
                i, j = i[ok], j[ok]
    a, b = np.concatenate(a), np.concatenate(b)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def groups_of_prints(prints: DataFrame) -> DataFrame:
    """(node, root): components of candidates. prints: (s, n, f0, ...) of every node, already cut; those without candidates have no row."""
    prints = prints.filter("n > 0")
    tiles = max(1, math.ceil(math.sqrt(prints.count()) / SPREAD))
    place = F.col("n") + F.pmod("s", F.lit(1 << 20)) / (1 << 20)
    cuts = prints.agg(F.percentile_approx(place, [k / tiles for k in range(1, tiles)] or [0.5], 20 * tiles + 10000)).first()[0]
    cuts = sorted(set(cuts or [])) if tiles > 1 else []
    # Set sizes from and to which a tile reaches; its partners are those that these allow.
    low, high = [0, *map(math.floor, cuts)], [*map(math.floor, cuts), 1 << 40]
    begin = F.lit([bisect_left([5 * h for h in high], 4 * n) for n in low])
    end = F.lit([bisect_right([4 * k for k in low], 5 * h) - 1 for h in high])
    tile = F.size(F.filter(F.lit(cuts), lambda c: c < place)) if cuts else F.lit(0)
    rows = prints.withColumn("tile", tile)
    before, after = F.sequence(F.get(begin, "tile"), F.col("tile")), F.sequence("tile", F.get(end, "tile"))
    meets = F.concat(
        F.transform(after, lambda o: F.struct(F.col("tile").alias("t"), o.alias("u"), F.lit(0).alias("side"))),
        F.transform(F.filter(before, lambda o: o < F.col("tile")), lambda o: F.struct(o.alias("t"), F.col("tile").alias("u"), F.lit(1).alias("side"))),
    )
    dealt = rows.select("s", "n", *PRINTS, F.explode(meets).alias("m")).select("m.*", "s", "n", *PRINTS)
    return components(dealt.groupBy("t", "u").applyInArrow(lambda t: _near_prints(t), "a bigint, b bigint"))


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are alike, of sets (s, set)."""
    x, y = (sets.select(F.col("s").alias(k), F.col("set").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    shared = F.size(F.array_intersect("x", "y"))
    return pairs.distinct().join(x, "a").join(y, "b").filter(_alike(shared, F.size("x"), F.size("y"))).select("a", "b")


def _within(prints: list[str], others: list[str]) -> Column:
    """Whether fingerprints differ in ``RADIUS`` bits or fewer."""
    return sum((F.bit_count(F.col(p).bitwiseXOR(F.col(q))) for p, q in zip(prints, others)), F.lit(0)) <= RADIUS


def _tile_pair(table: pa.Table) -> pa.Table:
    """A spanning forest of the alike pairs of nodes of side 0 and side 1 whose roots differ."""
    side, node, root = (table.column(c).to_numpy() for c in ("side", "s", "root"))
    sets = [frozenset(v) for v in table.column("set").to_pylist()]
    f = _words(table)
    parent = {r: r for r in set(root.tolist())}

    def find(r: int) -> int:
        while parent[r] != r:
            parent[r] = parent[parent[r]]
            r = parent[r]
        return r

    a, b = [], []
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    size = np.array([len(s) for s in sets])
    if len(left) and len(right):
        near = sum(np.bitwise_count(w[left][:, None] ^ w[right][None, :]).astype(np.int16) for w in f) <= RADIUS
        m, n = size[left][:, None], size[right][None, :]
        near &= 5 * np.minimum(m, n) >= 4 * np.maximum(m, n)
        for i, j in zip(*(k.tolist() for k in np.nonzero(near))):
            i, j = left[i], right[j]
            p, q = find(int(root[i])), find(int(root[j]))
            if p != q and _alike(len(sets[i] & sets[j]), len(sets[i]), len(sets[j])):
                parent[q] = p
                a.append(node[i])
                b.append(node[j])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _crowded(members: DataFrame, sets: DataFrame, linked: DataFrame) -> DataFrame:
    """Links between the components ``linked`` (node, root) of the large groups' members (key, s, f0, ...)."""
    named = members.join(linked, F.col("s") == F.col("node"), "left").select("key", "s", *PRINTS, F.coalesce("root", "s").alias("root"))
    open_ = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.count("*") / TILE).cast("int").alias("tiles")).filter("low < high")
    named = named.join(open_.select("key", "tiles"), "key").withColumn("tile", F.pmod(F.xxhash64("s"), F.col("tiles")).cast("int"))
    every = F.sequence(F.lit(0), F.col("tiles") - 1)
    pair = F.explode(F.transform(every, lambda o: F.struct(F.least("tile", o).alias("t"), F.greatest("tile", o).alias("u"), (o < F.col("tile")).cast("int").alias("side"), (o == F.col("tile")).alias("same"))))
    dealt = named.select("key", "s", *PRINTS, "root", pair.alias("p")).select("key", "p.t", "p.u", "s", *PRINTS, "root", F.explode(F.when(F.col("p.same"), F.array(F.lit(0), F.lit(1))).otherwise(F.array("p.side"))).alias("side"))
    return dealt.join(sets, "s").groupBy("key", "t", "u").applyInArrow(lambda t: _tile_pair(t), "a bigint, b bigint")


def links(prints: DataFrame, texts) -> DataFrame:
    """(a, b): links whose components are those of all alike candidates. prints: (s, n, f0, ...) of every node, already cut.

    ``texts``: a function of a table of nodes (s) that gives their (s, set), each once.
    """
    found = groups_of_prints(prints)
    members = cut(prints.join(found, F.col("s") == F.col("node")).select(F.col("root").alias("key"), "s", "n", *PRINTS))
    sets = cut(texts(members.select("s")))
    groups = cut(members.groupBy("key").agg(F.count("*").alias("size"), F.min("s").alias("c1"), F.max("s").alias("c2"), F.min_by("s", F.xxhash64("s")).alias("c3")))
    few = members.join(groups.filter(F.col("size") <= LARGE).select("key"), "key", "left_semi")
    other = few.select("key", F.col("s").alias("b"), F.col("n").alias("m"), *(F.col(f).alias(f"o{f}") for f in PRINTS))
    within = _within(PRINTS, [f"o{f}" for f in PRINTS])
    pairs = few.withColumnRenamed("s", "a").join(other, "key").filter((F.col("a") < F.col("b")) & _sizes_allow(F.col("n"), F.col("m")) & within).select("a", "b")
    large = groups.filter(F.col("size") > LARGE)
    if large.isEmpty():
        return cut(_linked(pairs, sets))
    crowd = cut(members.join(large.select("key"), "key", "left_semi").drop("n"))
    centers = large.select("key", F.explode(F.array("c1", "c2", "c3")).alias("b"))
    stars = crowd.join(centers, "key").filter("s <> b").select(F.least("s", "b").alias("a"), F.greatest("s", "b").alias("b"))
    found = cut(_linked(pairs.union(stars), sets))
    return found.union(cut(_crowded(crowd, sets, components(found))))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component of near copies, the one with the smallest id, with all its columns."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), F.md5(text).alias("_md5"))
    kind = rows.schema["_id"].dataType.simpleString()
    prints = cut(rows.mapInArrow(_sketches, f"_id {kind}, _md5 string, s bigint, n int, {', '.join(f'{f} bigint' for f in PRINTS)}"))
    # Of one node all but the row is equal.
    first = cut(prints.groupBy("s").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_md5")).alias("_first"), *(F.min(c).alias(c) for c in ("n", *PRINTS))))

    def texts(nodes: DataFrame) -> DataFrame:
        wanted = small(cut(first.join(nodes, "s", "left_semi").select("s", F.col("_first._id").alias("_k"), F.col("_first._md5").alias("_m"))))
        found = rows.join(wanted, F.col("_id").eqNullSafe(F.col("_k")) & (F.col("_md5") == F.col("_m"))).select("s", "_text")
        return found.dropDuplicates(["s"]).mapInArrow(_sets, "s bigint, set array<bigint>")

    linked = components(links(first.drop("_first"), texts))
    member = first.join(linked, first["s"] == linked["node"], "left").select(F.coalesce("root", "s").alias("root"), "_first")
    keep = member.groupBy("root").agg(F.min("_first").alias("x")).select(F.col("x._id").alias("_k"), F.col("x._md5").alias("_m"))
    out = docs.join(cut(keep), F.col(id_col).eqNullSafe(F.col("_k")) & (F.md5(text) == F.col("_m")), "left_semi")
    # Rows repeated with id and text: only then must whole rows be compared.
    if not prints.groupBy("_id", "_md5").count().filter("count > 1").isEmpty():
        out = out.dropDuplicates([id_col, text_col])
    return out
