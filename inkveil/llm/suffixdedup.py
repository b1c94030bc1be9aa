"""Suffix-array dedup: bytes covered by a long string that also starts anywhere else are removed.

Texts are UTF-8 bytes. A window of ``length`` bytes is repeated if the same bytes start at any other place of
any document; strings are judged on the input, overlaps count, and every byte of a repeated window goes.
Windows of a second, shorter size, ``short``, are found in the same pass and only reported: passages that
repeat and are too short to be removed.

The suffixes that can begin a repeated window are found and dealt out by content. The anchor of a short window
is the leftmost 16 bytes of smallest hash among its first three quarters, so equal windows have equal anchors at
the same distance; consecutive windows share theirs. A group is an anchor's next bytes that all its windows
contain (a quarter of ``short``): equal windows are always of one group, and only groups of two or more anchors
go on. A context is the span of all long windows that begin where an anchor's short windows do, or what the text
has of it; equal contexts of a group (copies of documents and passages, however many) become one class with a
count, pre-aggregated before the shuffle. A class of two or more is repeated as a whole. The different contexts
of a group meet in a bounded bucket: they are cut into 16-byte tokens from the anchor on, the linear suffix array
of the bucket's tokens (``suffixarray``) is built, runs of suffixes that share the tokens inside every
window are read from it, and the bytes at both window ends are compared exactly.

A group of more than ``CROWD`` different contexts does not fit a bucket and is split by more content, first in two:
windows of both sizes that begin in the same half of the places before the anchor share more than half of a short window
(phrases that many texts have part here), and a group of these, with contexts of its own, is classed and dealt like the first.
A half that is still crowded is split by the windows' size and start: those that start within the same ``STEP`` bytes share
all but ``STEP - 1`` of their bytes. Where even that is crowded
(many contexts differ in nothing but a window's edge), at most ``STEP`` windows of each context are left, one for
each start, and a group of windows with one start is one of equal windows: they are counted by a 128-bit hash.

Null or empty text: 0 bytes, nothing removed. Rows are told apart by content alone: equal texts have equal
results, null and repeated ids included. Texts shorter than ``length`` are never cut. An empty table gives an
empty result; other columns are ignored. Memory follows the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions
from .suffixarray import suffix_array

LENGTH = 400
#: The query's second, reported size: passages of some 50 words.
SHORT = 256
TOKEN = 16
#: Starts before an anchor whose windows the half of a crowded group is split into.
STEP = 16
#: Most different contexts of a group in a bucket, and how many a bucket holds about.
CROWD = 400
BUCKET = 1500
#: What a context is compared for: windows of both sizes, or of one.
BOTH, ONLY_SHORT, ONLY_LONG = 0, 1, 2
#: Windows of a text whose anchors are found at a time.
STRETCH = 1 << 20


def _reach(short: int) -> int:
    """Positions of a window in which its anchor lies."""
    return 3 * short // 4


def anchors(raw: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first and last start) of each run of windows with one anchor."""
    n = len(raw)
    reach = _reach(length)
    found = [(np.zeros(0, np.int64),) * 3]
    for at in range(0, n - length + 1, STRETCH):
        starts = min(STRETCH, n - length + 1 - at)
        m = starts + reach - 1  # anchor positions
        low, high = (np.ndarray((m,), "<u8", raw, at + o, (1,)) for o in (0, 8))
        h = low * np.uint64(0x9E3779B97F4A7C15) + (high ^ np.uint64(0x2545F4914F6CDD1D)) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x9FB21C651E98DF25)
        # Upper half: the hash; lower half: the position, so that the leftmost of equal hashes is smallest.
        key = np.full(-(-m // reach) * reach, np.iinfo(np.uint64).max, np.uint64)
        key[:m] = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
        blocks = key.reshape(-1, reach)
        left = np.minimum.accumulate(blocks, axis=1).ravel()
        right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = (np.minimum(right[:starts], left[reach - 1 : reach - 1 + starts]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        turns = np.flatnonzero(least[1:] != least[:-1]) + 1
        lo = np.concatenate(([0], turns))
        hi = np.concatenate((turns - 1, [starts - 1]))
        found.append((least[lo] + at, lo + at, hi + at))
    return tuple(np.concatenate(x) for x in zip(*found))


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), kind))


def _groups(short: int):
    """(raw) -> the group of each anchor."""
    from xxhash import xxh3_64_intdigest as xx

    inside = short - _reach(short)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g = [xx(raw[x : x + inside]) for raw in b.column(0).to_pylist() for x in anchors(raw, short)[0].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(_signed(g))], names=["g"])

    return run


def _anchored(length: int, short: int):
    """(k1, k2, _id, raw) -> of each text, its anchors' windows, their groups and their contexts' hashes."""
    from xxhash import xxh3_64_intdigest as xx

    inside = short - _reach(short)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for raw in b.column(3).to_pylist():
                p, lo, hi = anchors(raw, short)
                span = hi - lo
                lead = p - lo
                g = _signed([xx(raw[x : x + inside]) for x in p.tolist()])
                c = _signed([xx(raw[x : y + length], (q << 32) | (y - x)) for x, y, q in zip(lo.tolist(), hi.tolist(), lead.tolist())])
                rows.append((lo, lead, span, g, c))
            kinds = [pa.int32()] * 3 + [pa.int64()] * 2
            columns = [b.column(k) for k in range(3)]
            columns += [_lists([r[k].astype(np.int32) if k < 3 else r[k] for r in rows], kinds[k]) for k in range(5)]
            yield pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "_id", "lo", "lead", "span", "g", "c"])

    return run


def _intervals(owners: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ascending owners, ascending for each -> owner of each run of consecutive places, and first and last place of the runs, in turn."""
    first = np.concatenate(([True], (owners[1:] != owners[:-1]) | (places[1:] != places[:-1] + 1)))[: len(places)]
    last = np.concatenate((first[1:], [True]))[: len(places)]
    return owners[first], np.stack((places[first], places[last]), axis=1)


def repeated_starts(groups: np.ndarray, leads: np.ndarray, spans: np.ndarray, levels: np.ndarray, contexts: list[bytes], length: int, short: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(context, start from its first byte), ascending, of the short and of the long windows that another context of the same group holds too.

    Contexts of a group are different, and aligned by their anchors (``leads`` bytes from their starts).
    """
    inner = (short - TOKEN + 1) // TOKEN  # tokens inside every short window, wherever it starts
    pad = 2 * TOKEN
    size = np.array([len(c) for c in contexts], np.int64)
    data = b"".join(b"\0" * pad + c + b"\0" * pad for c in contexts)
    base = np.cumsum(size + 2 * pad) - size - pad
    words = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    offset = leads % TOKEN
    tokens = (size - offset) // TOKEN
    context = np.repeat(np.arange(len(contexts)), tokens)
    index = np.arange(len(context)) - np.repeat(np.cumsum(tokens) - tokens, tokens)
    place = base[context] + offset[context] + TOKEN * index
    low, high, own = words[place], words[place + 8], groups[context]
    order = np.lexsort((high, low, own))
    new = np.concatenate(([True], (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1]) | (own[order][1:] != own[order][:-1])))
    ids = np.empty(len(order), np.int64)
    ids[order] = np.cumsum(new)  # from 1: 0 parts the strings
    none = (np.zeros(0, np.int64),) * 2
    if not len(ids):
        return none, none
    # Only stretches of tokens that all occur elsewhere, long enough to hold a window's, need be sorted.
    common = np.bincount(ids)[ids] > 1
    broken = np.flatnonzero(np.concatenate(([True], (context[1:] != context[:-1]) | ~common[1:] | ~common[:-1])))
    lengths = np.diff(np.concatenate((broken, [len(ids)])))
    long = (lengths >= inner) & common[broken]
    if not long.any():
        return none, none
    string, origin = [], []
    for s, n in zip(broken[long].tolist(), lengths[long].tolist()):
        string += ids[s : s + n].tolist()
        string.append(0)
        origin.append(np.arange(s, s + n))
        origin.append(np.array([-1]))
    origin = np.concatenate(origin)
    left = np.concatenate([np.concatenate((np.arange(n, 0, -1), [0])) for n in lengths[long]])
    every = np.array(suffix_array(string), np.int64)
    symbols = np.array(string, np.int64)

    def found(size_of_window: int, level: int) -> tuple[np.ndarray, np.ndarray]:
        inner = (size_of_window - TOKEN + 1) // TOKEN
        sorted_ = every[left[every] >= inner]
        if not len(sorted_):
            return none
        same = np.ones(len(sorted_) - 1, bool)
        for k in range(inner):
            same &= symbols[sorted_[1:] + k] == symbols[sorted_[:-1] + k]
        run = np.cumsum(np.concatenate(([0], ~same)))
        often = np.bincount(run)[run] > 1
        run, at = run[often], origin[sorted_[often]]
        # Exactly: the bytes of each window before its first and after its last whole token.
        ctx = context[at]
        start = offset[ctx] + TOKEN * index[at]
        relative = index[at] - leads[ctx] // TOKEN
        where = place[at]
        rest = size_of_window - inner * TOKEN  # bytes of a window outside its tokens: fewer than 2 * TOKEN
        ends = where + inner * TOKEN
        edge = [words[where - 16], words[where - 8], *[words[ends + 8 * k] for k in range(4)]]
        asked = (levels[ctx] == BOTH) | (levels[ctx] == level)
        hits = []
        for r in range(TOKEN):
            if rest - r < 0:
                break
            ok = np.flatnonzero(asked & (start - r >= 0) & (start - r <= spans[ctx]) & (start - r + size_of_window <= size[ctx]))
            if len(ok) < 2:
                continue
            shown = [r - 8, r, *[rest - r - 8 * k for k in range(4)]]
            keys = [relative[ok], run[ok]]
            for k, n in enumerate(shown):
                n = min(8, max(0, n))
                if n:
                    bits = np.uint64((1 << 8 * n) - 1)
                    keys.append(edge[k][ok] & (bits << np.uint64(64 - 8 * n) if k < 2 else bits))
            order = np.lexsort(keys)
            differ = np.zeros(len(order) - 1, bool)
            for key in keys:
                differ |= key[order][1:] != key[order][:-1]
            part = np.cumsum(np.concatenate(([0], differ)))
            hit = ok[order[np.bincount(part)[part] > 1]]
            hits.append(ctx[hit] << 32 | (start[hit] - r))
        hits = np.unique(np.concatenate(hits)) if hits else none[0]
        return hits >> 32, hits & 0xFFFFFFFF

    return found(short, ONLY_SHORT), found(length, ONLY_LONG) if length > short else none


def _bucket(length: int, short: int):
    def run(table: pa.Table) -> pa.Table:
        g, c = table.column("g").to_numpy(), table.column("c").to_numpy()
        keep = np.sort(np.unique(np.stack((g, c), axis=1), axis=0, return_index=True)[1])  # rows repeated with their ids
        table = table.take(pa.array(keep))
        g, c, lead, span, level = (table.column(k).to_numpy() for k in ("g", "c", "lead", "span", "level"))
        runs = [_intervals(*x) for x in repeated_starts(g, lead.astype(np.int64), span.astype(np.int64), level, table.column("raw").to_pylist(), length, short)]
        some = np.union1d(runs[0][0], runs[1][0])
        lists = []
        for owners, edges in runs:
            ends = 2 * np.append(np.searchsorted(owners, some), len(owners))
            lists.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(edges.ravel(), pa.int32())))
        return pa.table([pa.array(g[some]), pa.array(c[some]), *lists], schema=pa.schema([("g", pa.int64()), ("c", pa.int64()), ("s", pa.list_(pa.int32())), ("l", pa.list_(pa.int32()))]))

    return run


def _cut_out(length: int, short: int):
    """(raw, items) -> the contexts of a string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = b.column(1)
            flat = items.flatten()
            lo, lead, span, level, g, c, crowded = (flat.field(k) for k in range(7))
            texts = b.column(0).to_pylist()
            owner = np.repeat(np.arange(b.num_rows), items.value_lengths().to_numpy(zero_copy_only=False))
            size = np.where(level.to_numpy() == ONLY_SHORT, short, length)
            raw = [texts[o][x : x + y + n] for o, x, y, n in zip(owner.tolist(), lo.to_pylist(), span.to_pylist(), size.tolist())]
            whole = pa.RecordBatch.from_arrays([g, c, lead, span, level, crowded, pa.array(raw, pa.binary())], names=["g", "c", "lead", "span", "level", "crowded", "raw"])
            for at in range(0, whole.num_rows, 4000):
                yield whole.slice(at, 4000)

    return run


def _split(length: int, short: int, width: int, levels: list[int]):
    """Contexts of crowded groups -> the contexts, for each of ``levels``, of their windows that start within the same ``width`` bytes before the anchor."""
    from xxhash import xxh3_64_intdigest as xx

    # What windows of a level share is as long as the shortest of them has it; their contexts reach as far as the longest.
    sizes = [(level, length if level == ONLY_LONG else short, short if level == ONLY_SHORT else length) for level in levels]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for g, c, lead, span, raw in zip(*(b.column(k).to_pylist() for k in range(5))):
                for level, size, reach in sizes:
                    least = max(lead - span, lead + size - len(raw))
                    for k in range(max(0, least) // width, lead // width + 1):
                        near, far = max(least, width * k), min(lead, width * k + width - 1)
                        if near > far:
                            continue
                        common = raw[lead - width * k : lead - width * k - width + 1 + size]
                        own = raw[lead - far : lead - near + reach]
                        rows.append((g, c, lead - far, far, far - near, level, xx(common, k << 2 | level), xx(own, (far << 32 | (far - near)) << 2 | level)))
            columns = list(zip(*rows)) if rows else [()] * 8
            kinds = [pa.int64()] * 2 + [pa.int32()] * 4
            arrays = [pa.array(x, kind) for x, kind in zip(columns, kinds)] + [pa.array(_signed(list(x)), pa.int64()) for x in columns[6:]]
            yield pa.RecordBatch.from_arrays(arrays, names=["k1", "k2", "lo", "lead", "span", "level", "g", "c"])

    return run


def _hashed(length: int, short: int):
    """Contexts -> a row for each of their windows, of one size each."""
    from xxhash import xxh3_128_digest as xx

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            span = b.column(2).to_numpy() + 1
            size = np.where(b.column(3).to_numpy() == ONLY_SHORT, short, length)
            h = b"".join([xx(raw[s : s + n]) for raw, m, n in zip(b.column(4).to_pylist(), span.tolist(), size.tolist()) for s in range(m)])
            h = np.frombuffer(h, np.int64).reshape(-1, 2)
            s = np.concatenate([np.arange(n) for n in span]) if len(span) else np.zeros(0, np.int64)
            owner = np.repeat(np.arange(len(span)), span)
            columns = [b.column(k).to_numpy()[owner] for k in (0, 1, 3)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(s.astype(np.int32)), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], names=["g", "c", "level", "s", "h1", "h2"])

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows with a 128-bit key of their text, in two longs."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).alias("_id"), F.xxhash64(t).alias("k1"), F.xxhash64(F.lit("second"), t).alias("k2"), t.alias("raw"))


def _by_level(iv: Column) -> list[Column]:
    """The intervals ``iv`` as those of short and of long windows, by what the context is compared for."""
    none = F.array().cast("array<int>")
    return [F.when(F.col("level") != ONLY_LONG, iv).otherwise(none).alias("s"), F.when(F.col("level") != ONLY_SHORT, iv).otherwise(none).alias("l")]


def _splits(length: int, short: int) -> list[tuple[int, list[int]]]:
    """How crowded groups are split, one way after the other: starts before the anchor that stay together, and the levels."""
    half = -(-_reach(short) // 2)
    return [(half, [BOTH])] * (half > STEP) + [(STEP, [ONLY_SHORT] + [ONLY_LONG] * (length > short))]


def _repeated(items: DataFrame, texts: DataFrame, length: int, short: int, splits: list[tuple[int, list[int]]]) -> DataFrame:
    """(g, c, s, l): the starts, as intervals, of each context's repeated short and long windows.

    items: (k1, k2, _id, lo, lead, span, level, g, c, n), the contexts of texts (k1, k2, _id, raw) and how often each stands there.
    splits: the ways that are left to split a crowded group.
    """
    first = [F.first(k).alias(k) for k in ("k1", "k2", "_id", "lo", "lead", "span", "level")]
    classes = cut(items.groupBy("g", "c").agg(F.sum("n").alias("n"), *first))
    mixed = cut(classes.groupBy("g").agg(F.count("*").alias("contexts"), F.min("n").alias("least")).filter("contexts > 1 AND least = 1").select("g", "contexts", (F.col("contexts") > CROWD).alias("crowded")))
    total, crowded = mixed.agg(F.coalesce(F.sum("contexts"), F.lit(0)), F.max("crowded")).first()
    every = classes.filter("n > 1").select("g", "c", *_by_level(F.array(F.lit(0), F.col("span"))))
    if not total:
        return every
    # One row of each text that stands for a class, with all that is asked of it.
    by_text = classes.join(mixed, "g").groupBy("k1", "k2").agg(F.first("_id").alias("_first"), F.collect_list(F.struct("lo", "lead", "span", "level", "g", "c", "crowded")).alias("items"))
    by_text = by_text.withColumnsRenamed({"k1": "_k1", "k2": "_k2"})
    found = texts.join(by_text, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")) & F.col("_id").eqNullSafe(F.col("_first")))
    contexts = found.select("raw", "items").mapInArrow(_cut_out(length, short), "g bigint, c bigint, lead int, span int, level int, crowded boolean, raw binary")
    if crowded:
        contexts = cut(contexts)
    bins = max(4 * shuffle_partitions(items.sparkSession), total // BUCKET + 1)
    dealt = contexts.filter("NOT crowded").withColumn("bin", F.pmod(F.xxhash64("g"), F.lit(bins)))
    run = _bucket(length, short)
    every = every.union(dealt.groupBy("bin").applyInArrow(lambda t: run(t), "g bigint, c bigint, s array<int>, l array<int>"))
    if not crowded:
        return every
    many = contexts.filter("crowded")
    if splits:
        # Rows repeated with their ids give a context twice.
        parts = many.select("g", "c", "lead", "span", "raw").mapInArrow(_split(length, short, *splits[0]), "k1 bigint, k2 bigint, lo int, lead int, span int, level int, g bigint, c bigint").distinct()
        shared = cut(parts.groupBy("g").count().filter("count > 1").select("g"))
        parts = cut(parts.join(shared, "g", "left_semi").withColumns({"_id": F.lit(None).cast("bigint"), "n": F.lit(1).cast("bigint")}))
        whole = many.select(F.col("g").alias("k1"), F.col("c").alias("k2"), F.lit(None).cast("bigint").alias("_id"), "raw")
        again = parts.join(_repeated(parts, whole, length, short, splits[1:]), ["g", "c"])
        moved = [F.transform(k, lambda x: x + F.col("lo")).alias(k) for k in ("s", "l")]
        return every.union(again.select(F.col("k1").alias("g"), F.col("k2").alias("c"), *moved))
    windows = many.select("g", "c", "span", "level", "raw").mapInArrow(_hashed(length, short), "g bigint, c bigint, level int, s int, h1 bigint, h2 bigint")
    both = windows.groupBy("g", "h1", "h2").agg(F.min("c").alias("a"), F.max("c").alias("b")).filter("a < b").select("g", "h1", "h2")
    again = windows.join(cut(both), ["g", "h1", "h2"], "left_semi").groupBy("g", "c", "level").agg(F.collect_set("s").alias("at"))
    return every.union(again.select("g", "c", *_by_level(F.flatten(F.transform("at", lambda x: F.array(x, x))))))


def marks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, short: int | None = None) -> DataFrame:
    """(k1, k2, marks array<struct<lo, s, l>>): of each text with repeated windows, the starts lo + [s0, s1], ... of short ones, lo + [l0, l1], ... of long ones.

    Long windows that would pass the text's end may be among them.
    """
    short = short or length
    rows = _keyed(docs, id_col, text_col)
    kind = rows.schema["_id"].dataType.simpleString()
    long_enough = rows.filter(F.octet_length("raw") >= short)
    # Anchors are found twice: to keep them all would take half as much disk as the texts. The first time only their groups are asked for.
    shared = cut(long_enough.select("raw").mapInArrow(_groups(short), "g bigint").groupBy("g").count().filter("count > 1").select("g"))
    found = long_enough.select("k1", "k2", "_id", "raw").mapInArrow(_anchored(length, short), f"k1 bigint, k2 bigint, _id {kind}, lo array<int>, lead array<int>, span array<int>, g array<bigint>, c array<bigint>")
    each = found.select("k1", "k2", "_id", F.explode(F.arrays_zip("lo", "lead", "span", "g", "c")).alias("x")).select("k1", "k2", "_id", "x.*")
    # Copies of a text are one row from here on. A place determines its group, which is no key here: keyed by
    # it, the sum would have to stand on the join's partitions, and Spark couldn't split a group of many copies.
    places = each.join(shared, "g", "left_semi").groupBy("c", "k1", "k2", "lo", "lead", "span").agg(F.first("g").alias("g"), F.count("*").alias("n"), F.min("_id").alias("_id"))
    places = cut(places.withColumn("level", F.lit(BOTH)))
    every = cut(_repeated(places, long_enough, length, short, _splits(length, short)))
    return cut(places.join(every, ["g", "c"]).groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "s", "l")).alias("marks")))


def _covered(sizes: np.ndarray, marks: pa.ListArray, which: str, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the maximal runs of bytes that texts' marked windows of ``size`` cover, texts and runs ascending; ``sizes``: the texts' bytes."""
    items = marks.flatten()
    text = np.repeat(np.arange(len(sizes)), marks.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    lists = pc.struct_field(items, which)
    pairs = lists.value_lengths().to_numpy(zero_copy_only=False) // 2
    low, high = lists.flatten().to_numpy().astype(np.int64).reshape(-1, 2).T
    lo, text = (np.repeat(x, pairs) for x in (pc.struct_field(items, "lo").to_numpy(), text))
    a, b = lo + low, np.minimum(sizes[text], lo + high + size)
    fits = b - a >= size  # else no such window fits the text
    a, b, text = a[fits], b[fits], text[fits]
    order = np.lexsort((a, text))
    a, b, text = a[order], b[order], text[order]
    # The furthest end so far, of a text's own windows: a later text's are beyond all of an earlier one's.
    shift = text << 32
    furthest = np.maximum.accumulate(shift + b)
    first = np.flatnonzero(np.concatenate(([True], shift[1:] + a[1:] > furthest[:-1]))[: len(a)])
    last = np.append(first[1:], len(a))[: len(first)] - 1
    return text[first], a[first], (furthest - shift)[last]


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, short: int | None = None) -> DataFrame:
    """(id, n_bytes, starts, ends, short_starts, short_ends array<int>, kept binary) of every row.

    The removed runs, the runs covered by repeated windows of ``short`` bytes (default: ``length``), the remaining bytes.
    """
    short = short or length
    if not 4 * TOKEN <= short <= length:
        raise ValueError(f"short must be {4 * TOKEN} at least and length no less")
    found = marks(docs, id_col, text_col, length, short)
    rows = _keyed(docs, id_col, text_col)
    found = found.withColumnsRenamed({"k1": "_k1", "k2": "_k2"})
    rows = rows.join(found, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left").select("_id", "raw", "marks")
    kind = rows.schema["_id"].dataType.simpleString()
    long_of = "l" if length > short else "s"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = b.column(1).to_pylist()
            sizes = np.fromiter(map(len, kept), np.int64, len(kept))
            lists = []
            for which, size in ((long_of, length), ("s", short)):
                text, start, end = _covered(sizes, b.column(2), which, size)
                ends = pa.array(np.searchsorted(text, np.arange(len(kept) + 1)), pa.int32())
                lists += [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (start, end)]
                if len(lists) == 2:  # the long ones are cut out
                    edges = np.flatnonzero(np.diff(text, prepend=-1, append=-1))
                    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
                        raw, at, rest = kept[text[i]], 0, []
                        for x, y in zip(start[i:j].tolist(), end[i:j].tolist()):
                            rest.append(raw[at:x])
                            at = y
                        kept[text[i]] = b"".join([*rest, raw[at:]])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), *lists, pa.array(kept, pa.binary())], names=[id_col, "n_bytes", "starts", "ends", "short_starts", "short_ends", "kept"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, starts array<int>, ends array<int>, short_starts array<int>, short_ends array<int>, kept binary")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, short: int | None = None) -> DataFrame:
    """Per document: id, bytes, removed bytes, removed runs, SHA-256 of the remaining bytes, bytes of repeated ``short`` windows."""
    rows = suffix_dedup(docs, id_col, text_col, length, short)
    covered = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (y - x).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)
    return rows.select(
        F.col(id_col), "n_bytes", covered("starts", "ends").alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), covered("short_starts", "short_ends").alias("n_repeated")
    )
