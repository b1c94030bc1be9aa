"""Document fingerprints by SpotSigs (Theobald, Siddharth and Paepcke, 2008).

Main path: built-in functions only. A text is lower-cased, freed of punctuation and cut into words. Anchors
are common function words; each anchor's signature is the hash of the anchor and of the chain of the next
``CHAIN`` content words (words that are no function words). So that lists and other languages are not blank,
the start of the text and one in ``SAMPLE`` content words, chosen by the word's hash, are anchors too: a rule
of the word alone, the same wherever it stands. The fingerprint is the sorted set of signatures.

Sets are compared by Jaccard likeness. They are partitioned by length, a class spanning a ratio of
``threshold``: sets more than one class apart, or whose lengths alone rule the threshold out, are pruned
before any element is read (``alike``); ``likeness`` prunes only what is certainly 0 or 1 and is exact.

``similar_documents`` joins a table with itself. Equal sets are one node. A set's signatures are ordered by how many sets
hold them, the rarest first; two sets alike by ``threshold`` share one among the first ``n - ceil(threshold * n) + 1``. Groups are the
sets of a length class, with those of the class below, that have such a signature in common; within a group, sizes
and the place of the shared signature bound the likeness before sets are compared exactly. Groups of over ``LARGE``
sets first compare all with three of them; only sets that this leaves in different components meet, in pairs of tiles
of ``TILE`` sets spread over tasks, and one link for each two components is kept, so a dense group never emits all its pairs.
There sets meet as bitmaps of ``64 * MAPS`` bits first: a bit is the parity of the signatures that fall on it, so two bitmaps differ in no
more bits than sets in signatures, and more than the threshold allows rules a pair out without its signatures.

Null or empty text: the empty set, written as the empty string; two empty sets are alike by 1, an empty and
another by 0. Ids are of any type that can be ordered. Null ids come first in the order of documents; rows that share
an id are ordered by text, and repeated rows follow each other. A class is named by its smallest id that isn't null.
An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, shuffle_partitions, small, words
from .graph import components
from .quality import STOP_WORDS

CHAIN = 2
SAMPLE = 8
THRESHOLD = 0.8
#: Most sets of a group that are compared pair by pair, and sets of a tile in larger ones.
LARGE = 32
TILE = 2048
#: Longs of a set's bitmap in such a group.
MAPS = 8
#: Ranges of ids, cut at quantiles, and rows of a block within a range, in which each document's next is found.
RANGES = 1024
ROWS_OF_BLOCK = 1000
PUNCTUATION = ".,;:!?\"'()[]{}«»„“”’…"


def with_signatures(df: DataFrame, text: str, out: str, chain: int = CHAIN) -> DataFrame:
    """Adds the sorted set of signatures of the column ``text`` as ``out``, array<bigint>."""
    w, c, p, k = (f"_{out}_{x}" for x in "wcpk")
    df = df.withColumn(w, words(F.translate(F.lower(F.coalesce(F.col(text), F.lit(""))), PUNCTUATION, "")))
    places = F.transform(w, lambda x, i: F.when(x.isin(STOP_WORDS), F.lit(None)).otherwise(i))
    df = df.withColumn(p, F.filter(places, lambda i: i.isNotNull()))
    df = df.withColumn(c, F.transform(p, lambda i: F.xxhash64(F.get(F.col(w), i))))
    n = F.size(p)

    def spot(j: Column) -> Column:
        """Signatures of the anchors between content words j - 1 and j, these included on the left."""
        before = F.coalesce(F.get(F.col(p), j - 1), F.lit(-1))
        until = F.coalesce(F.get(F.col(p), j), F.size(w))
        follow = F.xxhash64(*[F.get(F.col(c), j + d) for d in range(chain)])
        common = F.transform(F.slice(F.col(w), before + 2, until - before - 1), lambda a: F.xxhash64(a, follow))
        last = F.get(F.col(c), j - 1)
        own = F.when(j == 0, F.array(F.xxhash64(F.lit("^"), follow))).when(F.pmod(last, F.lit(SAMPLE)) == 0, F.array(F.xxhash64(last, follow)))
        return F.concat(common, F.coalesce(own, F.array().cast("array<bigint>")))

    all_ = F.when(F.size(w) > 0, F.flatten(F.transform(F.sequence(F.lit(0), n), spot))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(out, F.sort_array(F.array_distinct(all_))).drop(w, c, p, k)


def length_class(sigs: Column, threshold: float = THRESHOLD) -> Column:
    """Partition of a set by its length: classes grow by the ratio 1 / threshold; 0 for the empty set."""
    return F.when(F.size(sigs) > 0, F.floor(F.log(F.size(sigs).cast("double")) / math.log(1 / threshold)).cast("int") + 1).otherwise(0)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sorted sets, exactly; disjoint ranges and empty sets are never intersected."""
    shared = F.size(F.array_intersect(a, b))
    disjoint = (F.element_at(a, -1) < F.element_at(b, 1)) | (F.element_at(b, -1) < F.element_at(a, 1))
    some = F.when(disjoint, F.lit(0.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(some)


def alike(a: Column, b: Column, threshold: float = THRESHOLD) -> Column:
    """Whether likeness reaches the threshold; pruned by length class and by length."""
    far = F.abs(length_class(a, threshold) - length_class(b, threshold)) > 1
    short = F.least(F.size(a), F.size(b)) < threshold * F.greatest(F.size(a), F.size(b))
    return F.when(far | short, F.lit(False)).otherwise(likeness(a, b) >= threshold)


def render(sigs: Column) -> Column:
    return F.concat_ws(" ", sigs.cast("array<string>"))


def with_order(docs: DataFrame) -> DataFrame:
    """docs: _id -> the same and _ord, a whole number in the order of the ids: the id itself, or its place among the sorted ids."""
    if docs.schema["_id"].dataType.typeName() in ("byte", "short", "integer", "long"):
        return docs.withColumn("_ord", F.col("_id").cast("bigint"))
    parts = cut(docs.select("_id").filter("_id IS NOT NULL").distinct().repartitionByRange("_id").withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_size"))
    # A row for each partition.
    before = sizes.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    places = parts.join(F.broadcast(before), F.col("_part") == F.col("_p"))
    places = places.select(F.col("_id").alias("_k"), (F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy("_id"))).cast("bigint").alias("_ord"))
    return docs.join(cut(places), F.col("_id") == F.col("_k"), "left").drop("_k")


def with_next(docs: DataFrame, ranges: int = RANGES, rows_of_block: int = ROWS_OF_BLOCK) -> DataFrame:
    """docs: _id, _ord, _text -> the same and _block, _ghost: to each block of ids the first row of the next is added as a ghost.

    ``lead`` within a block then finds every row's next; after the last row comes the first. Blocks are even
    steps within ranges cut at quantiles of the ids' numbers, about ``rows_of_block`` rows each, and a few of them
    make a partition: both grow in number with the table while the quantiles do not. The texts are shuffled once.
    """
    ids = docs.select("_ord")
    stats = ids.agg(F.percentile_approx("_ord", [k / ranges for k in range(1, ranges)], 20 * ranges), F.min("_ord"), F.max("_ord"), F.count("*")).first()
    bounds = sorted(set(stats[0] or []))
    steps = max(1, -(-stats[3] // ((len(bounds) + 1) * rows_of_block)))
    edges = F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>")
    rank = F.size(F.filter(edges, lambda b: b < F.col("_ord")))
    low = F.coalesce(F.get(edges, rank - 1), F.lit(stats[1])).cast("double")
    high = F.coalesce(F.get(edges, rank), F.lit(stats[2])).cast("double")
    part = F.when(high > low, F.floor((F.col("_ord").cast("double") - low) / (high - low) * steps)).otherwise(F.lit(0))
    step = F.greatest(F.lit(0), F.least(F.lit(steps - 1), F.coalesce(part, F.lit(0)))) if steps > 1 else F.lit(0)
    block = (rank.cast("long") * steps + step).cast("long")
    firsts = ids.groupBy(block.alias("_block")).agg(F.min("_ord").alias("_low"), F.max(F.col("_ord").isNull()).alias("_none"))
    firsts = firsts.select("_block", F.floor(F.col("_block") / steps).alias("_range"), F.when(F.col("_none"), F.lit(None)).otherwise(F.col("_low")).alias("_first"))
    firsts = cut(firsts.withColumn("_back", F.lag("_block").over(Window.partitionBy("_range").orderBy("_block"))).withColumn("_last", F.max("_block").over(Window.partitionBy("_range"))))
    # The last block of the range before: at most ``ranges`` rows.
    before = firsts.groupBy("_range").agg(F.max("_last").alias("_l"))
    before = before.select(F.col("_range").alias("_r"), F.coalesce(F.lag("_l").over(Window.orderBy("_range")), F.max("_l").over(Window.partitionBy())).alias("_prior"))
    ring = cut(firsts.join(F.broadcast(before), F.col("_range") == F.col("_r")).select("_first", F.coalesce("_back", "_prior").alias("_to")))
    ghosts = docs.join(small(ring), F.col("_ord").eqNullSafe(F.col("_first")))
    ghosts = ghosts.groupBy("_to", "_ord").agg(F.min(F.coalesce("_text", F.lit(""))).alias("_text"))
    mine = docs.select("_id", "_ord", F.coalesce("_text", F.lit("")).alias("_text"), block.alias("_block"), F.lit(0).alias("_ghost"))
    ghosts = ghosts.select(F.lit(None).cast(docs.schema["_id"].dataType).alias("_id"), "_ord", "_text", F.col("_to").alias("_block"), F.lit(1).alias("_ghost"))
    partitions = max(shuffle_partitions(docs.sparkSession), stats[3] // (4 * rows_of_block) + 1)
    return mine.union(ghosts).repartition(partitions, "_block")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain: int = CHAIN) -> DataFrame:
    """(id, signatures) of every row."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return with_signatures(rows, "_text", "_s", chain).select(F.col("_id").alias(id_col), F.col("_s").alias("signatures"))


def compare_with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int = RANGES, rows_of_block: int = ROWS_OF_BLOCK) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and its likeness to this and to the next document.

    Edited: the last half (rounded down) of the code points gives way to as many first ones of the next document.
    """
    rows = with_next(with_order(docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))), ranges, rows_of_block)
    order = Window.partitionBy("_block").orderBy("_ghost", F.col("_ord").asc_nulls_first(), "_text")
    rows = with_signatures(rows, "_text", "_s")
    rows = rows.withColumns({"_next": F.lead("_text").over(order), "_ns": F.lead("_s").over(order)}).filter("_ghost = 0")
    n = F.length("_text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("_edited", F.concat(F.substring(F.col("_text"), F.lit(1), n - half), F.substring(F.col("_next"), F.lit(1), half)))
    rows = with_signatures(rows, "_edited", "_es")
    return rows.select(
        F.col("_id").alias(id_col),
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        render(F.col("_s")).alias("fingerprint"),
        render(F.col("_es")).alias("edited_fingerprint"),
        likeness(F.col("_s"), F.col("_es")).alias("near_edited"),
        likeness(F.col("_s"), F.col("_ns")).alias("near_next"),
        length_class(F.col("_s")).alias("length_class"),
        alike(F.col("_s"), F.col("_ns")).alias("next_alike"),
    )


def _candidates(sets: DataFrame, threshold: float) -> DataFrame:
    """(sig, cls, node, n, at, home) of sets (node, sigs): the sets that share a rare enough signature, by length class.

    ``at``: the signature's place in the set, from the rarest on. ``home``: whether the set is of the class, else of the one below.
    Signatures are shuffled once, to be counted over all sets. Those of one set only come first in its order and link nothing, so they go at
    once: a set of which they are a fifth has no first ones left.
    """
    each = sets.select("node", F.explode("sigs").alias("sig")).withColumn("f", F.count("*").over(Window.partitionBy("sig"))).filter("f > 1")
    each = cut(each.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("f", "sig"))).alias("common")))
    n = F.size("sigs")
    alone = n - F.size("common")
    first = F.slice("common", F.lit(1), F.greatest(F.lit(0), (n - F.ceil(n * threshold - 1e-9) + 1).cast("int") - alone))
    each = each.join(sets, "node").select("node", n.alias("n"), length_class(F.col("sigs"), threshold).alias("cls"), alone.alias("alone"), F.posexplode(first).alias("at", "x"))
    each = cut(each.select(F.col("x.sig").alias("sig"), "cls", "node", "n", (F.col("alone") + F.col("at") + 1).alias("at")))
    shared = cut(each.groupBy("sig").agg(F.count("*").alias("f")).filter("f > 1").select("sig"))
    both = F.array(F.struct(F.col("cls"), F.lit(True).alias("home")), F.struct((F.col("cls") + 1).alias("cls"), F.lit(False).alias("home")))
    return each.join(shared, "sig", "left_semi").select("sig", "node", "n", "at", F.explode(both).alias("x")).select("sig", "x.cls", "node", "n", "at", "x.home")


def _linked(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes that are alike."""
    x, y = (sets.select(F.col("node").alias(k), F.col("sigs").alias(v)) for k, v in (("a", "_x"), ("b", "_y")))
    return pairs.distinct().join(x, "a").join(y, "b").filter(alike(F.col("_x"), F.col("_y"), threshold)).select("a", "b")


def _may_be_alike(n: Column, at: Column, m: Column, bt: Column, threshold: float) -> Column:
    """Whether sets of n and m signatures can be alike if the first that both have is at these places."""
    most = 1 + F.least(n - at, m - bt)
    return (F.least(n, m) >= threshold * F.greatest(n, m) - 1e-9) & (most >= threshold / (1 + threshold) * (n + m) - 1e-9)


def bitmap(sigs: str) -> list[Column]:
    """The longs m0, m1, ... of the bitmap of the set in column ``sigs``."""
    bit = "shiftleft(1L, int(pmod(shiftright(x, 8), 64)))"
    return [F.expr(f"aggregate({sigs}, 0L, (m, x) -> m ^ if(pmod(x, {MAPS}) = {k}, {bit}, 0L))").alias(f"m{k}") for k in range(MAPS)]


def _crowded(members: DataFrame, sets: DataFrame, linked: DataFrame, threshold: float) -> DataFrame:
    """Links between the components ``linked`` (node, root) of the members (sig, cls, node, n, at, home) of large groups."""
    named = members.join(linked.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").withColumn("root", F.coalesce("root", "node")).drop("_node")
    open_ = named.groupBy("sig", "cls").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.count("*") / TILE).cast("int").alias("tiles")).filter("low < high")
    named = cut(named.join(open_.select("sig", "cls", "tiles"), ["sig", "cls"]))
    mapped = cut(sets.join(named.select("node").distinct(), "node", "left_semi").select("node", "sigs", *bitmap("sigs")))
    named = named.join(mapped, "node").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    maps = [f"m{k}" for k in range(MAPS)]
    own = ["sig", "cls", "node", "n", "at", "home", "root", "sigs", "tile", *maps]
    every = F.sequence(F.lit(0), F.col("tiles") - 1)
    left = named.select(*own, F.explode(F.filter(every, lambda o: o >= F.col("tile"))).alias("other"))
    right = named.select(*own, F.explode(F.filter(every, lambda o: o <= F.col("tile"))).alias("other"))
    right = right.select(*[F.col(c).alias(f"_{c}") for c in own + ["other"]])
    each = (F.col("root") != F.col("_root")) & (F.col("home") | F.col("_home")) & ((F.col("tile") != F.col("_tile")) | (F.col("node") < F.col("_node")))
    apart = sum((F.bit_count(F.col(m).bitwiseXOR(F.col(f"_{m}"))) for m in maps), F.lit(0))
    each &= _may_be_alike(F.col("n"), F.col("at"), F.col("_n"), F.col("_at"), threshold) & (apart <= (1 - threshold) / (1 + threshold) * (F.col("n") + F.col("_n")) + 1e-9)
    # Last in the join's own condition: a filter after the join would be put before what rules pairs out cheaply.
    met = left.join(right, (F.col("sig") == F.col("_sig")) & (F.col("cls") == F.col("_cls")) & (F.col("tile") == F.col("_other")) & (F.col("other") == F.col("_tile")) & each & alike(F.col("sigs"), F.col("_sigs"), threshold))
    return met.groupBy(F.least("root", "_root").alias("r"), F.greatest("root", "_root").alias("q")).agg(F.min(F.struct(F.col("node").alias("a"), F.col("_node").alias("b"))).alias("x")).select("x.a", "x.b")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain: int = CHAIN, threshold: float = THRESHOLD) -> DataFrame:
    """(id, class_id, n_class) of every row: the class of texts that links of ``threshold`` or more connect, and its number of rows."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    rows = with_signatures(rows, "_text", "sigs", chain).select("_id", F.unhex(F.md5(render(F.col("sigs")).cast("binary"))).alias("node"), "sigs")
    rows = cut(rows)
    sets = rows.filter(F.size("sigs") > 0).groupBy(F.col("node").alias("key")).agg(F.first("sigs").alias("sigs"))
    # Nodes are numbered, so that a signature is shuffled with 8 bytes.
    sets = cut(sets.select("key", F.monotonically_increasing_id().alias("node"), "sigs"))
    keys, sets = sets.select("key", F.col("node").alias("_n")), sets.select("node", "sigs")
    members = cut(_candidates(sets, threshold))
    groups = cut(members.groupBy("sig", "cls").agg(F.count("*").alias("size"), F.max("home").alias("any"), F.min("node").alias("c1"), F.max("node").alias("c2"), F.min_by("node", F.xxhash64("node")).alias("c3")).filter("size > 1 AND any"))
    few = members.join(groups.filter(F.col("size") <= LARGE).select("sig", "cls"), ["sig", "cls"], "left_semi")
    other = few.select("sig", "cls", F.col("node").alias("b"), F.col("n").alias("m"), F.col("at").alias("bt"), F.col("home").alias("bh"))
    bound = _may_be_alike(F.col("n"), F.col("at"), F.col("m"), F.col("bt"), threshold)
    pairs = few.withColumnRenamed("node", "a").join(other, ["sig", "cls"]).filter((F.col("a") < F.col("b")) & (F.col("home") | F.col("bh")) & bound).select("a", "b")
    large = groups.filter(F.col("size") > LARGE)
    if large.isEmpty():
        links = cut(_linked(pairs, sets, threshold))
    else:
        crowd = cut(members.join(large.select("sig", "cls"), ["sig", "cls"], "left_semi"))
        centers = large.select("sig", "cls", F.explode(F.array("c1", "c2", "c3")).alias("b"))
        stars = crowd.join(centers, ["sig", "cls"]).filter("node <> b").select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b"))
        links = cut(_linked(pairs.union(stars), sets, threshold))
        links = cut(links.union(_crowded(crowd, sets, components(links), threshold)))
    roots = components(links).withColumnRenamed("node", "_node")
    # Sets without a link are classes of their own, and so is the empty set.
    keys = keys.join(roots, F.col("_n") == F.col("_node"), "left").select("key", F.coalesce("root", "_n").alias("root"))
    named = rows.select("_id", "node").join(keys, F.col("node") == F.col("key"), "left").select("_id", F.coalesce("root", F.lit(-1)).alias("root"))
    classes = cut(named.groupBy("root").agg(F.min("_id").alias("class_id"), F.count("*").alias("n_class")).withColumnRenamed("root", "_root"))
    return named.join(classes, F.col("root") == F.col("_root")).select(F.col("_id").alias(id_col), "class_id", "n_class")
