import hashlib
import random

import xxhash

from inkveil.llm import spotsigs
from inkveil.llm.quality import STOP_WORDS

SCHEMA = "doc_id bigint, text string, fingerprint int"


def xx(seed, *values):
    """Hash of the values in turn, each seeding the next; nulls leave the hash as it is."""
    for v in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else (v & (2**64 - 1)).to_bytes(8, "little")
            seed = xxhash.xxh64_intdigest(raw, seed & (2**64 - 1))
    return seed - (1 << 64) if seed >> 63 else seed


def brute(text):
    words = [w for w in (text or "").lower().translate({ord(c): None for c in spotsigs.PUNCTUATION}).split() if w]
    content = [(i, xx(42, w)) for i, w in enumerate(words) if w not in STOP_WORDS]
    found = set()
    for at, anchor in [(-1, "^")] * bool(words) + list(enumerate(words)):
        chain = [h for i, h in content if i > at][:2]
        follow = xx(42, *chain)
        if at < 0 or anchor in STOP_WORDS:
            found.add(xx(42, anchor, follow))
        elif xx(42, anchor) % 8 == 0:
            found.add(xx(42, xx(42, anchor), follow))
    return sorted(found)


def likeness(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for k, r in enumerate(rows):
        text, after = r[1] or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        s, e = brute(text), brute(edited)
        out.append((r[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), " ".join(map(str, s)), " ".join(map(str, e)), likeness(s, e), likeness(s, brute(after))))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r)[:7] for r in df.collect()), key=str)


def test_whole_table_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert result(spotsigs.compare_with_edited(docs)) == expected([(r.doc_id, r.text) for r in docs.collect()])


def test_nulls_ties_repeats_and_long_texts(spark):
    rows = [(5, "The cat of the house, and a dog."), (5, "The cat of the house, and a dog."), (5, "Z"), (None, "a"), (7, None), (8, ""), (-3, "é la \U0001f600 of"), (10**15, "word the " * 4000), (9, "the")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    assert result(spotsigs.compare_with_edited(docs)) == expected(rows)
    assert result(spotsigs.compare_with_edited(docs, ranges=3, rows_of_block=1)) == expected(rows)
    one = docs.limit(1)
    assert result(spotsigs.compare_with_edited(one)) == expected([tuple(one.first())[:2]])
    assert spotsigs.compare_with_edited(docs.limit(0)).count() == 0


def test_pruning_is_exact(spark):
    import itertools

    from pyspark.sql import functions as F

    sets = [[], [1], [2], [1, 2, 3, 4], [1, 2, 3, 4, 5], [1, 2, 3, 5], list(range(40)), list(range(2, 42)), list(range(100, 140))]
    df = spark.createDataFrame([(a, b) for a, b in itertools.product(sets, sets)], "a array<bigint>, b array<bigint>")
    for r in df.select("a", "b", spotsigs.alike(F.col("a"), F.col("b")).alias("x"), spotsigs.likeness(F.col("a"), F.col("b")).alias("j")).collect():
        assert r.j == likeness(r.a, r.b) and r.x == (likeness(r.a, r.b) >= 0.8)


def classes(rows):
    """Class and its size of each row, by comparing all pairs of sets."""
    sets = [frozenset(brute(t)) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and likeness(sets[i], sets[j]) >= 0.8:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    name = {r: min((x for x in ids if x is not None), default=None) for r, ids in groups.items()}
    return sorted(((rows[i][0], name[find(i)], len(groups[find(i)])) for i in range(len(rows))), key=str)


def test_similar_documents_match_all_pairs(spark, sf_dir, monkeypatch):
    rng = random.Random(2)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for base in rng.sample([t for _, t in rows if len(t) > 300], 6):  # near copies, some just beyond the threshold
        for _ in range(25):
            w = base.split(" ")
            for _ in range(rng.randrange(1, max(2, len(w) // 12))):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
            rows.append((10_000 + len(rows), " ".join(w)))
    rows += [(None, rows[0][1]), (77_777, None), (77_778, ""), rows[1], (None, "entirely of its own making"), (None, rows[2][1])]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, node string, n int")
    want = classes(rows)
    assert max(x[2] for x in want) > 3
    for large, tile in ((32, 512), (4, 3)):
        monkeypatch.setattr(spotsigs, "LARGE", large)
        monkeypatch.setattr(spotsigs, "TILE", tile)
        assert sorted((tuple(r) for r in spotsigs.similar_documents(table).collect()), key=str) == want
    assert spotsigs.similar_documents(table.limit(0)).count() == 0


def test_ids_of_other_types(spark):
    rows = [(f"k{n}", t) for n, t in enumerate(["The cat of the house, and a dog.", "Z", None, "", "é la 😀 of", "word the " * 40, "the", "a b c"])] + [(None, "a"), ("k1", "Z")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    own = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] or ""))
    number = {k: i for i, k in enumerate(sorted({r[0] for r in rows if r[0]}))}
    want = [(r[0], *r[1:]) for r in expected([(number.get(r[0]), r[1]) for r in own])]
    got = [(number.get(r.doc_id), *tuple(r)[1:7]) for r in spotsigs.compare_with_edited(docs, ranges=3, rows_of_block=2).collect()]
    assert sorted(got, key=str) == want


def test_signatures_of_one_set_are_never_dealt(spark):
    """Only signatures that sets share, ordered by their own counts, make groups; a set with a fifth of its own has none."""
    common = list(range(1, 11))
    sets = [(0, common), (1, common[:9]), (2, common[:8] + [100, 101, 102]), (3, list(range(200, 220)))]
    got = spotsigs._candidates(spark.createDataFrame(sets, "node bigint, sigs array<bigint>"), 0.8).filter("home").collect()
    # 10 is of set 0 alone and comes first there; 9 is the rarest that is shared.
    assert sorted((r.node, r.sig, r.n, r["at"]) for r in got) == [(0, 1, 10, 3), (0, 9, 10, 2), (1, 1, 9, 2), (1, 9, 9, 1)]


def test_bitmaps_rule_out_no_alike_pair(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(100):
        both = [rng.randrange(-(2**63), 2**63) for _ in range(rng.randrange(1, 200))]
        rest = [[rng.randrange(-(2**63), 2**63) for _ in range(rng.randrange(0, 40))] for _ in "ab"]
        rows.append((both + rest[0], both + rest[1], len(rest[0]) + len(rest[1])))
    pairs = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>, apart int")
    got = pairs.select("apart", *(c.alias(f"x{k}") for k, c in enumerate(spotsigs.bitmap("a"))), *(c.alias(f"y{k}") for k, c in enumerate(spotsigs.bitmap("b")))).collect()
    far = [(sum(((r[f"x{k}"] ^ r[f"y{k}"]) & (2**64 - 1)).bit_count() for k in range(spotsigs.MAPS)), r.apart) for r in got]
    assert all(x <= y and (y - x) % 2 == 0 for x, y in far)
    assert sum(x for x, _ in far) > 0.9 * sum(y for _, y in far)
