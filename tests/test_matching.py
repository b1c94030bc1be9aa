"""Search kernels and both ways of the search operators against plain loops."""

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from inkveil.functions import automaton, bulk, filterindex, text
from inkveil.operators import groups, match


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d = d, [i]
        for j, y in enumerate(b, 1):
            d.append(min(p[j] + 1, d[-1] + 1, p[j - 1] + (x != y)))
    return d[-1]


def common(a, b):
    d = [0] * (len(b) + 1)
    for x in a:
        p, d = d, [0]
        for j, y in enumerate(b, 1):
            d.append(p[j - 1] + 1 if x == y else max(p[j], d[-1]))
    return d[-1]


def word(rng, alphabet, sizes):
    return "".join(rng.choice(alphabet) for _ in range(rng.choice(sizes)))


def near(target, line):
    """(start, length, distance, common, shared) of the windows that resemble the target."""
    out = []
    for i in range(len(line)):
        for n in range(max(1, len(target) - 2), len(target) + 3):
            w = line[i : i + n]
            if len(w) < n:
                break
            most, shared = max(len(target), n), sum(c in w for c in target)
            d, c = distance(target, w), common(target, w)
            if max(1 - d / most, c / most) >= 0.5 and shared >= (len(target) if len(target) <= 2 else max(2, -(-len(target) // 2))):
                out.append((i, n, d, c, shared))
    return out


def exact(target, line):
    out, i = [], line.find(target)
    while i >= 0:
        out.append(i)
        i = line.find(target, i + len(target))
    return out


@pytest.mark.parametrize("alphabet", ["ab", "abcdéf", "漢字かなカナ\U00020bb7"])
def test_bulk_scores_of_any_length(alphabet):
    rng = random.Random(len(alphabet))
    sizes = [0, 1, 2, 5, 31, 63, 64, 65, 100, 127, 128, 129, 200]
    pairs = [(word(rng, alphabet, sizes), word(rng, alphabet, sizes)) for _ in range(250)]
    got = list(zip(*(x.tolist() for x in bulk.compare(*map(list, zip(*pairs))))))
    assert got == [(distance(a, b), common(a, b), sum(c in b for c in a)) for a, b in pairs]
    assert [len(x) for x in bulk.compare([], [])] == [0, 0, 0]


def test_windows_drop_places_that_cannot_reach_the_threshold():
    rng = random.Random(2)
    targets = [word(rng, "abcdef", [1, 2, 3, 4, 6, 9, 70]) for _ in range(200)]
    lines = [word(rng, "abcdefghijklmnop", [0, 1, 7, 40] if len(t) < 60 else [90]) for t in targets]
    *rows, tried, left = bulk.windows(targets, lines)
    got = {}
    for k, *row in zip(*(x.tolist() for x in rows)):
        got.setdefault(k, []).append(tuple(row))
    assert [got.get(k, []) for k in range(len(targets))] == [near(t, x) for t, x in zip(targets, lines)]
    assert 0 < left < tried / 2, (left, tried)


def test_index_names_every_target_with_a_near_match():
    rng = random.Random(3)
    alphabet = "".join(map(chr, range(0x4E00, 0x4E80)))
    targets = sorted({word(rng, alphabet, [1, 2, 3, 4, 5, 6, 8, 12]) for _ in range(150)})
    lines = [word(rng, alphabet, [0, 3, 20]) for _ in range(80)]
    for _ in range(80):  # targets with characters put in, taken out, exchanged
        t = list(rng.choice(targets))
        for _ in range(rng.randrange(1 + len(t) // 2)):
            t[rng.randrange(len(t))] = rng.choice(["", rng.choice(alphabet), rng.choice(alphabet) + t[0]])
        lines.append(word(rng, alphabet, [2, 9]) + "".join(t) + word(rng, alphabet, [2, 9]))
    found = set(zip(*(x.tolist() for x in filterindex.PairIndex(targets).candidates(lines))))
    want = {(i, k) for i, x in enumerate(lines) for k, t in enumerate(targets) if near(t, x)}
    assert want <= found and len(want) > 60
    assert len(found) < len(lines) * len(targets) / 4  # most targets are never looked at


@pytest.mark.parametrize("lanes,least", [(4096, 256), (3, 5)])
def test_automaton_finds_what_one_search_for_each_target_finds(monkeypatch, lanes, least):
    monkeypatch.setattr(automaton, "LANES", lanes)
    monkeypatch.setattr(automaton, "LEAST", least)
    rng = random.Random(4)
    targets = sorted({word(rng, "abc", [1, 2, 3, 4, 7, 30]) for _ in range(120)} | {"é\U0001f600", "aaa"})
    lines = [word(rng, "abc", [0, 1, 5, 300]) for _ in range(60)] + ["aé\U0001f600é\U0001f600", "a" * 50, ""]
    got = list(zip(*(x.tolist() for x in automaton.Automaton.of(targets).occurrences(lines))))
    assert got == [(i, k, at) for i, x in enumerate(lines) for k, t in enumerate(targets) for at in exact(t, x)]


def test_automaton_time_hardly_follows_the_number_of_targets():
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    targets = sorted({word(rng, letters, [9]) for _ in range(10_000)})
    lines = [word(rng, letters, [100]) for _ in range(5000)]
    took = []
    for n in (10, 10_000):
        a = automaton.Automaton.of(targets[:n])
        a.occurrences(lines)
        began = time.process_time()
        a.occurrences(lines)
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0]  # a thousand times as many targets


LINES = "image_id string, pass string, pass_ix int, line_ix int, text string, scale double, units array<struct<ch:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>,raw:string,bbox_source:string>>"


def lines_of(spark, texts):
    return spark.createDataFrame([("i", "contrast", 0, k, t, 1.0, [(c, (10.0 * j, 0.0, 10.0 * j + 9, 10.0), c, "symbol") for j, c in enumerate(t)]) for k, t in enumerate(texts)], LINES)


@pytest.mark.parametrize("most", [20_000, 0])
def test_operators_find_all_by_either_way(spark, monkeypatch, most):
    """As an automaton and an index, or by equality joins."""
    monkeypatch.setattr(match, "MOST_TARGETS", most)
    rng = random.Random(6)
    targets = sorted({word(rng, "abcdef", [1, 2, 3, 5, 8]) for _ in range(12)})
    texts = [word(rng, "abcdefgh", [1, 9, 25]) for _ in range(12)]
    wanted = spark.createDataFrame([(f"t{k}", t) for k, t in enumerate(targets)] + [("again", targets[0])], "target_id string, target string")
    got = sorted((r.line_ix, r.target_id, r.at, r.box.x0) for r in match.exact_matches(lines_of(spark, texts), wanted).collect())
    ids = [(f"t{k}", t) for k, t in enumerate(targets)] + [("again", targets[0])]
    assert got == sorted((i, n, at, 10.0 * at) for i, x in enumerate(texts) for n, t in ids for at in exact(t, x))
    rows = match.near_candidates(lines_of(spark, texts), wanted, 10_000).collect()
    got = sorted((r.line_ix, r.target_id, r.start_index, len(r.candidate), r.similarity, r.exact_chars) for r in rows)
    want = sorted((i, n, s, m, max(1 - d / max(len(t), m), c / max(len(t), m)), shared) for i, x in enumerate(texts) for n, t in ids for s, m, d, c, shared in near(t, x))
    assert got == want


def test_no_targets_and_null_texts(spark):
    none = spark.createDataFrame([], "target_id string, target string")
    lines = lines_of(spark, ["abc"])
    assert match.exact_matches(lines, none).count() == match.near_candidates(lines, none).count() == 0
    null = spark.createDataFrame([(None, "a"), ("a", None)], "a string, b string")
    got = [tuple(r.p) for r in null.select(bulk.pair(F.col("a"), F.col("b")).alias("p")).collect()]
    assert got == [(1, 0, 0), (1, 0, 0)]
    assert null.select(text.occurrences(F.lit("abab"), F.lit("ab")).alias("o")).first().o == [0, 2]


def test_near_candidates_and_groups_carry_no_characters(spark):
    """A line's characters would go along with each of its windows, through two sorts and into every group."""
    near = match.near_candidates(lines_of(spark, ["xxabcdxx", "abxd"]), spark.createDataFrame([("t", "abcd")], "target_id string, target string"))
    members = groups.group_candidates(near).schema["members"].dataType.elementType
    assert not [f.name for s in (near.schema, members) for f in s if isinstance(f.dataType, ArrayType)]
    best = near.filter("similarity = 1").first()
    assert (tuple(best.box), tuple(best.around)) == ((20.0, 0.0, 59.0, 10.0), (0.0, 0.0, 79.0, 10.0))
    other = near.filter("line_ix = 1 AND candidate = 'abxd'").first()
    assert tuple(other.box) == tuple(other.around) == (0.0, 0.0, 39.0, 10.0)


def test_lines_are_searched_in_pieces():
    lines = pa.array(["abc", None, "abcd" * 5, "", "xabc"])
    assert bulk.pieces(lines, 10) == [(0, 2), (2, 3), (3, 5)]
    assert bulk.pieces(lines) == [(0, 5)] and bulk.pieces(lines.slice(5)) == []
