import hashlib
import random

import numpy as np
import pytest

from inkveil.llm import suffixdedup

SCHEMA = "doc_id bigint, text string, g bigint, c string, raw int"


def covered(raws, length):
    """For each text, which of its bytes a repeated window covers."""
    count = {}
    for r in raws:
        for s in range(len(r) - length + 1):
            w = r[s : s + length]
            count[w] = count.get(w, 0) + 1
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for s in range(len(r) - length + 1):
            if count[r[s : s + length]] > 1:
                gone[s : s + length] = True
        gone[len(r)] = False
        out.append(gone)
    return out


def brute(rows, length, short=None):
    raws = [(t or "").encode() for _, t in rows]
    out = []
    for (i, _), r, gone, again in zip(rows, raws, covered(raws, length), covered(raws, short or length)):
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(np.frombuffer(r, np.uint8)[~gone[: len(r)]])
        out.append((i, len(r), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), int(again.sum())))
    return sorted(out, key=str)


def result(spark, rows, length, short=None):
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA)
    return sorted((tuple(r) for r in suffixdedup.digests(docs, length=length, short=short).collect()), key=str)


def planted(rng, alphabet, length):
    text = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    passages = [text(length + d) for d in (-1, 0, 1, 7, 150, 600)]
    rows = [(1, None), (2, ""), (3, "aé" * length), (4, "a" * (3 * length)), (5, "xyz" * length)]
    for i in range(40):
        parts = [text(rng.randrange(length))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            if rng.random() < 0.4:  # a near copy
                k = rng.randrange(len(p))
                p = p[:k] + "#" + p[k + 1 :]
            parts += [p, text(rng.randrange(length // 2))]
        rows.append((10 + i, "".join(parts)))
    rows += [rows[12], (99, rows[13][1]), (None, rows[14][1]), (98, rows[15][1][:-1])]
    return rows


@pytest.mark.parametrize("length,short,alphabet,crowd", [(400, 256, "abcdef ", 400), (100, None, "ab", 400), (90, 64, "abcé", 1), (130, 70, "abc", 3)])
def test_planted_repeats_match_brute_force(spark, monkeypatch, length, short, alphabet, crowd):
    monkeypatch.setattr(suffixdedup, "CROWD", crowd)
    rows = planted(random.Random(length), alphabet, length)
    assert result(spark, rows, length, short) == brute(rows, length, short)


def test_crowded_groups_are_split_and_counted(spark, monkeypatch):
    """Many contexts share a passage, others all but the edge of a window: both rounds of crowded groups."""
    monkeypatch.setattr(suffixdedup, "CROWD", 4)
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passages = [text(n) for n in (80, 100, 131, 170, 300)]
    rows = [(i, text(rng.randrange(60)) + rng.choice(passages) + text(rng.randrange(200))) for i in range(120)]
    rounds = []
    own = suffixdedup._hashed
    monkeypatch.setattr(suffixdedup, "_hashed", lambda *a: rounds.append(a) or own(*a))
    assert result(spark, rows, 130, 80) == brute(rows, 130, 80)
    assert rounds


def test_crowded_phrases_are_parted_by_two_rows_a_context(spark, monkeypatch):
    """Texts that share a phrase too short for any window, and some a passage: what a crowded group's contexts are split into."""
    monkeypatch.setattr(suffixdedup, "CROWD", 4)
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    phrase, passage = text(130), text(450)
    rows = [(i, text(300 + rng.randrange(60)) + (passage if i % 20 == 0 else phrase) + text(500)) for i in range(60)]
    made = []
    own = suffixdedup._split

    def counted(*a):
        contexts, parts = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
        made.append((contexts, parts))
        run = own(*a)

        def watched(batches):
            def seen():
                for b in batches:
                    contexts.add(b.num_rows)
                    yield b

            for b in run(seen()):
                parts.add(b.num_rows)
                yield b

        return watched

    monkeypatch.setattr(suffixdedup, "_split", counted)
    assert result(spark, rows, 400, 256) == brute(rows, 400, 256)
    assert made and made[0][0].value > 0
    assert made[0][1].value <= 2 * made[0][0].value


def test_long_text_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(suffixdedup, "STRETCH", 700)
    rng = random.Random(9)
    a = "".join(rng.choice("abcdefgh") for _ in range(5000))
    rows = [(1, a), (2, "z" + a[100:4000] + "q" + a[4001:]), (3, a[2000:2600] * 3)]
    assert result(spark, rows, 400, 256) == brute(rows, 400, 256)


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert result(spark, rows, 400, 256) == brute(rows, 400, 256)


def test_empty_table(spark):
    assert suffixdedup.digests(spark.createDataFrame([], SCHEMA)).count() == 0
