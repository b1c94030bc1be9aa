import random
from functools import lru_cache

from inkveil.llm import tokencounts

COUNTER = tokencounts.Counter(tokencounts.default_model())


@lru_cache(None)
def brute(word):
    """The same choice by a plain left-to-right table of (score, pieces) over one word."""
    s = tokencounts.MARK + word
    best = [(0, 0)]
    for j in range(1, len(s) + 1):
        c = s[j - 1]
        options = []
        if c not in COUNTER.pieces:
            n = len(c.encode())
            score = (COUNTER.byte + 1) // tokencounts.UNIT
            options.append((best[j - 1][0] + n * score, best[j - 1][1] - n))
        for i in range(max(0, j - COUNTER.longest), j):
            if s[i:j] in COUNTER.pieces:
                score = (COUNTER.pieces[s[i:j]] + 1) // tokencounts.UNIT
                options.append((best[i][0] + score, best[i][1] - 1))
        best.append(max(options))
    return -best[-1][1]


def test_counts_match_a_table_for_each_word(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(tokencounts, "MAX_NODES", 500)
    rng = random.Random(3)
    own = tokencounts.Counter(tokencounts.default_model())
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).collect()]
    texts += ["".join(rng.choice("abe é한\U0001f600▁\t\x0b<0A>") for _ in range(rng.randrange(30))) for _ in range(200)]
    for t in texts:
        words = [w.decode() for w in t.encode().split()]
        assert own.text(t) == (len(words), sum(map(brute, words)))


def test_nulls_long_repeats_and_empty(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, " \n", "x"), (2, "ab" * 5000 + " the", "x"), (2, "the", "x"), (2, "the", "x")], "doc_id bigint, text string, n_tokens string")
    rows = sorted((str(r.doc_id), r.n_pretokens, r.n_tokens) for r in tokencounts.token_counts(docs).collect())
    the = brute("the")
    assert rows == sorted([("1", 0, 0), ("None", 0, 0), ("2", 2, brute("ab" * 5000) + the), ("2", 1, the), ("2", 1, the)])
    assert tokencounts.token_counts(docs.limit(0)).count() == 0


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in tokencounts.token_counts(docs).collect()}
    for r in docs.collect():
        words = [w.decode() for w in (r.text or "").encode().split()]
        assert got[r.doc_id] == (len(words), sum(map(brute, words)))
