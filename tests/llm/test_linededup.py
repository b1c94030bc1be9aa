import hashlib
import random
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from inkveil.llm import linededup

SCHEMA = "doc_id bigint, text string, source string, n_chars bigint, cls bigint, a string, i int"


def brute(rows, min_words):
    """Deleted line numbers by (id, text): every run of lines with words that stands earlier, by comparing all runs."""
    seqs = sorted({(r[0] is None, r[0] or 0, r[1] or "") for r in rows}, key=str)
    lines = {s: [(i, x) for i, x in enumerate(s[2].split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)] for s in seqs}
    runs = {}
    for s in seqs:
        c = lines[s]
        counts = [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for _, x in c]
        for p in range(len(c)):
            key, words = (), 0
            for q in range(p, len(c)):
                key, words = hash((key, c[q][1])), words + counts[q]
                if words >= min_words:
                    runs.setdefault((q - p, key), []).append((s[:2], s, c[p][0], c[q][0]))
    gone = {s: set() for s in seqs}
    for found in runs.values():
        first = min(f[0] for f in found)
        for place, s, a, b in found:
            if place > first:
                gone[s].update(range(a, b + 1))
        own = [f for f in found if f[0] == first]
        if len({f[1] for f in own}) == 1:  # of one text: the first place stays
            for _, s, a, b in sorted(own, key=lambda f: f[2])[1:]:
                gone[s].update(range(a, b + 1))
    return gone


def expected(rows, min_words):
    gone = brute(rows, min_words)
    out = []
    for r in rows:
        text = r[1] or ""
        g = gone[(r[0] is None, r[0] or 0, text)]
        rest = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in g)
        out.append((r[0], text.count("\n") + 1, len(g), hashlib.sha256(rest.encode()).hexdigest()))
    return sorted(out, key=str)


def result(spark, rows, min_words):
    docs = spark.createDataFrame([(*r, "s", 1, 2, "a", 3) for r in rows], SCHEMA)
    got = linededup.line_dedup(docs, min_words=min_words).select("doc_id", "n_lines", "n_removed", "kept_sha256").collect()
    return sorted((tuple(r) for r in got), key=str)


def test_planted_runs(spark):
    run = "one two three four\nfive six seven\n\neight nine ten"
    rows = [(1, "start\n" + run + "\nend"), (2, run), (3, "x\n" + run + "\ny\n" + run), (4, None), (5, ""), (6, "\n\n"), (7, "five six seven"), (None, run), (2, run), (8, "w " * 5000 + "\n" + run)]
    assert result(spark, rows, 10) == expected(rows, 10)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(["a", "b b", "c c c", "d " * 5, "e " * 12, "", " "]), max_size=12), min_size=1, max_size=6), st.sampled_from([1, 3, 4, 10]))
def test_random_texts(spark, texts, min_words):
    rows = [(i, "\n".join(t)) for i, t in enumerate(texts)]
    assert result(spark, rows, min_words) == expected(rows, min_words)


def test_many_random_texts(spark):
    rng = random.Random(4)
    lines = ["a", "b b", "c c c", "d " * 5, "e " * 12, "f " * 10, "", " "] + [f"only {i}" for i in range(4)]
    texts = [[rng.choice(lines) for _ in range(rng.randrange(14))] for _ in range(60)]
    texts += [rng.choice(texts) + rng.choice(texts) for _ in range(30)]
    rows = [(i, "\n".join(t)) for i, t in enumerate(texts)]
    assert result(spark, rows, 10) == expected(rows, 10)


def test_lines_without_words_inside_a_run_go(spark):
    text = "\n".join(["a " * 12, "", "b " * 12])
    docs = spark.createDataFrame([(1, text), (2, text)], "doc_id bigint, text string")
    assert sorted(tuple(r)[:4] for r in linededup.line_dedup(docs).collect()) == [(1, 3, 0, 0), (2, 3, 3, 1)]


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert result(spark, rows, 10) == expected(rows, 10)


def test_rows_keep_columns_and_empty_table(spark):
    line = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, line, "s", 9, 1, "x", 1), (2, line + "\nmore", "s", 9, 2, "y", 2), (3, line, "t", 9, 3, "z", 3), (4, None, None, None, None, None, None)], SCHEMA)
    got = {r.doc_id: r for r in linededup.dedup_rows(docs).collect()}
    assert linededup.dedup_rows(docs).schema == docs.schema
    assert {k: (r.text, r.n_chars, r.a) for k, r in got.items()} == {1: (line, 9, "x"), 2: ("more", 4, "y"), 4: (None, None, None)}
    empty = docs.limit(0)
    assert linededup.line_dedup(empty).count() == 0 and linededup.dedup_rows(empty).count() == 0
