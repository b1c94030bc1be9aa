import hashlib
import random
from collections import Counter

import duckdb
import pandas as pd

import corpus_pipeline
from inkveil.llm import mixing, quality

from .test_bpe import LIBRARY
from .test_linededup import brute as brute_lines
from .test_nearcopies import likeness, shingle_set


def near_copies_kept(texts):
    """The smallest id of each group of texts linked by a 5-word Jaccard likeness of 0.8 or more; all pairs of sets that share a shingle."""
    sets = {i: shingle_set(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = {}
    for i in sorted(sets):
        alike = {j for s in sets[i] or {None} for j in holders.get(s, ())}
        for j in alike:
            if likeness(sets[i], sets[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for s in sets[i] or {None}:
            holders.setdefault(s, []).append(i)
    return {find(i) for i in sets}


def brute(docs):
    """doc_id -> (remaining text, times) by plain versions of the stages; docs: pandas with the documents' columns."""
    con = duckdb.connect()
    con.register("documents", docs)
    kept = {r[0] for r in con.sql(f"SELECT doc_id FROM ({quality.ORACLE}) WHERE kept").fetchall()}
    docs = docs[docs.doc_id.isin(kept)]
    gone = brute_lines(list(zip(docs.doc_id, docs.text)), 10)
    rest = {}
    for i, t in zip(docs.doc_id, docs.text):
        lines = t.split("\n")
        x = "\n".join(x for k, x in enumerate(lines) if k not in gone[(False, i, t)])
        if not gone[(False, i, t)] or x.split():
            rest[i] = x
    docs = docs[docs.doc_id.isin(near_copies_kept(rest))].copy()
    docs["text"] = [rest[i] for i in docs.doc_id]
    con.register("mixable", docs)
    times = dict(con.sql("SELECT doc_id, repeats FROM (" + mixing.ORACLE.replace("FROM documents", "FROM mixable") + ")").fetchall())
    return {i: (rest[i], times[i]) for i in docs.doc_id if times[i]}


def test_run_matches_brute_force(spark, sf_dir):
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    want = Counter()
    for i, (text, times) in brute(docs).items():
        ids = LIBRARY.encode_ordinary(text)
        want[i, len(ids), tuple(ids), hashlib.sha256(text.encode()).hexdigest()] += times
    got = Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == want
    assert 0 < len(got) < len(docs)


def test_near_copies_that_differ_in_words_go(spark, tmp_path):
    """Clean texts of their own words, of each a copy at likeness 0.8 or more and one below: op6's values tell neither from the other."""
    rng = random.Random(12)
    common = "the of and to in is that it was for on with as by at from".split()
    rows, want = [], set()
    for g in range(12):
        sentence = lambda: " ".join(x for _ in range(6) for x in (rng.choice(common), f"word{rng.randrange(10**5)}"))  # noqa: B023, E731
        lines = [sentence() + "." for _ in range(12)]
        near, far = list(lines), list(lines)
        near[3] = near[3].replace(near[3].split()[5], "other")
        for k in (1, 4, 7, 10):
            far[k] = sentence() + "."
        for k, text in enumerate((lines, near, far)):
            # Each text stands in one line, so that no line of it repeats.
            rows.append((10 * g + k, " ".join(text), "en", "s", 1))
        sets = [shingle_set(r[1]) for r in rows[-3:]]
        assert likeness(sets[0], sets[1]) >= 0.8 > likeness(sets[0], sets[2])
        want |= {10 * g, 10 * g + 2}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == want == near_copies_kept({r[0]: r[1] for r in rows})
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want == set(brute(docs.toPandas()))


def test_stages_keep_columns_handle_odd_tables(spark, sf_dir, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, fp int, kept string"
    clean = "The house of the garden is by the river and was built with stone for a family in that time.\nIt was on the hill."
    rows = [(1, clean, "en", "a", 1, "x", 1, "y"), (1, clean, "en", "a", 1, "x", 1, "y"), (2, None, None, None, None, None, None, None), (None, clean + " end", "en", None, 3, "x", 1, "y"), (4, "", "en", "b", 0, None, 0, None)]
    for table in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            if name != "encode":
                assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in table.schema]
            out.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert (docs.count() > 0) == (table.count() > 0)
