import base64
import hashlib

import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

import public_tokenizers as P
from inkveil.llm import bpe


def library():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


LIBRARY = library()
CODEC = bpe.codec(bpe.default_ranks(), bpe.default_pattern())


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60) | st.text(" \n\t'sdlvert!?aé한\U0001f600", max_size=40))
def test_round_trip_and_library_ids(text):
    ids = CODEC.encode(text)
    assert ids.tolist() == LIBRARY.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()
    starts, ends = CODEC.offsets(ids)
    at = 0
    for i, start, end in zip(ids.tolist(), starts.tolist(), ends.tolist()):
        token = LIBRARY.decode_single_token_bytes(i)
        span = text[start:end].encode()
        before = len(text[:start].encode())
        assert before <= at and at + len(token) <= before + len(span)
        assert before + len(text[start].encode()) > at and before + len(text[start : end - 1].encode()) < at + len(token)
        at += len(token)


def test_query_columns(spark):
    texts = [None, "", "The the. 12 3's  x\n", "é" * 3000, "z" * 70000, "<|endoftext|>", "The the. 12 3's  x\n"]
    docs = spark.createDataFrame([(i if i != 5 else None, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, ids int")
    want = sorted(
        (
            (
                i if i != 5 else None,
                len(ids := LIBRARY.encode_ordinary(t or "")),
                hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                hashlib.sha256((t or "").encode()).hexdigest(),
            )
            for i, t in enumerate(texts)
        ),
        key=str,
    )
    assert sorted((tuple(r) for r in bpe.digests(docs).collect()), key=str) == want
    assert bpe.digests(docs.limit(0)).count() == 0


def test_cache_rotation_and_decode(spark, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    monkeypatch.setattr(bpe, "RUN", 10)
    own = bpe.Codec(bpe.default_ranks(), bpe.default_pattern())
    for t in ["a b c d e f g " * 5, "h i j k", "a b c", "long er tex ts here " * 4]:
        assert own.encode(t).tolist() == LIBRARY.encode_ordinary(t)
    rows = spark.createDataFrame([(1, LIBRARY.encode_ordinary("né \U0001f600")), (2, []), (3, None)], "doc_id int, ids array<int>")
    assert {r.doc_id: r.decoded for r in bpe.decode(rows).collect()} == {1: bytearray("né \U0001f600".encode()), 2: bytearray(), 3: None}
