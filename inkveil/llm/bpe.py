"""Byte-level BPE encoding and decoding with the tokenizers library, over Arrow batches.

A rank file (base64 token, rank) gives the vocabulary; its merges follow from the ranks, and the library's
BPE model runs them. Each match of the split pattern is encoded separately, without special tokens: its
UTF-8 bytes are mapped to printable characters (``byte_table``), which is what the model's vocabulary is
written in. Recurring pieces are looked up in a two-generation cache of a bounded number of pieces; a
piece may be as long as its text. Decoding maps ids to their bytes by the reversed table and joins bytes, not
characters, so characters that are split between tokens come back whole; ``offsets`` gives each token's
span in code points of the text (a token that holds part of a character spans that whole character).

Null text: encoded as the empty text (no ids). Null or repeated ids pass through; an empty table gives an
empty result; very long texts are encoded in runs of pieces; other columns are ignored by ``encode`` and
carried by ``encode_rows``. An id outside the vocabulary makes ``decode_ids`` raise.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces in each of the two generations of the cache.
CACHE = 150_000
#: Code points of text whose pieces are held at a time.
RUN = 1 << 20


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(1)
def byte_table() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def _halves(token: bytes, ranks: dict[bytes, int], own: int) -> tuple[bytes, bytes] | None:
    """The two parts whose merge makes ``token``: what the merges of lower rank leave of its bytes."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], own), i) for i in range(len(parts) - 1))
        if rank >= own:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


class Codec:
    """Encoder and decoder of one rank file, for one process."""

    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        table = byte_table()
        shown = {token: "".join(table[b] for b in token) for token in ranks}
        merges = [h for token, rank in sorted(ranks.items(), key=lambda x: x[1]) if len(token) > 1 and (h := _halves(token, ranks, rank))]
        model = models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=[(shown[a], shown[b]) for a, b in merges], ignore_merges=True)
        self.tokenizer = Tokenizer(model)
        # The pattern is applied here, so that recurring pieces are met once; a piece is never split again.
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.find = regex.compile(pattern)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.known = np.zeros(len(tokens), bool)
        self.known[list(ranks.values())] = True
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.length)[:-1]))

    def _learn(self, pieces: list[str]) -> None:
        """Brings every piece into ``young``."""
        young, old = self.young, self.old
        missing = []
        for piece in set(pieces).difference(young):
            ids = old.get(piece)
            if ids is None:
                missing.append(piece)
            else:
                young[piece] = ids
        for piece, found in zip(missing, self.tokenizer.encode_batch_fast(missing, add_special_tokens=False)):
            young[piece] = np.array(found.ids, "<i4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text as int32."""
        runs, held = [], []
        size = 0
        for m in self.find.finditer(text) if len(text) > RUN else ():
            held.append(m[0])
            size += len(m[0])
            if size >= RUN:
                runs.append(self._run(held))
                held, size = [], 0
        runs.append(self._run(held if len(text) > RUN else self.find.findall(text)))
        return np.frombuffer(b"".join(runs), "<i4")

    def _run(self, pieces: list[str]) -> bytes:
        try:
            return b"".join(map(self.young.__getitem__, pieces))
        except KeyError:
            if len(self.young) > CACHE:
                self.old, self.young = self.young, {}
            self._learn(pieces)
            return b"".join(map(self.young.__getitem__, pieces))

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return b""
        if ids.min() < 0 or ids.max() >= len(self.length) or not self.known[ids].all():
            raise ValueError("an id is not in the vocabulary")
        lengths = self.length[ids]
        ends = np.cumsum(lengths)
        return self.bytes[np.arange(ends[-1]) + np.repeat(self.start[ids] - (ends - lengths), lengths)].tobytes()

    def offsets(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last code point of each token in the decoded text."""
        raw = np.frombuffer(self.decode(ids), np.uint8)
        ends = np.cumsum(self.length[np.asarray(ids, np.int64)])
        upto = np.cumsum((raw & 0xC0) != 0x80)  # characters begun at or before each byte
        if not len(ends):
            return ends, ends
        starts = np.concatenate(([0], ends[:-1]))
        return upto[starts] - 1, upto[ends - 1]


@lru_cache(4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _ragged(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    values = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pattern: str | None = None, decode: bool = True, offsets: bool = False) -> DataFrame:
    """(id, ids array<int>[, decoded binary][, starts, ends array<int>]) of every row's whole text."""
    ranks, pattern = ranks or default_ranks(), pattern or default_pattern()
    rows = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kind = rows.schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, ids array<int>" + ", decoded binary" * decode + ", starts array<int>, ends array<int>" * offsets
    few = 256  # rows of a result batch: long rows stay few to a batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, few):
                batch = whole.slice(at, few)
                ids = [own.encode(t) for t in batch.column(1).to_pylist()]
                columns = [batch.column(0), _ragged(ids, pa.int32())]
                if decode:
                    columns.append(pa.array([own.decode(x) for x in ids], pa.binary()))
                if offsets:
                    spans = [own.offsets(x) for x in ids]
                    columns += [_ragged([s[k].astype(np.int32) for s in spans], pa.int32()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "ids", *["decoded"] * decode, *["starts", "ends"] * offsets])

    return rows.mapInArrow(run, schema)


def decode(rows: DataFrame, ids_col: str = "ids", ranks: str | None = None) -> DataFrame:
    """Replaces the ids of every row by ``decoded`` (binary); null ids give null."""
    ranks, pattern = ranks or default_ranks(), default_pattern()

    @F.pandas_udf("binary")
    def back(ids):
        own = codec(ranks, pattern)
        return ids.map(lambda x: None if x is None else own.decode(x))

    return rows.withColumn("decoded", back(F.col(ids_col))).drop(ids_col)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: its id, number of tokens, SHA-256 of the ids' text and of the decoded bytes."""
    rows = encode(docs, id_col, text_col, **options)
    return rows.select(
        F.col(id_col),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
