"""Token counts under a unigram vocabulary by trie-shared dynamic programming.

A pre-token is U+2581 and a word ``[^\\x20\\x09-\\x0D]+``. Its best segmentation into vocabulary pieces has the
largest sum of piece scores, then the fewest pieces; a code point that is no piece costs its UTF-8 bytes as
byte pieces. The vocabulary is a public tokenizer's, never trained here: its pieces in their given order
weigh as under Zipf's law, score = -round(1000 * ln(rank + 2)), in integers so that sums are exact.

Distinct pre-tokens are inserted in a trie. A node is a prefix, its forward score is computed once when the
node is made, from the nodes a piece's length above it, and shared by all pre-tokens that continue it; a
pre-token's end stores its count. Everything happens in Arrow batches where the text lies: no shuffle. Trie
and end counts are dropped when they reach ``MAX_NODES``; words longer than ``LONG`` are scored alone, in the
same way, so memory is bounded whatever the text.

Null or empty text: 0 pre-tokens, 0 tokens. Null or repeated ids pass through; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_NODES = 400_000
LONG = 64
#: A score's unit; the tokens of a path are counted below it.
UNIT = 1 << 24
MARK = "▁"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def scored_pieces(path: str) -> tuple[dict[str, int], int]:
    """Pieces with their value (score * UNIT - 1), and a byte piece's value: that of the last rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    value = lambda rank: -round(1000 * math.log(rank + 2)) * UNIT - 1
    found: dict[str, int] = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
            found.setdefault(model.id_to_piece(i), value(i))
    return found, value(model.get_piece_size())


class Counter:
    """Token counts of words, for one process."""

    def __init__(self, path: str):
        self.pieces, self.byte = scored_pieces(path)
        self.longest = max(map(len, self.pieces))
        # Lengths of the pieces that end in a code point: others need not be tried.
        ends: dict[str, set[int]] = {}
        for p in self.pieces:
            ends.setdefault(p[-1], set()).add(len(p))
        self.lengths = {c: sorted(n) for c, n in ends.items()}
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.best = [0]
        self.ends: dict[bytes, int] = {}

    def _step(self, word: str, best: list[int]) -> int:
        """Forward score of word[:len(best)] from the scores of its shorter prefixes."""
        j = len(best)
        c = word[j - 1]
        pieces = self.pieces
        top = best[j - 1] + (pieces[c] if c in pieces else self.byte * len(c.encode(errors="surrogatepass")))
        for n in self.lengths.get(c, ()):
            if n > j:
                break
            v = pieces.get(word[j - n : j])
            if v is not None and best[j - n] + v > top:
                top = best[j - n] + v
        return top

    def count(self, raw: bytes) -> int:
        """Tokens of one word; remembers it."""
        word = MARK + raw.decode(errors="surrogatepass")
        best = [0]
        if len(word) > LONG:
            while len(best) <= len(word):
                best.append(self._step(word, best))
            return -best[-1] % UNIT
        node = 0
        child, scores = self.child, self.best
        for c in word:
            after = child.get((node, c))
            if after is None:
                after = child[node, c] = len(scores)
                scores.append(self._step(word, best))
            best.append(scores[after])
            node = after
        n = self.ends[raw] = -best[-1] % UNIT
        return n

    def text(self, text: str) -> tuple[int, int]:
        """Pre-tokens and tokens of a text."""
        words = text.encode(errors="surrogatepass").split()
        try:
            return len(words), sum(map(self.ends.__getitem__, words))
        except KeyError:
            if len(self.best) > MAX_NODES or len(self.ends) > MAX_NODES:
                self.clear()
            # ``ends`` is looked up again for each word: it may be one that this loop has just met.
            ends, count = self.ends, self.count
            return len(words), sum(ends[w] if w in ends else count(w) for w in words)


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """(id, n_pretokens, n_tokens) of every row's whole text."""
    path = model or default_model()
    rows = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kind = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for b in batches:
            found = np.array([own.text(t) for t in b.column(1).to_pylist()], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found[:, 0]), pa.array(found[:, 1])], names=[id_col, "n_pretokens", "n_tokens"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_pretokens bigint, n_tokens bigint")
