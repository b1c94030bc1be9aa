"""Which targets may have a near match in a line: an index of gapped pairs of the targets' characters.

A window of n characters is near a target of t only if ``k`` characters of both, at least half of the longer one (m), match in order: the
longest common subsequence is that long, or the edit distance leaves so many in place. Between these k lie k - 1 gaps,
together no longer than t - 1 and n - 1. So two neighbours among them are few places apart in both: the two gaps
sum up to ``4 * (m - 1) / (m - 2)`` at most, which leaves each no more than ``GAP`` for every m. A line is looked at for a target
only if it holds such a pair of the target. A target of one or two characters counts by each of its characters.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .automaton import POINTS, code_points
from .bulk import pieces

GAP = 4
SHORT = 2


class PairIndex:
    """Distinct targets that aren't empty -> the targets of each gapped pair, as arrays."""

    def __init__(self, targets: list[str]):
        self.alphabet = np.unique(code_points(targets))
        place = {chr(c): k + 1 for k, c in enumerate(self.alphabet.tolist())}
        size = len(self.alphabet) + 1
        pairs = set()
        for k, t in enumerate(targets):
            own = [place[c] for c in t]
            if len(own) <= SHORT:
                pairs |= {(a, k) for a in own}  # below any pair: its first class is 0
            else:
                pairs |= {(a * size + b, k) for g in range(1, GAP + 1) for a, b in zip(own, own[g:])}
        key, owner = np.array(sorted(pairs), np.int64).reshape(-1, 2).T
        self.keys, self.first = np.unique(key, return_index=True)
        self.first = np.append(self.first, len(key))
        self.owners, self.targets = owner.copy(), len(targets)

    @cached_property
    def classes(self) -> np.ndarray:
        table = np.zeros(POINTS, np.int32)
        table[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
        return table

    def __getstate__(self) -> dict:
        return {k: v for k, v in vars(self).items() if k != "classes"}

    def candidates(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, target) of the pairs that may hold a near match, ordered."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        text = np.repeat(np.arange(len(texts)), sizes)
        c = self.classes[code_points(texts)].astype(np.int64)
        seen = [text * (len(self.alphabet) + 1) ** 2 + c]
        for g in range(1, GAP + 1):
            both = np.flatnonzero((text[g:] == text[: len(text) - g]) & (c[g:] > 0) & (c[: len(c) - g] > 0)) if len(text) > g else np.zeros(0, np.int64)
            seen.append(text[both] * (len(self.alphabet) + 1) ** 2 + c[both] * (len(self.alphabet) + 1) + c[both + g])
        seen = np.unique(np.concatenate(seen))  # a line's pairs once
        text, key = np.divmod(seen, (len(self.alphabet) + 1) ** 2)
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        there = self.keys[k] == key
        text, k = text[there], k[there]
        n = self.first[k + 1] - self.first[k]
        at = np.repeat(self.first[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.divmod(np.unique(np.repeat(text, n) * self.targets + self.owners[at]), self.targets)


def candidates(text: Column, targets: list[str]) -> Column:
    """array<int>: the places of those of ``targets`` that a text may hold a near match of."""
    if not targets:
        return F.array().cast("array<int>")
    index = PairIndex(targets)

    def run(texts: pa.Array) -> pa.Array:
        done = [pa.array([], pa.list_(pa.int32()))]
        for at, to in pieces(texts):
            owner, target = index.candidates(["" if t is None else t for t in texts.slice(at, to - at).to_pylist()])
            done.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(to - at + 1)), pa.int32()), pa.array(target, pa.int32())))
        return pa.concat_arrays(done)

    return F.arrow_udf(run, "array<int>")(text)


def pair_keys(text: Column, short: bool) -> Column:
    """The same pairs as strings, for an equality join: of a text, or (``short``) single characters too."""
    n = F.length(text)
    at = lambda i: F.substring(text, i, F.lit(1))
    none = F.array().cast("array<string>")
    apart = lambda g: F.transform(F.sequence(F.lit(1), n - g), lambda i: F.concat(at(i), at(i + g)))
    pairs = [F.when(n > g, apart(g)).otherwise(none) for g in range(1, GAP + 1)]
    single = [F.when(n > 0, F.transform(F.sequence(F.lit(1), n), at)).otherwise(none)] if short else []
    return F.array_distinct(F.concat(*single, *pairs))


def target_keys(target: Column) -> Column:
    """The keys by which a target meets lines: its pairs, or its characters if it is short."""
    return F.when(F.length(target) <= SHORT, F.array_distinct(F.split(target, ""))).otherwise(pair_keys(target, False))
