"""Similarity of many pairs of strings at once, bit-parallel: each numpy step adds one character to thousands of rows.

A target is at most some words of 64 bits, one bit for each of its characters. A row's character matches some of them
(its mask). From the masks follow, character by character, the column of the table of edit distances as vertical steps up
and down (Myers 1999, in words: Hyyroe 2003), the row of the longest common subsequence (Hyyroe 2004) and the set of the target's
characters seen so far. After n characters the three are those of the first n, so all windows that start at one place are
scored by one pass over the longest of them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .automaton import code_points
from .config import CONFIG

WORD = 64
ONE, TOP = np.uint64(1), np.uint64(1 << 63)
#: Rows that go forward together.
ROWS = 1 << 15
#: Characters of a batch's lines that are searched at a time, so that memory follows neither a batch nor a table.
CHARACTERS = 1 << 15


def _masks(targets: np.ndarray, owner: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """(place, word): the bits of the owner's target characters (rows of ``targets``, -1 behind the end) that equal each of ``codes``."""
    width = targets.shape[1]
    out = np.zeros((len(codes), -(-width // WORD)), np.uint64)
    for k in range(width):
        out[:, k // WORD] |= (targets[owner, k] == codes).astype(np.uint64) << np.uint64(k % WORD)
    return out


def forward(masks: np.ndarray, starts: np.ndarray, steps: np.ndarray, sizes: np.ndarray, tell: Callable[[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray], None]) -> None:
    """Goes ``steps`` characters on from ``starts`` (places in ``masks``), each row with a target of ``sizes`` characters.

    After the n-th: ``tell(n, rows, distance, common, shared)`` of the rows that have so many.
    """
    words = masks.shape[1]
    rows = np.arange(len(starts))
    full = np.full((words, len(starts)), ~np.uint64(0))
    inside = np.clip(sizes[None, :] - WORD * np.arange(words)[:, None], 0, WORD)
    inside = np.where(inside == WORD, ~np.uint64(0), (ONE << np.minimum(inside, WORD - 1).astype(np.uint64)) - ONE)
    top, last = (sizes - 1) // WORD, ONE << ((sizes - 1) % WORD).astype(np.uint64)
    up, down, row, seen = full.copy(), np.zeros_like(full), full.copy(), np.zeros_like(full)
    distance = sizes.astype(np.int64)
    for n in range(1, int(steps.max(initial=0)) + 1):
        go = steps >= n
        if not go.all():
            rows, starts, steps, sizes, top, last, distance = (x[go] for x in (rows, starts, steps, sizes, top, last, distance))
            up, down, row, seen, inside = (x[:, go] for x in (up, down, row, seen, inside))
        mask = masks[starts + n - 1]
        # Into the lowest word comes a step up: without characters of the target, each of the row's costs one.
        rise, fall = np.ones(len(rows), bool), np.zeros(len(rows), bool)
        carry = np.zeros(len(rows), np.uint64)
        for w in range(words):
            own = mask[:, w]
            seen[w] |= own
            u = row[w] & own
            total = row[w] + u
            over = total < u
            total += carry
            carry = (over | (total < carry)).astype(np.uint64)
            row[w] = total | (row[w] & ~own)
            p, m = up[w], down[w]
            x = own | m
            e = own | fall.astype(np.uint64)
            d = (((e & p) + p) ^ p) | e
            plus, minus = m | ~(d | p), p & d
            edge = np.where(top == w, last, TOP)
            out_rise, out_fall = (plus & edge) != 0, (minus & edge) != 0
            done = top == w
            distance += (done & out_rise).astype(np.int64) - (done & out_fall)
            plus, minus = (plus << ONE) | rise.astype(np.uint64), (minus << ONE) | fall.astype(np.uint64)
            up[w], down[w] = minus | ~(x | plus), plus & x
            rise, fall = out_rise, out_fall
        common = np.bitwise_count(~row & inside).sum(axis=0, dtype=np.int64)
        shared = np.bitwise_count(seen & inside).sum(axis=0, dtype=np.int64)
        tell(n, rows, distance, common, shared)


def _padded(targets: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each target, -1 behind the end; and their lengths."""
    sizes = np.fromiter(map(len, targets), np.int64, len(targets))
    out = np.full((len(targets), max(1, int(sizes.max(initial=0)))), -1, np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = code_points(targets)
    return out, sizes


def _by_words(sizes: np.ndarray) -> list[np.ndarray]:
    """Rows in groups whose targets take equally many words, ``ROWS`` at most."""
    words = -(-np.maximum(sizes, 1) // WORD)
    groups = [np.flatnonzero(words == w) for w in np.unique(words)]
    return [g[k : k + ROWS] for g in groups for k in range(0, len(g), ROWS)]


def compare(targets: list[str], candidates: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edit distance, longest common subsequence, characters of the target, repeats counted, that the candidate holds) of each pair."""
    padded, sizes = _padded(targets)
    lengths = np.fromiter(map(len, candidates), np.int64, len(candidates))
    codes, first = code_points(candidates).astype(np.int64), np.cumsum(lengths) - lengths
    distance, common, shared = sizes.copy(), np.zeros(len(targets), np.int64), np.zeros(len(targets), np.int64)
    distance[sizes == 0] = lengths[sizes == 0]
    for g in _by_words(sizes):
        g = g[(sizes[g] > 0) & (lengths[g] > 0)]
        if not len(g):
            continue
        own = lengths[g]
        at = np.cumsum(own) - own
        place = np.repeat(first[g] - at, own) + np.arange(own.sum())
        masks = _masks(padded[g][:, : int(sizes[g].max())], np.repeat(np.arange(len(g)), own), codes[place])

        def tell(n, rows, d, c, s, g=g, own=own):
            done = own[rows] == n
            for out, value in ((distance, d), (common, c), (shared, s)):
                out[g[rows[done]]] = value[done]

        forward(masks, at, own, sizes[g], tell)
    return distance, common, shared


def least_shared(sizes: np.ndarray) -> np.ndarray:
    return np.where(sizes <= 2, sizes, np.maximum(2, (sizes + 1) // 2))


def windows(targets: list[str], lines: list[str]) -> tuple[np.ndarray, ...]:
    """(pair, start, length, distance, common, shared) of the windows of each line that resemble its target, ordered, and the places tried and left.

    A window of n characters scores ``most / 2`` (most: the longer of window and target) only if so many of its characters match
    the target's in order. So a place starts windows only if the stretch of the longest one holds at least half as many characters
    of the target as the target has; of the others none is looked at. ``tried``: places of all lines; ``left``: those that pass.
    """
    padded, sizes = _padded(targets)
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    codes, first = code_points(lines).astype(np.int64), np.cumsum(lengths) - lengths
    found, left = [(np.zeros(0, np.int64),) * 6], 0
    for g in _by_words(sizes):
        g = g[(sizes[g] > 0) & (lengths[g] > 0)]
        if not len(g):
            continue
        own, t = lengths[g], sizes[g]
        at = np.cumsum(own) - own
        owner = np.repeat(np.arange(len(g)), own)
        index = np.arange(own.sum()) - at[owner]
        masks = _masks(padded[g][:, : int(t.max())], owner, codes[first[g][owner] + index])
        held = np.concatenate(([0], np.cumsum((masks != 0).any(axis=1))))
        longest = np.minimum(own[owner] - index, t[owner] + CONFIG.near_slack)
        place = np.arange(len(owner))
        ok = place[2 * (held[place + longest] - held[place]) >= t[owner]]
        left += len(ok)

        def tell(n, rows, d, c, s, g=g, t=t, owner=owner, index=index, ok=ok):
            who = owner[ok[rows]]
            size = t[who]
            most = np.maximum(size, n)
            similar = np.maximum(1 - d / most, c / most) >= CONFIG.min_similarity
            good = similar & (s >= least_shared(size)) & (n >= np.maximum(1, size - CONFIG.near_slack))
            found.append((g[who[good]], index[ok[rows[good]]], np.full(int(good.sum()), n), d[good], c[good], s[good]))

        forward(masks, ok, longest[ok], t[owner[ok]], tell)
    out = tuple(np.concatenate(x) for x in zip(*found))
    order = np.lexsort((out[2], out[1], out[0]))
    return (*(x[order] for x in out), int(lengths[sizes > 0].sum()), left)


PAIR = StructType([StructField(n, IntegerType()) for n in ("distance", "common", "shared")])
WINDOWS = ArrayType(StructType([StructField(n, IntegerType()) for n in ("start", "len", "distance", "common", "shared")]))


def pieces(texts: pa.Array, characters: int | None = None) -> list[tuple[int, int]]:
    """(first, behind the last) of the rows that are worked on at a time: ``CHARACTERS`` in all, or one text that is longer."""
    ends = np.cumsum(pc.utf8_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    out, at = [], 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (characters or CHARACTERS), "right")))
        out.append((at, to))
        at = to
    return out


def _texts(a: pa.Array) -> list[str]:
    return ["" if t is None else t for t in a.to_pylist()]


@F.arrow_udf(PAIR)
def _pair(target: pa.Array, candidate: pa.Array) -> pa.Array:
    values = compare(_texts(target), _texts(candidate))
    return pa.StructArray.from_arrays([pa.array(v, pa.int32()) for v in values], names=["distance", "common", "shared"])


def pair(target: Column, candidate: Column) -> Column:
    """struct<distance, common, shared> of two strings; null counts as empty."""
    return _pair(target, candidate)


@F.arrow_udf(WINDOWS)
def _windows(target: pa.Array, line: pa.Array) -> pa.Array:
    done = [pa.array([], pa.list_(pa.struct([(n, pa.int32()) for n in WINDOWS.elementType.names])))]
    for at, to in pieces(line):
        owner, *values = windows(_texts(target.slice(at, to - at)), _texts(line.slice(at, to - at)))[:6]
        rows = pa.StructArray.from_arrays([pa.array(v, pa.int32()) for v in values], names=WINDOWS.elementType.names)
        done.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(to - at + 1)), pa.int32()), rows))
    return pa.concat_arrays(done)


def near_windows(target: Column, line: Column) -> Column:
    """The windows of a line that resemble the target, by start and length."""
    return _windows(target, line)
