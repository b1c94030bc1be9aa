"""Exact search of many targets at once: an automaton of states and failure links in arrays (Aho and Corasick, 1975).

A batch of lines is one array of character classes. It is cut into lanes of equal length, which numpy moves forward together, one
character a step; each lane starts as many characters early as the longest target has, so that its state is right
where its own part begins, and a class that no target holds stands between lines. The time follows the text, not the targets.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lanes that move together, and the fewest characters of one.
LANES = 4096
LEAST = 256
#: Code points, and one more.
POINTS = 0x110001


def code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class Automaton:
    """The targets' trie, its states numbered from the root (0) by depth."""

    alphabet: np.ndarray  # the targets' code points, ascending; a class is a place here, from 1
    edges: np.ndarray  # state * classes + class, ascending
    to: np.ndarray  # the state behind each edge
    fail: np.ndarray  # the longest proper suffix of a state that is a state
    ends: np.ndarray  # the target that a state spells, or -1
    shorter: np.ndarray  # the longest proper suffix of a state that spells a target, or 0
    lengths: np.ndarray

    @classmethod
    def of(cls, targets: list[str]) -> Automaton:
        """Distinct targets that aren't empty."""
        alphabet = np.unique(code_points(targets))
        size = len(alphabet) + 1
        place = {chr(c): k + 1 for k, c in enumerate(alphabet.tolist())}
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for k, t in enumerate(targets):
            state = 0
            for ch in t:
                following = children[state]
                state = following.get(place[ch])
                if state is None:
                    state = following[place[ch]] = len(children)
                    children.append({})
                    ends.append(-1)
            ends[state] = k
        fail, shorter = [0] * len(children), [0] * len(children)
        queue = deque(children[0].values())
        while queue:
            state = queue.popleft()
            shorter[state] = fail[state] if ends[fail[state]] >= 0 else shorter[fail[state]]
            for c, child in children[state].items():
                queue.append(child)
                s = fail[state]
                while s and c not in children[s]:
                    s = fail[s]
                fail[child] = children[s].get(c, 0)
        pairs = sorted((s * size + c, child) for s, own in enumerate(children) for c, child in own.items())
        edges, to = np.array(pairs, np.int64).reshape(-1, 2).T.copy()
        return cls(alphabet, edges, to, *(np.array(x, np.int64) for x in (fail, ends, shorter, [len(t) for t in targets])))

    @cached_property
    def classes(self) -> np.ndarray:
        """The class of every code point; 0: in no target."""
        table = np.zeros(POINTS, np.int32)
        table[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
        return table

    def __getstate__(self) -> dict:
        return {k: v for k, v in vars(self).items() if k != "classes"}

    def step(self, states: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """The states behind one more character of each lane."""
        size, last = len(self.alphabet) + 1, len(self.edges) - 1
        out = np.zeros_like(states)
        left = np.flatnonzero(classes)  # a class of no target leads to the root
        at = states[left]
        while len(left):
            key = at * size + classes[left]
            k = np.minimum(np.searchsorted(self.edges, key), last)
            there = self.edges[k] == key
            out[left[there]] = self.to[k[there]]
            go = ~there & (at > 0)
            left, at = left[go], self.fail[at[go]]
        return out

    def scan(self, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last place, target) of every occurrence, overlapping ones included, in no order."""
        early = int(self.lengths.max()) - 1
        width = max(LEAST, 4 * early, -(-len(classes) // LANES))
        lanes = -(-len(classes) // width)
        padded = np.zeros(early + lanes * width, np.int32)
        padded[early : early + len(classes)] = classes
        starts = np.arange(lanes) * width
        states = np.zeros(lanes, np.int64)
        found = [(np.zeros(0, np.int64),) * 2]
        for s in range(early + width):
            states = self.step(states, padded[starts + s])
            if s < early:
                continue
            at = np.flatnonzero((self.ends[states] >= 0) | (self.shorter[states] > 0))
            state = states[at]
            while len(at):
                own = self.ends[state] >= 0
                found.append((starts[at[own]] + s - early, self.ends[state[own]]))
                state = self.shorter[state]
                at, state = at[state > 0], state[state > 0]
        return tuple(np.concatenate(x) for x in zip(*found))

    def occurrences(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, target, start) of the occurrences, ordered; of each target left to right, none overlapping another."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.cumsum(sizes + 1) - sizes - 1  # one place more behind each text
        classes = np.zeros(int((sizes + 1).sum()), np.int32)
        inside = np.arange(sizes.sum()) + np.repeat(np.arange(len(texts)), sizes)
        classes[inside] = self.classes[code_points(texts)]
        last, target = self.scan(classes)
        text = np.searchsorted(first, last, "right") - 1
        start = last - first[text] - self.lengths[target] + 1
        order = np.lexsort((start, target, text))
        text, target, start = text[order], target[order], start[order]
        new = np.concatenate(([True], (text[1:] != text[:-1]) | (target[1:] != target[:-1])))[: len(text)]
        clash = np.flatnonzero(~new & (start - np.roll(start, 1) < self.lengths[target]))
        keep = np.ones(len(text), bool)
        for k in clash.tolist():  # only of targets that overlap themselves
            before = k - 1
            while not keep[before]:
                before -= 1
            keep[k] = start[k] - start[before] >= self.lengths[target[k]]
        return text[keep], target[keep], start[keep]


FOUND = "array<struct<target_ix:int,at:int>>"


def find(text: Column, targets: list[str]) -> Column:
    """Where each of the targets (distinct, not empty) occurs in a text: array<struct<target_ix, at>>, a target's places ascending and apart."""
    if not targets:
        return F.array().cast(FOUND)
    automaton = Automaton.of(targets)

    def run(texts: pa.Array) -> pa.Array:
        texts = ["" if t is None else t for t in texts.to_pylist()]
        owner, target, at = automaton.occurrences(texts)
        both = pa.StructArray.from_arrays([pa.array(target, pa.int32()), pa.array(at, pa.int32())], names=["target_ix", "at"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(texts) + 1)), pa.int32()), both)

    return F.arrow_udf(run, FOUND)(text)
