"""Weighted acyclic automata: sorted sequences of labels with a count each, built incrementally, united and composed."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np

from .common import ship

#: Automata that one union reads side by side.
FAN = 64

ship(__name__)


class Automaton:
    """A minimal acyclic automaton. State s has a count (0: no sequence ends here) and arcs (label, next state) in rising order of the label; next states
    come before s, and the last state is the root. States with the same count and arcs are one."""

    __slots__ = ("arcs", "counts")

    def __init__(self, counts: list[int], arcs: list[tuple]):
        self.counts, self.arcs = counts, arcs

    def __iter__(self) -> Iterator[tuple[tuple, int]]:
        """The sequences in rising order, with their counts."""
        stack = [((), len(self.counts) - 1)]
        while stack:
            path, s = stack.pop()
            if self.counts[s]:
                yield path, self.counts[s]
            stack += [((*path, label), t) for label, t in reversed(self.arcs[s])]

    def dumps(self) -> bytes:
        """As bytes; labels must be bytes."""
        labels = sorted({label for arcs in self.arcs for label, _ in arcs})
        place = {x: i for i, x in enumerate(labels)}
        flat = [(place[label], t) for arcs in self.arcs for label, t in arcs]
        parts = [
            np.array([len(labels), len(self.counts), len(flat)], np.int64),
            np.array([len(x) for x in labels], np.uint32),
            np.array(self.counts, np.int64),
            np.array([len(a) for a in self.arcs], np.uint32),
            np.array(flat, np.uint32),
        ]
        return b"".join([*(p.tobytes() for p in parts), *labels])

    @classmethod
    def loads(cls, data: bytes) -> Automaton:
        n_labels, n, n_arcs = np.frombuffer(data, np.int64, 3).tolist()
        at = 24

        def take(kind: type, k: int) -> list:
            nonlocal at
            out = np.frombuffer(data, kind, k, at)
            at += out.nbytes
            return out.tolist()

        sizes, counts, degrees, flat = take(np.uint32, n_labels), take(np.int64, n), take(np.uint32, n), take(np.uint32, 2 * n_arcs)
        labels = []
        for k in sizes:
            labels.append(data[at : at + k])
            at += k
        every = iter(zip([labels[i] for i in flat[::2]], flat[1::2]))
        return cls(counts, [tuple(a for _, a in zip(range(k), every)) for k in degrees])


def build(items: Iterable[tuple[tuple, int]]) -> Automaton:
    """The automaton of sequences that come in rising order, each once. A state is closed, and met with an equal one if there is one, as soon as the
    order says that no later sequence passes through it; so only one path is open at any time."""
    counts: list[int] = []
    arcs: list[tuple] = []
    register: dict[tuple, int] = {}
    path: list = []  # labels from the root to the open state
    open_counts, open_arcs = [0], [[]]

    def close() -> int:
        key = (open_counts.pop(), tuple(open_arcs.pop()))
        s = register.get(key)
        if s is None:
            s = register[key] = len(counts)
            counts.append(key[0])
            arcs.append(key[1])
        return s

    for sequence, count in items:
        k = 0
        for a, b in zip(path, sequence):
            if a != b:
                break
            k += 1
        while len(path) > k:
            s = close()
            open_arcs[-1].append((path.pop(), s))
        for label in sequence[k:]:
            path.append(label)
            open_counts.append(0)
            open_arcs.append([])
        open_counts[-1] = count
    while path:
        s = close()
        open_arcs[-1].append((path.pop(), s))
    counts.append(open_counts.pop())  # the root is a state of its own, and the last
    arcs.append(tuple(open_arcs.pop()))
    return Automaton(counts, arcs)


def union(parts: list[Automaton], least: int = 1) -> Automaton:
    """One automaton of all sequences, counts added up; those below least are left out. Parts are read side by side, in order."""
    merged = heapq.merge(*parts)
    sums = ((sequence, sum(c for _, c in same)) for sequence, same in groupby(merged, key=lambda x: x[0]))
    return build(x for x in sums if x[1] >= least)


class Union:
    """A union of any number of automata, of which at most FAN and one are held at a time."""

    def __init__(self) -> None:
        self.parts: list[Automaton] = []

    def add(self, part: Automaton) -> None:
        self.parts.append(part)
        if len(self.parts) > FAN:
            self.parts = [union(self.parts)]

    def result(self, least: int = 1) -> Automaton:
        return union(self.parts, least)


def compose(asked: Automaton, known: Automaton) -> Iterator[tuple[tuple, int]]:
    """The sequences of asked that known has too, in rising order, with known's counts: both are walked in step."""
    tables: dict[int, dict] = {}
    stack = [((), len(asked.counts) - 1, len(known.counts) - 1)]
    while stack:
        path, a, b = stack.pop()
        if asked.counts[a] and known.counts[b]:
            yield path, known.counts[b]
        if b not in tables:
            tables[b] = dict(known.arcs[b])
        there = tables[b]
        stack += [((*path, label), t, there[label]) for label, t in reversed(asked.arcs[a]) if label in there]
