"""A word lexicon as a minimal acyclic transducer in one memory-mapped file.

Words sharing a suffix share its states.  An arc carries the number of words that come before it, so
the sum along a path is the word's own number, and the number finds the word's ids in a flat array.
"""

from __future__ import annotations

import mmap
import struct
from collections.abc import Iterable
from itertools import pairwise

import numpy as np

_HEADER = struct.Struct("<5q")


class _State:
    __slots__ = ("arcs", "final")

    def __init__(self) -> None:
        self.arcs: dict[int, _State] = {}
        self.final = False

    def signature(self) -> tuple:
        return self.final, tuple((a, id(s)) for a, s in self.arcs.items())


def _minimal(words: list[bytes]) -> _State:
    """The minimal automaton of sorted distinct words, states merged as soon as they are complete."""
    register: dict[tuple, _State] = {}
    root, path = _State(), []  # path: (parent, label, child) of the last word's unmerged states

    def merge(down_to: int) -> None:
        while len(path) > down_to:
            parent, label, child = path.pop()
            parent.arcs[label] = register.setdefault(child.signature(), child)

    last = b""
    for word in words:
        shared = next((i for i, (a, b) in enumerate(zip(last, word)) if a != b), min(len(last), len(word)))
        merge(shared)
        at = path[-1][2] if path else root
        for label in word[shared:]:
            new = _State()
            at.arcs[label] = new
            path.append((at, label, new))
            at = new
        at.final = True
        last = word
    merge(0)
    return root


def compile_lexicon(entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """(word, ids) pairs compiled; the bytes are those of a lexicon file."""
    table = dict(entries)
    words = sorted(table)
    root = _minimal(words)
    order, number, stack = [], {}, [root]
    while stack:
        state = stack.pop()
        if id(state) not in number:
            number[id(state)] = len(order)
            order.append(state)
            stack.extend(state.arcs.values())
    below: dict[int, int] = {}

    def count(state: _State) -> int:
        pending = [state]
        while pending:
            top = pending[-1]
            missing = [s for s in top.arcs.values() if id(s) not in below]
            if missing:
                pending.extend(missing)
            else:
                pending.pop()
                below[id(top)] = top.final + sum(below[id(s)] for s in top.arcs.values())
        return below[id(state)]

    count(root)
    first, labels, targets, skips = [0], bytearray(), [], []
    for state in order:
        skipped = int(state.final)
        for label, child in sorted(state.arcs.items()):
            labels.append(label)
            targets.append(number[id(child)])
            skips.append(skipped)
            skipped += below[id(child)]
        first.append(len(labels))
    lengths = [len(table[w]) for w in words]
    flat = [i for w in words for i in table[w]]
    parts = [_HEADER.pack(len(order), len(labels), len(words), len(flat), 0)]
    for values in (first, targets, skips, np.cumsum([0, *lengths]), flat, [s.final for s in order]):
        parts.append(np.asarray(values, np.int32).tobytes())
    return b"".join([*parts, bytes(labels)])


class Lexicon:
    """Read access to a compiled lexicon; the file is mapped, not read."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        states, arcs, words, ids, _ = _HEADER.unpack_from(self._map)
        self.words, at = words, _HEADER.size
        view = memoryview(self._map)
        cuts = np.cumsum([at, *(4 * n for n in (states + 1, arcs, arcs, words + 1, ids, states))])
        self._first, self._targets, self._skips, self._starts, self._ids, self._final = (
            view[int(a) : int(b)].cast("i") for a, b in pairwise(cuts)
        )
        self._labels = int(cuts[-1])

    def get(self, word: bytes) -> list[int] | None:
        """The ids of ``word``, or None where the lexicon lacks it."""
        state = number = 0
        first, targets, skips, labels, find = self._first, self._targets, self._skips, self._labels, self._map.find
        for i in range(len(word)):
            arc = find(word[i : i + 1], labels + first[state], labels + first[state + 1])
            if arc < 0:
                return None
            arc -= labels
            number += skips[arc]
            state = targets[arc]
        if not self._final[state]:
            return None
        return self._ids[self._starts[number] : self._starts[number + 1]].tolist()
