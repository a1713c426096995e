"""Induced suffix sorting of one shard, with bucket queues that go to disk.

Only suffixes at local minima (LMS positions) are sorted directly. All others follow from them: going through the sorted suffixes in
order, each suffix hands its left neighbour on to the queue of that neighbour's first byte, and the queues together are the suffix array. The
same induction, started from unsorted LMS positions, sorts and names the pieces between them; the names form a shorter text whose suffixes give
the LMS order. Names are no bytes and have no byte buckets, so the shorter text is ranked by doubling, up to the depth that is asked for.

Queues hold positions in arrival order. Entries beyond ``memory`` bytes are written to unnamed scratch files that vanish with the task; nobody
but the task reads them, as with the spill files of a sort.
"""

from __future__ import annotations

import tempfile
from collections import deque
from collections.abc import Iterator

import numpy as np

from textloom.llm.common import prefix_hash, span_hash


class Queues:
    """One first-in first-out queue of position arrays for each first byte."""

    def __init__(self, count: int, memory: int):
        self.items = [deque() for _ in range(count)]
        self.memory, self.held, self.file = memory, 0, None

    def put(self, queue: int, positions: np.ndarray) -> None:
        if self.held + positions.nbytes > self.memory:
            self.file = self.file or tempfile.TemporaryFile()
            at = self.file.seek(0, 2)
            self.file.write(positions.tobytes())
            self.items[queue].append((at, len(positions), positions.dtype))
        else:
            self.held += positions.nbytes
            self.items[queue].append(positions)

    def take(self, queue: int) -> Iterator[np.ndarray]:
        """Everything in the queue, also what is put there meanwhile. What waits there comes at once, up to ``memory`` bytes: many small arrays would
        cost far more than what they hold."""
        items = self.items[queue]
        while items:
            waiting, size = [], 0
            while items and (not waiting or size < self.memory):
                item = items.popleft()
                if isinstance(item, tuple):
                    self.file.seek(item[0])
                    item = np.frombuffer(self.file.read(item[1] * item[2].itemsize), item[2])
                else:
                    self.held -= item.nbytes
                waiting.append(item)
                size += item.nbytes
            yield np.concatenate(waiting) if len(waiting) > 1 else waiting[0]

    def hand_on(self, positions: np.ndarray, chars: np.ndarray) -> None:
        """Put every position into the queue of its byte, keeping the order."""
        if len(positions):
            order = np.argsort(chars, kind="stable")
            positions, chars = positions[order], chars[order]
            cuts = np.flatnonzero(np.concatenate(([True], chars[1:] != chars[:-1])))
            for a, b in zip(cuts, [*cuts[1:], len(chars)]):
                self.put(int(chars[a]), positions[a:b])


def rising(t: np.ndarray) -> np.ndarray:
    """Whether the suffix at each position is smaller than its right neighbour (S type). ``t`` ends with its smallest value."""
    step = np.sign(np.diff(t.astype(np.int32)))
    at = np.where(step != 0, np.arange(len(step)), len(step))
    following = np.minimum.accumulate(at[::-1])[::-1]  # equal neighbours take the type of the next different one
    out = np.ones(len(t), bool)
    out[:-1] = step[np.minimum(following, len(step) - 1)] > 0
    return out


def induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, memory: int) -> np.ndarray:
    """Suffix array of ``t`` from LMS positions in (assumed) order."""
    top = int(t.max()) + 1
    stars = Queues(top, memory)
    stars.hand_on(lms, t[lms])
    larger, larger_out = Queues(top, memory), Queues(top, memory)

    def left(positions: np.ndarray, of_type: bool) -> tuple[np.ndarray, np.ndarray]:
        before = positions[positions > 0] - 1
        before = before[small[before] == of_type]
        return before, t[before]

    for c in range(top):
        for positions in larger.take(c):
            larger_out.put(c, positions)
            larger.hand_on(*left(positions, False))
        for positions in stars.take(c):
            larger.hand_on(*left(positions, False))
    smaller, result = Queues(top, memory), deque()
    for c in range(top - 1, -1, -1):
        for positions in smaller.take(c):
            result.appendleft(positions[::-1])
            smaller.hand_on(*left(positions, True))
        whole = list(larger_out.take(c))
        for positions in reversed(whole):
            result.appendleft(positions)
            smaller.hand_on(*left(positions[::-1], True))
        if c == 0:
            result.appendleft(lms[t[lms] == 0])
    return np.concatenate(result)


def suffix_order(t: np.ndarray, depth: int, memory: int = 64 << 20) -> np.ndarray:
    """Positions of ``t`` in the order of their first ``depth`` values. ``t`` holds small integers and ends with the only 0."""
    small = rising(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int32) + 1
    if len(lms) <= 1:
        return induce(t, small, lms if len(lms) else np.array([len(t) - 1], np.int32), memory)
    order = induce(t, small, lms, memory)
    is_lms = np.zeros(len(t), bool)
    is_lms[lms] = True
    pieces = order[is_lms[order]]  # LMS pieces in order
    number = np.zeros(len(t), np.int32)
    number[lms] = np.arange(len(lms))
    ends = np.append(lms[1:] + 1, len(t))
    raw = t.astype(np.uint16).view(np.uint8)
    sums = prefix_hash(raw)
    at = number[pieces]
    key = span_hash(sums, 2 * pieces.astype(np.int64), 2 * ends[at].astype(np.int64))
    names = np.zeros(len(lms), np.int64)
    names[at] = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]).astype(np.int64))))
    reach = 1
    while 2 * reach < depth + 2 and names.max() + 1 < len(names):  # a piece has two values of its own at least
        tail = np.zeros(len(names), np.int64)
        tail[:-reach] = names[reach:] + 1
        both = names * (len(names) + 1) + tail
        order = np.argsort(both, kind="stable")
        both = both[order]
        names[order] = np.cumsum(np.concatenate(([0], (both[1:] != both[:-1]).astype(np.int64))))
        reach *= 2
        if reach >= len(names):
            break
    return induce(t, small, lms[np.argsort(names, kind="stable")], memory)


def equal_neighbours(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` bytes at each position of ``order`` equal those at the one before (common prefix of at least that)."""
    same = np.concatenate(([False], np.ones(max(len(order) - 1, 0), bool)))[:len(order)]
    words = np.lib.stride_tricks.sliding_window_view(data, 8)
    for k in [*range(0, length - 7, 8), length - 8]:
        at = np.flatnonzero(same)
        a, b = words[order[at] + k], words[order[at - 1] + k]
        same[at] = (np.ascontiguousarray(a).view(np.uint64) == np.ascontiguousarray(b).view(np.uint64))[:, 0]
    return same
