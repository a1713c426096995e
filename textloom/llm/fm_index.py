"""FM-index of a shard: backward search over an entropy-shaped wavelet tree, for many patterns at once.

The wavelet tree gives every symbol a prefix code of about as many bits as its frequency calls for; a level holds one bit for each entry of the
Burrows-Wheeler transform whose code reaches it, with a running count of ones for each 64 of them. Positions are not kept: what a match must tell (here the
smallest value among the matched suffixes) is stored once for each class of suffixes with the same first ``window`` symbols.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[:len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        low = self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)


class WaveletTree:
    """Rank of any symbol in a sequence of the symbols 0, 1, ..., by levels of its code."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        counts = np.bincount(sequence, minlength=symbols)
        used = counts > 0
        length = np.zeros(len(counts), np.int64)  # 0: not in the sequence
        length[used] = np.maximum(1, np.ceil(-np.log2(counts[used] / len(sequence)) - 1e-12).astype(np.int64))
        depth = int(length[used].max(initial=1))
        order = np.flatnonzero(used)[np.argsort(length[used], kind="stable")]
        share = np.left_shift(1, depth - length[order])
        full = np.zeros(len(counts), np.int64)  # codes, aligned to ``depth`` bits
        full[order] = np.cumsum(share) - share
        self.length, self.full, self.depth = length, full, depth
        self.levels: list[tuple[Bits, np.ndarray, np.ndarray]] = []
        now = sequence
        for t in range(depth):
            prefix = full[now] >> (depth - t)
            first = np.flatnonzero(np.concatenate(([True], prefix[1:] != prefix[:-1])))
            begin = np.zeros(1 << t, np.int32)  # of each node; no longer than the sequence, but for rounding
            begin[prefix[first]] = first
            bit = (full[now] >> (depth - 1 - t) & 1).astype(bool)
            bits = Bits(bit)
            start = begin[full >> (depth - t)]
            self.levels.append((bits, start, bits.rank(start.astype(np.int64)).astype(np.int32)))
            goes_on = length[now] > t + 1
            now = np.concatenate((now[goes_on & ~bit], now[goes_on & bit]))
            if not len(now):
                break

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each ``symbol`` stands before position ``at``."""
        out, of = np.where(self.length[symbol] > 0, at, 0), np.arange(len(at))
        for t, (bits, start, ones) in enumerate(self.levels):
            of = of[self.length[symbol[of]] > t]
            if not len(of):
                break
            s, i = symbol[of], out[of]
            one = bits.rank(start[s] + i) - ones[s]
            out[of] = np.where(self.full[s] >> (self.depth - 1 - t) & 1, one, i - one)
        return out


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Positions by their first ``depth`` symbols or more, and the (depth, ranks) of each round. As many ranks as fit in 62 bits are compared at once."""
    reach, rank, rounds = 1, text.astype(np.int64), []
    while True:
        bits = max(1, int(rank.max(initial=0)).bit_length())
        many = max(2, min(62 // bits, -(-depth // reach)))
        key = rank.copy()
        for k in range(1, many):
            key <<= bits
            key[:max(len(key) - k * reach, 0)] |= rank[k * reach:]
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))[:len(key)]
        reach *= many
        rounds.append((reach, rank))
        if reach >= depth:
            return order, rounds


class FMIndex:
    """Index of ``text`` (symbols below ``symbols``; 0 ends a segment) with a value for each position."""

    def __init__(self, text: np.ndarray, value: np.ndarray, window: int, symbols: int):
        self.window, self.size = window, len(text)
        order, rounds = suffix_order(text, window + 1)
        self.tree = WaveletTree(text[order - 1], symbols)
        self.smaller = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))
        reach, rank = [r for r in rounds if r[0] <= window][-1] if rounds[0][0] <= window else (1, text)
        same = np.concatenate(([False], np.ones(max(len(order) - 1, 0), bool)))[:len(order)]
        for k in [*range(0, window - reach, reach), window - reach]:
            at = np.flatnonzero(same)
            a, b = order[at] + k, order[at - 1] + k
            inside = np.maximum(a, b) < len(text)
            same[at] = inside & (rank[np.minimum(a, len(text) - 1)] == rank[np.minimum(b, len(text) - 1)])
        self.first = np.flatnonzero(~same)
        self.least = np.minimum.reduceat(value[order], self.first)
        self.kind = (np.cumsum(~same) - 1).astype(np.int32)
        self.first = np.append(self.first, len(order))

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with ``symbol`` before them."""
        both = self.tree.rank(np.concatenate((symbol, symbol)), np.concatenate((low, high)))
        return self.smaller[symbol] + both[:len(low)], self.smaller[symbol] + both[len(low):]

    def matches(self, text: np.ndarray, end: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(segment, window start in the segment, smallest value of the matched suffixes) for every window of the streamed segments.

        Segment k is ``text[end[k] - size[k]:end[k]]``. All are read from the right, a symbol at a time; the interval is that of the longest match, cut
        back to ``window`` symbols as soon as it is longer. What ends inside a match that the index does not hold reports nothing.
        """
        low, high, have = np.zeros(len(end), np.int64), np.full(len(end), self.size, np.int64), np.zeros(len(end), np.int64)
        owner, start, least = [], [], []
        for t in range(int(size.max(initial=0))):
            on = np.flatnonzero(size > t)
            symbol = text[end[on] - 1 - t]
            low[on], high[on] = self.extend(symbol, low[on], high[on])
            have[on] += 1
            lost = on[low[on] >= high[on]]
            if len(lost):
                self.restart(text, end, t, lost, low, high, have)
            full = on[have[on] >= self.window]
            kind = self.kind[low[full]]
            low[full], high[full], have[full] = self.first[kind], self.first[kind + 1], self.window
            owner.append(full)
            start.append(size[full] - 1 - t)
            least.append(self.least[kind])
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *owner]), np.concatenate([none, *start]), np.concatenate([none, *least])

    def restart(self, text: np.ndarray, end: np.ndarray, t: int, lost: np.ndarray, low: np.ndarray, high: np.ndarray, have: np.ndarray) -> None:
        """Longest shorter matches of the patterns that start at step ``t``: the match loses symbols at its right end until it is found."""
        have[lost] -= 1
        while len(lost):
            low[lost], high[lost] = 0, self.size
            left = np.full(len(lost), True)
            for k in range(int(have[lost].max(initial=0))):
                some = np.flatnonzero(left & (have[lost] > k))
                at = lost[some]
                low[at], high[at] = self.extend(text[end[at] - 1 - t + have[at] - 1 - k], low[at], high[at])
                left[some] = low[at] < high[at]
            lost = lost[~left]
            have[lost] -= 1
