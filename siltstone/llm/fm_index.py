"""A compressed FM-index over short passages of words, searched for many patterns at once with numpy.

The index holds the Burrows-Wheeler transform of the passages (each ends with a separator) in a wavelet
matrix: one packed bit vector per bit of a word's code, with a 32-bit count per 64 bits.  Passages that
occur more than once are marked by one more packed bit per suffix, so that an index never holds copies.
Suffixes are sorted to a depth of `DEPTH` words, which is all that patterns shorter than that can tell
apart; the text itself is not kept, the passages are streamed as patterns.
"""

from __future__ import annotations

import numpy as np

DEPTH = 128
#: Where the next window of a region is read from: the region's end, the end of its first window, or halfway between
#: those where the first window is known to be repeated.
WHOLE, FIRST, MIDDLE = 0, 1, 2
_one = np.uint64(1)


def _packed(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A packed bit vector, and the ones before each of its 64-bit words."""
    packed = np.packbits(np.concatenate([bits, np.zeros(-len(bits) % 64 + 64, bool)]), bitorder="little").view(np.uint64)
    return packed, np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int32)])[: len(packed)].astype(np.int32)


class FmIndex:
    def __init__(self, passages: np.ndarray, bounds: np.ndarray, many: np.ndarray):
        """passages: word hashes, one passage after another; bounds: where each starts (one more at the end);
        many: whether a passage occurs more than once."""
        size = np.diff(bounds)
        self.alphabet, codes = np.unique(passages, return_inverse=True)
        self.n = n = len(passages) + len(size)
        text, marked = np.zeros(n, np.int32), np.zeros(n, bool)
        at = np.arange(len(passages)) + np.repeat(np.arange(len(size)), size)
        text[at], marked[at] = codes + 1, np.repeat(many, size)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(self.alphabet) + 1))])
        # a rank is the first slot of its group; only suffixes that share theirs are sorted further, and separators never are
        order, rank, depth = np.argsort(text, kind="stable"), self.before[text], 1
        slots = np.arange(len(size), n)
        slots = slots[np.diff(self.before)[text[order[slots]]] > 1]
        while depth < DEPTH and len(slots):
            at = order[slots]
            key = rank[at] * (n + 1)
            follows = at + depth < n
            key[follows] += rank[at[follows] + depth] + 1
            sort = np.argsort(key)
            at, key = at[sort], key[sort]
            fresh = np.concatenate([[True], key[1:] != key[:-1]])
            order[slots], rank[at] = at, np.maximum.accumulate(np.where(fresh, slots, 0))
            slots = slots[~(fresh & np.append(fresh[1:], True))]
            depth *= 2
        bwt = text[order - 1]
        self.marks = _packed(marked[order])
        self.levels = []
        self.bits = max(1, int(len(self.alphabet)).bit_length())
        for b in range(self.bits - 1, -1, -1):
            bit = ((bwt >> b) & 1).astype(bool)
            self.levels.append((*_packed(bit), int(n - bit.sum())))
            bwt = np.concatenate([bwt[~bit], bwt[bit]])
        self.origin = self._walk(np.arange(len(self.alphabet) + 1), np.zeros(len(self.alphabet) + 1, np.int64))

    def encode(self, words: np.ndarray) -> np.ndarray:
        """The codes of words of the indexed passages."""
        return np.searchsorted(self.alphabet, words) + 1

    @staticmethod
    def _ones(packed: np.ndarray, counts: np.ndarray, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        return counts[block] + np.bitwise_count(packed[block] & ((_one << (at & 63).astype(np.uint64)) - _one))

    def _walk(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the first `at` entries of the transform that equal code end, after all levels."""
        for b, (packed, counts, zeros) in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            ones = self._ones(packed, counts, at)
            at = np.where((code >> b) & 1, zeros + ones, at - ones)
        return at

    def extend(self, code: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A backward step: from the intervals of patterns to those of code + pattern."""
        both = self._walk(np.concatenate([code, code]), np.concatenate([low, high]))
        shift = self.before[code] - self.origin[code]
        return both[: len(code)] + shift, both[len(code) :] + shift

    def again(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the patterns of these intervals occur twice or more: at two places, or in a passage with copies."""
        copies = self._ones(*self.marks, high) > self._ones(*self.marks, low)
        return (high - low > 1) | copies

    def reach(self, codes: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Matching statistics: for each stretch first to end of a stream of codes, the first start from which
        its words up to `end` occur twice or more."""
        low, high = np.zeros(len(end), np.int64), np.full(len(end), self.n, np.int64)
        start, active = end.copy(), np.arange(len(end))
        while len(active):
            active = active[start[active] > first[active]]
            if not len(active):
                break
            lo, hi = self.extend(codes[start[active] - 1], low[active], high[active])
            on = self.again(lo, hi)
            active = active[on]
            low[active], high[active] = lo[on], hi[on]
            start[active] -= 1
        return start


def repeated_windows(passages: np.ndarray, bounds: np.ndarray, many: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, first word, past word) of the stretches, width words or more, whose windows all occur twice or more."""
    index = FmIndex(passages, bounds, many)
    codes = index.encode(passages)
    # regions whose windows are to be judged: passage, first word, past word, and how they are probed
    regions = [(np.arange(len(bounds) - 1), bounds[:-1], bounds[1:], np.full(len(bounds) - 1, WHOLE))]
    found = []
    while regions:
        which, low, high, probe = (np.concatenate(x) for x in zip(*regions, strict=True))
        regions = []
        wide = high - low >= width
        which, low, high, probe = which[wide], low[wide], high[wide], probe[wide]
        if not len(which):
            break
        end = np.where(probe == WHOLE, high, np.where(probe == FIRST, low + width, (low + width + high + 1) // 2))
        start = index.reach(codes, low, end)
        hit = start == low
        # a first window that is repeated is reported with what follows it
        more = hit & (probe == FIRST) & (end < high)
        told = (end - start >= width) & ~more
        found.append((which[told], (start - bounds[which])[told], (end - bounds[which])[told]))
        regions.append((which[more], low[more], high[more], np.full(int(more.sum()), MIDDLE)))
        # [start - 1, end) occurs once, and so does each window with it: those left end before, or begin at start or later
        left = ~hit & (probe != FIRST)
        regions.append((which[left], low[left], np.minimum(end - 1, start + width - 1)[left], np.where(probe == WHOLE, FIRST, MIDDLE)[left]))
        right = ~more & (probe != WHOLE)
        regions.append((which[right], np.maximum(start, end - width + 1)[right], high[right], np.full(int(right.sum()), FIRST)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
