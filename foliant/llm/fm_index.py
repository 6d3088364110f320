"""A compressed word-level FM-index in numpy: BWT in a wavelet matrix, backward search, matching statistics."""

from __future__ import annotations

import numpy as np


class Bits:
    """A packed bit vector with rank by 64-bit words."""

    def __init__(self, flags: np.ndarray) -> None:
        n = len(flags)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = flags
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words)[:-1], out=self.before[1:])
        self.zeros = n - int(flags.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones among the first ``at`` bits."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class Wavelet:
    """Rank of symbols in a sequence of numbers below 2^bits."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits, self.levels = bits, []
        for k in range(bits - 1, -1, -1):
            flags = (symbols >> k & 1).astype(np.uint8)
            self.levels.append(Bits(flags))
            symbols = np.concatenate([symbols[flags == 0], symbols[flags == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol among the first ``at`` places."""
        start, end = np.zeros_like(at), at
        for k, level in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            one = (symbol >> k & 1).astype(bool)
            a, b = level.rank(start), level.rank(end)
            start = np.where(one, level.zeros + a, start - a)
            end = np.where(one, level.zeros + b, end - b)
        return end - start


class FMIndex:
    """Index of segments of word codes; each segment belongs to a document.

    Segment j ends with separator j, the smallest symbols, so suffixes are distinct and their
    order is that of their words. What stays after building is compressed: the BWT as packed
    bits of a wavelet matrix, the common prefixes of neighbouring rows cut at ``depth`` (a byte
    each), and for every class of rows that share ``depth`` words the smallest document id.
    Text and suffix array are dropped.
    """

    def __init__(self, segments: list[np.ndarray], owners: list[int], depth: int) -> None:
        self.depth, count = depth, len(segments)
        sizes = np.array([len(s) for s in segments])
        ends = np.cumsum(sizes + 1) - 1  # place of each separator
        self.codes, inverse = np.unique(np.concatenate(segments), return_inverse=True)
        self.separators = count
        self.n = n = int(sizes.sum()) + count
        text = np.empty(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends] = False
        text[inside] = inverse + count
        text[ends] = np.arange(count)
        order, ranks = _suffix_order(text, depth)
        self.bwt = Wavelet(text[order - 1], max(1, int(len(self.codes) + count - 1).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(self.codes) + count))])
        shared = _shared_words(order, ranks, depth)
        self.shared = np.concatenate([[0], shared, [0]]).astype(np.uint8)  # of each row with the row before
        self.starts = np.concatenate([np.flatnonzero(self.shared[:-1] < depth), [n]]).astype(np.int32)
        self.boundary = Bits(self.shared[:-1] < depth)
        self.smallest = np.minimum.reduceat(np.repeat(np.array(owners, np.int64), sizes + 1)[order], self.starts[:-1])

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        """The symbol of each word code; -1 for words that the index does not have."""
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, at + self.separators, -1)

    def back(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """One step of backward search for a bound of an interval."""
        return self.first[symbol] + self.bwt.rank(symbol, row)

    def count(self, words: np.ndarray) -> int:
        """Occurrences of a sequence of word codes."""
        low, high = np.array([0]), np.array([self.n])
        for symbol in self.symbols(words)[::-1]:
            if symbol < 0:
                return 0
            low, high = self.back(np.array([symbol]), low), self.back(np.array([symbol]), high)
        return int(high[0] - low[0])

    def _shorter(self, symbol: int, low: int, high: int, length: int) -> tuple[int, int, int]:
        """The longest shortened match that the symbol extends: interval and length after the step."""
        while length:
            length = int(max(self.shared[low], self.shared[high]))
            while self.shared[low] >= length and low > 0:
                low -= 1
            while self.shared[high] >= length and high < self.n:
                high += 1
            a, b = (int(self.back(np.array([symbol]), np.array([x]))[0]) for x in (low, high))
            if a < b:
                return a, b, length + 1
        return 0, self.n, 0

    def matching_statistics(self, patterns: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For every place of every pattern the length of its longest match, cut at depth, and the smallest owner of a full one.

        Backward search: the interval of a match is extended to the left by one word at a time, all
        patterns side by side. An interval that gets empty is replaced by that of the longest prefix
        of the match that the word extends. Matches of depth words are widened to the interval of
        all rows that share these words; its smallest owner is the answer (-1 for shorter matches).
        """
        sizes = np.array([len(p) for p in patterns], np.int64)
        ends = np.cumsum(sizes)
        flat = self.symbols(np.concatenate(patterns)) if len(patterns) else np.zeros(0, np.int64)
        lengths, owner = np.zeros(len(flat), np.uint8), np.full(len(flat), -1, np.int64)
        by_size = np.argsort(-sizes, kind="stable")
        down, last = -sizes[by_size], ends[by_size]
        low, high, size = np.zeros(len(sizes), np.int64), np.full(len(sizes), self.n, np.int64), np.zeros(len(sizes), np.int64)
        for step in range(1, int(sizes.max(initial=0)) + 1):
            live = int(np.searchsorted(down, -step, side="right"))
            place = last[:live] - step
            symbol = flat[place]
            a, b = self.back(np.maximum(symbol, 0), low[:live]), self.back(np.maximum(symbol, 0), high[:live])
            grown = size[:live] + 1
            for k in np.flatnonzero((a >= b) | (symbol < 0)).tolist():
                a[k], b[k], grown[k] = self._shorter(int(symbol[k]), int(low[k]), int(high[k]), int(size[k])) if symbol[k] >= 0 else (0, self.n, 0)
            full = np.flatnonzero(grown >= self.depth)
            kind = self.boundary.rank(a[full] + 1) - 1
            a[full], b[full], grown[full] = self.starts[kind], self.starts[kind + 1], self.depth
            low[:live], high[:live], size[:live] = a, b, grown
            lengths[place] = grown
            owner[place[full]] = self.smallest[kind]
        return [(lengths[e - s : e], owner[e - s : e]) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]


def _suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """The suffix array by prefix doubling, and the ranks by so many first symbols for widths up to depth."""
    n, width, ranks = len(text), 1, {}
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    while True:
        if width <= depth:
            ranks[width] = rank.astype(np.int32)
        second = np.zeros(n, np.int64)
        second[: n - width] = rank[width:] + 1
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], (ordered[1:] != ordered[:-1]).astype(np.int64)]))
        width *= 2
        if width >= n or rank.max() == n - 1 and width > depth:
            return order, ranks


def _shared_words(order: np.ndarray, ranks: dict[int, np.ndarray], depth: int) -> np.ndarray:
    """The words that each row shares with the row before it, cut at depth."""
    n, a, b = len(order), order[1:], order[:-1]
    out = np.zeros(n - 1, np.int64)
    for width in sorted(ranks, reverse=True):
        x, y = a + out, b + out
        ok = (x < n) & (y < n)
        out += width * (ok & (ranks[width][np.minimum(x, n - 1)] == ranks[width][np.minimum(y, n - 1)]))
    return np.minimum(out, depth)
