"""A compressed FM-index over word sequences, searched backward for many streams at once.

The Burrows-Wheeler transform is kept in a wavelet tree in matrix form: one
packed bit vector per bit of a word's number, with counts per 64 bits. A
backward step maps both ends of an interval through all levels. Matching
statistics follow each stream from its end: a step to the left either narrows
the interval or, where the word does not precede it, first widens it to its
parent in the LCP-interval tree, that is, drops words at the right. A match
counts only if some text of a smaller owner contains it, which is a range
minimum over owners in suffix order.
"""

from __future__ import annotations

import numpy as np


def _minimum_table(values: np.ndarray) -> list[np.ndarray]:
    """Minima of all runs whose length is a power of two."""
    table = [values]
    while 2 << (len(table) - 1) <= len(values):
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    return table


def _smaller_before(values: np.ndarray) -> np.ndarray:
    """The nearest place before each with a smaller value; 0 if there is none."""
    out, stack = [], []
    for place, value in enumerate(values.tolist()):
        while stack and stack[-1][1] >= value:
            stack.pop()
        out.append(stack[-1][0] if stack else 0)
        stack.append((place, value))
    return np.array(out, np.int64)


class BitVector:
    def __init__(self, bits: np.ndarray):
        packed = np.packbits(np.concatenate([bits, np.zeros(64 - len(bits) % 64, bool)]), bitorder="little")
        self.words = packed.view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.concatenate([[0], np.cumsum(ones, dtype=np.int32)[:-1]]).astype(np.int32)
        self.zeros = int(len(bits) - bits.sum())

    def ones(self, end: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block, bit = end >> 6, (end & 63).astype(np.uint64)
        rest = self.words[block] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[block] + np.bitwise_count(rest)


class FmIndex:
    def __init__(self, texts: list[np.ndarray], owners: np.ndarray):
        """``texts`` are arrays of word hashes; ``owners`` says whose each is."""
        lengths = np.array([len(text) for text in texts])
        words, numbers = np.unique(np.concatenate(texts), return_inverse=True)
        self.words = words
        # Symbols: one separator per text, all smaller than any word. In the tree they are all 0.
        n = int(lengths.sum()) + len(texts)
        ends = np.cumsum(lengths + 1) - 1
        symbols = np.empty(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends] = False
        symbols[inside] = numbers + len(texts)
        symbols[ends] = np.arange(len(texts))
        order, rank = self._sort(symbols)
        tree = np.where(symbols < len(texts), 0, symbols - len(texts) + 1)
        self.lcp = self._lcp(symbols, order, rank)
        self.smaller_before = _smaller_before(self.lcp)
        self.smaller_after = len(self.lcp) - 1 - _smaller_before(self.lcp[::-1])[::-1]
        place = np.repeat(np.arange(len(texts)), lengths + 1)
        self.owner = _minimum_table(owners[place][order])
        self._wavelet(tree[order - 1])
        counts = np.bincount(tree, minlength=len(words) + 1)
        self.offset = np.cumsum(counts) - counts - self._through(np.arange(len(words) + 1), np.zeros(len(words) + 1, np.int64))
        self.size = n

    @staticmethod
    def _sort(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix order and ranks by prefix doubling."""
        _, rank = np.unique(symbols, return_inverse=True)
        n, step = len(symbols), 1
        while True:
            following = np.zeros(n, np.int64)
            following[:-step] = rank[step:] + 1 if step < n else 0
            key = rank * np.int64(n + 1) + following
            order = np.argsort(key, kind="stable")
            new = np.empty(n, np.int64)
            new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            rank, step = new, step * 2
            if rank[order[-1]] == n - 1 or step >= n:
                return order, rank

    @staticmethod
    def _lcp(symbols: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Equal words at the start of neighbours in suffix order: all neighbours are compared at once."""
        n = len(symbols)
        lcp = np.zeros(n + 1, np.int32)
        at = np.arange(1, n)
        left, right = order[:-1].copy(), order[1:].copy()
        while len(at):
            good = symbols[left] == symbols[right]  # separators all differ, so no match leaves its text
            at, left, right = at[good], left[good] + 1, right[good] + 1
            lcp[at] += 1
        return lcp

    def _wavelet(self, last: np.ndarray) -> None:
        self.levels = []
        for bit in range(max(1, int(last.max()).bit_length()) - 1, -1, -1):
            bits = (last >> bit & 1).astype(bool)
            self.levels.append((bit, BitVector(bits)))
            last = np.concatenate([last[~bits], last[bits]])

    def _through(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for bit, level in self.levels:
            ones = level.ones(place)
            place = np.where(symbol >> bit & 1, level.zeros + ones, place - ones)
        return place

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals [low, high) of the words' matches after one more word to the left."""
        found = self._through(np.concatenate([symbol, symbol]), np.concatenate([low, high])) + np.tile(self.offset[symbol], 2)
        return found[: len(low)], found[len(low) :]

    def least_owner(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Smallest owner in each interval that is not empty."""
        out = np.empty(len(low), np.int64)
        power = np.frexp((high - low).astype(float))[1] - 1
        for p in np.unique(power):
            rows = power == p
            out[rows] = np.minimum(self.owner[p][low[rows]], self.owner[p][high[rows] - (1 << int(p))])
        return out

    def parent(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next wider intervals and the length of what they match."""
        left, right = self.lcp[low], self.lcp[high]
        size = np.maximum(left, right)
        return np.where(left == size, self.smaller_before[low], low), np.where(right == size, self.smaller_after[high], high), size

    def matching_statistics(self, streams: list[np.ndarray], owners: np.ndarray, least: int = 0) -> list[np.ndarray]:
        """For every place of a stream of words, the longest match that starts there within texts of smaller owners.

        A stream is left, with 0 for the rest, where no match of ``least`` words can begin any more.
        """
        lengths = np.array([len(stream) for stream in streams])
        out = [np.zeros(length, np.int32) for length in lengths]
        by_length = np.argsort(-lengths, kind="stable")
        width = int(lengths.max(initial=0))
        grid = np.full((len(streams), width), -1, np.int64)  # aligned at the end
        for row, stream in enumerate(streams):
            at = np.searchsorted(self.words, stream).clip(0, len(self.words) - 1)
            grid[row, width - len(stream) :] = np.where(self.words[at] == stream, at + 1, -1)
        result = np.zeros((len(streams), width), np.int32)
        low, high = np.zeros(len(streams), np.int64), np.full(len(streams), self.size, np.int64)
        size = np.zeros(len(streams), np.int32)
        alive = len(streams)
        for place in range(width - 1, -1, -1):
            while alive and lengths[by_length[alive - 1]] < width - place:
                alive -= 1
            active = by_length[:alive]
            active = active[size[active] + lengths[active] - (width - 1 - place) >= least]
            todo = active
            strange = grid[todo, place] < 0
            reset = todo[strange]
            low[reset], high[reset], size[reset] = 0, self.size, 0
            todo = todo[~strange]
            while len(todo):
                a, b = self.step(grid[todo, place], low[todo], high[todo])
                good = a < b
                good[good] = self.least_owner(a[good], b[good]) < owners[todo[good]]
                done = todo[good]
                low[done], high[done], size[done] = a[good], b[good], size[done] + 1
                todo = todo[~good]
                todo = todo[size[todo] > 0]  # those at the root have no match here
                if len(todo):
                    low[todo], high[todo], size[todo] = self.parent(low[todo], high[todo])
            result[active, place] = size[active]
        for row, length in enumerate(lengths):
            out[row] = result[row, width - length :]
        return out
