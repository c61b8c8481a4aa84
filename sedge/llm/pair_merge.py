"""Merging adjacent symbols by rank, for many words in step."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property
from heapq import heapify, heappop, heappush

import numpy as np

PAIR_BITS = 21
NONE = np.iinfo(np.int64).max
END = np.iinfo(np.int64).min
#: Symbols of words that are merged together.
CELLS = 1 << 20
#: A word of more symbols has a heap of its own, for a step in rows costs its whole length.
LONG = 256


class PairMerge:
    """pairs: (left symbol, right symbol) to (rank, symbol that they make); negative symbols never merge."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        items = sorted((a << PAIR_BITS | b, rank << PAIR_BITS | made) for (a, b), (rank, made) in pairs.items())
        self.keys = np.array([k for k, _ in items], np.int64)
        self.values = np.array([v for _, v in items], np.int64)
        # a table of at most a fourth of its slots filled; a pair whose slot is taken lies in the next free one
        self.shift = np.uint64(61 - max(1, len(items)).bit_length())
        size = 1 << 64 - int(self.shift)
        slots, held = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        left, at = np.arange(len(items)), self.slot(self.keys)
        while len(left):
            free = slots[at] < 0
            slots[at[free]] = self.keys[left[free]]
            placed = slots[at] == self.keys[left]
            held[at[placed]] = self.values[left[placed]]
            left, at = left[~placed], (at[~placed] + 1) % size
        self.slots, self.held = slots, held

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def made(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank and symbol that each pair makes, NONE where it makes none."""
        key = (a << PAIR_BITS | b).ravel()
        key[((a | b) < 0).ravel()] = -2
        at = self.slot(key)
        there = self.slots[at]
        out = np.where(there == key, self.held[at], NONE)
        rest = np.flatnonzero((there != key) & (there >= 0))
        while len(rest):
            at[rest] = next_at = (at[rest] + 1) % len(self.slots)
            there = self.slots[next_at]
            hit = there == key[rest]
            out[rest[hit]] = self.held[next_at[hit]]
            rest = rest[~hit & (there >= 0)]
        return out.reshape(a.shape)

    def merge(self, symbols: np.ndarray) -> np.ndarray:
        """Symbols of words of one length (rows) when no pair makes anything any more; END fills up.

        Each word has its own agenda of adjacent pairs; a step takes the best pair of each, the
        leftmost among equals.
        """
        out = np.full(symbols.shape, END, np.int64)
        rows, s = np.arange(len(symbols)), symbols.astype(np.int64)
        agenda = self.made(s[:, :-1], s[:, 1:])
        width = s.shape[1]
        while width > 1 and len(rows):
            best = agenda.argmin(axis=1)
            value = agenda[np.arange(len(rows)), best]
            going = value < NONE
            if not going.all():
                stay = ~going
                out[rows[stay], :width] = s[stay]
                rows, s, agenda, best, value = rows[going], s[going], agenda[going], best[going], value[going]
            s[np.arange(len(rows)), best] = value & (1 << PAIR_BITS) - 1
            shift = np.arange(width - 1)[None, :]
            s = np.take_along_axis(s, shift + (shift > best[:, None]), 1)
            width -= 1
            if width == 1:
                break
            shift = np.arange(width - 1)[None, :]
            agenda = np.take_along_axis(agenda, shift + (shift >= best[:, None]), 1)
            left = np.flatnonzero(best > 0)
            agenda[left, best[left] - 1] = self.made(s[left, best[left] - 1], s[left, best[left]])
            right = np.flatnonzero(best < width - 1)
            agenda[right, best[right]] = self.made(s[right, best[right]], s[right, best[right] + 1])
        out[rows, :width] = s
        return out

    @cached_property
    def table(self) -> dict[int, int]:
        return dict(zip(self.keys.tolist(), self.values.tolist(), strict=True))

    def merge_one(self, symbols: np.ndarray) -> np.ndarray:
        """The same for one long word: a heap of pairs and linked neighbours."""
        s, n, get = symbols.tolist(), len(symbols), self.table.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        values = self.made(symbols[:-1], symbols[1:])
        agenda = [(v, k) for k, v in enumerate(values.tolist()) if v < NONE]
        heapify(agenda)
        gone = bytearray(n)
        while agenda:
            value, k = heappop(agenda)
            m = after[k]
            # a pair that has changed since is another entry, or none
            if gone[k] or m >= n or s[k] < 0 or s[m] < 0 or get(s[k] << PAIR_BITS | s[m]) != value:
                continue
            s[k] = made = value & (1 << PAIR_BITS) - 1
            gone[m] = 1
            after[k] = r = after[m]
            if r < n:
                before[r] = k
                if s[r] >= 0 and (v := get(made << PAIR_BITS | s[r])) is not None:
                    heappush(agenda, (v, k))
            left = before[k]
            if left >= 0 and s[left] >= 0 and (v := get(s[left] << PAIR_BITS | made)) is not None:
                heappush(agenda, (v, left))
        return np.array(s, np.int64)[np.frombuffer(gone, np.uint8) == 0]

    def merge_all(self, flat: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Yields (word numbers, merged rows) for words that lie end to end in flat."""
        begins = np.cumsum(sizes) - sizes
        for size in np.unique(sizes):
            which = np.flatnonzero(sizes == size)
            if size > LONG:
                for k in which.tolist():
                    yield np.array([k]), self.merge_one(flat[begins[k] : begins[k] + size])[None, :]
                continue
            step = max(1, CELLS // max(1, int(size)))
            for at in range(0, len(which), step):
                rows = which[at : at + step]
                yield rows, self.merge(flat[begins[rows][:, None] + np.arange(size)])
