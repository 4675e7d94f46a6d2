"""Flat arrays of variable-length runs, and a bounded cache from strings to runs of integers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What a kept string is taken to cost beside its characters and its run: object, dictionary slot, bounds.
_OVERHEAD = 180


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + length], one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


def split_words(texts: pa.Array, separator: str) -> tuple[pa.Array, np.ndarray]:
    """All pieces between separators, and their number for each text."""
    lists = pc.split_pattern(texts, separator)
    return lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def slices(sizes: np.ndarray, most_rows: int, most_size: int) -> list[tuple[int, int]]:
    """Bounds of stretches of rows, each of few rows and of little size in all, or of one row."""
    out, a, total = [], 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > a and (i - a >= most_rows or total + n > most_size):
            out.append((a, i))
            a, total = i, 0
        total += n
    return out + [(a, len(sizes))] if len(sizes) else out


class RunCache:
    """Runs of integers by string. Keeps strings up to ``limit`` bytes in all, the first ones, which hold the
    frequent ones; later ones are encoded each time they come. It starts anew when most strings of a batch
    are not among those kept."""

    def __init__(self, encode: Callable[[list[str]], list[np.ndarray]], limit: int) -> None:
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int32)
        self.used = self.cost = 0

    @staticmethod
    def _cost(units: list[str]) -> int:
        # A run has at most an id for each byte; most have far fewer.
        return sum(map(len, units)) * 5 + _OVERHEAD * len(units)

    def _add(self, units: list[str]) -> None:
        runs = self.encode(units)
        lengths = np.array([len(r) for r in runs], np.int64)
        n, k = int(lengths.sum()), len(self.at)
        while self.used + n > len(self.flat):
            self.flat = np.r_[self.flat, np.zeros_like(self.flat)]
        while k + len(units) > len(self.start):
            self.start, self.length = np.r_[self.start, np.zeros_like(self.start)], np.r_[self.length, np.zeros_like(self.length)]
        self.length[k : k + len(units)] = lengths
        self.start[k : k + len(units)] = self.used + np.cumsum(lengths) - lengths
        if n:
            self.flat[self.used : self.used + n] = np.concatenate(runs)
        self.used += n
        self.cost += self._cost(units)
        self.at.update(zip(units, range(k, k + len(units))))

    def runs(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The runs of all values, one after the other, and the length of each."""
        if not len(values):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        coded = values.dictionary_encode()
        names = coded.dictionary.to_pylist()
        known = list(map(self.at.get, names))
        new = [n for n, k in zip(names, known) if k is None]
        if new:
            if self.cost + self._cost(new) <= self.limit:
                self._add(new)
            elif 2 * len(new) > len(names) and self._cost(names) <= self.limit:
                self._clear()
                self._add(names)
            else:
                return self._mixed(coded, names, known, new)
            known = [self.at[n] for n in names]
        at = np.array(known, np.int64)
        picked = at[coded.indices.to_numpy(zero_copy_only=False)]
        lengths = self.length[picked].astype(np.int64)
        return gather(self.flat, self.start[picked], lengths), lengths

    def _mixed(self, coded: pa.DictionaryArray, names: list[str], known: list[int | None], new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As runs(), with the new strings' runs behind those kept, for this batch only."""
        runs = self.encode(new)
        sizes = np.array([len(r) for r in runs], np.int64)
        flat = np.concatenate([self.flat[: self.used], *runs])
        place = dict(zip(new, range(len(new))))
        at = np.array([len(self.at) + place[n] if k is None else k for n, k in zip(names, known)], np.int64)
        start = np.r_[self.start[: len(self.at)], self.used + np.cumsum(sizes) - sizes][at]
        length = np.r_[self.length[: len(self.at)], sizes][at]
        picked = coded.indices.to_numpy(zero_copy_only=False)
        return gather(flat, start[picked], length[picked]), length[picked]
