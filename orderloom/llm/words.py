"""Words of many texts at once as 64-bit hashes, from their bytes."""

from __future__ import annotations

import numpy as np

from orderloom.llm.shingles import mix

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STRETCH = 1 << 20


class WordHasher:
    """Hashes of the words between the bytes ``separators``; the powers of the base are kept between calls."""

    def __init__(self, separators: bytes):
        self.blank = np.zeros(256, bool)
        self.blank[list(separators)] = True
        self.mark = separators[:1]
        self.power = self.inverse = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            self.power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE)]))
            self.inverse = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, _INVERSE)]))

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, first byte, byte behind the last) of every word of ``data``, a stretch of about a megabyte at a time."""
        out, at = [], 0
        flat = np.frombuffer(data, np.uint8)
        while at < len(flat):
            to = min(len(flat), at + _STRETCH)
            if to < len(flat):  # a stretch ends where a word does
                while to < len(flat) and not self.blank[flat[to]]:
                    ahead = self.blank[flat[to : to + 4096]]
                    to += int(ahead.argmax()) if ahead.any() else len(ahead)
            out.append(self._stretch(flat[at:to], at))
            at = to
        if not out:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def between(self, flat: np.ndarray, begins: list[np.ndarray], ends: list[np.ndarray]) -> list[np.ndarray]:
        """Hashes of the bytes from each of ``begins`` up to its one of ``ends``; those of a word equal the ones of ``words``."""
        self._powers(len(flat) + 1)
        sums = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * self.power[: len(flat)], out=sums[1:])
        return [mix((sums[e] - sums[b]) * self.inverse[b] + (e - b).astype(np.uint64)) for b, e in zip(begins, ends, strict=True)]

    def _stretch(self, flat: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inside = np.zeros(len(flat) + 2, bool)
        np.logical_not(self.blank[flat], out=inside[1:-1])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        begin, end = edge[::2], edge[1::2]
        (word,) = self.between(flat, [begin], [end])
        return word, begin + at, end + at


def joined(texts: list[bytes], mark: bytes) -> tuple[bytes, np.ndarray]:
    """All texts in one, a separator between them, and the first byte of each (with one more behind the last)."""
    size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return mark.join(texts), np.concatenate([[0], np.cumsum(size)])
