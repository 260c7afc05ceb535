"""Word shingles of whole texts as sorted 64-bit hashes, worked out for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PORTION_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A well-mixed permutation of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Distinct shingles of ``words`` words; powers are kept between calls."""

    def __init__(self, words: int):
        self.words = words
        self.power = self.inverse = np.ones(1, np.uint64)
        self.place = mix(np.arange(1, words + 1, dtype=np.uint64) * _BASE) | np.uint64(1)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            self.power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE)]))
            self.inverse = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, _INVERSE)]))

    def sets(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Per text its sorted distinct shingles; only A-Z are lower-cased, words end at ASCII white space.

        A text of fewer words is one shingle as a whole, one without words has none.
        """
        held, size = [], 0
        for text in texts:
            data = (text or "").encode("utf-8", "surrogatepass").lower()
            held.append(data)
            size += len(data)
            if size > _PORTION_BYTES:
                yield from self._portion(held)
                held, size = [], 0
        if held:
            yield from self._portion(held)

    def _portion(self, data: list[bytes]) -> Iterator[np.ndarray]:
        flat = np.frombuffer(b" " + b" ".join(data) + b" ", np.uint8)
        self._powers(len(flat) + 1)
        space = _SPACE[flat]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        begin, end = edge[::2], edge[1::2]
        sums = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * self.power[: len(flat)], out=sums[1:])
        word = mix((sums[end] - sums[begin]) * self.inverse[begin] + (end - begin).astype(np.uint64))
        starts = np.cumsum([1] + [len(d) + 1 for d in data])
        first = np.searchsorted(begin, starts)
        n = self.words
        count = max(0, len(word) - n + 1)
        whole = np.zeros(count, np.uint64)
        for j in range(n):
            whole += word[j : j + count] * self.place[j]
        whole = mix(whole)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= n:
                yield np.unique(whole[a : b - n + 1])
            elif b > a:
                few = (word[a:b] * self.place[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                yield mix(np.array([few], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
