"""Sets of word shingles as 64-bit hashes, computed over many texts at a time."""

from __future__ import annotations

import numpy as np

WORDS = 5
#: Bytes hashed at once (a longer text is hashed alone).
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C13


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


class Hasher:
    """Hashes words `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; keeps tables between calls."""

    def __init__(self):
        self.letters = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
        self.blank = np.zeros(256, bool)
        self.blank[[9, 10, 11, 12, 13, 32]] = True
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            inverse = pow(_BASE, -1, 1 << 64)
            for name, base in (("powers", _BASE), ("inverses", inverse)):
                steps = np.full(n, np.uint64(base), np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hash and start of each word of ASCII-lower-cased bytes."""
        x = np.frombuffer(data, np.uint8)
        self._grow(len(x) + 1)
        inside = np.zeros(len(x) + 2, np.int8)
        inside[1:-1] = ~self.blank[x]
        edges = np.diff(inside)
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(self.letters[x] * self.powers[:len(x)], out=sums[1:])
        return _mix((sums[ends] - sums[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64)), starts

    def sets(self, texts: list[str | None]):
        """The distinct shingles of each text, ascending: of ``WORDS`` words, or of all its words if it has fewer."""
        group, size = [], 0
        for text in texts:
            data = (text or "").encode("utf-8", "surrogatepass").lower()
            if group and size + len(data) > CHUNK:
                yield from self._group(group)
                group, size = [], 0
            group.append(data)
            size += len(data) + 1
        yield from self._group(group)

    def _group(self, group: list[bytes]):
        words, starts = self.words(b" ".join(group))
        firsts = np.cumsum([0, *(len(x) + 1 for x in group)])
        bounds = np.searchsorted(starts, firsts)
        rolled = words
        for k in range(1, WORDS):
            rolled = _mix(rolled[:len(words) - k] * np.uint64(_BASE) + words[k:]) if len(words) > k else rolled[:0]
        for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if end - begin >= WORDS:
                yield np.unique(rolled[begin:end - WORDS + 1])
            elif end > begin:
                whole = np.uint64(end - begin)
                for word in words[begin:end]:
                    whole = _mix(np.array([whole], np.uint64) * np.uint64(_BASE) + word)[0]
                yield np.array([whole], np.uint64)
            else:
                yield words[:0]
