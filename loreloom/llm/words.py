"""Words of many texts at once, as numpy arrays of positions and 64-bit hashes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bytes of words that are digits, a-z or outside ASCII (texts lower-cased before).
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Bytes of words that white space parts.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_BYTE = np.random.RandomState(20240229).randint(1, 1 << 62, 256, dtype=np.int64).astype(np.uint64)
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b)], dtype=np.uint64) for b in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64 bits well."""
    x = (x ^ (x >> np.uint64(32))) * _STEP
    x = (x ^ (x >> np.uint64(29))) * _BASE
    return x ^ (x >> np.uint64(32))


@dataclass
class Words:
    """Words of texts in one buffer: begin, end and hash of each, and its text's number, ascending."""

    data: bytes
    begin: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    n_docs: int

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the sequences of k words of one text, and the first word of each."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        h, c = np.zeros(n, np.uint64), np.uint64(1)
        for i in range(k):
            h += self.hash[i : i + n] * c
            c = np.uint64((int(c) * int(_STEP)) & (2**64 - 1))
        return mix(h[at] + np.uint64(k)), at

    def text(self, at: int, k: int) -> list[bytes]:
        return [self.data[a:b] for a, b in zip(self.begin[at : at + k].tolist(), self.end[at : at + k].tolist(), strict=True)]

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)


def words_of(texts: list[str | None], kind: np.ndarray, lower: bool = True) -> Words:
    """All words; only A-Z are lower-cased. A null has none."""
    data = "\n".join("" if t is None else t for t in texts).encode()
    if lower:
        data = data.lower()
    raw = np.frombuffer(data, np.uint8)
    inside = np.r_[False, kind[raw], False]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edge[::2], edge[1::2]
    power, inverse = _power(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * power[: len(raw)], out=total[1:])
    hashes = mix((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
    if len(texts) > 1:
        size = np.array([0 if t is None else len(t) if t.isascii() else len(t.encode()) for t in texts], np.int64) + 1
        doc = np.searchsorted(np.cumsum(size), begin, side="right")
    else:
        doc = np.zeros(len(begin), np.int64)
    return Words(data, begin, end, doc, hashes, len(texts))
