"""Words of many texts at once: places and 64-bit hashes, by array operations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes of text that array work is done on at a time.
SLAB = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit number over all bits."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n of each."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        np.multiply.accumulate(p, out=p)
        out.append(p)
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, int(n).bit_length())
    return _powers(size)


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """p with p[e] - p[s] the hash of buf[s:e], times the base to the power s."""
    up, _ = powers(len(buf) + 1)
    p = np.empty(len(buf) + 1, np.uint64)
    p[0] = 0
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=p[1:])
    return p


def slices_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hashes of buf[start:end], by the prefix hashes of buf."""
    _, down = powers(len(p))
    return mix((p[end] - p[start]) * down[start])


class Words:
    """Words of a list of texts: byte places in `buf`, hashes, and the text of each."""

    def __init__(self, texts: Sequence[bytes | None], lower: bool = False):
        sizes = np.array([len(t or b"") + 1 for t in texts], np.int64)
        self.base = np.cumsum(sizes) - sizes
        self.data = b"\n".join([t or b"" for t in texts]) + b"\n"
        found = [_words(self.data, lo, hi, lower) for lo, hi in _at_spaces(self.data)]
        self.start, self.end, self.hash = (np.concatenate(x) for x in zip(*found))
        self.doc = np.searchsorted(self.base, self.start, "right") - 1
        self.count = np.bincount(self.doc, minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
        self.first = np.cumsum(self.count) - self.count

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and text of every k consecutive words; of all words where a text has fewer."""
        h, ok = rolling(self.hash, self.doc, k)
        first = np.flatnonzero(ok)
        hashes, docs = h[first], self.doc[first]
        few = np.flatnonzero((self.count > 0) & (self.count < k))
        if len(few):
            own = [self.hash[self.first[d] : self.first[d] + self.count[d]] for d in few]
            short = [mix(np.array([_sequence(h)], np.uint64))[0] for h in own]
            hashes, docs = np.r_[hashes, np.array(short, np.uint64)], np.r_[docs, few]
        return hashes, docs


def _at_spaces(data: bytes) -> Iterator[tuple[int, int]]:
    """Ranges of about a slab that end behind a separator, where the data do."""
    lo = 0
    while lo < len(data):
        hi = lo + SLAB
        if hi >= len(data):
            hi = len(data)
        else:
            tail = np.frombuffer(data, np.uint8, count=len(data) - hi, offset=hi)
            hi += next(at + int(found[0]) + 1 for at in range(0, len(tail), 4096) if len(found := np.flatnonzero(_SPACE[tail[at : at + 4096]])))
        yield lo, hi
        lo = hi
    if not data:
        yield 0, 0


def _words(data: bytes, lo: int, hi: int, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and hashes of the words in data[lo:hi], which ends with a separator."""
    buf = np.frombuffer(data, np.uint8, count=hi - lo, offset=lo)
    if lower:
        buf = _LOWER[buf]
    space = np.r_[True, _SPACE[buf]]
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[0::2], edge[1::2]
    return start + lo, end + lo, slices_hash(prefix_hash(buf), start, end)


def _sequence(h: np.ndarray) -> np.uint64:
    """Hash of fewer words than a shingle has; their number is part of it."""
    up, _ = powers(len(h) + 1)
    return np.uint64((int((h * up[: len(h)]).sum(dtype=np.uint64)) + len(h)) & 0xFFFFFFFFFFFFFFFF)


def rolling(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of h[i:i + k] at each i, and whether all of it lies in one text."""
    out, ok = np.zeros(len(h), np.uint64), np.zeros(len(h), bool)
    n = len(h) - k + 1
    if n > 0:
        up, _ = powers(k + 1)
        acc = np.zeros(n, np.uint64)
        for j in range(k):
            acc += h[j : j + n] * up[j]
        out[:n] = mix(acc)
        ok[:n] = doc[:n] == doc[k - 1 :]
    return out, ok


def slabs(sizes: Sequence[int], limit: int = SLAB) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` bytes together; a longer text is alone."""
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if i > first and total + n > limit:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)
