"""Vectorised text primitives over Arrow string buffers.

A batch of texts is one contiguous UTF-8 buffer with offsets.  The helpers work on
that buffer as a whole, so no Python code runs per word or per byte.

Hashes are polynomial prefix hashes modulo 2**64: ``S[i]`` sums ``T[byte] * B**i``, so
the hash of any byte range is one subtraction and one multiplication by the inverse
power.  ``T`` and ``B`` come from a seed by rule.  Wherever a collision could change a
result, the callers compare bytes or a 96- or 128-bit digest as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once by the vectorised code (a longer text is one block of its own).
BLOCK = 1 << 19

#: Positions that one anchor search covers; their number must fit the low bits of a key.
POS_BITS = 20

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every input bit over the output."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=8)
def byte_table(seed: int) -> np.ndarray:
    """256 odd words drawn by rule from the seed."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


def _base(seed: int) -> int:
    return int(byte_table(seed)[seed % 256]) & ~7 | 5


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**0..B**n and their inverses modulo 2**64, grown on demand by doubling."""
    up, down = _powers.get(seed, (np.ones(1, _U), np.ones(1, _U)))
    base = _base(seed)
    inverse = pow(base, -1, 1 << 64)
    while len(up) <= n:
        k = len(up)
        step, back = pow(base, k, 1 << 64), pow(inverse, k, 1 << 64)
        up = np.concatenate([up, up * _U(step)])
        down = np.concatenate([down, down * _U(back)])
        _powers[seed] = up, down
    return up, down


class PrefixHash:
    """Hashes of any range of one buffer of bytes, or of 64-bit hashes, in constant time each."""

    def __init__(self, data: np.ndarray, seed: int = 1) -> None:
        up, self.down = powers(seed, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, _U)
        np.cumsum((data if data.dtype == _U else byte_table(seed)[data]) * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Raw hashes of data[start:end]; equal ranges have equal hashes."""
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def every(self, size: int) -> np.ndarray:
        """Raw hashes of all windows of one size."""
        n = len(self.sums) - size
        return (self.sums[size:] - self.sums[:n]) * self.down[:n]


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and n+1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def blocks(off: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of at most ``limit`` bytes together, or one longer text."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words for shingles: everything but space and 0x09-0x0D.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False

#: Bytes of words for classifiers: letters and digits of ASCII and all bytes beyond it.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True
ALNUM[128:] = True


def words(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every maximal run of ``inside`` bytes, and how many each text has."""
    n = len(data)
    mask = np.zeros(n + 1, bool)
    mask[:n] = inside[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.zeros(n + 1, bool)
    before[1:] = mask[:-1]
    starts = np.flatnonzero(mask & (~before | edge))
    ends = np.flatnonzero(before & (~mask | edge))
    return starts, ends, np.diff(np.searchsorted(starts, off))


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the word shingles of every text, concatenated, and n+1 offsets.

    A text with fewer words than ``size`` has one shingle, the whole sequence; one
    without words has none.
    """
    data = LOWER[data]
    starts, ends, count = words(data, off, NOT_SPACE)
    h = mix(PrefixHash(data).of(starts, ends) + (ends - starts).astype(_U))
    first = np.concatenate([[0], np.cumsum(count)])
    many = np.where(count >= size, count - size + 1, (count > 0).astype(count.dtype))
    out_off = np.concatenate([[0], np.cumsum(many)])
    at = np.repeat(first[:-1] - out_off[:-1], many) + np.arange(out_off[-1])
    left = np.repeat(count, many) - (at - np.repeat(first[:-1], many))
    out = np.zeros(len(at), _U)
    padded = np.concatenate([h, np.zeros(size, _U)])
    for k in range(size):
        out = mix(out + np.where(left > k, padded[at + k], _U(k + 1)) * _U(0x9E3779B97F4A7C15) + _U(k))
    for i in np.flatnonzero(many > 1):
        out[out_off[i] : out_off[i + 1]].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[out_off[:-1][many > 0]] = True
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[out_off]


def anchors(data: np.ndarray, off: np.ndarray, size: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor, anchor hash) for all anchors of concatenated texts."""
    w = size - k + 1
    low = _U((1 << POS_BITS) - 1)
    out: list[tuple] = []
    step = (1 << POS_BITS) - size
    for at in range(0, max(len(data) - size + 1, 0), step):
        sub = data[at : at + step + size - 1]
        h = mix(PrefixHash(sub).every(k))
        key = (h & ~low) | np.arange(len(h), dtype=_U)
        n = len(sub) - size + 1
        pad = np.full(-(-len(key) // w) * w, ~_U(0))
        pad[: len(key)] = key
        grid = pad.reshape(-1, w)
        ahead = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(ahead[:n], np.minimum.accumulate(grid, axis=1).ravel()[w - 1 : w - 1 + n])
        # windows inside one text: those after a text's last full window are none
        whole = np.zeros(n + 1, np.int64)
        begin = np.clip(off[:-1] - at, 0, n)
        end = np.clip(np.maximum(off[1:] - size + 1, off[:-1]) - at, 0, n)
        np.add.at(whole, begin, 1)
        np.add.at(whole, end, -1)
        p = np.flatnonzero(np.cumsum(whole[:-1]) > 0)
        if not len(p):
            continue
        a = (least[p] & low).astype(np.int64)
        new = np.ones(len(p), bool)
        new[1:] = (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(p)]]) - 1
        out.append((p[first] + at, p[last] + at, a[first] + at, h[a[first]]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U)
    return tuple(np.concatenate(x) for x in zip(*out))
