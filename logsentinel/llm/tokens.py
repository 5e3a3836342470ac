"""Vectorised tokens of Arrow text batches: word bounds, rolling 64-bit hashes, windowed minima.

Everything here works on numpy arrays of one slice of an Arrow batch at a time, so a Python worker holds a
few arrays of ``SLICE_BYTES`` whatever the size of the batch; a document longer than that is one slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 1 << 20
U64 = np.uint64

#: Bytes 0x20 and 0x09-0x0D part words; every other byte of the UTF-8 text is part of one.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: Range hashes are polynomials modulo a prime: modulo a power of two, texts of two letters or words with equal hashes are
#: easily written down (Thue-Morse sequences of 1,024 of them), whatever the base.
_P = (1 << 61) - 1
_BASE = 0x1B873593CC9E2D51 % _P
_BASE_INV = pow(_BASE, -1, _P)
_PRIME, _LOW31, _LOW30, _LOW29 = U64(_P), U64((1 << 31) - 1), U64((1 << 30) - 1), U64((1 << 29) - 1)
#: Values that are multiplied at once: what a core's cache holds.
_AT_ONCE = 1 << 15


def _below(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, in place."""
    over = x >> U64(61)
    x &= _PRIME
    x += over
    np.subtract(x, _PRIME, out=x, where=x >= _PRIME)
    return x


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime of values below it."""
    out = np.empty(len(a), U64)
    for i in range(0, len(a), _AT_ONCE):
        x, y = a[i : i + _AT_ONCE], b[i : i + _AT_ONCE]
        x1, x0, y1, y0 = x >> U64(31), x & _LOW31, y >> U64(31), y & _LOW31
        mid = x1 * y0
        mid += x0 * y1
        x1 *= y1
        x1 <<= U64(1)  # 2 ** 62 is 2
        x0 *= y0
        x1 += _below(x0)
        x1 += mid >> U64(30)
        mid &= _LOW30
        mid <<= U64(31)
        x1 += mid
        out[i : i + _AT_ONCE] = _below(x1)
    return out


def _sums(v: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, ... values modulo the prime; halves are summed apart, so nothing overflows."""
    out = np.zeros(len(v) + 1, U64)
    high = np.cumsum(v >> U64(32), dtype=U64)
    low = np.cumsum(v & U64(0xFFFFFFFF), dtype=U64)
    np.add(_below(((high & _LOW29) << U64(32)) + (high >> U64(29))), low, out=out[1:])
    _below(out)
    return out


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), U64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = _times(out[:more], np.full(more, pow(base, have, _P), U64))
        have += more
    return out


_POW = {"n": 0, "p": np.zeros(0, U64), "q": np.zeros(0, U64)}


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept for the next call."""
    if _POW["n"] < n:
        m = max(n, 2 * SLICE_BYTES // 8)
        _POW.update(n=m, p=_powers(_BASE, m), q=_powers(_BASE_INV, m))
    return _POW["p"][:n], _POW["q"][:n]


class Rolling:
    """Hashes of any range of a token array in O(1) each; equal ranges hash alike wherever they stand."""

    def __init__(self, tokens: np.ndarray):
        n = len(tokens)
        p, self._q = _pow(n + 1)
        self._c = _sums(_times(_below(tokens.astype(U64, copy=True)), p[:n]))

    def _between(self, a: np.ndarray, b: np.ndarray, q: np.ndarray) -> np.ndarray:
        return _times(_below(b + (_PRIME - a)), q)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = self._between(self._c[start], self._c[end], self._q[start])
        return mix(h + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k tokens from each position at which k tokens remain."""
        n = len(self._c) - 1
        if n < k:
            return np.zeros(0, U64)
        return mix(self._between(self._c[: n - k + 1], self._c[k:], self._q[: n - k + 1]))


class RollingBytes(Rolling):
    """The same over bytes: their products with powers stay small, so that they are summed as they are; sums are below
    2 ** 62, not reduced."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        p, self._q = _pow(n + 1)
        self._data = data
        self._c = np.zeros(n + 1, U64)
        high, low = U64(0), U64(0)
        for i in range(0, n, _AT_ONCE):
            part = p[i : min(n, i + _AT_ONCE)]
            t = data[i : i + _AT_ONCE].astype(U64)
            t += U64(1)
            h, lo = part >> U64(31), part & _LOW31
            h *= t
            lo *= t
            h[0] += high
            lo[0] += low
            np.cumsum(h, out=h)
            np.cumsum(lo, out=lo)
            high, low = h[-1] % _PRIME, lo[-1] % _PRIME
            lo += h >> U64(30)
            h &= _LOW30
            h <<= U64(31)  # below 2 ** 61; each other part is below 2 ** 60
            lo += h
            self._c[i + 1 : i + 1 + len(t)] = lo

    def _between(self, a: np.ndarray, b: np.ndarray, q: np.ndarray) -> np.ndarray:
        return _times(_below(b + (U64(3 * _P) - a)), q)

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k bytes from each position at which k bytes remain, eight at a time."""
        n = len(self._data) - k + 1
        if n < 1:
            return np.zeros(0, U64)
        eight = _eights(self._data)
        out = np.empty(n, U64)
        for i in range(0, n, _AT_ONCE):
            to = min(n, i + _AT_ONCE)
            h = np.full(to - i, k, U64)
            for at in range(0, k, 8):
                part = eight[i + at : to + at] if k - at >= 8 else eight[i + at : to + at] & (~U64(0) >> U64(64 - 8 * (k - at)))
                h = mix(h ^ part)
                h *= U64(0x9FB21C651E98DF25)
            h ^= h >> U64(32)
            out[i:to] = h
        return out


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place, as numbers; zeros follow the last."""
    return np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """min(a[i:i+w]) for every i with w values left, by doubling spans."""
    if len(a) < w:
        return a[:0]
    cur, span = a, 1
    while 2 * span <= w:
        cur = np.minimum(cur[:-span], cur[span:])
        span *= 2
    if span < w:
        cur = np.minimum(cur[: len(a) - w + 1], cur[w - span : w - span + len(a) - w + 1])
    return cur


def slices(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) for runs of rows of at most SLICE_BYTES; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.type != pa.large_string():
        col = col.cast(pa.large_string())
    if col.null_count:
        col = pc.fill_null(col, "")
    n = len(col)
    if not n:
        return
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + SLICE_BYTES, side="right")) - 1)
        yield at, to, data[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def word_bounds(data: np.ndarray, off: np.ndarray, parts: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words, and for each row the index of its first word (one more at the end).
    parts: which bytes part words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    solid = ~parts[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    cut = off[(off > 0) & (off < len(data))]
    first[cut] = solid[cut]
    last[cut - 1] = solid[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, off)


#: Words of more bytes are hashed one by one.
_LONG_WORD = 64


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: eight at a time are mixed into it."""
    if not len(start):
        return np.zeros(0, U64)
    eight = _eights(data)
    size = end - start
    out = mix(size.astype(U64) * U64(0xD6E8FEB86659FD93))
    long = size > _LONG_WORD
    left = np.flatnonzero(~long)
    at = 0
    while len(left):
        rest = np.minimum(size[left] - at, 8)
        part = eight[start[left] + at] & (~U64(0) >> (U64(64) - U64(8) * rest.astype(U64)))
        out[left] = mix((out[left] ^ part) * U64(0x9FB21C651E98DF25) + U64(0x2545F4914F6CDD1D))
        at += 8
        left = left[size[left] > at]
    for i in np.flatnonzero(long):
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes())
    return out


def signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))
