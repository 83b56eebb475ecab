"""Hashes of words and of word shingles, for whole texts at once with NumPy.

Words are hashed eight bytes at a time, each step mixing what came before, so that no family of long words collides
by its structure; words of over 64 bytes by BLAKE2. A shingle's hash mixes the hashes of its words by place. Sets of
shingles are sorted arrays of such hashes. ``ranges_hash`` is a polynomial modulo 2**64 from prefix sums, for
overlapping ranges of fewer than 1024 bytes: from there on such polynomials collide by structure, whatever the base.
"""

from __future__ import annotations

import hashlib

import numpy as np

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RANDOM = np.random.default_rng(77)
_VALUES = _RANDOM.integers(0, 1 << 64, 256, np.uint64)
_PLACES = _RANDOM.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 3  # odd, and 1 less has one factor of two
_INVERSE = pow(_BASE, -1, 1 << 64)


#: Words of more bytes are hashed one by one.
LONG = 64
#: By a number of bytes left, those bytes of eight.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW, _INV = _powers(_BASE, 1 << 16), _powers(_INVERSE, 1 << 16)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if n > len(_POW):
        size = 1 << (n - 1).bit_length()
        _POW, _INV = _powers(_BASE, size), _powers(_INVERSE, size)
    return _POW, _INV


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ranges_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges of fewer than 1024 bytes; equal bytes hash alike wherever they stand."""
    power, inverse = _tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: str | None) -> np.ndarray:
    r"""Hashes of the words ``[^\x20\x09-\x0D]+``, A-Z lower-cased, in order."""
    data = np.frombuffer((text or "").encode().translate(_LOWER), np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[data], [True]])))
    start, size = edge[::2], edge[1::2] - edge[::2]
    out = mix(size.astype(np.uint64) + _VALUES[0])
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    # The eight bytes from each place on, as numbers that overlap.
    eights = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    for at in range(0, min(int(size.max(initial=0)), LONG), 8):
        some = some[size[some] > at] if at else np.flatnonzero(size <= LONG)
        piece = eights[start[some] + at] & _MASKS[np.minimum(size[some] - at, 8)]
        out[some] = mix((out[some] ^ piece) + _VALUES[1 + at // 8])
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : start[i] + size[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of k words; of fewer words, of the whole sequence; of none, empty."""
    w = word_hashes(text)
    if not len(w):
        return w
    if len(w) < k:
        return mix((w * _PLACES[: len(w)]).sum(keepdims=True) + np.uint64(len(w)))
    n = len(w) - k + 1
    total = np.full(n, np.uint64(k))
    for i in range(k):
        total += w[i : i + n] * _PLACES[i]
    out = mix(total)
    out.sort()
    first = np.ones(n, bool)
    np.not_equal(out[1:], out[:-1], out=first[1:])
    return out[first]
