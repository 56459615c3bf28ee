"""Vectorised hashing of words and word shingles.

A word's hash is a polynomial in its bytes modulo 2**64, read off one running sum over the whole buffer: the sum of
value(byte) * P**position between a word's ends, times P**-start, doesn't depend on where the word stands.  A final
mix spreads it over all bits.  Everything is a pure function of the bytes, so reruns and machines agree.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_P = 0x9E3779B97F4A7C55 | 1
_INVERSE = pow(_P, -1, 1 << 64)

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
IS_SPACE.setflags(write=False)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits: two rounds of shift, xor and multiply."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


_VALUE = mix(np.arange(1, 257, dtype=_U) * _U(0xA24BAED4963EE407))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        with np.errstate(over="ignore"):
            up, down = (np.cumprod(np.full(size, p, dtype=_U)) for p in (_P, _INVERSE))
        _powers[size] = up, down
    return _powers[size]


def words(buffer: bytes, block: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Hash and byte offset of every word of a buffer, in order."""
    raw = np.frombuffer(buffer, dtype=np.uint8)
    hashes, offsets, at = [], [], 0
    while at < len(raw):
        end = min(at + block, len(raw))
        if end < len(raw):  # a block ends at white space, however long the word
            gap = np.flatnonzero(IS_SPACE[raw[at:end]])
            while not len(gap) and end < len(raw):
                end = min(end + block, len(raw))
                gap = np.flatnonzero(IS_SPACE[raw[at:end]])
            if len(gap) and end < len(raw):
                end = at + int(gap[-1]) + 1
        part = raw[at:end]
        space = IS_SPACE[part]
        edge = np.diff(space.view(np.int8), prepend=np.int8(1), append=np.int8(1))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        up, down = _power_tables(len(part) + 1)
        with np.errstate(over="ignore"):
            running = np.zeros(len(part) + 1, dtype=_U)
            np.cumsum(_VALUE[part] * up[: len(part)], out=running[1:])
            hashes.append(mix((running[ends] - running[starts]) * down[starts] + (ends - starts).astype(_U)))
        offsets.append(starts + at)
        at = end
    if not hashes:
        return np.zeros(0, dtype=_U), np.zeros(0, dtype=np.int64)
    return np.concatenate(hashes), np.concatenate(offsets)


def words_by_text(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in order, and where each text's words begin (one more bound than texts)."""
    joined = b"\n".join(texts) + b"\n"
    hashes, offsets = words(joined.lower() if lower else joined)  # bytes.lower() changes A-Z only
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return hashes, np.searchsorted(offsets, begins)


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words has its whole sequence as one."""
    hashes, bounds = words_by_text(texts)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(hashes) - width + 1), dtype=_U)
        for i in range(width):
            rolled = (rolled + hashes[i : i + len(rolled)]) * _U(_P)
        rolled = mix(rolled)
        out = []
        for first, last in zip(bounds[:-1], bounds[1:]):
            n = int(last - first)
            if n >= width:
                out.append(np.unique(rolled[first : last - width + 1]))
            elif n:
                short = _U(n)
                for h in hashes[first:last]:
                    short = (short + h) * _U(_P)
                out.append(mix(np.array([short], dtype=_U)))
            else:
                out.append(np.zeros(0, dtype=_U))
    return out
