"""Words, word fingerprints and window fingerprints of many texts at once, as array operations."""

from __future__ import annotations

import functools
import hashlib

import numpy as np

U64 = np.uint64
# Odd multipliers of the polynomial fingerprints, with their inverses modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole 64-bit value (one to one)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@functools.lru_cache(maxsize=1)
def byte_values() -> np.ndarray:
    """A 64-bit value for each byte."""
    return mix(np.arange(1, 257, dtype=U64) * U64(_BASE))


@functools.lru_cache(maxsize=4)
def _powers(size: int, inverse: bool) -> np.ndarray:
    out = np.full(size, U64(_INVERSE if inverse else _BASE))
    out[0] = 1
    return np.cumprod(out, dtype=U64)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    return _powers(1 << max(16, (n + 1).bit_length()), inverse)[: n + 1]


def prefix(values: np.ndarray) -> np.ndarray:
    """Sums S with S[j] - S[i] = sum of values[k] * base**k for i <= k < j."""
    out = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * powers(len(values))[:-1], dtype=U64, out=out[1:])
    return out


def fingerprints(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray | int) -> np.ndarray:
    """Fingerprints of values[start:end]: equal sequences have equal ones wherever they stand."""
    ends = starts + ends if isinstance(ends, int) else ends
    return mix((sums[ends] - sums[starts]) * powers(len(sums) - 1, inverse=True)[starts])


def word_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the bounds of each text in words.  A word is a run of bytes other than white
    space (0x20, 0x09-0x0D), and ends where its text ends."""
    word = np.zeros(len(data) + 1, dtype=bool)
    word[:-1] = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    cut = bounds[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    both = cut[word[cut] & word[cut - 1]]
    first[both] = True
    last[both - 1] = True
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, bounds)


#: Bytes beyond which a word's name is made from its BLAKE2 digest.
LONG_WORD = 256
_ENDS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U64)


def word_prints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit name of each word: its 8-byte pieces are mixed in one after another, so that no algebra of the pieces
    makes words meet; words of one length up to 8 never do.  Another seed gives names that are independent of these."""
    eights = np.ndarray(len(data) + 1, dtype="<u8", buffer=np.append(data, np.zeros(8, dtype=np.uint8)), strides=(1,))
    size = ends - starts
    out = mix(size.astype(U64) + mix(np.array([seed + 1], dtype=U64)))
    open_, at = np.flatnonzero(size <= LONG_WORD), starts
    step = 0
    while len(open_):
        piece = eights[at[open_] + step] & _ENDS[np.minimum(size[open_] - step, 8)]
        out[open_] = mix(out[open_] ^ piece)
        step += 8
        open_ = open_[size[open_] > step]
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        digest = hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little"))
        out[k] = U64(int.from_bytes(digest.digest(), "little"))
    return out


def sequence_prints(names: np.ndarray, begin: np.ndarray, count: int) -> np.ndarray:
    """A 64-bit name of each `count` names from begin on, mixed in one after another."""
    out = np.full(len(begin), U64(count))
    for k in range(count):
        out = mix((out ^ names[begin + k]) * U64(_BASE) + U64(k))
    return out


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def row_of(bounds: np.ndarray) -> np.ndarray:
    """Of each element its text."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
