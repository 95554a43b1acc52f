"""Words of whole texts as numpy arrays: splitting, hashing and windows without a Python loop over words.

A word is a run of bytes other than 0x20 and 0x09 to 0x0D (``[^\\x20\\x09-\\x0D]+``); those bytes never occur inside a
multi-byte UTF-8 character.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa

WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Bytes from which on a span is hashed by a digest and not by a polynomial.
LONG = 256
#: Odd multipliers of the polynomial hashes of bytes and of words.
_BYTE_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_WORD_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers after which all bits depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd base modulo 2**64 and of its inverse."""
    kept = _powers.get(base)
    if kept is None or len(kept[0]) < n:
        n = max(n, 1 << 16)
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(n, b, dtype=np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        _powers[base] = kept = (made[0], made[1])
        if n > 1 << 23:  # one huge document must not be remembered
            del _powers[base]
    return kept[0][:n], kept[1][:n]


def sums(values: np.ndarray) -> np.ndarray:
    """Sums of all prefixes, the empty one first."""
    out = np.zeros(len(values) + 1, dtype=values.dtype)
    np.cumsum(values, out=out[1:])
    return out


def rolling(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Rabin-Karp hash of ``values[start:end]`` for each pair: a polynomial that does not depend on the place."""
    power, inverse = powers(base, max(len(values), 1))
    prefix = sums(values * power[: len(values)])
    return mix((prefix[end] - prefix[start]) * inverse[start])


class Words(NamedTuple):
    data: np.ndarray  #: bytes of all texts of the batch
    at: np.ndarray  #: first byte of each document, and the end of the last
    start: np.ndarray  #: first byte of each word
    end: np.ndarray  #: byte after each word
    first: np.ndarray  #: first word of each document, and the end of the last

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; null is the empty text."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        if data is None or not len(at):
            return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
        return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]
    return text_bytes(column.cast(pa.string()))


def split_words(column: pa.Array) -> Words:
    data, at = text_bytes(column)
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = at[:-1][at[:-1] < at[1:]]
    begins[edge] = inside[edge]
    start = np.flatnonzero(begins)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = edge[1:] - 1
    ends[last] |= inside[last]
    return Words(data, at, start, np.flatnonzero(ends) + 1, np.searchsorted(start, at))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """A 64-bit hash of ``data[start:end]`` (bytes) for each pair.

    Polynomials modulo 2**64 have texts of a thousand letters and more that collide for every odd base (Thue-Morse words).
    So they serve spans of less than ``LONG`` bytes, and a keyed digest serves the few that are longer.
    """
    out = rolling(data.astype(np.uint64) + np.uint64(1), start, end, base)
    key = base.to_bytes(8, "little")
    for i in np.flatnonzero(end - start >= LONG).tolist():
        digest = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, key=key).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def word_hashes(w: Words, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word; ``which`` chooses one of two independent ones."""
    return span_hashes(w.data, w.start, w.end, _BYTE_BASES[which])


def window_starts(w: Words, size: int) -> np.ndarray:
    """First words of all windows of ``size`` words that lie in one document."""
    left = np.repeat(w.first[1:], w.count) - np.arange(len(w.start))
    return np.flatnonzero(left >= size)


def window_hashes(hashes: np.ndarray, starts: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    return rolling(hashes, starts, starts + size, _WORD_BASES[which])


def per_doc_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the values of each document."""
    return np.diff(sums(values.astype(np.int64))[first])
