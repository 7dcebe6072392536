"""Vectorised words, hashes and windows over UTF-8 bytes of many texts at once."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

U64 = np.uint64
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
SEPARATOR = b" "

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: ASCII letters, digits and every byte of a non-ASCII character.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True
ALNUM[128:] = True

#: Everything but the space and the characters 9 to 13.
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[[32, 9, 10, 11, 12, 13]] = False

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = np.ones(1, dtype=U64)
_inverses = np.ones(1, dtype=U64)


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64, for n places at least."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 1 << 16)
        step = np.full(size, _BASE, dtype=U64)
        step[0] = 1
        back = np.full(size, _INVERSE, dtype=U64)
        back[0] = 1
        with np.errstate(over="ignore"):
            _powers, _inverses = np.multiply.accumulate(step), np.multiply.accumulate(back)
    return _powers, _inverses


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


def lower(raw: np.ndarray) -> np.ndarray:
    """The bytes in lower case: ASCII, Latin-1 letters and the basic Cyrillic ones; the length stays."""
    out = LOWER[raw]
    lead = np.concatenate([[0], raw[:-1]])
    out[(lead == 0xC3) & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97)] += 0x20
    cyrillic = lead == 0xD0
    out[cyrillic & (raw >= 0x90) & (raw <= 0x9F)] += 0x20
    late = cyrillic & (raw >= 0xA0) & (raw <= 0xAF)
    out[late] -= 0x20
    out[np.flatnonzero(late) - 1] = 0xD1
    return out


def give_back() -> None:
    """Return freed memory to the system: workers live on between tasks, and several share the memory of an executor."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def blocks(texts: list[bytes], limit: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, bytes, starts): runs of texts of about ``limit`` bytes, never part of a text.

    A separator stands before and after each text; ``starts`` has where each text begins, and where one more would.
    """
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= limit or i + 1 == len(texts):
            part = texts[first : i + 1]
            joined = SEPARATOR + SEPARATOR.join(part) + SEPARATOR
            starts = np.zeros(len(part) + 1, dtype=np.int64)
            np.cumsum([len(x) + 1 for x in part], out=starts[1:])
            yield first, i + 1, np.frombuffer(joined, dtype=np.uint8), starts + 1
            first, size = i + 1, 0
    if len(texts) > 1:
        give_back()


def words(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of bytes for which ``inside`` holds; data begins and ends with a separator."""
    mask = inside[data]
    edges = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    return edges[0::2], edges[1::2]


#: Entries of a word from which on it is hashed by itself: some words of 1,024 letters and more have one sum of powers for any odd base.
LONG_WORD = 64


def digested(hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hashes, with those of long words replaced by digests of their entries."""
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        hashes[i] = int.from_bytes(blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return hashes


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words; equal bytes give equal hashes wherever they stand."""
    powers, inverses = _grown(len(data))
    with np.errstate(over="ignore"):
        sums = np.cumsum((data.astype(U64) + U64(1)) * powers[: len(data)], dtype=U64)
        own = (sums[ends - 1] - sums[starts - 1]) * inverses[starts]
        own += (ends - starts).astype(U64)
    return digested(mix(own), data, starts, ends)


def owners(starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each text, how many words come before it, and in all: word i of text t has first[t] <= i < first[t + 1]."""
    return np.searchsorted(starts, bounds)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` consecutive entries, for each start that has as many."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    out = np.zeros(n, dtype=U64)
    with np.errstate(over="ignore"):
        for j in range(size):
            out *= U64(_BASE)
            out += hashes[j : j + n]
    return mix(out)
