"""Vectorised word hashing shared by the operators that read whole texts in Python.

Words are maximal runs of ``[^\\x20\\x09-\\x0D]`` with A-Z lower-cased. All separators are ASCII, so
words are found on UTF-8 bytes. Every word gets a 64-bit hash: a polynomial over the ring of
integers modulo 2**64 (taken from prefix sums, so no Python loop runs per word), then mixed. Two different words of
a corpus share a hash with a chance of about 2**-64 for each pair.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SEP = np.zeros(256, bool)
_SEP[[32, *range(9, 14)]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Bytes of text that one vectorised step works on; a longer text is a step of its own.
STEP_BYTES = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        size = max(n, STEP_BYTES + 4096)
        for k, base in enumerate((_P, _PINV)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _POW[k] = np.cumprod(row, dtype=np.uint64)
    return _POW[0], _POW[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts`` in order, and offsets: text i has words off[i]:off[i+1]."""
    buf = _LOW[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    sep = _SEP[buf]
    edge = np.empty(len(sep), bool)
    edge[0] = not sep[0]
    np.not_equal(sep[1:], sep[:-1], out=edge[1:])
    at = np.flatnonzero(edge)
    start, end = at[0::2], at[1::2]
    power, inverse = _powers(len(buf))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: len(buf)], out=total[1:])
    words = mix((total[end] - total[start]) * inverse[start] ^ (end - start).astype(np.uint64))
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    off = np.zeros(len(texts) + 1, np.int64)
    off[1:] = np.searchsorted(start, ends)
    return words, off


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of one text; with fewer words, of the whole sequence."""
    if len(words) == 0:
        return words
    n = min(n, len(words))
    total = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        total = mix(total * _P + words[k : len(words) - n + 1 + k])
    return np.unique(total)


def steps(texts: Iterable[bytes], most: int = STEP_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of consecutive texts of about ``most`` bytes, each with the place of its first text."""
    first, held, size = 0, [], 0
    for k, t in enumerate(texts):
        if held and size + len(t) > most:
            yield first, held
            first, held, size = k, [], 0
        held.append(t)
        size += len(t) + 1
    if held:
        yield first, held


def release() -> None:
    """Give memory that is free in this process back to the system. Workers outlive their tasks and share an executor's limit with its other processes."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; after each, memory that it took is given back."""
    for batch in batches:
        yield batch
        del batch
        release()
