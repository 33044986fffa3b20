"""Hashes of words and word shingles of many texts at once, on byte arrays.

Words are the stretches ``[^\\x20\\x09-\\x0D]+`` of a text whose letters A-Z are lower-cased.
A word's 64-bit hash is a polynomial over a random table of its bytes; a shingle's hash mixes
the hashes of its words in order.
"""

from __future__ import annotations

import ctypes
import functools
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of an Arrow batch: a task holds some batches, however long the texts are.
ARROW_BYTES = 4 << 20

#: Bytes hashed at once. A single word may exceed it; then the arrays grow with that word.
SLICE = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_LETTER = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(int(_RANDOM.integers(2**62, 2**63)) | 1)
_PLACE = _RANDOM.integers(2**62, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.full(n, _BASE, dtype=np.uint64))


def _slices(data: bytes) -> Iterator[tuple[int, int]]:
    """Ranges of about ``SLICE`` bytes that end behind white space or at the end."""
    start, n = 0, len(data)
    while start < n:
        end = min(start + SLICE, n)
        while end < n and not _SPACE[data[end - 1]]:
            end += 1
        yield start, end
        start = end


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the first byte's place of each word of ``data``."""
    data = data.lower()  # of bytes: A-Z alone
    hashes, places = [], []
    for begin, end in _slices(data):
        part = np.frombuffer(data, dtype=np.uint8, count=end - begin, offset=begin)
        space = _SPACE[part]
        edge = np.diff(space.astype(np.int8), prepend=1, append=1)
        first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if not len(first):
            continue
        length = last - first
        # bytes of words only, each with its place in its word
        inside = np.flatnonzero(~space)
        offset = np.concatenate(([0], np.cumsum(length)[:-1]))
        place = np.arange(len(inside)) - np.repeat(offset, length)
        most = int(length.max())
        powers = _powers(1 << max(6, most.bit_length()))
        value = _LETTER[part[inside]] * powers[place]
        total = np.add.reduceat(value, offset)
        hashes.append(mixed(total + length.astype(np.uint64) * _PLACE[63]))
        places.append(first + begin)
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(places)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches bounded by their bytes and not by their rows alone, for the session's next jobs."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def give_back() -> None:
    """Return freed memory to the system; the allocators keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None
    if trim:
        trim(0)


def trimmed(work: Callable) -> Callable:
    """``work`` for ``mapInArrow``; what it freed goes back at the task's end, as a worker stays
    alive beside the executor's next stages, which may need no Python at all."""

    def whole(batches):
        yield from work(batches)
        give_back()

    return whole


def trimmed_group(work: Callable) -> Callable:
    """The same for a function of ``applyInArrow``, after each group."""

    def whole(table: pa.Table) -> pa.Table:
        out = work(table)
        give_back()
        return out

    return whole


def portions(texts: pa.Array, size: int) -> Iterator[list[str | None]]:
    """The texts in order, in lists of about ``size`` characters; one text may exceed it."""
    held, length = [], 0
    for text in texts:
        held.append(text.as_py())
        length += len(held[-1] or "")
        if length >= size:
            yield held
            held, length = [], 0
    if held:
        yield held


def texts_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in order and where each text's words begin (and the end)."""
    encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    hashes, places = word_hashes(b"\n".join(encoded))
    starts = np.concatenate(([0], np.cumsum([len(e) + 1 for e in encoded])))
    return hashes, np.searchsorted(places, starts)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct shingle hashes of one text in ascending order; a text with fewer words than
    ``size`` is one shingle, one without words has none."""
    n = len(words)
    if not n:
        return words
    width = min(n, size)
    total = np.full(n - width + 1, width, dtype=np.uint64)
    for k in range(width):
        total = total + mixed(words[k : n - width + 1 + k] + _PLACE[k]) * _PLACE[k]
    return np.unique(mixed(total))
