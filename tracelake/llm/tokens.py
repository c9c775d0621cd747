"""Words of many texts at once, as 64-bit hashes, in numpy.

Words are the longest runs of bytes other than space and 0x09-0x0D; A-Z are lower-cased. A word's hash is a polynomial
over a fixed table of byte values, modulo 2^64, mixed with the word's length: prefix sums give the hashes of all words
of a block in a few passes over its bytes. Blocks are cut at white space, so memory is bounded by BLOCK bytes or the
longest single word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on each other (the finalizer of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))
_VALUES[ord("A") : ord("Z") + 1] = _VALUES[ord("a") : ord("z") + 1]
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(n: int, way: str, base: int) -> np.ndarray:
    """base to 0..n-1, kept for the next block."""
    if len(_powers[way]) < n:
        steps = np.full(max(n, BLOCK + 64), base, np.uint64)
        steps[0] = 1
        _powers[way] = np.multiply.accumulate(steps)
    return _powers[way][:n]


def hash_spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hashes of spans of bytes, from a value for each byte."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(len(values), "up", _BASE), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _power(len(values), "down", _INVERSE)[starts]
    return mix(hashes + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words in these bytes start and end."""
    inner = ~_SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inner, [False])).astype(np.int8)))
    return edges[::2], edges[1::2]


def hash_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words in these bytes, and where they start."""
    starts, ends = word_spans(data)
    return (hash_spans(_VALUES[data], starts, ends) if len(starts) else np.zeros(0, np.uint64)), starts


def cuts(texts: pa.Array, size: int | None = None) -> Iterator[tuple[np.ndarray, int, np.ndarray, int]]:
    """(bytes with a separator between texts, first text, where each text ends, bytes of the texts) of successive blocks.

    A block has `size` bytes (BLOCK without it). The text of a place in it is first + searchsorted(ends, place, "right"). No word is cut; a text longer than a
    block goes on in the next one."""
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at, end = int(offsets[0]), int(offsets[-1])
    # An end of text is an end of word, so a separator is put between texts where blocks are made.
    first = 0
    while at < end:
        stop = min(end, at + (size or BLOCK))
        while first + 1 < len(texts) and offsets[first + 1] <= at:
            first += 1
        last = int(np.searchsorted(offsets, stop, "left"))  # texts first..last-1 have bytes in at..stop
        if stop < end and offsets[last] != stop:
            # Cut within the last text: at white space, or at its start, or beyond the word if it is longer than a block.
            begin = max(at, int(offsets[last - 1]))
            spaces = np.flatnonzero(_SPACE[data[begin:stop]])
            if len(spaces):
                stop = begin + int(spaces[-1]) + 1
            elif begin > at:
                stop = begin
            else:
                limit = int(offsets[last])
                while stop < limit and not _SPACE[data[stop]]:
                    stop += 1
            last = int(np.searchsorted(offsets, stop, "left"))
        inner = offsets[first + 1 : last]  # ends of texts strictly inside the block
        inner = inner[(inner > at) & (inner < stop)] - at
        cut = np.insert(data[at:stop], inner, 0x20)
        bounds = offsets[first + 1 : last + 1] - at + np.searchsorted(inner, offsets[first + 1 : last + 1] - at, "left")
        yield cut, first, bounds, stop - at
        at = stop


def blocks(texts: pa.Array, size: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(word hashes, index of each word's text, bytes) of successive blocks; null texts have no words."""
    for cut, first, bounds, n in cuts(texts, size):
        hashes, starts = hash_words(cut)
        yield hashes, first + np.searchsorted(bounds, starts, "right"), n


def per_text(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, stop, hashes, words of each text) of successive runs of whole texts of about a block each."""
    if not len(texts):
        return
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    first = 0
    while first < len(texts):
        stop = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK, "right")) - 1)
        found = [(h, i) for h, i, _ in blocks(texts.slice(first, stop - first))]
        hashes = np.concatenate([h for h, _ in found]) if found else np.zeros(0, np.uint64)
        index = np.concatenate([i for _, i in found]) if found else np.zeros(0, np.int64)
        yield first, stop, hashes, np.bincount(index, minlength=stop - first).astype(np.int64)
        first = stop
