"""Words and their hashes straight from Arrow's UTF-8 buffers, for many documents at once.

A word is a longest run of bytes other than ASCII white space (0x20, 0x09-0x0D), which is the
same as ``[^\\x20\\x09-\\x0D]+`` on code points, as no byte of a longer UTF-8 sequence is one of these.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
LENGTH_SALT = U64(0xD1342543DE82EF95)
BLOCK_BYTES = 1 << 18

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Block:
    """Rows first..last-1 of an array: their bytes, and where each row's bytes begin (one more at the end)."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


def blocks(texts: pa.Array, most: int = BLOCK_BYTES) -> Iterator[Block]:
    """Runs of whole rows of about ``most`` bytes; a longer row is a block of its own. Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, ends, data = texts.buffers()
    n = len(texts)
    if n == 0:
        return
    at = np.frombuffer(ends, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield Block(i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j


_powers = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            out = np.empty(size, U64)
            out[0], have = 1, 1
            while have < size:
                out[have : 2 * have] = out[:have] * U64(pow(base, have, 1 << 64))
                have *= 2
            _powers[k] = out
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(29))
    x = x * U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> U64(32))


def word_spans(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word, and for each row the number of words before it (one more at the end)."""
    full = ~SPACE[block.data]
    n = len(full)
    first = full.copy()
    last = full.copy()
    if n:
        first[1:] &= ~full[:-1]
        last[:-1] &= ~full[1:]
        edges = block.offsets[1:-1]
        edges = edges[(edges > 0) & (edges < n)]
        first[edges] = full[edges]
        last[edges - 1] = full[edges - 1]
    begin = np.flatnonzero(first)
    return begin, np.flatnonzero(last) + 1, np.searchsorted(begin, block.offsets)


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's bytes; it depends on nothing but these."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(U64) * LENGTH_SALT)


def lowered(block: Block) -> np.ndarray:
    return LOWER[block.data]


def word_hashes(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word with A-Z lowered, and the rows' word offsets."""
    begin, end, rows = word_spans(block)
    return span_hashes(lowered(block), begin, end), rows


def shingle_sets(block: Block, width: int = 5) -> Iterator[np.ndarray]:
    """Per row the sorted distinct hashes of its ``width``-word shingles.

    A row of fewer words has its whole sequence as one shingle; a row without words has none.
    """
    words, rows = word_hashes(block)
    weights = [U64(pow(int(LENGTH_SALT), k + 1, 1 << 64)) for k in range(width)]
    n = max(0, len(words) - width + 1)
    sums = np.zeros(n, U64)
    for k in range(width):
        sums += words[k : n + k] * weights[k]
    sums = mix(sums)
    for a, b in zip(rows[:-1], rows[1:], strict=True):
        if b - a >= width:
            yield np.unique(sums[a : b - width + 1])
        elif b > a:
            short = (words[a:b] * np.array(weights[: b - a], U64)).sum(dtype=U64) + U64(b - a)
            yield mix(np.array([short], U64))
        else:
            yield np.zeros(0, U64)
