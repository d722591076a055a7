"""Words of Arrow text columns as numpy arrays: byte spans and 64-bit hashes.

Both word classes of this package are defined by ASCII bytes, so they can be cut on the UTF-8 bytes of a
whole Arrow column without decoding it. Hashes are polynomial over a random byte table, taken from prefix
sums modulo 2^64 and finished with a mixing step.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)

_ALL = np.arange(256)
#: words [^\x20\x09-\x0D]+
SPACED = ~((_ALL == 0x20) | ((_ALL >= 0x09) & (_ALL <= 0x0D)))
#: words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z became a-z
ALNUM = ((_ALL >= 0x30) & (_ALL <= 0x39)) | ((_ALL >= 0x41) & (_ALL <= 0x5A)) | (
    (_ALL >= 0x61) & (_ALL <= 0x7A)) | (_ALL >= 0x80)
_LOWER = np.where((_ALL >= 0x41) & (_ALL <= 0x5A), _ALL + 32, _ALL).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixing (the splitmix64 finisher)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_TABLE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
_TABLE_LOWER = _TABLE[_LOWER]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_pow = [_powers(_BASE, 1), _powers(_BASE_INV, 1)]


class Block(NamedTuple):
    """Documents [lo, hi) of a column: their bytes, the words' spans and hashes, and bounds[i]:bounds[i+1],
    the words of document lo + i. Spans are positions in ``data``; document i begins at ``offsets[i]``."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset:column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def word_blocks(column: pa.Array, word: np.ndarray, lower: bool,
                block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The words of a text column, in blocks of whole documents of about ``block_bytes``.

    ``word`` says which bytes belong to words; with ``lower`` the hashes see A-Z as a-z.
    """
    raw, offsets = utf8(column)
    n = len(offsets) - 1
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + block_bytes, side="right")) - 1)
        yield cut(raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], lo, hi, word, lower)
        lo = hi


def cut(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, word: np.ndarray, lower: bool) -> Block:
    """The maximal runs of word bytes in each document; document i is data[offsets[i]:offsets[i + 1]]."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Block(lo, hi, data, offsets, none, none, np.zeros(0, U64), np.zeros(hi - lo + 1, np.int64))
    inside = word[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    if len(_pow[0]) < n + 1:
        _pow[:] = [_powers(_BASE, n + n // 4 + 1), _powers(_BASE_INV, n + n // 4 + 1)]
    sums = np.zeros(n + 1, U64)
    np.cumsum((_TABLE_LOWER if lower else _TABLE)[data] * _pow[0][:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _pow[1][starts] + (ends - starts).astype(U64))
    return Block(lo, hi, data, offsets, starts, ends, hashes, np.searchsorted(starts, offsets))


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word shingles of one text, with repeats; fewer words: the whole sequence as one."""
    if len(hashes) == 0:
        return hashes
    n = min(n, len(hashes))
    out = np.full(len(hashes) - n + 1, n, dtype=U64)
    for k in range(n):
        out = (out ^ hashes[k:len(hashes) - n + 1 + k]) * U64(0x9FB21C651E98DF25)
        out ^= out >> U64(29)
    return mix(out)
