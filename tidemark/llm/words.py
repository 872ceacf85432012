"""Words and shingles of whole Arrow text batches, found and hashed with numpy.

A batch's UTF-8 bytes are scanned once; nothing loops over words in Python. Hashes have 64 bits
and depend on a word's bytes only, so they agree between batches, tasks and runs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
AS_IS = np.arange(256, dtype=np.uint8)

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BLOCK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(256, dtype=np.uint64) + np.uint64(1))


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that texts of one piece have about `most` bytes; a longer text stays whole."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = np.nan_to_num(np.asarray(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), float))
        piece = (np.cumsum(sizes) // most).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(i, j - i)


class Words(NamedTuple):
    """Words of a batch: byte range, text number, hash; `first[i]:first[i + 1]` are those of text i."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a batch's texts, one after another, and their borders; a null has none."""
    texts = texts.cast(pa.large_string()).fill_null("")
    borders = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[borders[0] : borders[-1]], borders - borders[0]


_POWERS: dict[int, np.ndarray] = {}


def _powers(n: int, base: np.uint64) -> np.ndarray:
    known = _POWERS.get(int(base))
    if known is None or len(known) < n:
        known = np.full(max(n, 2 * _BLOCK), base, np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if n <= 4 * _BLOCK:
            _POWERS[int(base)] = known
    return known[:n]


def _block_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    running = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * _powers(len(data), _BASE), out=running[1:])
    back = _powers(len(data) + 1, _INVERSE)
    return mix(mix((running[end] - running[start]) * back[start]) + (end - start).astype(np.uint64))


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte range (ascending, apart): a polynomial over its bytes, mixed with its length.

    Works in blocks, so memory stays near that of the bytes themselves.
    """
    out = np.zeros(len(start), np.uint64)
    cuts = np.unique(np.searchsorted(start, np.arange(0, len(data) + _BLOCK, _BLOCK)))
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        low, high = start[i], end[j - 1]
        out[i:j] = _block_hashes(data[low:high], start[i:j] - low, end[i:j] - low)
    return out


def find_words(texts: pa.Array, gap: np.ndarray = BLANK, fold: np.ndarray = LOWER, hashes: bool = True) -> Words:
    """Maximal runs of bytes outside `gap` after `fold`; no word crosses from one text to the next.

    A null or blank text has no words.
    """
    data, borders = text_bytes(texts)
    data = fold[data] if fold is not AS_IS else data
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~gap[data]
    starts = inside[1:] & ~inside[:-1]
    ends = ~inside[1:] & inside[:-1]
    inner = borders[1:-1]
    joined = inner[inside[inner] & inside[inner + 1] & (inner > 0) & (inner < len(data))]
    starts[joined] = True
    ends[joined] = True
    start, end = np.flatnonzero(starts), np.flatnonzero(ends)
    first = np.searchsorted(start, borders)
    return Words(data, start, end, first, range_hashes(data, start, end) if hashes else np.zeros(0, np.uint64))


def chain(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every `width` neighbours, order included; the i-th result begins at the i-th value."""
    n = max(0, len(hashes) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = mix(out * _BASE + hashes[k : k + n])
    return out


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes of `width`-word shingles, sorted; of fewer words, the whole sequence as one."""
    if len(hashes) == 0:
        return np.zeros(0, np.uint64)
    return np.unique(chain(hashes, min(width, len(hashes))) + np.uint64(min(width, len(hashes))))
