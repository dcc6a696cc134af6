"""Vectorised word splitting and hashing over Arrow text columns.

Words are maximal runs of characters other than space and the control
characters 9 to 13, which are all single bytes in UTF-8, so the work is done on
the byte buffers of whole Arrow batches with numpy, without a Python object per
word.  A word's hash is a polynomial over a table of random 64-bit byte values,
modulo 2^64, passed through a mixer; equal words have equal hashes on every
executor.  Two different words share a hash with a chance of about 2^-64.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time; bounds the temporary arrays to some tens of MB.
BLOCK = 1 << 20
_ODD = 0x9E3779B97F4A7C15 | 1
_ODD_INV = pow(_ODD, -1, 1 << 64)
WORD = r"[^\x20\x09-\x0D]+"


def mix64(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser that spreads every input bit over the result."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def seeds(n: int, salt: int = 0) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_ODD) + np.uint64(salt * 7919 + 1))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n + 1, _ODD, np.uint64), np.full(n + 1, _ODD_INV, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


@lru_cache(maxsize=2)
def _byte_values(fold: bool) -> np.ndarray:
    t = seeds(256, salt=17)
    if fold:
        t[65:91] = t[97:123]
    return t


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of n + 1 texts, their UTF-8 bytes); a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0] : offsets[-1]]


def spans(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the index of its first word for
    each of the n + 1 text bounds."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _hash_long(data: np.ndarray, table: np.ndarray) -> np.uint64:
    up, _ = _powers(BLOCK)
    h, scale = np.uint64(0), np.uint64(1)
    for i in range(0, len(data), BLOCK):
        part = data[i : i + BLOCK]
        h = h + scale * np.sum(table[part] * up[: len(part)], dtype=np.uint64)
        scale = scale * up[BLOCK]
    return h


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """64-bit hashes of the words; fold: A-Z count as a-z."""
    table, (up, down) = _byte_values(fold), _powers(BLOCK)
    out = np.empty(len(starts), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            j = int(np.searchsorted(ends, starts[i] + BLOCK, side="right"))
            if j <= i:
                out[i] = _hash_long(data[starts[i] : ends[i]], table)
                i += 1
                continue
            base, top = starts[i], ends[j - 1]
            part = data[base:top]
            c = np.empty(len(part) + 1, np.uint64)
            c[0] = 0
            np.cumsum(table[part] * up[: len(part)], out=c[1:])
            s = starts[i:j] - base
            out[i:j] = (c[ends[i:j] - base] - c[s]) * down[s]
            i = j
        return mix64(out + (ends - starts).astype(np.uint64) * np.uint64(_ODD))


def windows(hashes: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of every run of k hashes (len - k + 1 of them)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.full(n, salt, np.uint64)
        for j in range(k):
            h = h * np.uint64(_ODD) + hashes[j : j + n]
        return mix64(h)


def signed(h: np.ndarray) -> np.ndarray:
    """The same bits as int64, as Spark's bigint has them."""
    return h.view(np.int64)


def batches(rows: pa.RecordBatch, text: str, most: int = 4 << 20):
    """Slices of a batch with at most about `most` bytes of text each, so that
    working memory does not follow the batch size; a longer text is a slice."""
    col = rows.column(rows.schema.get_field_index(text)).cast(pa.large_string())
    if not len(col):
        return
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield rows.slice(i, j - i)
        i = j
