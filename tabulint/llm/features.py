"""Hashed n-gram features of whole texts, and the bounded samples models learn from."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulint.llm import textkit


def bucket(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % n, F.lit(-1))


def sampled(labelled: DataFrame, label: str, text: str, per_label: int, most_rows: int = 8_000, least: int = 8) -> tuple[list[str], DataFrame]:
    """(labels, rows (label, text)) with `per_label` rows of each label, or all it has;
    fewer, but no fewer than `least`, where labels times rows would pass `most_rows`.

    Every label is there.  Rows are chosen one by one, by a hash of the text and the
    row's place in the scan, so of a text with many copies as many come as of other
    rows, and reruns on the same files choose the same.
    """
    counts = labelled.groupBy(F.col(label).alias("l")).count().orderBy("l").collect()
    if not counts:
        return [], labelled.select(F.col(label).alias("label"), F.col(text).alias("text")).limit(0)
    each = max(least, min(per_label, most_rows // len(counts)))
    # four times as many, so that the exact choice is among few rows
    share = labelled.sparkSession.createDataFrame([(r["l"], min(1.0, (4 * each + 100) / r["count"])) for r in counts], f"l {labelled.schema[label].dataType.simpleString()}, share double")
    rows = labelled.select(F.col(label).alias("label"), F.col(text).alias("text"), F.xxhash64(F.col(text), F.monotonically_increasing_id(), F.lit(11)).alias("h"))
    rows = rows.join(F.broadcast(share), F.col("label") == F.col("l")).filter(F.pmod("h", F.lit(1 << 30)) < F.col("share") * float(1 << 30))
    best = Window.partitionBy("label").orderBy("h", "text")
    return [r["l"] for r in counts], rows.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= each).select("label", "text")


class Grams:
    """Counts of hashed byte n-grams.

    shape: letters become a or A and digits 0 before the n-grams are taken, so
    they show layout and not wording; otherwise the text is lower-cased and what
    is not a letter becomes a space.
    """

    def __init__(self, dims: int, orders: tuple[int, ...], shape: bool):
        self.dims, self.orders, self.shape = dims, orders, shape
        t = np.arange(256, dtype=np.uint8)
        lower, upper, digit = (np.isin(t, np.frombuffer(s, np.uint8)) for s in (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"))
        high = t >= 128
        if shape:
            self.table = t.copy()
            self.table[lower | high], self.table[upper], self.table[digit] = ord("a"), ord("A"), ord("0")
        else:
            self.table = np.where(lower | high, t, 32).astype(np.uint8)

    def codes(self, texts: pa.Array):
        """For each order: (the n-gram code at each byte, first and last byte of
        each text); texts shorter than an order have none."""
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets, data = textkit.buffers(texts if self.shape else pc.utf8_lower(texts))
        b = self.table[data].astype(np.uint32)
        for n in self.orders:
            if len(b) < n:
                h = np.zeros(0, np.uint32)
            else:
                h = np.full(len(b) - n + 1, n, np.uint32)
                for j in range(n):
                    h = h * np.uint32(0x01000193) ^ b[j : len(b) - n + 1 + j]
                h = (h * np.uint32(0x9E3779B1)) >> np.uint32(8)
            first = offsets[:-1]
            yield h % np.uint32(self.dims), first, np.maximum(first, offsets[1:] - n + 1)

    def means(self, texts: pa.Array, weights: np.ndarray) -> np.ndarray:
        """Mean of the weight rows of each text's n-grams, summed over orders."""
        out = np.zeros((len(texts), weights.shape[1]))
        for h, first, last in self.codes(texts):
            some = np.flatnonzero(last > first)
            if len(some):
                picked = weights[h]
                # reduceat sums from one bound to the next: every second sum is of a text
                picked = np.concatenate([picked, np.zeros((1, picked.shape[1]), picked.dtype)])
                sums = np.add.reduceat(picked, np.stack([first[some], last[some]], 1).ravel(), axis=0)[::2]
                out[some] += sums / (last - first)[some][:, None]
        return out

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Dense counts, a row per text."""
        out = np.zeros(len(texts) * self.dims)
        for h, first, last in self.codes(texts):
            size = last - first
            row = np.repeat(np.arange(len(texts)), size)
            at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
            out += np.bincount(row * self.dims + h[at], minlength=len(out))
        return out.reshape(len(texts), self.dims)


class Gaps:
    """Counts of how far back each word stood last, in powers of two (0: never), and of
    two such numbers in a row: repeated words and lines show here, whatever they say."""

    LEVELS = 12
    dims = LEVELS * (LEVELS + 1)

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Dense counts, a row per text."""
        offsets, data = textkit.buffers(texts)
        starts, ends, first = textkit.spans(offsets, data)
        h = textkit.hash_words(data, starts, ends, fold=True)
        text = np.repeat(np.arange(len(texts)), np.diff(first))
        order = np.lexsort((np.arange(len(h)), h, text))
        again = np.append(False, (h[order][1:] == h[order][:-1]) & (text[order][1:] == text[order][:-1])) if len(h) else np.zeros(0, bool)
        gap = np.zeros(len(h), np.int64)
        gap[order[again]] = order[again] - order[np.flatnonzero(again) - 1]
        level = np.where(gap > 0, np.minimum(np.log2(np.maximum(gap, 1)).astype(np.int64) + 1, self.LEVELS - 1), 0)
        one = text * self.dims + level
        follows = np.flatnonzero(text[1:] == text[:-1])
        two = text[follows] * self.dims + self.LEVELS + level[follows] * self.LEVELS + level[follows + 1]
        return np.bincount(np.append(one, two), minlength=len(texts) * self.dims).astype(np.float64).reshape(len(texts), self.dims)


class Words:
    """Counts of hashed words, A-Z lower-cased."""

    def __init__(self, dims: int):
        self.dims = dims

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Dense counts, a row per text."""
        offsets, data = textkit.buffers(texts)
        starts, ends, first = textkit.spans(offsets, data)
        h = textkit.hash_words(data, starts, ends, fold=True) % np.uint64(self.dims)
        text = np.repeat(np.arange(len(texts)), np.diff(first))
        return np.bincount(text * self.dims + h.astype(np.int64), minlength=len(texts) * self.dims).astype(np.float64).reshape(len(texts), self.dims)


class Blocks:
    """Several kinds of counts side by side."""

    def __init__(self, *parts):
        self.parts = parts
        self.bounds = np.cumsum([0, *(p.dims for p in parts)])
        self.dims = int(self.bounds[-1])

    def counts(self, texts: pa.Array) -> np.ndarray:
        return np.hstack([p.counts(texts) for p in self.parts])


def collected(rows: DataFrame, grams) -> tuple[list[str], np.ndarray]:
    """Labels and dense counts of a bounded sample.  The executors make sparse
    counts, so the driver gets at most `dims` numbers per row, whatever the
    length of the texts."""

    def run(parts):
        for p in parts:
            for q in textkit.batches(p, "text", 1 << 20):
                m = grams.counts(q.column(1))
                at = [np.flatnonzero(r) for r in m]
                yield pa.RecordBatch.from_arrays([q.column(0).cast(pa.string()), pa.array([a.astype(np.int32).tobytes() for a in at], pa.binary()), pa.array([r[a].astype(np.float32).tobytes() for r, a in zip(m, at)], pa.binary())], names=["label", "at", "n"])

    got = rows.mapInArrow(run, "label string, at binary, n binary").orderBy(F.xxhash64("at", "n"), "label").toArrow()
    x, i = np.zeros((got.num_rows, grams.dims), np.float32), 0
    for p in got.to_batches():
        for at, n in zip(p.column(1), p.column(2)):
            x[i, np.frombuffer(at.as_buffer(), np.int32)] = np.frombuffer(n.as_buffer(), np.float32)
            i += 1
    return got.column(0).to_pylist(), x
