"""Distinct words in sorted buckets, and how many words share each prefix of theirs.

Words are closed (lower-cased, ended by a space, so none starts another), written in
some code that keeps it so, and sorted, in buckets of a range each.  There the words that share a prefix stand
together, so the counts of all prefixes are sums over runs; a prefix that reaches
over a bucket's edge gets the rest from its neighbours' first and last words.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulint.llm import textkit
from tabulint.plans.durable import saved

#: About the bytes of a bucket's words.
BUCKET = 1 << 18
#: Closes a text; a word of its own.
END = b"\n"
_ZEROS = np.array([8 - v.bit_length() for v in range(256)])


def shared_bits(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Leading bits that each word has in common with the word before; -1 for the
    first.  No word may start another, as closed words do not."""
    size = np.diff(offsets)
    out = np.full(len(size), -1, np.int64)
    at, d = np.arange(1, len(size)), 0
    while len(at):
        at = at[np.minimum(size[at], size[at - 1]) > d]
        x = data[offsets[at] + d] ^ data[offsets[at - 1] + d]
        out[at] = 8 * d + _ZEROS[x]
        at, d = at[x == 0], d + 1
    return out


def in_common(a: bytes, b: bytes) -> int:
    """Leading bits in common of two words."""
    n = min(len(a), len(b))
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    other = np.flatnonzero(x != y)
    return int(8 * other[0] + _ZEROS[x[other[0]] ^ y[other[0]]]) if len(other) else 8 * n


def paths(offsets: np.ndarray, data: np.ndarray, n: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None, bits: int = 8) -> np.ndarray:
    """For each of the sorted words and each b from 0 to its bits, the sum of n over
    the words with the same b leading bits; word i's start at 8 offsets[i] + i.
    `before` and `after`: what the words of other buckets add along the first and
    the last word.  bits: how many bits of each byte, from the top, may be set."""
    size = 8 * np.diff(offsets) + 1
    start = 8 * offsets[:-1] + np.arange(len(size))
    out = np.repeat(n.astype(np.float64), size)
    if not len(size):
        return out
    same = shared_bits(offsets, data)
    most = np.maximum(same, np.append(same[1:], -1))
    most[0] = max(most[0], 0)
    at, b = np.flatnonzero(most >= 0), 0
    while len(at):
        if b % 8 > bits or b and b % 8 == 0 and bits < 8:  # as before: these bits are 0 in all words
            out[start[at] + b] = out[start[at] + b - 1]
        else:
            run = np.cumsum(same[at] < b) - 1
            out[start[at] + b] = np.bincount(run, n[at])[run]
        b += 1
        at = at[most[at] >= b]
    for more, order in ((before, 1), (after, -1)):
        if more is not None and len(more):
            # along the first word, what all words between have in common counts
            near = np.append(size[0] - 1, same[1:]) if order == 1 else np.append(size[-1] - 1, same[:0:-1])
            reach = np.minimum(np.minimum.accumulate(near) + 1, len(more))
            place = np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
            out[np.repeat(start[::order], reach) + place] += more[place]
    return out


def end_path(offsets: np.ndarray, data: np.ndarray, n: np.ndarray, last: bool = False) -> np.ndarray:
    """The path of the first (or the last) of the words within them: paths() of it alone."""
    i = len(n) - 1 if last else 0
    # what all words between have in common with it
    near = shared_bits(offsets, data)[1:]
    near, rest = (near[::-1], n[:-1][::-1]) if last else (near, n[1:])
    size = int(8 * (offsets[i + 1] - offsets[i]))
    reach = np.minimum.accumulate(near) if len(near) else near
    per = np.bincount(np.maximum(reach, 0), rest, size + 1).astype(np.float64)
    return n[i] + np.cumsum(per[::-1])[::-1]


def edges(rows: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """bucket: (before, after) of paths(), from each bucket's (bucket, first word,
    its path within the bucket, last word, its path), in order."""

    def carried(rows):
        out, before = [], np.zeros(0)
        for i, (_, near, _, far, path) in enumerate(rows):
            out.append(before)
            if i + 1 < len(rows):
                path = path.copy()
                k = min(len(before), in_common(near, far) + 1)
                path[:k] += before[:k]
                before = path[: in_common(far, rows[i + 1][1]) + 1]
        return out

    back = [(b, last, last_path, first, first_path) for b, first, first_path, last, last_path in rows[::-1]]
    return {r[0]: x for r, *x in zip(rows, carried(rows), carried(back)[::-1])}


def closed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, A-Z lower-cased and closed by a space: (offsets, bytes)."""
    size = ends - starts + 1
    offsets = np.append(0, np.cumsum(size))
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - starts, size)
    out = data[np.minimum(at, len(data) - 1)] if len(data) else np.zeros(0, np.uint8)
    out = np.where((out >= 65) & (out <= 90), out + 32, out).astype(np.uint8)
    out[offsets[1:] - 1] = 32
    return offsets, out


def binary(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary())


def bytes_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    col = col.cast(pa.large_binary())
    if not len(col):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, off, raw = col.buffers()
    o = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    return o - o[0], np.frombuffer(raw, np.uint8)[o[0] : o[-1]]


def closed_hashes(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Hashes of closed words, equal to those of the words without their ends."""
    return textkit.hash_words(data, offsets[:-1], offsets[1:] - 1, fold=False)


#: What is counted of a word: its places in all training texts, in the first half of
#: these, and in all texts.
COUNTS = ("n", "m", "seen")


def vocabulary(rows: DataFrame, batches) -> DataFrame:
    """(word, n, m, seen): closed, lower-cased words of the texts, and each text's end.
    `batches` makes batches with columns text and part from an iterator of those of
    `rows`; part is 0 for texts to score only, 1 and 2 for the halves of the training
    texts."""

    def run(parts):
        for p in parts:
            for q in batches(p):
                offsets, data = textkit.buffers(q.column("text"))
                part = q.column("part").to_numpy()
                starts, ends, first = textkit.spans(offsets, data)
                h = textkit.hash_words(data, starts, ends, fold=True)
                own = np.repeat(part, np.diff(first))
                order = np.argsort(h)
                g, own = h[order], own[order]
                new = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
                ends_of = [np.count_nonzero(part > 0), np.count_nonzero(part == 1), len(part)]
                counts = [np.append(np.add.reduceat(x, new) if len(new) else np.zeros(0, np.int64), e) for x, e in zip(((own > 0).astype(np.int64), (own == 1).astype(np.int64), np.ones(len(g), np.int64)), ends_of)]
                at = order[new]
                o, d = closed(data, starts[at], ends[at])
                yield pa.RecordBatch.from_arrays([binary(np.append(o, o[-1] + len(END)), np.append(d, np.frombuffer(END, np.uint8))), *(pa.array(c, pa.int64()) for c in counts)], names=["word", *COUNTS])

    return rows.mapInArrow(run, "word binary, n long, m long, seen long").groupBy("word").agg(*(F.sum(c).alias(c) for c in COUNTS))


def sorted_buckets(words: DataFrame, recode) -> DataFrame:
    """A row for each range of the words (word, n, m, seen) as written by `recode`:
    bucket, and in binary the words, their sizes, hashes and counts, and the paths
    (paths()) of the first and the last word within it by n and by m.  The limits are
    words chosen by hash."""
    number, size = words.agg(F.count("*"), F.sum(F.length("word"))).first()
    many = max(1, -(-(size or 0) // BUCKET))
    rate = min(1.0, 64 * many / max(1, number))
    limits = []
    if many > 1:
        got = words.filter(F.pmod(F.xxhash64("word", F.lit(9)), F.lit(1 << 30)) < int(rate * (1 << 30))).select("word").toArrow()
        if len(got):
            offsets, data = recode(*bytes_of(got.column(0).combine_chunks()))
            some = sorted(binary(offsets, data).to_pylist())
            far = np.cumsum([len(w) for w in some])
            limits = sorted({some[i] for i in np.searchsorted(far, np.arange(1, many) * (far[-1] / many))})

    def number_of(parts):
        for p in parts:
            offsets, data = bytes_of(p.column(0))
            written = binary(*recode(offsets, data))
            at = [bisect.bisect_right(limits, w) for w in written.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), written, pa.array(textkit.signed(closed_hashes(offsets, data))), *p.columns[1:]], names=["bucket", "word", "h", *COUNTS])

    names = ["bucket", "data", "sizes", "h", *COUNTS, "first_n", "last_n", "first_m", "last_m"]

    def row(bucket, got):
        table = pa.Table.from_batches(got)
        offsets, data = bytes_of(table.column("word").combine_chunks())
        counts = [table.column(c).to_numpy().astype(np.int64) for c in ("h", *COUNTS)]
        ways = [end_path(offsets, data, c, last) for c in counts[1:3] for last in (False, True)]
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in (data, np.diff(offsets).astype(np.int64), *counts, *ways))], names=names)

    def gather(parts):
        now, got = None, []
        for p in parts:
            b = p.column(0).to_numpy()
            at = np.append(0, np.flatnonzero(b[1:] != b[:-1]) + 1) if len(b) else []
            for i, j in zip(at, np.append(at[1:], len(b))):
                if got and b[i] != now:
                    yield row(now, got)
                    got = []
                now = b[i]
                got.append(p.slice(i, j - i))
        if got:
            yield row(now, got)

    dealt = words.select("word", *COUNTS).mapInArrow(number_of, "bucket int, word binary, h long, n long, m long, seen long")
    dealt = dealt.repartition(len(limits) + 1, "bucket").sortWithinPartitions("bucket", "word")
    return saved(dealt.mapInArrow(gather, ", ".join(f"{c} {'int' if c == 'bucket' else 'binary'}" for c in names)), "buckets", compression="zstd")


def opened(parts):
    """(bucket, offsets, bytes, hashes and counts by name) of the rows of sorted_buckets."""
    for p in parts:
        for i in range(p.num_rows):
            of = lambda c, t: np.frombuffer(p.column(p.schema.get_field_index(c))[i].as_buffer(), t)  # noqa: B023, E731
            yield p.column(0)[i].as_py(), np.append(0, np.cumsum(of("sizes", np.int64))), of("data", np.uint8), {c: of(c, np.int64) for c in ("h", *COUNTS)}


def edges_of(buckets: DataFrame, count: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """edges() of the buckets for a count, n or m; of their words only the first and the last are read."""
    path = lambda x: np.frombuffer(bytes(x), np.float64)
    near, far = f"first_{count}", f"last_{count}"
    first, last = F.expr(f"substring(data, 1, int((length({near}) div 8 - 1) div 8))"), F.expr(f"substring(data, int(length(data) - (length({far}) div 8 - 1) div 8 + 1))")
    rows = buckets.select("bucket", first.alias("f"), near, last.alias("l"), far).orderBy("bucket").collect()
    return edges([(r["bucket"], bytes(r["f"]), path(r[near]), bytes(r["l"]), path(r[far])) for r in rows])
