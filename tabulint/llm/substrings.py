"""Removing repeated spans of words with a compacted de Bruijn graph.

A window of `span` words is an edge of the graph.  Every window has a minimizer,
the k-word run inside it with the least hash, and consecutive windows with one
minimizer form a path: 13 windows at most, of one text.  Equal windows have equal
minimizers at equal offsets, so:

1. Minimizers are counted; paths whose minimizer occurs once hold no repeated
   window and go no further.
2. Paths with equal words are compacted by an aggregation to their first source
   coordinate (document, position).  Every other source of such a path repeats
   it whole.
3. Where a minimizer has several different paths, the graph branches.  Only the
   first source of each of those paths is taken apart into windows, whose first
   coordinates are found by the same aggregation.
4. The coordinates go back to the texts, which lose the covered words; or pieces that
   are neighbours in a text and in its source are joined to spans as long as can be.

What is shuffled is a row per path, about a sixth of the words, once as a bare
minimizer and once with its coordinate, and the texts twice, one after the other.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulint.llm import textkit
from tabulint.plans.durable import saved

#: Words of a minimizer.
CORE = 8
#: A coordinate packs, from its low bits, a path's windows, its first word's
#: position and some bits that tell apart texts that share a doc_id.
_COUNT, _PLACE = 5, 36


def _sums(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = textkit._powers(max(textkit.BLOCK, len(h)))
    c = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=c[1:])
    return c, down


def paths(h: np.ndarray, first: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """(minimizer, content, text, position, windows) of every path of the texts
    whose word hashes are h[first[i]:first[i + 1]]."""
    wide = span - CORE + 1
    n = len(h) - span + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    core = textkit.windows(h, CORE)
    at = sliding_window_view(core, wide).argmin(axis=1) + np.arange(n)
    text = np.searchsorted(first, np.arange(n), side="right") - 1
    inside = np.arange(n) + span <= first[text + 1]
    fresh = np.ones(n, bool)
    fresh[1:] = (at[1:] != at[:-1]) | ~inside[:-1]
    start = np.flatnonzero(fresh & inside)
    bounds = np.append(np.flatnonzero(fresh | ~inside), n)
    end = bounds[np.searchsorted(bounds, start, side="right")]
    c, down = _sums(h)
    size = end - start
    content = textkit.mix64((c[end - 1 + span] - c[start]) * down[start] + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return core[at[start]], content, text[start], start - first[text[start]], size


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets, data = textkit.buffers(texts)
    starts, ends, first = textkit.spans(offsets, data)
    return textkit.hash_words(data, starts, ends, fold=False), first


def _tagged(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """has (0 for a null id, 1 for others, so nulls come first), doc (the id, of any
    type with an order; a null's is filled up), part (bits of the text's hash, above a
    coordinate's place) and text."""
    part = F.shiftleft(F.pmod(F.xxhash64(F.col(text)), F.lit(1 << 22)), _COUNT + _PLACE)
    kind = docs.schema[doc_id].dataType
    return docs.select(F.col(doc_id).isNotNull().cast("int").alias("has"), F.coalesce(F.col(doc_id), F.lit("0").cast(kind)).alias("doc"), part.alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text"))


#: What names a text, and what orders the places where a window stands.
_TEXT, _SOURCE = ["has", "doc", "part"], ["has", "doc", "at"]


def _differs(a: str, b: str):
    """Whether two places (has, doc, at), given as prefixes of their columns, differ."""
    return (F.col(f"{a}at") != F.col(f"{b}at")) | (F.col(f"{a}has") != F.col(f"{b}has")) | (F.col(f"{a}doc") != F.col(f"{b}doc"))


def repeats(tagged: DataFrame, span: int) -> DataFrame:
    """(has, doc, part, start, words, has0, doc0, start0): pieces of texts, `words` long,
    and the first places where these words stand; pieces may overlap."""
    kind = tagged.schema["doc"].dataType.simpleString()

    def minimizers(parts):
        for p in parts:
            for q in textkit.batches(p, "text", 1 << 20):
                m = paths(*hashed(q.column(0)), span)[0]
                yield pa.RecordBatch.from_arrays([pa.array(textkit.signed(m))], names=["m"])

    def sources(parts):
        for p in parts:
            for q in textkit.batches(p, "text", 1 << 20):
                m, c, text, place, size = paths(*hashed(q.column(3)), span)
                at = q.column(2).to_numpy()[text] | place << _COUNT | size
                own = pa.array(text)
                yield pa.RecordBatch.from_arrays([pa.array(textkit.signed(m)), pa.array(textkit.signed(c)), q.column(0).take(own), q.column(1).take(own), pa.array(at)], names=["m", "c", *_SOURCE])

    # a table of its own, so that the join below is of two plain exchanges, whose hot minimizers adaptive execution splits
    counted = saved(tagged.select("text").mapInArrow(minimizers, "m long").groupBy("m").agg(F.count("*").alias("n")).filter("n > 1").select("m"), "repeated")
    repeated = saved(tagged.mapInArrow(sources, f"m long, c long, has int, doc {kind}, at long").join(counted, "m"), "paths")
    place = F.shiftright("at", _COUNT).bitwiseAND((1 << _PLACE) - 1)
    part = F.shiftleft(F.shiftright("at", _COUNT + _PLACE), _COUNT + _PLACE)
    source = [F.col(c).alias(f"first_{c}") for c in _SOURCE]
    start0 = F.shiftright("first_at", _COUNT).bitwiseAND((1 << _PLACE) - 1)
    piece = lambda words: ["has", "doc", part.alias("part"), place.alias("start"), words.cast("long").alias("words"), F.col("first_has").alias("has0"), F.col("first_doc").alias("doc0"), start0.alias("start0")]

    first = repeated.groupBy("m", "c").agg(F.min(F.struct(*_SOURCE)).alias("first"))
    firsts = saved(first.select("m", "c", "first.*"), "firsts")
    again = repeated.join(firsts.select("m", "c", *source), ["m", "c"]).filter(_differs("", "first_"))
    whole = again.select(*piece(F.col("at").bitwiseAND((1 << _COUNT) - 1) + (span - 1)))

    branching = firsts.groupBy("m").agg(F.count("*").alias("n")).filter("n > 1").select("m")
    wanted = firsts.join(branching, "m").groupBy("has", "doc", part.alias("part")).agg(F.collect_list("at").alias("at"))

    def windows(parts):
        for p in parts:
            for q in textkit.batches(p, "text", 1 << 20):
                h, first = hashed(q.column(3))
                lists = q.column(4)
                at = lists.flatten().to_numpy()
                text = np.repeat(np.arange(q.num_rows), lists.value_lengths().to_numpy())
                size = at & (1 << _COUNT) - 1
                row = np.repeat(np.arange(len(at)), size)
                step = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                local = (at[row] >> _COUNT & (1 << _PLACE) - 1) + step
                i = first[text[row]] + local
                c, down = _sums(h)
                w = textkit.mix64((c[i + span] - c[i]) * down[i])
                coordinate = at[row] >> _COUNT + _PLACE << _COUNT + _PLACE | local << _COUNT | 1
                own = pa.array(text[row])
                yield pa.RecordBatch.from_arrays([pa.array(textkit.signed(w)), q.column(0).take(own), q.column(1).take(own), pa.array(coordinate)], names=["w", *_SOURCE])

    apart = saved(tagged.join(wanted, _TEXT).select("has", "doc", "part", "text", "at").mapInArrow(windows, f"w long, has int, doc {kind}, at long"), "windows")
    known = saved(apart.groupBy("w").agg(F.count("*").alias("n"), F.min(F.struct(*_SOURCE)).alias("first")).filter("n > 1").select("w", *[F.col(f"first.{c}").alias(f"first_{c}") for c in _SOURCE]), "known")
    later = apart.join(known, "w").filter(_differs("", "first_")).select(*piece(F.lit(span)))
    return whole.unionAll(later)


def removals(tagged: DataFrame, span: int) -> DataFrame:
    """(has, doc, part, cuts): the places to cut, as array of start << 24 | words."""
    cut = (F.shiftleft("start", 24) + F.col("words")).alias("cut")
    return repeats(tagged, span).select(*_TEXT, cut).groupBy(*_TEXT).agg(F.collect_list("cut").alias("cuts"))


def repeated_spans(docs: DataFrame, span: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, words, source_id, source_start): the longest spans of `span`
    words and more that also stand, as a whole, at an earlier source.

    Neighbouring pieces of a text that come from neighbouring pieces of one source are
    joined: they have the same distance to it, so where the next piece starts no later
    than the last one's windows go on, both are one span.  Rows that share id and text
    are one source.  A null id counts as the smallest."""
    tagged = _tagged(docs, doc_id, text)
    line = ["has", "doc", "part", "has0", "doc0", "shift"]
    pieces = repeats(tagged, span).distinct().withColumn("shift", F.col("start") - F.col("start0")).withColumn("end", F.col("start") + F.col("words"))
    w = Window.partitionBy(*line).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    # windows go on without a gap where a piece starts span - 1 words before the last end
    fresh = before.isNull() | (F.col("start") > before - (span - 1))
    islands = pieces.withColumn("fresh", fresh.cast("int")).withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = islands.groupBy(*line, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("start0").alias("start0"))
    kind = docs.schema[doc_id].dataType
    named = lambda has, doc, name: F.when(F.col(has) == 1, F.col(doc)).cast(kind).alias(name)
    return out.select(named("has", "doc", "doc_id"), "start", (F.col("end") - F.col("start")).alias("words"), named("has0", "doc0", "source_id"), F.col("start0").alias("source_start"))


def without_repeats(docs: DataFrame, span: int = 20, doc_id: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """A row per document: doc_id, n_words, n_removed, kept_sha256 (of the kept
    words joined by one space) and, if asked for, kept_text.

    A word goes if a window of `span` words over it also starts earlier, in a
    document of smaller doc_id or further up in the same one; windows are those
    of the input.  Texts of fewer words, null and empty ones lose nothing.  Rows
    that share both doc_id and text are one source, so all or none of them lose a
    window; ids may be of any type with an order, a null id counts as the smallest.
    """
    tagged = _tagged(docs, doc_id, text)
    rows = tagged.join(removals(tagged, span), _TEXT, "left").select(F.when(F.col("has") == 1, F.col("doc")).cast(docs.schema[doc_id].dataType).alias("doc_id"), "text", "cuts")
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text]

    def run(parts):
        for p in parts:
            for q in textkit.batches(p, "text", 4 << 20):
                n, gone, sha, kept_text = [], [], [], []
                for t, cuts in zip(q.column(1).to_pylist(), q.column(2)):
                    words = t.encode().split()  # the same white space for bytes
                    n.append(len(words))
                    if cuts.is_valid:
                        c = cuts.values.to_numpy()
                        change = np.zeros(len(words) + 1, np.int64)
                        np.add.at(change, c >> 24, 1)
                        np.add.at(change, (c >> 24) + (c & (1 << 24) - 1), -1)
                        words = list(compress(words, np.cumsum(change[:-1]) == 0))
                    gone.append(n[-1] - len(words))
                    kept = b" ".join(words)
                    sha.append(hashlib.sha256(kept).hexdigest())
                    kept_text.append(kept.decode())
                yield pa.RecordBatch.from_arrays([q.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), *[pa.array(kept_text, pa.string())] * with_text], names=names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
