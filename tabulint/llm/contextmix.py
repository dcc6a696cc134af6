"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is a stream: its words, A-Z lower-cased, each closed by a space, then a
newline.  The 31 bytes most frequent in training are a symbol each, any other byte is an
escape and its two halves; a symbol is five binary decisions.  For each decision
several predictors say how likely either bit is:

* hashed contexts, the last 3, 4 and 6 symbols of the stream, which reach over
  word boundaries and to the text's start: how often either bit followed in training;
* the whole prefix of the word, in exact counts over all training words
  (wordpaths.py), a table that grows with the corpus and is joined to the texts; it
  starts at the fourth symbol, as a shorter prefix is one of the contexts above;
* the last place in the same text where the last 6 symbols stood: the symbol there.

Their stretched probabilities are added with weights from a set that a gate selects
(how well the prefix, the last place and the four symbols are known).  A weight of the
text's own scales the sum, another adds to the last place's; it is squashed and refined by
adaptive probability maps: one by gate, one of the text's own.  What is the text's own
starts level and is updated along the text, after each block of 64 to 512 symbols.  The
sum of -log2 of the probabilities of the bits that came is the text's length in bits.

Training is distributed.  Counts of the hashed contexts are sums over all training
texts; a predictor whose rate is one over its count holds just those, in whatever
order the texts came.  The gated weights and their map are learned from all training
texts, too: a hash of the text halves them, and each half is predicted from the other
half's counts, as texts must not be known while weights are learned from them.  A pack's
weights follow its bits by Newton steps, each bit seen once; the packs' weights are
averaged by their curvature.  Scores are made with the counts of both halves.

Texts stay in packs of some megabytes.  Frequent words' prefix codes are broadcast (a
fixed number); a pack's other words get theirs by a join.
"""

from __future__ import annotations

import copy
import math
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulint.llm import dense, textkit, wordpaths
from tabulint.plans.durable import dropped, given_back, saved

#: Symbols of the hashed contexts; one of four gives the gate.
ORDERS = (3, 4, 6)
#: Predictors: those, the word's prefix, and the last place in the text.
INPUTS = len(ORDERS) + 2
#: Slots (32 counts each) of the contexts' tables by powers of two: as many as there are
#: contexts, or distinct training words within these bounds.  Beyond, contexts share slots.
LEAST_BITS, MOST_BITS = 16, 18
#: Symbols of a word without prefix codes.
SKIP = 3
#: Most frequent words whose prefix codes are broadcast.
FREQUENT = 1 << 18
#: About the bytes of text in a pack.
PACK = 1 << 22
#: Bytes of text that are scored side by side, and symbols of a longer text whose
#: predictions are held at a time; the last place in the text is looked for within these.
BATCH, SEGMENT = 1 << 18, 1 << 20
#: Symbols worked on at a time, so that what is made of them stays in a core's caches.
NEAR = 1 << 14
#: Weights before training, the curvature that holds them there, bits of a Newton step,
#: and most repetitions of one, which ends as soon as no weight moves by more than MOVED.
START, HELD, STEP, REPEATS, MOVED = 0.3, 10.0, 1 << 20, 8, 0.05
#: Block ends along a text; further blocks have 512 symbols.
BLOCKS = (64, 128, 256, 512)
#: Gates: three levels of knowledge out of four each.
GATES = 64
#: A sum's size is at most FAR, in steps of FAR / FINE; maps have every eighth step.
FAR, FINE, COARSE = 12.0, 256, 32
#: Update rate of a text's weights; weight of the trained map in the text's own.
RATE, TRUST = 2.0, 64.0
#: Counts in a row of a table in transport.
PIECE = 1 << 14
_SPREAD = 0x9E3779B1

# For the upper three bits of a symbol: the nodes on its way in a binary tree, both of the last.
_WAYS = np.array([[*(1 << d | v >> 3 - d for d in range(4)), 16 | 2 * v, 17 | 2 * v] for v in range(8)])
# for each symbol, by depth, what turns a code of a 1 to the bit that came: codes ^ _MIRROR + _ONE
_OFF = np.array([[~v >> 4 - d & 1 for d in (0, 1, 2, 3, 4, 4, 4, 4)] for v in range(32)], np.uint8)
_MIRROR, _ONE = (63 * _OFF).reshape(-1).view(np.uint64), _OFF.reshape(-1).view(np.uint64)
_AGREE = np.array([5 - v.bit_length() for v in range(32)], np.uint8)


def inputs(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Stretched probability of a 1, nearer to none the smaller the count."""
    n = n0 + n1
    return np.log((n1 + np.float32(0.4)) / (n0 + np.float32(0.4))) * (n / (n + np.float32(0.6)))


def codes(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """A byte for a prediction: the input in quarters, 6 bits about 32, and above it
    how well the place is known: not, once or twice, often, very often."""
    n = n0 + n1
    level = (n > 0.5).astype(np.uint8) + (n > 2.5) + (n > 30.5)
    return (level << 6 | (np.clip(np.rint(inputs(n0, n1) * 4), -31, 31) + 32).astype(np.uint8)).astype(np.uint8)


#: Input of a code.
_INPUT = ((np.arange(256) & 63) - 32).astype(np.float32) / 4
# Codes of a symbol's bits for how long the last place has been right (none, not yet,
# up to 5, 15, 31, more) and how many bits of its symbol are right now.
_RUNS = (1, 6, 16, 32)
_MATCH = np.full((6, 6, 5), 32, np.uint8)
for _i, _s in enumerate((4, 10, 16, 22, 28)):
    for _a in range(6):
        _MATCH[_i + 1, _a, :_a] = min(_i, 2) + 1 << 6 | 32 + _s
        _MATCH[_i + 1, _a, _a : _a + 1] = min(_i, 2) + 1 << 6 | 32 - _s


# those of the five bits in a number, and the code of a place's bits 2 to 5, which tell them apart
_MATCHES = np.pad(_MATCH.reshape(36, 5), ((0, 0), (0, 3))).reshape(-1).view(np.uint64)
_MATCH_CODE = np.full(16, 32, np.uint8)
_MATCH_CODE[_MATCH >> 2 & 15] = _MATCH
# what the place's length adds to its row, by the length to the longest limit
_RUN_ROWS = (6 + 6 * np.searchsorted(_RUNS, np.arange(_RUNS[-1] + 1), side="right")).astype(np.uint8)


def tables_of(counts: np.ndarray) -> np.ndarray:
    """Codes of a 1 at the nodes 1 to 31 of each slot, from how often each symbol came
    there."""
    c = counts.reshape(-1, 32).astype(np.float32)
    out = np.full(c.shape, 32, np.uint8)
    for depth in range(5):
        sums = c.reshape(len(c), 2 << depth, -1).sum(2)
        out[:, 1 << depth : 2 << depth] = codes(sums[:, ::2], sums[:, 1::2])
    return out


class Ways:
    """The tables' codes as they are read, one number for those that a symbol needs: by
    slot and upper three bits of the symbol, a byte for each of the nodes _WAYS."""

    def __init__(self, tables: list[np.ndarray]):
        self.bits, self.tables = [len(t).bit_length() - 1 for t in tables], tables

    @cached_property
    def codes(self) -> list[np.ndarray]:
        """Made where they are first read, so that the tables are what is sent."""
        out = [np.zeros((len(t), 8, 8), np.uint8) for t in self.tables]
        for codes_, t in zip(out, self.tables):
            for i in range(0, len(t), NEAR):
                codes_[i : i + NEAR, :, :6] = np.take(t[i : i + NEAR], _WAYS, axis=1)
        del self.tables
        return [codes_.reshape(-1).view(np.uint64) for codes_ in out]


class Alphabet:
    """The bytes that are a symbol of their own."""

    def __init__(self, counts: np.ndarray):
        """counts: how often each byte came; ties go to the smaller byte."""
        self.symbol = np.full(256, 31, np.uint8)
        self.symbol[np.argsort(-counts, kind="stable")[:31]] = np.arange(31)
        self.size = np.where(self.symbol < 31, 1, 3)

    def symbols(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of bytes, where those of each byte start, and their number)."""
        out = self.symbol[data]
        rare = np.flatnonzero(out == 31)
        at = np.arange(len(data) + 1)
        if len(rare):
            begin = rare + 2 * np.arange(len(rare))
            single = np.ones(len(data) + 2 * len(rare), bool)
            single[begin + 1] = single[begin + 2] = False
            wide = np.empty(len(single), np.uint8)
            wide[single] = out
            wide[begin + 1], wide[begin + 2] = data[rare] >> 4, data[rare] & 15
            at = np.append(np.flatnonzero(single), len(single))
            out = wide
        return out, at


class Stream:
    """Texts as they are scored: symbols, bounds of the texts, start and hash of the words."""

    def __init__(self, texts: pa.Array, alphabet: Alphabet, hashes: bool = True):
        offsets, data = textkit.buffers(texts)
        self.n_bytes = np.diff(offsets)
        starts, ends, first = textkit.spans(offsets, data)
        h = textkit.hash_words(data, starts, ends, fold=True) if hashes else np.zeros(len(starts), np.uint64)
        at, closed = wordpaths.closed(data, starts, ends)
        n = np.diff(first)
        text = np.repeat(np.arange(len(n)), n)
        raw = np.full(len(closed) + len(n), wordpaths.END[0], np.uint8)
        raw[np.arange(len(closed)) + np.repeat(text, np.diff(at))] = closed
        self.words = first + np.arange(len(n) + 1)
        self.hashes = np.full(self.words[-1], END_HASH, np.uint64)
        self.hashes[np.arange(len(h)) + text] = h
        begin = np.empty(len(self.hashes) + 1, np.int64)
        begin[np.arange(len(h)) + text] = at[:-1] + text
        bounds = at[first] + np.arange(len(n) + 1)
        begin[self.words[1:] - 1] = bounds[1:] - 1
        begin[-1] = len(raw)
        self.data, place = alphabet.symbols(raw)
        self.bounds, self.starts = place[bounds], place[begin]
        # the six symbols before each, the last one lowest; escapes stand before the text
        self.past = np.zeros(len(self.data), np.uint32)
        wide = self.data.astype(np.uint32)
        for j in range(1, 7):
            if j < len(wide):
                self.past[j:] |= wide[:-j] << np.uint32(5 * (j - 1))
        for j in range(6):
            at = self.bounds[:-1] + j
            at = at[at < self.bounds[1:]]
            self.past[at] = self.past[at] & np.uint32((1 << 5 * j) - 1) | np.uint32((1 << 30) - (1 << 5 * j))


END_HASH = wordpaths.closed_hashes(np.array([0, 1]), np.frombuffer(wordpaths.END, np.uint8))[0]


def slots(order: int, past: np.ndarray, bits: int) -> np.ndarray:
    """Slots of contexts: all apart if they fit."""
    x = past & np.uint32((1 << 5 * order) - 1)
    return x if 5 * order <= bits else x * np.uint32(_SPREAD) >> np.uint32(32 - bits)


def slot_bits(distinct: int) -> tuple[int, ...]:
    """Slots of the tables by powers of two."""
    bits = min(max((max(1, distinct) - 1).bit_length(), LEAST_BITS), MOST_BITS)
    return tuple(min(5 * order, bits) for order in ORDERS)


def last_places(stream: Stream, a: int, b: int) -> np.ndarray:
    """Rows of _MATCHES for the predictor that repeats what last stood behind the same 6
    symbols of a text, for the symbols from a to b, looking back as far as a."""
    past, data = stream.past[a:b], stream.data[a:b]
    n, texts = len(data), len(stream.bounds) - 1
    shift = np.uint64(max(1, n.bit_length()))
    text = np.repeat(np.arange(texts, dtype=np.uint64) << np.uint64(30), np.diff(np.clip(stream.bounds, a, b)))
    key = past | text
    exact = int(shift) + 30 + (max(1, texts) - 1).bit_length() <= 64
    if exact:
        s = key << shift
    else:  # a hash of them
        s = key * np.uint64(0x9E3779B97F4A7C15) >> shift << shift
    s |= np.arange(n, dtype=np.uint64)
    s.sort()
    again = np.flatnonzero(s[1:] ^ s[:-1] < np.uint64(1) << shift)
    s &= (np.uint64(1) << shift) - np.uint64(1)
    place = s.view(np.int64)
    here, there = place[1:][again], place[again]
    if not exact:
        same = key[here] == key[there]
        here, there = here[same], there[same]
    # one more than how many bits agree, 0 where there is no place
    agree = np.zeros(n, np.uint8)
    agree[here] = 1 + _AGREE[data[here] ^ data[there]]
    wrong_at = np.arange(n, dtype=np.int32)
    run = wrong_at.copy()
    wrong_at[agree == 6] = -1
    run[1:] -= 1 + np.maximum.accumulate(wrong_at, out=wrong_at)[:-1]
    kind = np.take(_RUN_ROWS, np.minimum(run, _RUNS[-1], out=run), mode="clip")
    kind += agree
    kind -= 1
    kind *= agree > 0
    return kind


class Codes:
    """Prefix codes of words, five bytes for each symbol of a word from the fourth on,
    found by hash.  The pool's first row says nothing."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, sizes: np.ndarray, pool: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.counts, self.pool = hashes[order], counts[order], np.concatenate([np.full((1, 5), 32, np.uint8), pool])
        self.start, self.size = (1 + np.cumsum(sizes) - sizes)[order], sizes[order]

    #: Further words, none of them among these; their pool's rows follow.
    more: Codes | None = None

    def __or__(self, other: Codes) -> Codes:
        """The words of both, which have none in common, without a copy."""
        out = copy.copy(self)
        out.more = other
        return out

    @classmethod
    def of(cls, h: pa.Array, n: pa.Array, code: pa.Array) -> Codes:
        """From the columns (h, n, code)."""
        offsets, raw = wordpaths.bytes_of(code)
        return cls(h.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), n.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(offsets) // 5, raw.copy().reshape(-1, 5))

    @classmethod
    def none(cls) -> Codes:
        return cls(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 5), np.uint8))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of those of the sorted hashes that are there, which)."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        ok = np.flatnonzero(self.hashes[k] == h)
        return k[ok], ok

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(count, first row in the pool, rows) of each of the sorted hashes."""
        n, begin, size = (np.zeros(len(h), np.int64) for _ in range(3))
        for words, base in ((self, 0), (self.more, len(self.pool))):
            if words is not None:
                k, ok = words.find(h)
                n[ok], begin[ok], size[ok] = words.counts[k], base + words.start[k], words.size[k]
        return n, begin, size

    def rows(self, at: np.ndarray) -> np.ndarray:
        """Rows of the pool."""
        out = np.take(self.pool, at, axis=0, mode="clip")
        if self.more is not None and len(far := np.flatnonzero(at >= len(self.pool))):
            out[far] = self.more.pool[at[far] - len(self.pool)]
        return out


def predictions(ways: Ways, stream: Stream, words: Codes, a: int, b: int, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(codes of each predictor, bit and symbol; count of each word) for the symbols
    from a to b, brought in an order, all seen from the bit that came."""
    out = np.empty((INPUTS, 5, b - a), np.uint8)
    data, past = stream.data[a:b], stream.past[a:b]
    if order is not None:
        data, past = data[order], past[order]
    for i in range(0, b - a, NEAR):
        near, before = data[i : i + NEAR], past[i : i + NEAR]
        upper = near >> np.uint8(2)
        mirror, one = np.take(_MIRROR, near, mode="clip"), np.take(_ONE, near, mode="clip")
        fifth = np.arange(4, 8 * len(near), 8) + (near >> np.uint8(1) & np.uint8(1))
        for k, n in enumerate(ORDERS):
            at = slots(n, before, ways.bits[k]) << np.uint32(3)
            at |= upper
            got = np.take(ways.codes[k], at.astype(np.int64), mode="clip")
            got ^= mirror
            got += one
            got = got.view(np.uint8)
            for d in range(4):
                out[k, d, i : i + NEAR] = got[d::8]
            np.take(got, fifth, out=out[k, 4, i : i + NEAR], mode="clip")
    u, v = int(np.searchsorted(stream.starts, a, side="right")) - 1, int(np.searchsorted(stream.starts, b))
    h, starts = stream.hashes[u:v], stream.starts[u : v + 1]
    distinct, which = np.unique(h, return_inverse=True)
    n, begin, size = words.look(distinct)
    at = np.flatnonzero(size[which])
    low, high = np.maximum(starts[at] + SKIP, a), np.minimum(starts[at + 1], b)
    many = np.maximum(high - low, 0)
    step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    prefix = np.zeros(b - a, np.int64)
    prefix[np.repeat(low - a, many) + step] = np.repeat(begin[which[at]] + low - starts[at] - SKIP, many) + step
    last = last_places(stream, a, b)
    if order is not None:
        prefix, last = prefix[order], last[order]
    for i in range(0, b - a, NEAR):
        out[-2, :, i : i + NEAR] = words.rows(prefix[i : i + NEAR]).T
        got = np.take(_MATCHES, last[i : i + NEAR], mode="clip").view(np.uint8).reshape(-1, 8)
        for d in range(5):
            out[-1, d, i : i + NEAR] = got[:, d]
    return out, n[which]


def gates(code: np.ndarray) -> np.ndarray:
    """Weight sets: levels of the prefix, the last place and the four symbols."""
    return code[-2] >> 2 & 48 | code[-1] >> 4 & 12 | code[ORDERS.index(4)] >> 6


def blocks(place: np.ndarray) -> np.ndarray:
    """Number of the block of each place in a text."""
    out = place // BLOCKS[-1] + (len(BLOCKS) - 1)
    early = np.flatnonzero(place < BLOCKS[-1])
    out[early] = np.searchsorted(BLOCKS, place[early], side="right")
    return out


#: Steps of a sum, from -FINE to FINE, and on which side how far they are.
_STEPS = np.arange(-FINE, FINE + 1)
#: Predictors whose weighted inputs are looked up together.
PAIRS = ((0, 2), (3, 1))
_SQUASH = (1 / (1 + np.exp(-_STEPS * (FAR / FINE)))).astype(np.float32)
_SIDE = np.sign(_STEPS)
_BIN = (np.abs(_STEPS) + FINE // COARSE // 2) // (FINE // COARSE)
_SIGNED = _SIDE * _BIN + COARSE


def untrained() -> tuple[np.ndarray, np.ndarray]:
    """Weights by input and gate, and the map: how likely the side that the sum is on
    is, by gate and distance."""
    mid = 1 / (1 + np.exp(-np.arange(COARSE + 1) * (FAR / COARSE)))
    return np.full((INPUTS, GATES), START, np.float32), np.tile(mid, (GATES, 1)).astype(np.float32)


class Model:
    """Alphabet, tables, gated weights and the map."""

    def __init__(self, alphabet: Alphabet, tables: list[np.ndarray], weights: np.ndarray, map_: np.ndarray):
        self.alphabet, self.tables = alphabet, tables
        self.weights, self.map = weights.astype(np.float32), map_.astype(np.float32)
        # weight times input by gate and the lower bits of codes, of pairs and the last place; squashed sum and what the map makes of it, by gate and step
        one = [np.outer(w, _INPUT[:64]).astype(np.float32) for w in self.weights]
        self.products = [(one[p][:, :, None] + one[q][:, None, :]).reshape(-1) for p, q in PAIRS] + [one[-1].reshape(-1)]
        self.refined = (_SQUASH + 0.5 + _SIDE * (self.map[:, _BIN] - 0.5)).astype(np.float32).reshape(-1)
        self.trained = self.map.mean(0)
        self.ways = Ways(tables)

    def bits(self, stream: Stream, words: Codes) -> tuple[np.ndarray, np.ndarray]:
        """(bits of each text, count of each word)."""
        n = len(stream.bounds) - 1
        total, counts, state = np.zeros(n), np.zeros(len(stream.hashes), np.int64), self.fresh(n)
        size = len(stream.data)
        for a in range(0, size, size if n > 1 else SEGMENT) if size else ():
            b = size if n > 1 else min(a + SEGMENT, size)
            bounds = stream.bounds if n > 1 else np.array([0, b - a])
            text = np.repeat(np.arange(n, dtype=np.int32), np.diff(bounds))
            block = blocks(np.arange(a, b) - np.repeat(bounds[:-1], np.diff(bounds)))
            order = np.argsort(block.astype(np.uint16) if block.max() < 1 << 16 else block, kind="stable")
            u, v = int(np.searchsorted(stream.starts, a, side="right")) - 1, int(np.searchsorted(stream.starts, b))
            code, counts[u:v] = predictions(self.ways, stream, words, a, b, order)
            self._along(code.transpose(0, 2, 1), None, text[order], block[order], state, total)
        return total, counts

    def fresh(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """State of n texts: weight of the sum and more for the last place, and places
        seen by signed distance."""
        return np.repeat(np.array([[1], [0]], np.float32), n, axis=1), np.zeros((n, 2 * COARSE + 1), np.int64)

    def own_map(self, seen: np.ndarray) -> np.ndarray:
        """What texts' own maps make of a signed distance."""
        right, out = seen[:, COARSE:], np.empty(seen.shape, np.float32)
        likely = (right + TRUST * self.trained) / (right + seen[:, COARSE::-1] + TRUST)
        out[:, COARSE:], out[:, :COARSE], out[:, COARSE] = likely, 1 - likely[:, :0:-1], 0.5
        return out

    def _along(self, code: np.ndarray, data: np.ndarray | None, text: np.ndarray, block: np.ndarray, state: tuple[np.ndarray, np.ndarray], total: np.ndarray) -> None:
        """Add the bits of texts whose codes (by predictor, symbol and bit) are given by
        block and text, and carry their state on.  data: their symbols, if the contexts'
        codes are of a 1; none, if they are seen from the bit that came."""
        own, seen = state
        code = code.transpose(0, 2, 1)
        if data is not None:
            off = _OFF[data, :5].T
            code = np.concatenate([(code[: len(ORDERS)] ^ 63 * off) + off, code[len(ORDERS) :]])
        cut = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.zeros(0, np.int64)
        for i, j in zip(cut, np.append(cut[1:], len(block))):
            t = text[i:j]
            first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            who, many = t[first], np.diff(np.append(first, j - i))
            c = code[:, :, i:j]
            gate = gates(c)
            low = [x & np.uint8(63) for x in c]
            high = gate.astype(np.int32) << 6
            corpus = None
            for (p, q), product in zip(PAIRS, self.products):
                at = high | low[p].astype(np.int32)
                at <<= 6
                at |= low[q].astype(np.int32)
                x = np.take(product, at.astype(np.int64), mode="clip")
                corpus = x if corpus is None else np.add(corpus, x, out=corpus)
            high |= low[-1].astype(np.int32)
            corpus += np.take(self.products[-1], high.astype(np.int64), mode="clip")
            last = (low[-1].astype(np.float32) - np.float32(32)) * np.float32(0.25)
            s = np.repeat(own[0, who], many) * corpus
            s += np.repeat(own[1, who], many) * last
            s *= np.float32(FINE / FAR)
            np.clip(np.rint(s, out=s), -FINE, FINE, out=s)
            step = s.astype(np.int16)
            at = gate.astype(np.int32)
            at *= 2 * FINE + 1
            at += (step + np.int16(FINE)).astype(np.int32)
            final = np.take(self.refined, at.astype(np.int64), mode="clip")
            # as _SIGNED has it
            step += (step >> 15) + np.int16(FINE // COARSE // 2)
            step >>= (FINE // COARSE).bit_length() - 1
            step += np.int16(COARSE)
            cell = step.astype(np.int64)
            cell += np.repeat(np.arange(len(who)) * (2 * COARSE + 1), many)
            final += np.take(self.own_map(seen[who]).reshape(-1), cell, mode="clip")
            final *= np.float32(1 / 3)
            np.maximum(final, np.float32(1e-6), out=final)
            # a symbol's probability, at least 1e-30
            total[who] -= np.add.reduceat(np.log(final[0] * final[1] * final[2] * final[3] * final[4]), first, dtype=np.float64) / math.log(2)
            error = np.subtract(1, final, out=final)
            for k, x in enumerate((corpus, last)):
                own[k, who] += (RATE * np.add.reduceat(np.einsum("ij,ij->j", x, error), first) / (5 * many + 64)).astype(np.float32)
            seen[who] += np.bincount(cell.reshape(-1), minlength=len(who) * (2 * COARSE + 1)).reshape(len(who), -1)


def newton(weights: np.ndarray, curve: np.ndarray, x: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights, curvature) of a gate after more bits, whose inputs (a row each) are seen
    from the bit that came; many: how often each column stands there."""
    at = weights
    for _ in range(REPEATS):
        likely = 1 / (1 + np.exp(-np.clip(at.astype(np.float32) @ x, -FAR, FAR)))
        error = (1 - likely) * many
        bent = x * (likely * error)
        more = curve + np.array([bent @ row for row in x])
        step = np.linalg.solve(more, x @ error - curve @ (at - weights))
        at = at + step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < MOVED:
            break
    return at, more


def distinct(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all predictors in one number, how often they stand there) of the distinct
    ones among bits, seen from those that came.  The gate and the inputs are kept: of the
    contexts that have no part in the gate, the level is not."""
    key = np.empty(code.shape[1:], np.uint32)
    for i in range(0, code.shape[2], NEAR):
        c = code[:, :, i : i + NEAR]
        at = c[3].astype(np.uint32) << np.uint32(8)
        for x, bits in ((c[1], 6), (c[0] & np.uint8(63), 6), (c[2] & np.uint8(63), 4)):
            at |= x.astype(np.uint32)
            at <<= np.uint32(bits)
        np.bitwise_or(at, c[4] >> np.uint8(2) & np.uint8(15), out=key[:, i : i + NEAR])
    key = key.reshape(-1)
    key.sort()
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    many = np.diff(np.append(new, len(key)))
    return key[new], many


def learn(ways: Ways, batches) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(curvature by gate, the same times the weights, both without what holds the start;
    places seen by gate and signed distance) from the (stream, codes of its words) pairs."""
    weights, hold = np.full((GATES, INPUTS), START), HELD * np.eye(INPUTS)
    curve = np.tile(hold, (GATES, 1, 1))
    seen = np.zeros((GATES, 2 * COARSE + 1))
    for stream, words in batches:
        for a in range(0, len(stream.data), SEGMENT):
            b = min(a + SEGMENT, len(stream.data))
            code = predictions(ways, stream, words, a, b)[0]
            for i in range(0, b - a, STEP // 5):
                # the same codes are the same lesson, as often as they stand there
                key, many = distinct(code[:, :, i : i + STEP // 5])
                gate = (key >> 26 & 48).astype(np.uint8) | np.take(_MATCH_CODE >> 4 & 12, key & 15) | (key >> 22 & 3).astype(np.uint8)
                order = np.argsort(gate, kind="stable")
                key, many = key[order], many[order].astype(np.float32)
                x = np.empty((INPUTS, len(key)), np.float32)
                for k, shift in enumerate((10, 16, 4, 24)):
                    x[k] = key >> shift & 63
                x[-1] = np.take(_MATCH_CODE & 63, key & 15)
                x -= 32
                x /= 4
                cut = np.append(0, np.cumsum(np.bincount(gate, minlength=GATES)))
                for g in np.flatnonzero(np.diff(cut)):
                    own, times = x[:, cut[g] : cut[g + 1]], many[cut[g] : cut[g + 1]]
                    weights[g], curve[g] = newton(weights[g], curve[g], own, times)
                    s = np.clip(weights[g].astype(np.float32) @ own, -FAR, FAR)
                    seen[g] += np.bincount(_SIGNED[np.rint(s * np.float32(FINE / FAR)).astype(np.int64) + FINE], times, minlength=2 * COARSE + 1)
    return curve - hold, np.einsum("gij,gj->gi", curve, weights) - HELD * START, seen


def map_of(seen: np.ndarray) -> np.ndarray:
    """The map, from places seen by gate and signed distance."""
    seen = seen.reshape(GATES, -1)
    right, wrong = seen[:, COARSE:], seen[:, COARSE::-1]
    return (right + 20 * untrained()[1]) / (right + wrong + 20)


def count_bits(tables: list[np.ndarray], stream: Stream) -> None:
    """Add the symbols of texts to the tables [slot * 32 + symbol]."""
    if not len(stream.data):
        return
    for table, order in zip(tables, ORDERS):
        at = slots(order, stream.past, (len(table) >> 5).bit_length() - 1) << np.uint32(5) | stream.data
        at = np.sort(at)
        new = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        table[at[new]] += np.diff(np.append(new, len(at))).astype(table.dtype)


def counted(packs: DataFrame, alphabet: Alphabet, bits: tuple[int, ...]) -> tuple[list[np.ndarray], ...]:
    """Tables' codes from the first half of the training texts, the second, and all.  A
    task sends its counts that are not 0, piece by piece; a piece is made into codes where
    its counts meet, so the driver gets three bytes for each."""
    sizes = [32 << b for b in bits]
    first = np.cumsum([0, *sizes]) // PIECE

    def rows(tables, kind):
        for k, table in enumerate(tables):
            for i, piece in enumerate(table.reshape(-1, PIECE)):
                if len(at := np.flatnonzero(piece)):
                    yield pa.RecordBatch.from_arrays([pa.array([first[k] + i], pa.int64()), pa.array([kind], pa.int32()), pa.array([at.astype(np.uint16).tobytes()], pa.binary()), pa.array([piece[at].tobytes()], pa.binary())], names=["piece", "kind", "at", "n"])

    def count(parts):
        tables, later = [np.zeros(n, np.int32) for n in sizes], []

        def add(data):
            for q in unpacked(data, SEGMENT):
                count_bits(tables, Stream(q.column("text"), alphabet, hashes=False))

        for p in parts:
            for half, data in zip(p.column(0).to_pylist(), p.column(1)):
                if half == 2:
                    later.append(data)
                else:
                    add(data)
        yield from rows(tables, 1)
        if later:
            for t in tables:
                t[:] = 0
            for data in later:
                add(data)
            yield from rows(tables, 2)

    def fold(parts):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for p in parts:
            for piece, kind, at, n in zip(*(c.to_pylist() for c in p.columns)):
                if (piece, kind) not in sums:
                    sums[piece, kind] = np.zeros(PIECE, np.int64)
                sums[piece, kind][np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.int32)
        none = np.zeros(PIECE, np.int64)
        for piece in sorted({k[0] for k in sums}):
            first_, second = (sums.get((piece, kind), none) for kind in (1, 2))
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int64()), *(pa.array([tables_of(x).tobytes()], pa.binary()) for x in (first_, second, first_ + second))], names=["piece", "first", "second", "both"])

    got = packs.filter("half > 0").select("half", "data").mapInArrow(count, "piece long, kind int, at binary, n binary")
    # a table of its own, so that the counts' shuffle files can go
    got = saved(got.repartition(min(128, int(first[-1])), "piece").mapInArrow(fold, "piece long, first binary, second binary, both binary"), "counts")
    out = [np.full(int(first[-1]) * PIECE, 32, np.uint8) for _ in range(3)]
    for p in got.toArrow().to_batches():
        for i, piece in enumerate(p.column(0).to_pylist()):
            for table, c in zip(out, p.columns[1:]):
                table[piece * PIECE : (piece + 1) * PIECE] = np.frombuffer(c[i].as_buffer(), np.uint8)
    dropped(got)
    return tuple([t[first[k] * PIECE : first[k + 1] * PIECE].reshape(-1, 32) for k in range(len(sizes))] for t in out)


def recoded(alphabet: Alphabet):
    """A function that writes closed words as their symbols, in the upper five bits of
    a byte each: (offsets, bytes) from (offsets, bytes)."""

    def run(offsets, data):
        symbols, at = alphabet.symbols(data)
        return at[offsets], symbols << np.uint8(3)

    return run


def word_codes(offsets: np.ndarray, path: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, codes) of the chosen words from the paths: a row for each symbol from
    SKIP on, and none of other words."""
    size = np.where(chosen, np.maximum(np.diff(offsets) - SKIP, 0), 0)
    way = np.repeat(8 * (offsets[:-1] + SKIP) + np.arange(len(size)), size) + 8 * (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
    out = np.empty((len(way), 5), np.uint8)
    for k in range(5):
        every, on = path[way + k], path[way + k + 1]
        # seen from the bit that came: how often it did, and how often it did not
        out[:, k] = codes((every - on).astype(np.float32), on.astype(np.float32))
    return size, out


def coded(buckets: DataFrame) -> DataFrame:
    """(h, n, seen, code, first, second) of all words: hash, training count, count in all
    texts, codes of the prefixes' predictions from all training texts and, for words
    that stand in the first half of these, from the second half; and the other way round."""
    shared = buckets.sparkSession.sparkContext.broadcast((wordpaths.edges_of(buckets, "n"), wordpaths.edges_of(buckets, "m")))

    def run(parts):
        for bucket, offsets, data, counts in wordpaths.opened(parts):
            n, m = counts["n"], counts["m"]
            every, first = (wordpaths.paths(offsets, data, counts[c], *edge[bucket], bits=5) for c, edge in zip("nm", shared.value))
            columns = []
            for path, chosen in ((every, np.ones(len(n), bool)), (every - first, m > 0), (first, n > m)):
                size, code = word_codes(offsets, path, chosen)
                column = wordpaths.binary(5 * np.append(0, np.cumsum(size)), code.reshape(-1))
                columns.append(pc.if_else(pa.array(chosen), column, pa.scalar(None, pa.binary())))
            rows = pa.RecordBatch.from_arrays([pa.array(counts["h"]), pa.array(n), pa.array(counts["seen"]), *columns], names=["h", "n", "seen", "code", "first", "second"])
            for i in range(0, len(n), 1 << 15):
                yield rows.slice(i, 1 << 15)

    out = saved(buckets.repartition(F.col("bucket")).mapInArrow(run, "h long, n long, seen long, code binary, first binary, second binary"), "codes", compression="zstd")
    shared.destroy()
    return out


def unpacked(data: pa.Scalar, most: int):
    """The rows of a pack, in slices of about `most` bytes of text."""
    for p in pa.ipc.open_stream(data.as_buffer()):
        yield from textkit.batches(p, "text", most)


def words_of(packs: DataFrame, shared: Broadcast) -> DataFrame:
    """(pack, h): the words of each pack that are not among the sorted hashes `shared`."""

    def run(parts):
        listed = shared.value
        for p in parts:
            for pack, data in zip(p.column(0).to_pylist(), p.column(1)):
                got = [np.array([END_HASH])]
                for q in unpacked(data, PACK):
                    offsets, raw = textkit.buffers(q.column("text"))
                    starts, ends, _ = textkit.spans(offsets, raw)
                    got.append(np.unique(textkit.hash_words(raw, starts, ends, fold=True)))
                h = np.unique(np.concatenate(got))
                if len(listed):
                    h = h[listed[np.minimum(np.searchsorted(listed, h), len(listed) - 1)] != h]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), pack)), pa.array(textkit.signed(h))], names=["pack", "h"])

    return packs.select("pack", "data").mapInArrow(run, "pack long, h long")


def at_most(words: DataFrame, count: str, number: int) -> int:
    """The least count that at most `number` words reach, to a sixteenth of an octave."""
    step = F.ceil(F.log2(count) * 16).cast("int")
    total, best = 0, None
    for r in words.filter(F.col(count) > 0).groupBy(step.alias("k")).count().orderBy(F.desc("k")).collect():
        total += r["count"]
        if total > number:
            break
        best = r["k"]
    return math.floor(2 ** ((best - 1) / 16)) + 1 if best is not None else 1 << 62


def packed_texts(docs: DataFrame, learn: str, text: str, keep: tuple[str, ...]) -> DataFrame:
    """(pack, half, data): packs of rows of some megabytes of text, in a compressed
    column format, with the `keep` columns, text (null: empty) and part.  A pack's rows are
    all of one part, its half: 0 for rows that are only scored, 1 and 2 for the halves of
    those that are learned from, which equal texts share.  A pack's number ends in its
    half (two bits)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    chosen = F.coalesce(F.col(learn).cast("boolean"), F.lit(False))
    half = F.pmod(F.xxhash64(whole, F.lit(5)), F.lit(2)) + 1
    names = [*(f"k{i}" for i in range(len(keep))), "text", "part"]

    def run(parts):
        number = TaskContext.get().partitionId() << 32
        waiting, size = ([], [], []), [0, 0, 0]

        def pack(half):
            nonlocal number
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, waiting[half][0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for p in waiting[half]:
                    out.write_batch(p)
            waiting[half].clear()
            size[half], number = 0, number + 4
            return pa.RecordBatch.from_arrays([pa.array([number | half], pa.int64()), pa.array([half], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["pack", "half", "data"])

        for p in parts:
            for q in textkit.batches(pa.RecordBatch.from_arrays(p.columns, names=names), "text", SEGMENT):
                for half in range(3):
                    rows = q.filter(pc.equal(q.column("part"), half))
                    if rows.num_rows:
                        waiting[half].append(rows)
                        size[half] += rows.nbytes
                        if size[half] >= PACK:
                            yield pack(half)
        for half in range(3):
            if waiting[half]:
                yield pack(half)

    rows = docs.select(*keep, whole.alias("__text"), F.when(chosen, half).otherwise(0).cast("int").alias("__part"))
    return saved(rows.mapInArrow(run, "pack long, half int, data binary"), "packs")


def lessons(packs: DataFrame, codes_: DataFrame, alphabet: Alphabet, halves: tuple, frequent: pa.Table | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """learn() of all training texts, each half with the tables `halves` of the other;
    `frequent`: rows of codes_ that are broadcast."""
    numbers = np.cumsum([GATES * INPUTS * INPUTS, GATES * INPUTS, GATES * (2 * COARSE + 1)])
    common = [Codes.of(*(frequent.column(c).combine_chunks() for c in ("h", "n", half))) if frequent is not None else Codes.none() for half in ("first", "second")]
    shared = [packs.sparkSession.sparkContext.broadcast(x) for x in (*zip(map(Ways, halves[::-1]), common), common[0].hashes)]

    def run(left, right):
        # what earlier stages left in this worker
        given_back()
        (data,) = left.column("data")
        ways, known = shared[left.column("half")[0].as_py() - 1].value
        known = known | Codes.of(*(right.column(c).combine_chunks() for c in ("h", "n", "code")))
        got = learn(ways, ((Stream(q.column("text"), alphabet), known) for q in unpacked(data, BATCH)))
        return pa.Table.from_batches([*dense.pieces(np.concatenate([x.reshape(-1) for x in got]))])

    training = packs.filter("half > 0")
    code = F.when(F.col("pack").bitwiseAND(F.lit(3)) == 1, F.col("first")).otherwise(F.col("second"))
    needed = words_of(training, shared[2]).join(codes_.select("h", "n", "first", "second"), "h").select("pack", "h", "n", code.alias("code"))
    parts = training.select("pack", "half", "data").groupBy("pack").cogroup(needed.groupBy("pack")).applyInArrow(run, dense.SCHEMA)
    # a table of its own, so that the words' shuffle files can go, and the tables' copies on every executor's disk
    parts = saved(parts, "lessons")
    for x in shared:
        x.destroy()
    curve, pull, seen = np.split(dense.folded(parts, (int(numbers[-1]),)), numbers[:-1])
    dropped(parts)
    return curve.reshape(GATES, INPUTS, INPUTS), pull.reshape(GATES, INPUTS), seen


def trained(packs: DataFrame, codes_: DataFrame, alphabet: Alphabet, distinct: int, frequent: pa.Table | None = None) -> Model:
    """The model: counts, gated weights and the map, all of all training texts."""
    first, second, both = counted(packs, alphabet, slot_bits(distinct))
    curve, pull, seen = lessons(packs, codes_, alphabet, (first, second), frequent)
    weights = np.linalg.solve(curve + HELD * np.eye(INPUTS), (pull + HELD * START)[:, :, None])[:, :, 0].T
    return Model(alphabet, both, weights, map_of(seen))


def vocabulary(packs: DataFrame) -> DataFrame:
    """wordpaths.vocabulary() of packs."""
    return wordpaths.vocabulary(packs.select("data"), lambda p: (q for data in p.column(0) for q in unpacked(data, 2 * PACK)))


def alphabet_of(words: DataFrame) -> Alphabet:
    """The most frequent bytes of the training words."""

    def task(parts):
        out = np.zeros(256)
        for p in parts:
            offsets, data = wordpaths.bytes_of(p.column(0))
            out += np.bincount(data, np.repeat(p.column(1).to_numpy().astype(np.float64), np.diff(offsets)), minlength=256)
        return out

    return Alphabet(dense.total(words.select("word", "n"), (256,), task))


def score(docs: DataFrame, learn: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns with n_bytes, n_tokens (words and one end), n_known
    (tokens that occur in training), train_tokens, base_score (log10 probability
    under smoothed single-token counts), score (the mixing model's, of the same
    tokens) and bits_per_byte (null for an empty text).

    `learn`: boolean column, true for rows to learn from; null counts as false.  A null
    text counts as empty: one token, its end.  Repeated rows stay, and teach as often as
    they stand there.  With nothing to learn from every token is unknown and the model
    is untrained.  Long texts are scored a segment at a time with the state carried on.
    """
    spark = docs.sparkSession
    packs = packed_texts(docs, learn, text, keep)
    words = saved(vocabulary(packs), "words", compression="zstd")
    distinct, total = words.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    alphabet = alphabet_of(words)
    buckets = wordpaths.sorted_buckets(words, recoded(alphabet))
    codes_ = coded(buckets)
    listed = codes_.filter(F.col("seen") >= at_most(words, "seen", FREQUENT)).toArrow()
    # all that is read from here on is in the codes and the packs
    dropped(buckets)
    dropped(words)
    model = trained(packs, codes_, alphabet, distinct, listed)
    common = Codes.of(*(listed.column(c).combine_chunks() for c in ("h", "n", "code")))
    del listed
    needed = words_of(packs, spark.sparkContext.broadcast(common.hashes)).join(codes_.select("h", "n", "code"), "h").select("pack", "h", "n", "code")
    shared = spark.sparkContext.broadcast((model, common))
    bottom = math.log10(total + 0.5 * (distinct + 1))
    out = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(n, t) for n, t in (("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()), ("bits_per_byte", T.DoubleType())))])

    def run(left, right):
        given_back()
        model, common = shared.value
        known = common | Codes.of(*(right.column(c).combine_chunks() for c in ("h", "n", "code")))
        done = []
        for data in left.column("data"):
            for q in unpacked(data, BATCH):
                stream = Stream(q.column("text"), model.alphabet)
                bits, n = model.bits(stream, known)
                first = stream.words[:-1]
                size = stream.n_bytes
                done.append(
                    pa.RecordBatch.from_arrays(
                        [
                            *(q.column(i) for i in range(len(keep))),
                            pa.array(size),
                            pa.array(np.diff(stream.words)),
                            pa.array(np.add.reduceat((n > 0).astype(np.int64), first)),
                            pa.array(np.full(len(bits), total, np.int64)),
                            pa.array(np.add.reduceat(np.log10(n + 0.5) - bottom, first)),
                            pa.array(-bits * math.log10(2)),
                            pa.array(bits / np.maximum(size, 1), mask=size == 0),
                        ],
                        names=out.names,
                    )
                )
        return pa.Table.from_batches(done)

    return packs.select("pack", "data").groupBy("pack").cogroup(needed.groupBy("pack")).applyInArrow(run, out)
