"""The mixing model against a plain version, and what a language model must do."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabulint.llm import contextmix, wordpaths

FOLD = {i: i + 32 for i in range(65, 91)}
WORD = re.compile(r"[^ \t-\r]+")


def words(text):
    return [w.encode() + b" " for w in WORD.findall((text or "").translate(FOLD))]


def flagged(docs):
    return docs.withColumn("learn", F.coalesce(F.col("doc_id") % 5 != 1, F.lit(False)))


def fitted(docs):
    """The model as score() fits it, and the prefix counts, by plain counting."""
    packs = contextmix.packed_texts(docs, "learn", "text", ("doc_id",))
    vocabulary = contextmix.vocabulary(packs)
    distinct = vocabulary.filter("n > 0").count()
    alphabet = contextmix.alphabet_of(vocabulary)
    return contextmix.trained(packs, contextmix.coded(wordpaths.sorted_buckets(vocabulary, contextmix.recoded(alphabet))), alphabet, distinct)


class Plain:
    """Bits of a text, one after the other, from training texts and a model's weights."""

    def __init__(self, texts, model):
        self.model, self.slot_bits = model, [len(t).bit_length() - 1 for t in model.tables]
        count = Counter(b for t in texts for w in [*words(t), b"\n"] for b in w)
        top = sorted(range(256), key=lambda b: (-count[b], b))[:31]
        self.symbol = {b: top.index(b) if b in top else 31 for b in range(256)}
        self.tables, self.prefixes = [Counter() for _ in contextmix.ORDERS], Counter()
        for t in texts:
            stream = self.symbols(b"".join(words(t)) + b"\n")
            for i, v in enumerate(stream):
                for k, slot in enumerate(self.slots(stream, i)):
                    self.tables[k][slot, v] += 1
            for w in [*words(t), b"\n"]:
                way = "".join(f"{v:05b}" for v in self.symbols(w))
                self.prefixes.update(way[:j] for j in range(len(way) + 1))

    def symbols(self, raw):
        out = []
        for b in raw:
            out += [self.symbol[b]] if self.symbol[b] < 31 else [31, b >> 4, b & 15]
        return out

    def slots(self, stream, i):
        past = sum((stream[i - j] if i >= j else 31) << 5 * (j - 1) for j in range(1, 7))
        for order, bits in zip(contextmix.ORDERS, self.slot_bits):
            x = past % (1 << 5 * order)
            yield x if 5 * order <= bits else (x * contextmix._SPREAD % 2**32) >> 32 - bits

    @staticmethod
    def code(n0, n1, bit):
        """(input for a 1 turned to the bit that came, level)."""
        n = n0 + n1
        x = math.log((n1 + 0.4) / (n0 + 0.4)) * (n / (n + 0.6)) if n else 0.0
        q = max(-31, min(31, int(np.rint(x * 4))))
        return (q if bit else -q) / 4, (n > 0) + (n > 2) + (n > 30)

    def inputs(self, stream, i, prefix, last):
        """For each bit of symbol i: (inputs, gate); prefix: the word's bits before, or
        None where it has no codes."""
        v, slots = stream[i], list(self.slots(stream, i))
        for k in range(5):
            bit, x, levels = v >> 4 - k & 1, [], []
            fit = [u for u in range(32) if u >> 5 - k == v >> 5 - k]
            for t, slot in zip(self.tables, slots):
                n = [sum(t[slot, u] for u in fit if u >> 4 - k & 1 == b) for b in (0, 1)]
                value, level = self.code(*n, bit)
                x.append(value)
                levels.append(level)
            if prefix is None:
                value, level = 0.0, 0
            else:
                way = prefix + f"{v:05b}"[:k]
                value, level = self.code(self.prefixes[way + "0"], self.prefixes[way + "1"], bit)
            x.append(value)
            expected, run = last
            if expected is None or expected >> 5 - k != v >> 5 - k:
                x.append(0.0)
                known = 0
            else:
                kind = sum(run >= r for r in (1, 6, 16, 32))
                strength = (4, 10, 16, 22, 28)[kind] / 4
                x.append(strength if expected >> 4 - k & 1 == bit else -strength)
                known = min(kind, 2) + 1
            yield x, level * 16 + known * 4 + levels[1]

    def score(self, text):
        raw = [*words(text), b"\n"]
        stream = self.symbols(b"".join(raw))
        word_places = [j for w in raw for j in range(len(self.symbols(w)))]
        own, seen = [1.0, 0.0], Counter()
        trained = self.model.map.mean(0)
        places, run, prefix, total, i = {}, 0, "", 0.0, 0
        limits = [64, 128, 256]
        while i < len(stream):
            limit = limits.pop(0) if limits else i + 512 - i % 512
            grads, cells, n = [0.0, 0.0], [], 0
            for i in range(i, min(limit, len(stream))):
                key = tuple(stream[i - j] if i >= j else 31 for j in range(6, 0, -1))
                place = places.get(key)
                expected = stream[place] if place is not None else None
                prefix = "" if word_places[i] == 0 else prefix
                for x, gate in self.inputs(stream, i, prefix if word_places[i] >= 3 else None, (expected, run)):
                    w = self.model.weights[:, gate].tolist()
                    corpus, last = sum(a * b for a, b in zip(w, x)), x[-1]
                    s = max(-256, min(256, int(np.rint(np.float32((own[0] * corpus + own[1] * last) * 256 / 12)))))
                    p, side, far = 1 / (1 + math.exp(-s * 12 / 256)), (s > 0) - (s < 0), (abs(s) + 4) // 8
                    adapted = (seen[far] + 64 * trained[far]) / (seen[far] + (seen[-far] if far else seen[0]) + 64) if far else 0.5
                    adapted = adapted if side >= 0 else 1 - (seen[far] + 64 * trained[far]) / (seen[far] + seen[-far] + 64) if far else 0.5
                    final = (p + 0.5 + side * (self.model.map[gate, far] - 0.5) + adapted) / 3
                    total -= math.log2(final)
                    grads = [grads[0] + (1 - final) * corpus, grads[1] + (1 - final) * last]
                    cells.append(side * far)
                    n += 1
                run = run + 1 if expected == stream[i] else 0
                places[key] = i
                prefix += f"{stream[i]:05b}"
            i += 1
            own = [o + contextmix.RATE * g / (n + 64) for o, g in zip(own, grads)]
            seen.update(cells)
        return total


def test_scores_equal_a_plain_version(spark, docs, rows):
    """Twenty texts: the counts of all training texts, and every bit in its place."""
    train = [r[1] for r in rows if r[0] is not None and r[0] % 5 != 1 and len(r[1] or "") < 10_000]
    small = docs.filter("text is null or length(text) < 10000")
    got = contextmix.score(flagged(small), "learn").collect()
    plain = Plain(train, fitted(flagged(small)))
    text_of = {r[0]: r[1] for r in rows}
    chosen = [r for r in got if r.doc_id is not None][:20]
    assert len(chosen) == 20
    for r in chosen:
        assert -r.score / math.log10(2) == pytest.approx(plain.score(text_of[r.doc_id]), rel=2e-3)


def test_counts_and_base(docs, rows):
    got = contextmix.score(flagged(docs), "learn").collect()
    count = Counter()
    for r in rows:
        if r[0] is not None and r[0] % 5 != 1:
            count.update([*words(r[1]), None])
    n, v = sum(count.values()), len(count)
    by = {r[0]: [*words(r[1]), None] for r in rows}
    assert len(got) == len(rows)
    for r in got:
        w = by[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(count[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        assert r.score < 0 and math.isfinite(r.score)
        assert (r.bits_per_byte is None) == (r.n_bytes == 0)
    same = {r.score for r in got if by[r.doc_id] == by[6]}
    assert max(same) - min(same) < 1e-6


def prose(rnd, n, chain):
    out = ["the"]
    while len(out) < n:
        out.append(rnd.choice(chain[out[-1]]))
    return " ".join(out)


@pytest.fixture(scope="module")
def chained():
    """Words of which each has four that may follow."""
    rnd = random.Random(3)
    names = ["the", *("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 8))) for _ in range(300))]
    chain = {w: [rnd.choice(names) for _ in range(4)] for w in names}
    return [prose(rnd, 120, chain) for _ in range(400)]


def test_order_repeats_and_held_out_prose(spark, chained):
    rnd = random.Random(8)
    held = chained[360:]
    shuffled = [" ".join(rnd.sample(t.split(), len(t.split()))) for t in held]
    odd = " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(60))
    texts = [(i, t, i < 360) for i, t in enumerate([*chained, *shuffled, odd, *[" ".join([odd] * 8)]])]
    got = {r.doc_id: r for r in contextmix.score(spark.createDataFrame(texts, "doc_id long, text string, learn boolean"), "learn").collect()}
    in_order, mixed = (sum(got[i].score for i in at) for at in (range(360, 400), range(400, 440)))
    assert in_order > mixed + 0.3 * 40 * 120 * math.log10(2)  # well over a quarter of a bit a word
    assert got[441].score > 2.5 * got[440].score  # eight times the text, well under eight times the bits
    # tokens' smoothed counts know all these words, and pay nothing for their spelling
    assert in_order > sum(got[i].base_score for i in range(360, 400))


def test_is_a_probability(spark, docs):
    """Whatever stands before, a bit and its opposite share out the whole."""
    model = fitted(flagged(docs))
    rng = np.random.default_rng(1)
    kinds = len(contextmix.ORDERS)
    for _ in range(50):
        before = [rng.integers(1, 64, (contextmix.INPUTS, 40, 5)).astype(np.uint8) | rng.integers(0, 4, (contextmix.INPUTS, 40, 5)).astype(np.uint8) << np.uint8(6)][0]
        state, data = model.fresh(1), rng.integers(0, 32, 40).astype(np.uint8)
        model._along(before, data, np.zeros(40, np.int64), np.zeros(40, np.int64), state, np.zeros(1))
        one = before[:, :1].copy()
        p = []
        for bit in (0, 1):
            x, total = one.copy(), np.zeros(1)
            if not bit:  # codes seen from the bit that came are turned over with it
                x[kinds:, 0, 0] = x[kinds:, 0, 0] & 192 | 64 - (x[kinds:, 0, 0] & 63)
            x[:, :, 1:] = 32  # the other bits of the symbol cost one each
            own = tuple(a.copy() for a in state)
            model._along(x, np.array([bit << 4], np.uint8), np.zeros(1, np.int64), np.zeros(1, np.int64), own, total)
            p.append(2.0 ** -(total[0] - 4))
        assert sum(p) == pytest.approx(1.0, abs=1e-5)


def test_symbols_can_be_read_back():
    alphabet = contextmix.Alphabet(np.bincount(np.frombuffer("the cat sat on the mat, zéro".encode(), np.uint8), minlength=256))
    back = {int(s): b for b, s in enumerate(alphabet.symbol) if s < 31}
    raw = bytes(range(256)) * 3
    symbols, at = alphabet.symbols(np.frombuffer(raw, np.uint8))
    out, i = [], 0
    while i < len(symbols):
        v = int(symbols[i])
        out.append(back[v] if v < 31 else int(symbols[i + 1]) << 4 | int(symbols[i + 2]))
        i += 1 if v < 31 else 3
    assert bytes(out) == raw and at[-1] == len(symbols)


def test_long_texts_go_by_segments(spark, chained, monkeypatch):
    """State and contexts are carried on: only what the last place can see differs."""
    long_text = " ".join(chained[:60])
    table = spark.createDataFrame([(0, long_text, False), *((i, t, True) for i, t in enumerate(chained[60:], 1))], "doc_id long, text string, learn boolean")
    whole = contextmix.score(table, "learn").filter("doc_id = 0").first()
    model = fitted(table)
    stream = contextmix.Stream(pa.array([long_text]), model.alphabet)
    none = contextmix.Codes.none()
    one = model.bits(stream, none)[0][0]
    monkeypatch.setattr(contextmix, "SEGMENT", 1 << 13)
    assert model.bits(stream, none)[0][0] == pytest.approx(one, rel=0.03)
    assert whole.n_bytes == len(long_text)


def test_without_training(docs, nothing):
    never = docs.withColumn("learn", F.lit(False))
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in contextmix.score(never, "learn").collect())
    assert contextmix.score(nothing.withColumn("learn", F.lit(True)), "learn").count() == 0
    assert contextmix.score(docs.withColumn("learn", F.lit(None).cast("boolean")), "learn").filter("train_tokens > 0").count() == 0


def test_every_prefix_over_all_buckets(spark, docs, rows, monkeypatch):
    """The paths of all words, over the edges of many buckets, are the counts of
    words with these leading bits, and the scores do not depend on the buckets."""
    table = flagged(docs)
    packs = contextmix.packed_texts(table, "learn", "text", ("doc_id",))
    vocabulary = contextmix.vocabulary(packs).persist()
    recode = contextmix.recoded(contextmix.alphabet_of(vocabulary))
    written = lambda w: recode(np.array([0, len(w)]), np.frombuffer(w, np.uint8))[1].tobytes()
    count = Counter(written(w) for r in rows if r[0] is not None and r[0] % 5 != 1 for w in [*words(r[1]), b"\n"])
    every = sorted(map(written, {w for r in rows for w in [*words(r[1]), b"\n"]}))
    bit_text = lambda w: "".join(f"{b:08b}" for b in w)
    short = [w for w in every if len(w) <= 64]
    expected = Counter()
    for w in every:
        for b in range(8 * min(len(w), 64) + 1):
            expected[bit_text(w[:64])[:b]] += count[w]
    one = {r["doc_id"]: r["score"] for r in contextmix.score(table, "learn").collect()}
    monkeypatch.setattr(wordpaths, "BUCKET", 500)
    buckets = wordpaths.sorted_buckets(vocabulary, recode)
    assert buckets.count() > 20
    ends, seen = wordpaths.edges_of(buckets, "n"), []
    for batch in buckets.toArrow().to_batches():
        for bucket, offsets, data, counts in wordpaths.opened([batch]):
            path = wordpaths.paths(offsets, data, counts["n"], *ends[bucket])
            assert np.array_equal(path, wordpaths.paths(offsets, data, counts["n"], *ends[bucket], bits=5))
            inside = wordpaths.paths(offsets, data, counts["n"])
            assert np.array_equal(inside[: 8 * offsets[1] + 1], wordpaths.end_path(offsets, data, counts["n"]))
            assert np.array_equal(inside[8 * offsets[-2] + len(counts["n"]) - 1 :], wordpaths.end_path(offsets, data, counts["n"], True))
            for i in range(len(counts["n"])):
                w = data[offsets[i] : offsets[i + 1]].tobytes()
                seen.append(w)
                if len(w) <= 64:
                    at = 8 * offsets[i] + i
                    assert path[at : at + 8 * len(w) + 1].tolist() == [expected[bit_text(w)[:b]] for b in range(8 * len(w) + 1)]
    assert sorted(seen) == every and len(short) > 500
    vocabulary.unpersist()
    many = {r["doc_id"]: r["score"] for r in contextmix.score(table, "learn").collect()}
    assert many == pytest.approx(one, rel=1e-6)


def test_weights_come_from_all_training_texts(spark, docs, rows):
    """Every bit of every training text is a lesson, once, predicted from the other half."""
    packs = contextmix.packed_texts(flagged(docs), "learn", "text", ("doc_id",))
    words_ = contextmix.vocabulary(packs)
    alphabet = contextmix.alphabet_of(words_)
    codes = contextmix.coded(wordpaths.sorted_buckets(words_, contextmix.recoded(alphabet)))
    first, second, both = contextmix.counted(packs, alphabet, contextmix.slot_bits(1))
    curve, _, seen = contextmix.lessons(packs, codes, alphabet, (first, second), codes.filter("seen > 1").toArrow())
    train = [r[1] for r in rows if r[0] is not None and r[0] % 5 != 1]
    assert seen.sum() == 5 * len(contextmix.Stream(pa.array([t or "" for t in train]), alphabet).data)
    assert (np.linalg.eigvalsh(curve) > -1e-2).all()
    # the words beyond the broadcast ones are joined: the same lessons
    joined = contextmix.lessons(packs, codes, alphabet, (first, second))
    assert joined[0] == pytest.approx(curve, rel=1e-3, abs=1e-2) and joined[2] == pytest.approx(seen, abs=5)
    halves = {r.text: set() for r in docs.select(F.coalesce("text", F.lit("")).alias("text")).collect()}
    for half, data in ((r.half, r.data) for r in packs.filter("half > 0").collect()):
        for q in contextmix.unpacked(pa.scalar(bytes(data), pa.binary()), 1 << 20):
            for t in q.column("text").to_pylist():
                halves[t].add(half)
    assert max(map(len, halves.values())) == 1 and set.union(*halves.values()) == {1, 2}


def test_what_only_training_reads_goes(spark, docs, monkeypatch):
    """Of tables and broadcasts, those stay that the scores are read from."""
    made = []
    send = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: made.append((value, send(self, value))) or made[-1][1])
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.iterdir())
    out = contextmix.score(flagged(docs), "learn")
    assert sorted(p.name.split("-")[0] for p in set(folder.iterdir()) - before) == ["codes", "packs"]
    left = [value for value, b in made if Path(b._path).exists()]
    assert len(made) > len(left) == 2 and sum(isinstance(x, tuple) for x in left) == 1
    assert out.count() == docs.count()


def test_equal_codes_are_one_lesson(chained, monkeypatch):
    """The codes are those along each symbol's way, and a lesson is worked through once,
    however often its codes stand there."""
    raw = np.frombuffer(" ".join(chained).encode(), np.uint8)
    alphabet = contextmix.Alphabet(np.bincount(raw, minlength=256))
    stream = contextmix.Stream(pa.array([*chained[200:], "Zéro ~ 漢字"]), alphabet)
    tables = [np.zeros(32 << b, np.int32) for b in contextmix.slot_bits(1)]
    contextmix.count_bits(tables, contextmix.Stream(pa.array(chained[:200]), alphabet))
    tables = [contextmix.tables_of(t) for t in tables]
    ways, size = contextmix.Ways(tables), len(stream.data)
    code = contextmix.predictions(ways, stream, contextmix.Codes.none(), 0, size)[0]
    for i in range(0, size, 997):
        v = int(stream.data[i])
        for table, order, got in zip(tables, contextmix.ORDERS, code):
            row = table[contextmix.slots(order, stream.past[i : i + 1], len(table).bit_length() - 1)[0]]
            for d in range(5):
                c = int(row[1 << d | v >> 5 - d])
                assert got[d, i] == (c if v >> 4 - d & 1 else c & 192 | 64 - (c & 63))
    kept = code.reshape(contextmix.INPUTS, -1).copy()
    kept[[0, 2]] &= 63
    expected, counts = np.unique(kept, axis=1, return_counts=True)
    assert sorted(contextmix.distinct(code)[1].tolist()) == sorted(counts.tolist())
    columns, plain = [], contextmix.newton
    monkeypatch.setattr(contextmix, "newton", lambda *a: (columns.append(a[2].shape[1]), plain(*a))[1])
    curve, _, seen = contextmix.learn(ways, [(stream, contextmix.Codes.none())])
    assert seen.sum() == 5 * size and sum(columns) == expected.shape[1] < size
    # bit by bit, at the weights that the steps came to: about the same curvature
    gate = contextmix.gates(code).reshape(-1)
    assert set(np.flatnonzero(seen.sum(1))) == set(np.unique(gate)) and (seen.sum(1) == np.bincount(gate, minlength=contextmix.GATES)).all()
    assert (np.linalg.eigvalsh(curve) > -1e-2).all()


def test_last_places_of_very_many_texts():
    """Beyond the texts that a key has room for, hashes of them find the same places."""
    some = ["ab ab abc ab ab", "", "abcabcabcabc abcabcabd", "x" * 40]
    alphabet = contextmix.Alphabet(np.bincount(np.frombuffer("".join(some).encode() + b" \n", np.uint8), minlength=256))
    few, many = (contextmix.Stream(pa.array(some * n), alphabet) for n in (1, 1 << 15))
    assert len(many.data).bit_length() + 30 + (len(many.bounds) - 2).bit_length() > 64
    expected = contextmix.last_places(few, 0, len(few.data))
    assert expected.any() and np.array_equal(contextmix.last_places(many, 0, len(many.data)).reshape(-1, len(expected)), np.tile(expected, (1 << 15, 1)))
