"""Finding benchmark items, also reworded ones, by latent semantic retrieval.

1. The words of the benchmark are the terms; a scan counts them over all texts.
   Terms that make up more than a thousandth of all words (of 20,000 at least) are stop
   words.  All get inverse-frequency weights, stop words half of theirs.
2. Texts are cut into passages of 32 words.  A distributed randomised singular
   value decomposition of their TF-IDF matrix A takes one scan, which sums
   Y = A'(A G) for a random orthonormal G; the Nystrom form Y (G'Y)^-1 Y' of A'A
   then gives the leading singular values and vectors.  Texts and items are
   folded in: V' x over the roots of the singular values, so that neither the few
   directions that all passages share nor those of single words decide.
3. Every 32-word window, one each 16 words, of every text is compared by exact
   cosine in that space with every piece of every item, in blocks; items of fewer
   words are compared with windows of 16, 8 or 4, no longer than they are.
4. A window near enough is a match if the longest common subsequence of the item and
   the text around the window covers most of the item: words may be replaced, left out
   or put in.  Or, for a paraphrase with clauses in another order, if the window is
   nearer still, words with half the weight of the item's are there, and the longest
   common subsequences of all words, and of those that are not stop words, cover a good
   part of them.  The item's answer must be there, if it has one.  Subsequences are not computed where
   too few of the item's words are.
5. Items that stand in a text word for word are found from their rarest word,
   whatever the cosine.

There is one space for the whole benchmark, so that an item is found or not whatever
else is searched for.  Nothing is shuffled but sums that are as large as the
benchmark; a text is judged inside one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulint.llm import dense, textkit

#: Dimensions of the space: RANK at least, one for PER_RANK items, MOST_RANK at most.
RANK, PER_RANK, MOST_RANK, EXTRA = 64, 4, 512, 8
PASSAGE = 32
#: Words of the windows; an item has the longest that is no longer than itself.
SIZES = (4, 8, 16, PASSAGE)
#: Items that are broadcast and searched for at a time; more go in further scans, in the same space.
ITEMS = 5_000
#: Cells of the largest table of items by terms that is laid out whole (a byte each).
MATRIX = 1 << 25
#: Rows that run_sums() adds to one where runs are long.
PART = 16
STOP = 1e-3
#: Stop words have this share of their weight, and weigh less than any other word.
LIGHT, COMMON = 0.5, 2.0
#: Least cosine, and share of an item's words in the common subsequence.
NEAR, COVERED = 0.4, 0.6
#: For paraphrases: least cosine, share of the weight that is there, share of the words
#: in the common subsequence, and of those other than stop words in theirs.
NEARER, WEIGHT, PARTLY, IN_ORDER = 0.6, 0.5, 0.4, 0.35


class Terms:
    """The benchmark's words: a table by 20 bits of the hash finds the few words
    of a text that can be terms, the full hash decides."""

    def __init__(self, words: np.ndarray):
        self.words = np.unique(words)
        order = np.argsort(self.words)
        self.words = self.words[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.words >> np.uint64(44)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in h that hold a term, their terms)."""
        at = np.flatnonzero(self.maybe[h >> np.uint64(44)])
        k = np.minimum(np.searchsorted(self.words, h[at]), len(self.words) - 1)
        same = self.words[k] == h[at]
        return at[same], k[same]


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets, data = textkit.buffers(texts)
    starts, ends, first = textkit.spans(offsets, data)
    return textkit.hash_words(data, starts, ends, fold=True), first


def _slices(parts, column: int, most: int = 1 << 18):
    for p in parts:
        for q in textkit.batches(p, p.schema.names[column], most):
            yield q, *_words(q.column(column))


def groups(first: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the first piece of each text, piece of each position) for
    pieces of `size` words that do not cross texts."""
    base = np.append(0, np.cumsum(-(-np.diff(first) // size)))
    text = np.searchsorted(first, at, side="right") - 1
    return base, base[text] + (at - first[text]) // size


def run_sums(rows: np.ndarray, which: np.ndarray, start: np.ndarray, scale: np.ndarray | None = None) -> np.ndarray:
    """Sums of rows[which] (times `scale`) over the short runs that begin at `start`: all
    runs' first rows at once, then their second ones, and so on."""
    many = np.diff(np.append(start, len(which)))
    take = lambda at: rows[which[at]] if scale is None else scale[at][:, None] * rows[which[at]]
    out = take(start)
    for j in range(1, int(many.max(initial=1))):
        longer = np.flatnonzero(many > j)
        out[longer] += take(start[longer] + j)
    return out


def weights(texts: DataFrame, terms: Terms) -> np.ndarray:
    """A weight per term, that of stop words below COMMON."""
    shared = texts.sparkSession.sparkContext.broadcast(terms)

    def task(parts):
        out = np.zeros(len(shared.value.words) + 1)
        for _, h, _ in _slices(parts, 0):
            out[:-1] += np.bincount(shared.value.find(h)[1], minlength=len(out) - 1)
            out[-1] += len(h)
        return out

    n = dense.total(texts, (len(terms.words) + 1,), task)
    weight = np.log((n[-1] + 2) / (n[:-1] + 1))
    common = n[:-1] > STOP * max(n[-1], 20_000)
    return np.where(common, np.minimum(LIGHT * weight, 0.99 * COMMON), np.maximum(weight, COMMON)).astype(np.float32)


def gram_times(texts: DataFrame, terms: Terms, weight: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A'(A basis) over all passages, rows of A scaled to length one."""
    shared = texts.sparkSession.sparkContext.broadcast((terms, weight, basis.astype(np.float32)))

    def task(parts):
        terms, weight, basis = shared.value
        out = np.zeros(basis.shape)
        for _, h, first in _slices(parts, 0):
            at, k = terms.find(h)
            keep = weight[k] > 0
            at, k = at[keep], k[keep]
            if not len(k):
                continue
            _, passage = groups(first, at, PASSAGE)
            w, row = weight[k], k
            start = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
            own = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(k))))
            y = run_sums(basis, row, start, w) / np.add.reduceat(w * w, start)[:, None]
            # short numbers are sorted by their digits
            order = np.argsort(row.astype(np.uint16) if len(basis) <= 1 << 16 else row, kind="stable")
            row = row[order]
            bounds = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            # long runs in parts, then the parts' sums
            parts = -(-np.diff(np.append(bounds, len(row))) // PART)
            first_part = np.cumsum(parts) - parts
            start = np.repeat(bounds - PART * first_part, parts) + PART * np.arange(parts.sum())
            out[row[bounds]] += np.add.reduceat(run_sums(y, own[order], start, w[order]), first_part, axis=0)
        return out

    return dense.total(texts, basis.shape, task)


def latent_space(texts: DataFrame, terms: Terms, weight: np.ndarray, rank: int = RANK) -> np.ndarray:
    """A row per term: what an occurrence of it adds to a folded-in vector."""
    width = min(rank + EXTRA, len(weight))
    g = np.linalg.qr(np.random.default_rng(7).standard_normal((len(weight), width)))[0]
    y = gram_times(texts, terms, weight, g)
    # a small shift keeps the root stable
    shift = 1e-7 * max(float(np.linalg.norm(y)), 1e-9)
    y = y + shift * g
    small = g.T @ y
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    ok = values > 1e-9 * values.max()
    left, singular, _ = np.linalg.svd(y @ (vectors[:, ok] / np.sqrt(values[ok])), full_matrices=False)
    # the squares of `singular` are the eigenvalues of A'A
    best = singular[:rank] > 1e-5 * singular.max()
    basis = left[:, :rank][:, best] / np.sqrt(singular[:rank][best])
    return (weight[:, None] * basis).astype(np.float32)


def stepped(terms: Terms, vectors: np.ndarray, at: np.ndarray, k: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors of the pieces of `size` words that do not cross texts, number of the
    first piece of each text)."""
    base, step = groups(first, at, size)
    out = np.zeros((base[-1] + 1, vectors.shape[1]), np.float32)
    if len(k):
        start = np.flatnonzero(np.append(True, step[1:] != step[:-1]))
        out[step[start]] = run_sums(vectors, k, start)
    return out, base


def doubled(steps: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """stepped() of twice the size."""
    wide = np.append(0, np.cumsum(-(-np.diff(base) // 2)))
    text = np.repeat(np.arange(len(wide) - 1), np.diff(wide))
    left = base[text] + 2 * (np.arange(wide[-1]) - wide[text])
    out = np.zeros((wide[-1] + 1, steps.shape[1]), np.float32)
    out[:-1] = steps[left]
    both = np.flatnonzero(left + 1 < base[text + 1])
    out[both] += steps[left[both] + 1]
    return out, wide


def windows(steps: np.ndarray, base: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, first words, texts) of the windows of `size` words, one each half of
    that, that hold a term; a text's last window is what is left.  steps, base: of half
    the size."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(base))
    both = steps[:-1] + steps[1:]
    last = base[1:][np.diff(base) > 0] - 1
    both[last] = steps[last]
    use = np.flatnonzero(np.einsum("ij,ij->i", both, both))
    return both[use], first[text[use]] + (use - base[text[use]]) * (size // 2), text[use]


class Places:
    """Places of words, for bit-parallel subsequence lengths."""

    def __init__(self, words: list[int]):
        self.n, self.places = len(words), {}
        for i, w in enumerate(words):
            self.places[w] = self.places.get(w, 0) | 1 << i

    def common(self, words: list[int]) -> int:
        """Length of the longest common subsequence."""
        full = (1 << self.n) - 1
        v = full
        for w in words:
            if m := self.places.get(w):
                u = v & m
                v = (v + u | v - u) & full
        return self.n - v.bit_count()


class Item:
    """An item's words, those that are not stop words, and its answer's."""

    def __init__(self, key, words: np.ndarray, content: np.ndarray, answer: list[int]):
        self.key, self.n, self.answer = key, len(words), answer
        self.all, self.content = Places(words.tolist()), Places(content.tolist())

    def answered(self, words: list[int]) -> bool:
        n = len(self.answer)
        return not n or any(words[i : i + n] == self.answer for i in range(len(words) - n + 1))

    def match(self, words: list[int], covered: float, like: bool) -> float:
        """Share of the common subsequence if the words are a match, or 0; `like`:
        they may be a paraphrase."""
        share = self.all.common(words) / self.n
        if share < covered and not (like and share >= PARTLY and self.content.n and self.content.common(words) >= IN_ORDER * self.content.n):
            return 0.0
        return share if self.answered(words) else 0.0


class Pieces:
    """The pieces of the items that go with windows of one size: vectors of length
    one, their lengths before, and each piece's item."""

    def __init__(self, vectors: list[np.ndarray], owner: list[int], rank: int):
        self.vectors, self.owner = np.array(vectors, np.float32).reshape(len(vectors), rank), np.array(owner, np.int64)
        self.length = np.maximum(np.linalg.norm(self.vectors, axis=1), 1e-9)
        self.vectors /= self.length[:, None]


class Bench:
    """The items of a scan, their pieces by window size, their words, of which `need`
    occurrences must be near a match to cover the item, and their rarest words' places,
    by term."""

    def __init__(self, rows: list, words: list[np.ndarray], answers: list[np.ndarray], terms: Terms, weight: np.ndarray, vectors: np.ndarray, covered: float):
        self.items, self.words, anchors, found, keys = [], [], [], {}, []
        self.weight, whole = weight, []
        for (key, _, _), h, answer in zip(rows, words, answers):
            if not len(h):
                continue
            k = terms.find(h)[1]  # every word of an item is a term
            self.items.append(Item(key, h, h[weight[k] >= COMMON], answer.tolist()))
            self.words.append(h)
            own, times = np.unique(k, return_counts=True)
            whole.append(float(weight[own].sum()))
            keys.append((own, len(self.items) - 1, np.minimum(times, 255)))
            rarest = int(np.argmax(weight[k]))
            anchors.append((int(k[rarest]), rarest))
            size = max([s for s in SIZES if s <= len(h)], default=SIZES[0])
            # pieces like the texts' windows, and a last one that ends with the item
            starts = [0] if len(h) <= size + size // 4 else [*range(0, len(h) - size, size // 2), len(h) - size]
            queries, owner = found.setdefault(size, ([], []))
            for s in starts:
                queries.append(vectors[k[s:] if len(starts) == 1 else k[s : s + size]].sum(0))
                owner.append(len(self.items) - 1)
        self.pieces = {size: Pieces(*x, vectors.shape[1]) for size, x in sorted(found.items())}
        # how often an item has a term: a row for each item if that is small, else by hash,
        # where what is let through is checked on the words
        self.wide = len(terms.words) if len(self.items) * len(terms.words) <= MATRIX else 0
        places = sum(len(x) for x, _, _ in keys)
        self.shift = np.uint64(64 - max(16, (16 * places).bit_length()))
        self.times = np.zeros(len(self.items) * self.wide or 1 << int(64 - self.shift), np.uint8)
        for own, i, times in keys:
            np.maximum.at(self.times, self._place(np.full(len(own), i), own), times.astype(np.uint8))
        self.whole = np.maximum(np.array(whole), 1e-9)
        self.n = np.array([i.n for i in self.items], np.int64)
        self.need = np.ceil(self.n * covered - 1e-9)
        term, self.offset = np.array(anchors, np.int64).reshape(-1, 2).T
        self.anchored = np.argsort(term, kind="stable")
        self.by_term = np.searchsorted(term[self.anchored], np.arange(len(terms.words) + 1))

    def _place(self, item: np.ndarray, term: np.ndarray) -> np.ndarray:
        if self.wide:
            return item * self.wide + term
        return (textkit.mix64(item.astype(np.uint64) << np.uint64(32) | term.astype(np.uint64)) >> self.shift).astype(np.int64)

    def there(self, item: np.ndarray, number: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of the items: how many of the terms, a number of which go with each, are
        its own, each as often as it has it, and the share of its weight that they have."""
        spot = np.repeat(item * self.wide, number) + term if self.wide else self._place(np.repeat(item, number), term)
        most = np.take(self.times, spot)
        own = np.flatnonzero(most != 0)
        row = np.repeat(np.arange(len(item)), np.diff(np.searchsorted(own, np.append(0, np.cumsum(number)))))
        pair = np.sort(row.astype(np.uint64) << np.uint64(40) | term[own].astype(np.uint64) << np.uint64(8) | most[own])
        new = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, np.int64)
        once, many = pair[new], np.diff(np.append(new, len(pair)))
        row, term, most = (once >> np.uint64(40)).astype(np.int64), (once >> np.uint64(8) & np.uint64(0xFFFFFFFF)).astype(np.int64), (once & np.uint64(255)).astype(np.int64)
        return np.bincount(row, np.minimum(many, most), len(item)), np.bincount(row, self.weight[term], len(item)) / self.whole[item]

    def verbatim(self, h: np.ndarray, first: np.ndarray, at: np.ndarray, k: np.ndarray):
        """(text, item, first word) of the items that stand in the texts."""
        many = self.by_term[k + 1] - self.by_term[k]
        place = np.repeat(at, many)
        item = self.anchored[np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.by_term[k], many)]
        start, text = place - self.offset[item], np.searchsorted(first, place, side="right") - 1
        ok = np.flatnonzero((start >= first[text]) & (start + self.n[item] <= first[text + 1]))
        heads, tails = (np.array([w[i] for w in self.words], np.uint64) for i in (0, -1))
        ok = ok[(h[start[ok]] == heads[item[ok]]) & (h[start[ok] + self.n[item[ok]] - 1] == tails[item[ok]])]
        for x in ok.tolist():
            if np.array_equal(h[start[x] : start[x] + self.n[item[x]]], self.words[item[x]]):
                yield int(text[x]), int(item[x]), int(start[x])


def prepared(docs: DataFrame, benchmark: DataFrame, text: str, item_id: str, item_text: str, answer: str | None, covered: float) -> list:
    """Broadcasts (terms, vectors, Bench), one for each ITEMS items or so."""
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    answers = F.col(answer).cast("string") if answer else F.lit(None).cast("string")
    rows = [tuple(x) for x in benchmark.select(F.col(item_id).alias("k"), F.col(item_text).alias("t"), answers.alias("a")).orderBy("k", "t").collect()]
    words, answered = ([_words(pa.array([x[i] or ""]))[0] for x in rows] for i in (1, 2))
    if not any(len(h) for h in words):
        return []
    terms = Terms(np.concatenate(words + answered))
    weight = weights(texts, terms)
    vectors = latent_space(texts, terms, weight, min(MOST_RANK, max(RANK, len(rows) // PER_RANK)))
    out = []
    for i in range(0, len(rows), ITEMS):
        part = slice(i, i + ITEMS)
        if any(len(h) for h in words[part]):
            out.append(docs.sparkSession.sparkContext.broadcast((terms, vectors, Bench(rows[part], words[part], answered[part], terms, weight, vectors, covered))))
    return out


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", answer: str | None = None, near: float = NEAR, covered: float = COVERED) -> DataFrame:
    """Rows (doc_id, item_id, cosine, lcs) for each document and benchmark item
    found in it: the best cosine of its windows, and the share of the item's words
    in the longest common subsequence.

    Words are runs other than white space, A-Z lower-cased.  `answer`: column of
    the benchmark whose words must follow each other near the match; without it, or
    where it is null or blank, the subsequence alone decides.  Null and empty texts and
    items match nothing; items that stand word for word are always found, with cosine
    1.  Repeated documents give repeated rows, repeated items a row for each.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kinds = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, item_id {benchmark.schema[item_id].dataType.simpleString()}, cosine double, lcs double"

    def run(shared):
        def rows(parts):
            for q, bench, best in _search(shared, parts, 1, near, covered):
                if best:
                    found = sorted(best.items())
                    ids = q.column(0).take(pa.array([d for (d, _), _ in found]))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([bench.items[m].key for (_, m), _ in found]), pa.array([x[0] for _, x in found]), pa.array([x[1] for _, x in found])], names=["doc_id", "item_id", "cosine", "lcs"])

        return rows

    out = None
    for shared in prepared(docs, benchmark, text, item_id, item_text, answer, covered):
        found = source.mapInArrow(run(shared), kinds)
        out = found if out is None else out.unionAll(found)
    return docs.sparkSession.createDataFrame([], kinds) if out is None else out


def without(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id", "text"), text: str = "text", item_id: str = "item_id", item_text: str = "text", answer: str | None = None, near: float = NEAR, covered: float = COVERED) -> DataFrame:
    """The `keep` columns of the rows in whose text matches() finds no item.  Each row
    is judged by its own text; null and empty texts stay."""
    out = docs.select(*keep, F.col(text).alias("__text"))
    schema = out.schema

    def run(shared):
        def rows(parts):
            for q, _, best in _search(shared, parts, len(keep), near, covered):
                clean = np.ones(q.num_rows, bool)
                clean[[t for t, _ in best]] = False
                yield q.filter(pa.array(clean))

        return rows

    for shared in prepared(docs, benchmark, text, item_id, item_text, answer, covered):
        out = out.mapInArrow(run(shared), schema)
    return out.select(*keep)


def _search(shared, parts, column: int, near: float, covered: float):
    """(batch, items, {(text, item): [cosine, share]}) for all slices of the rows."""
    terms, vectors, bench = shared.value
    for q, h, first in _slices(parts, column):
        at, k = terms.find(h)
        best: dict[tuple[int, int], list[float]] = {}
        for t, m, s in bench.verbatim(h, first, at, k):
            n = int(bench.n[m])
            if bench.items[m].answered(h[max(first[t], s - n) : min(first[t + 1], s + 2 * n)].tolist()):
                best[t, m] = [1.0, 1.0]
        steps, wide = None, 0
        for size, pieces in bench.pieces.items():
            while wide < size // 2:  # half of the least size first, then twice as wide each time
                steps, wide = (stepped(terms, vectors, at, k, first, size // 2), size // 2) if steps is None else (doubled(*steps), 2 * wide)
            w, start, text = windows(*steps, first, size)
            own = np.sqrt(np.einsum("ij,ij->i", w, w))
            # a window with most of a piece is also as long as most of it
            some = np.flatnonzero(own >= near * pieces.length.min(initial=np.inf))
            w, start, text, own = w[some], start[some], text[some], own[some]
            for b in range(0, len(pieces.vectors), 1024):
                product = w @ pieces.vectors[b : b + 1024].T
                width = product.shape[1]
                place = np.flatnonzero(product >= near * own[:, None])
                value, i, j = product.reshape(-1)[place], place // width, place % width
                both = np.flatnonzero(value >= near * pieces.length[b + j])
                i, j = i[both], j[both]
                for x, c, share in _judged(bench, h, first, at, k, size, start[i], text[i], value[both] / own[i], pieces.owner[b + j], covered, best):
                    best[x] = [max(best[x][0], c), max(best[x][1], share)] if x in best else [c, share]
        yield q, bench, best


def _judged(bench: Bench, h, first, at, k, size, start, text, cosine, item, covered, best):
    """((text, item), cosine, share) of the candidates that are matches."""
    low, high = np.maximum(first[text], start - bench.n[item]), np.minimum(first[text + 1], start + size + bench.n[item])
    t0, t1 = np.searchsorted(at, low), np.searchsorted(at, high)
    for a in range(0, len(item), 1 << 14):
        z = slice(a, a + (1 << 14))
        many = t1[z] - t0[z]
        place = np.arange(many.sum()) + np.repeat(t0[z] - np.cumsum(many) + many, many)
        # how many of the item's words are there: no fewer than a subsequence of them
        there, weight = bench.there(item[z], many, k[place])
        like = (cosine[z] >= NEARER) & (weight >= WEIGHT)
        for x in np.flatnonzero((there >= bench.need[item[z]]) | like):
            key, c = (int(text[a + x]), int(item[a + x])), min(float(cosine[a + x]), 1.0)
            if key in best:
                yield key, c, best[key][1]
            elif share := bench.items[key[1]].match(h[low[a + x] : high[a + x]].tolist(), covered, bool(like[x])):
                yield key, c, share
