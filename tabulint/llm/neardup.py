"""Near-duplicate documents: MinHash bands for candidates, odd sketches to
estimate their similarity, full shingle sets to confirm.

1. A scan gives every document its shingle set's digest, its band keys and its
   odd sketch.  The sketch folds the MinHash samples into a parity bitmap: each
   (sample number, minimum) flips one bit, so samples that agree cancel in the
   XOR of two sketches, and its population count gives the number that differ.
2. Documents with one digest are one node; only nodes go on.
3. Nodes with a band key form a bucket.  Its leader is the member whose buckets
   are largest in sum: in a group of edited copies that is the text they come
   from.  Members are compared with their leaders only: as many pairs as bucket
   memberships.
4. Pairs that the sketches put anywhere near are compared on the texts, which
   also gives what sets a member apart from its leader.
5. Buckets that are still in more than one component are settled exactly: every
   member outside the bucket's largest component is compared with every member
   of another component, in blocks of bounded size, by those differences: two
   sets differ where just one of them differs from the leader.

So no link inside a bucket is lost, and pairs of one component are not listed.
With 40 bands of 5, a pair of similarity 0.8 meets in no bucket with a chance of
1.3e-7.  A sketch misses such a pair with a chance of about 1e-9.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulint.llm import textkit
from tabulint.operators.components import components
from tabulint.plans.durable import saved

BANDS, ROWS = 40, 5
SKETCH_BITS = 512
#: How far a sketch's estimate may be under the threshold: six standard errors.
SLACK = 0.18
#: Members of a bucket that are compared in one task's block.
SIDE = 256


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles; of fewer words, the whole as one."""
    if not len(words):
        return words
    return np.unique(textkit.windows(words, min(k, len(words)), salt=len(words) if len(words) < k else 0))


def minima(sets: list[np.ndarray], n: int) -> np.ndarray:
    """n MinHash samples of every set, as uint32."""
    s = textkit.seeds(n, salt=3)
    xor, mul = (s >> np.uint64(32)).astype(np.uint32), (s & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)
    out = np.full((len(sets), n), 0xFFFFFFFF, np.uint32)
    for i, x in enumerate(sets):
        x = (x >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(x), 1024):
            h = (x[at : at + 1024, None] ^ xor) * mul
            np.minimum(out[i], h.min(axis=0), out=out[i])
    return out


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the samples, as int64 words."""
    n = samples.shape[1]
    bit = textkit.mix64(samples.astype(np.uint64) * np.uint64(n) + np.arange(n, dtype=np.uint64)) % np.uint64(SKETCH_BITS)
    flat = (np.arange(len(samples))[:, None] * SKETCH_BITS + bit.astype(np.int64)).ravel()
    parity = np.bincount(flat, minlength=len(samples) * SKETCH_BITS).astype(np.uint8) & 1
    return np.packbits(parity.reshape(len(samples), -1), axis=1).view(np.int64)


def band_keys(samples: np.ndarray) -> np.ndarray:
    key = np.tile(np.arange(BANDS, dtype=np.uint64), (len(samples), 1))
    for r in range(ROWS):
        key = textkit.mix64(key * np.uint64(0x9E3779B97F4A7C15) + samples[:, r::ROWS].astype(np.uint64))
    return key.view(np.int64)


def word_lists(texts: pa.Array):
    """Hashes of the words of each text, A-Z lower-cased."""
    offsets, data = textkit.buffers(texts)
    starts, ends, first = textkit.spans(offsets, data)
    hashes = textkit.hash_words(data, starts, ends, fold=True)
    return [hashes[first[i] : first[i + 1]] for i in range(len(texts))]


def digest(s: np.ndarray) -> bytes:
    """128 bits that name a set."""
    import hashlib

    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def sketched(docs: DataFrame, shingle: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n_shingles, node, keys, sketch), the last three null if empty."""

    def run(parts):
        for p in parts:
            for q in textkit.batches(p, "text", 1 << 20):
                sets = [shingle_set(w, shingle) for w in word_lists(q.column(1))]
                some = np.array([bool(len(s)) for s in sets])
                samples = minima(sets, BANDS * ROWS)
                keys, sketch = band_keys(samples), odd_sketches(samples)

                def lists(m):
                    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel(), pa.int64()), mask=pa.array(~some))

                yield pa.RecordBatch.from_arrays(
                    [q.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) if len(s) else None for s in sets], pa.binary()), lists(keys), lists(sketch)],
                    names=["doc_id", "n_shingles", "node", "keys", "sketch"],
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_shingles long, node binary, keys array<long>, sketch array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity of two sets from their odd sketches."""
    z = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, x: s + x)
    differ = -(SKETCH_BITS / 2) * F.log(F.greatest(1 - 2 * z / SKETCH_BITS, F.lit(1e-3)))
    return 1 - differ / (2 * BANDS * ROWS)


def compared(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int, differences: bool = True) -> DataFrame:
    """(u, v, linked, n, delta) for pairs (u, v): whether the full sets have 100 *
    common >= percent * union, the size of u's set, and the sorted hashes that are
    in one of the two sets only.  The side that may repeat (v) is joined first,
    while rows are small."""

    def run(parts):
        for p in parts:
            for q in textkit.batches(p, "a", 1 << 20):
                linked, size, delta = [], [], []
                for x, y in zip(word_lists(q.column(2)), word_lists(q.column(3))):
                    x, y = shingle_set(x, shingle), shingle_set(y, shingle)
                    d = np.setxor1d(x, y, assume_unique=True)
                    both = len(x) + len(y)
                    linked.append(100 * (both - len(d)) >= percent * (both + len(d)))
                    size.append(len(x))
                    delta.append(d.tobytes() if differences else None)
                yield pa.RecordBatch.from_arrays([q.column(0), q.column(1), pa.array(linked), pa.array(size, pa.int64()), pa.array(delta, pa.binary())], names=["u", "v", "linked", "n", "delta"])

    both = pairs.join(texts.select(F.col("node").alias("v"), F.col("text").alias("b")), "v").join(texts.select(F.col("node").alias("u"), F.col("text").alias("a")), "u")
    return both.select("u", "v", "a", "b").mapInArrow(run, "u binary, v binary, linked boolean, n long, delta binary")


def open_pairs(led: DataFrame, roots: DataFrame, sketches: DataFrame, to_leader: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v, sure) of a bucket that lie in different components.

    Of the bucket's component with most members, only pairs with the others are
    looked at, in blocks of about SIDE members a side.  Two sets that were both
    compared with the leader are compared exactly, by what sets each of them apart
    from it; one link (sure) is enough for a member and a component.  A set too
    far from the leader cannot be linked with one that is linked with it, as the
    Jaccard distance obeys the triangle inequality.  The rest are judged by sketch
    and left to be confirmed.
    """
    own = led.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    parts = own.groupBy("key", "root").agg(F.count("*").alias("n"))
    buckets = parts.groupBy("key").agg(F.count("*").alias("parts"), F.sum("n").alias("all"), F.max(F.struct("n", "root")).alias("main"))
    buckets = buckets.filter("parts > 1").select("key", F.col("main.root").alias("main"), F.ceil(F.col("all") / SIDE).cast("int").alias("blocks"), F.ceil((F.col("all") - F.col("main.n")) / SIDE).cast("int").alias("rest"))
    known = to_leader.select(F.col("u").alias("node"), "v", "linked", "n", "delta")
    rows = own.join(buckets, "key").join(sketches, "node").join(known, ["node", "v"], "left")
    rows = rows.withColumn("direct", F.coalesce("linked", F.col("node") == F.col("v"))).withColumn("delta", F.when(F.col("node") == F.col("v"), F.lit(b"")).otherwise(F.col("delta")))
    columns = ["node", "root", "main", "sketch", "direct", F.coalesce("n", F.col("size")).alias("n"), "delta"]
    side = lambda count, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(count)).cast("int")
    few = rows.filter("root <> main").select("key", side("rest", 1).alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.lit(True).alias("few"), *columns)
    many = rows.select("key", F.explode(F.sequence(F.lit(0), F.col("rest") - 1)).alias("i"), side("blocks", 2).alias("j"), F.lit(False).alias("few"), *columns)
    least = percent / 100 - SLACK

    def block(t: pa.Table) -> pa.Table:
        few, direct, n = (t.column(c).to_numpy() for c in ("few", "direct", "n"))
        node, root, main = (np.array(t.column(c).to_pylist(), dtype=object) for c in ("node", "root", "main"))
        bits = np.array(t.column("sketch").to_pylist(), np.int64).reshape(len(few), -1)
        delta = [None if d is None else np.frombuffer(d, np.uint64) for d in t.column("delta").to_pylist()]
        exact = np.array([d is not None for d in delta])
        a, b = np.flatnonzero(few), np.flatnonzero(~few)
        sizes = np.array([0 if delta[i] is None else len(delta[i]) for i in b], np.int64)
        flat = np.concatenate([np.zeros(0, np.uint64), *(delta[i] for i in b if exact[i])])
        owner = np.repeat(np.arange(len(b)), sizes)
        us, vs, sure = [], [], []
        for i in a:
            z = np.bitwise_count(bits[b] ^ bits[i]).sum(1, dtype=np.int64)
            j = 1 + SKETCH_BITS / 2 * np.log(np.maximum(1 - 2 * z / SKETCH_BITS, 1e-3)) / (2 * BANDS * ROWS)
            # a pair of two outsiders is there in both directions: one is enough
            ok = (j >= least) & (root[b] != root[i]) & ((root[b] == main[b]) | (node[b] > node[i]))
            ok &= ~(direct[b] & (not exact[i])) & ~(~exact[b] & direct[i])
            judged = ok & exact[b] & exact[i]
            if judged.any():
                common = np.bincount(owner[np.isin(flat, delta[i])], minlength=len(b))
                apart = sizes + len(delta[i]) - 2 * common
                both = n[b] + n[i]
                found: set = set()
                for k in np.flatnonzero(judged & (100 * (both - apart) >= percent * (both + apart))):
                    if root[b[k]] not in found:
                        found.add(root[b[k]])
                        us.append(node[i]), vs.append(node[b[k]]), sure.append(True)
            for k in np.flatnonzero(ok & ~judged):
                us.append(node[i]), vs.append(node[b[k]]), sure.append(False)
        return pa.table({"u": pa.array(us, pa.binary()), "v": pa.array(vs, pa.binary()), "sure": pa.array(sure, pa.bool_())})

    return few.unionAll(many).groupBy("key", "i", "j").applyInArrow(block, "u binary, v binary, sure boolean").distinct()


def classes(docs: DataFrame, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id (the smallest doc_id
    reachable over links, its own included) and kept (doc_id = component_id).

    Documents are linked if their sets of `shingle`-word shingles have 100 *
    intersection >= percent * union.  Words are runs other than white space, A-Z
    lower-cased.  With fewer words than a shingle the whole sequence is one; a
    text that is null or without words has an empty set and is linked with
    nothing.  Repeated rows are linked with each other and stay.
    """
    sk = saved(sketched(docs, shingle, doc_id, text), "sketches")
    nodes = saved(sk.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep")), "nodes")
    one = sk.join(nodes.withColumnRenamed("rep", "doc_id"), ["node", "doc_id"]).dropDuplicates(["node"])
    keyed = one.select("node", F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = saved(keyed.join(sizes, "key").select("key", "node", "n"), "members")
    central = members.groupBy("node").agg(F.sum("n").alias("weight"))
    leaders = members.join(central, "node").groupBy("key").agg(F.max(F.struct("weight", "node")).alias("top")).select("key", F.col("top.node").alias("v"))
    led = saved(members.join(leaders, "key").select("key", "node", "v"), "led")
    # sketches and texts of the members alone
    sketches = saved(one.join(central.select("node"), "node").select("node", "doc_id", "sketch", F.col("n_shingles").alias("size")), "members")
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    texts = saved(named(source.join(sketches.select("node", "doc_id"), "doc_id"), shingle), "texts")
    bits = sketches.select("node", "sketch", "size")
    # nearer than this a member may be linked with one that the leader is linked with
    reach = 2 * percent / 100 - 1 - SLACK
    near = (
        led.filter("node <> v")
        .select(F.col("node").alias("u"), "v")
        .distinct()
        .join(bits.select(F.col("node").alias("v"), F.col("sketch").alias("b")), "v")
        .join(bits.select(F.col("node").alias("u"), F.col("sketch").alias("a")), "u")
        .filter(estimate(F.col("a"), F.col("b")) >= reach)
        .select("u", "v")
    )
    to_leader = saved(compared(near, texts, shingle, percent), "leaders")
    roots = saved(components(to_leader.filter("linked").select("u", "v")), "roots")
    more = saved(open_pairs(led, roots, bits, to_leader, percent), "open")
    confirmed = compared(more.filter("not sure").select("u", "v").distinct(), texts, shingle, percent, differences=False)
    extra = saved(more.filter("sure").select("u", "v").unionAll(confirmed.filter("linked").select("u", "v")), "links")
    if not extra.isEmpty():
        stars = roots.filter("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))
        roots = components(stars.unionAll(extra))
    first = nodes.join(roots, "node").groupBy("root").agg(F.min("rep").alias("component_id"))
    linked = roots.join(first, "root").select("node", "component_id")
    # a table of its own, so that the nodes with most copies are split in the join with the documents
    named_nodes = saved(nodes.join(linked, "node", "left").select("node", F.coalesce("component_id", "rep").alias("component_id")), "named")
    out = sk.select("doc_id", "n_shingles", "node").join(named_nodes, "node", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def named(rows: DataFrame, shingle: int) -> DataFrame:
    """(node, text) of the rows (doc_id, text, node) whose text has that node's
    set: of rows that share an id, only those."""

    def run(parts):
        for p in parts:
            for q in textkit.batches(p, "text", 1 << 20):
                own = [digest(shingle_set(w, shingle)) for w in word_lists(q.column(1))]
                keep = [a == b for a, b in zip(own, q.column(0).to_pylist())]
                yield q.filter(pa.array(keep, pa.bool_()))

    return rows.select("node", "text").mapInArrow(run, "node binary, text string").dropDuplicates(["node"])
