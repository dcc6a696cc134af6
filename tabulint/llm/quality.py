"""Quality by nearest-neighbour voting in a latent-semantic space.

A bounded, labelled sample gives a TF-IDF space, a randomised singular value
decomposition of it, and the sample's own vectors.  The space has four blocks of equal
length: hashed lower-cased words and hashed lower-cased letter n-grams (what a text
says), n-grams of its shape (letters as a or A, digits as 0: how it is laid out), and
how far back its words stood last (what it repeats).  The vectors are broadcast (at
most 2 * per_label rows of `rank` numbers).  Every document's cosines with all of them
are exact, computed in blocks, and its nearest ones vote, weighted by similarity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulint.llm import features, textkit

WORDS, LETTERS, SHAPES, RANK = 1 << 12, 1 << 12, 1 << 11, 48


def randomised_svd(x: np.ndarray, rank: int, rounds: int = 3) -> np.ndarray:
    """The leading right singular vectors, a column each."""
    rank = max(1, min(rank, *x.shape))
    rng = np.random.default_rng(5)
    q = np.linalg.qr(x.T @ (x @ rng.standard_normal((x.shape[1], rank + 8)).astype(np.float32)))[0]
    for _ in range(rounds):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T)[:, :rank].astype(np.float32)


def unit(z: np.ndarray) -> np.ndarray:
    return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)


def fit(docs: DataFrame, labels: DataFrame, label: str, on: str, text: str, per_label: int, rank: int = RANK) -> dict:
    """The space and the sample's vectors.  The sample is chosen from the labels
    alone, by a hash of their key, at most `per_label` rows of each label: small
    enough to broadcast, so the texts are not shuffled."""
    grams = features.Blocks(features.Words(WORDS), features.Grams(LETTERS, (3,), shape=False), features.Grams(SHAPES, (2, 3), shape=True), features.Gaps())
    known = labels.select(on, F.col(label).cast("int").alias("label")).filter(F.col(on).isNotNull())
    picks = [known.filter(F.col("label") == v).orderBy(F.xxhash64(on), on).limit(per_label) for v in (0, 1)]
    rows = docs.select(on, F.col(text).alias("text")).filter("text is not null").join(F.broadcast(picks[0].unionAll(picks[1])), on)
    labels, counts = features.collected(rows.select("label", "text"), grams)
    model = {"grams": grams, "labels": np.array([float(x) for x in labels])}
    if not labels:
        return model
    df = np.count_nonzero(counts, axis=0)
    model["idf"] = np.log((1 + len(labels)) / (1 + df)).astype(np.float32) + np.float32(0.05)
    x = weighed(model, counts)
    model["basis"] = randomised_svd(x, rank)
    model["vectors"] = unit(x @ model["basis"])
    return model


def weighed(model: dict, counts: np.ndarray) -> np.ndarray:
    """Weighted counts, each block brought to length one; counts that are floats of 32
    bits are changed in place, so that the sample is in memory once."""
    x = counts.astype(np.float32, copy=False)
    np.log1p(x, out=x)
    x *= model["idf"]
    bounds = model["grams"].bounds
    for i, j in zip(bounds, bounds[1:]):
        part = x[:, i:j]
        part /= np.maximum(np.sqrt(np.einsum("ij,ij->i", part, part)), 1e-9)[:, None]
    return x


def vote(model: dict, texts: pa.Array, neighbours: int) -> np.ndarray:
    labels = model["labels"]
    if not len(labels):
        return np.full(len(texts), 0.5)
    prior = float(labels.mean())
    z = unit(weighed(model, model["grams"].counts(texts)) @ model["basis"])
    k = min(neighbours, len(labels))
    near = z @ model["vectors"].T
    at = np.argsort(-near, axis=1, kind="stable")[:, :k]
    weight = np.maximum(np.take_along_axis(near, at, 1), 0).astype(np.float64) ** 4
    total = weight.sum(1)
    return np.where(total > 1e-9, (weight * labels[at]).sum(1) / np.maximum(total, 1e-9), prior)


def scores(docs: DataFrame, labels: DataFrame, label_col: str, on: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), per_label: int = 1500, neighbours: int = 15) -> DataFrame:
    """The `keep` columns with score, the similarity-weighted share of label 1
    among the `neighbours` nearest sample rows (0 to 1).

    labels: rows (on, label 0 or 1) for documents to learn from; others teach
    nothing.  A text without n-grams (null or empty) gets the sample's share of
    label 1; without a sample it is 0.5.  Of equally near rows the first in the sample's
    order vote.  Repeated rows stay.  Whole texts are read, at most 256 or one long one
    at a time.
    """
    model = fit(docs, labels, label_col, on, text_col, per_label)
    out = T.StructType([*(docs.schema[c] for c in keep), T.StructField("score", T.DoubleType(), False)])

    def run(parts):
        for p in parts:
            for q in textkit.batches(p, "__text", 1 << 18):
                for at in range(0, q.num_rows, 256):
                    r = q.slice(at, 256)
                    yield pa.RecordBatch.from_arrays([*(r.column(i) for i in range(len(keep))), pa.array(vote(model, r.column(len(keep)), neighbours), pa.float64())], names=out.names)

    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, out)
