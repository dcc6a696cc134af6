"""Language identification in two levels.

A linear classifier first picks the language family; inside the family,
one-versus-one linear support vector machines separate the languages.  Features
are mean hashed byte 2-grams and 3-grams of the whole lower-cased text.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulint.llm import features, textkit

# Families of common language codes; any other code is a family of its own.
FAMILIES = {
    **dict.fromkeys(("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb", "yi"), "germanic"),
    **dict.fromkeys(("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"), "romance"),
    **dict.fromkeys(("ru", "uk", "be", "bg", "mk", "sr", "hr", "bs", "sl", "cs", "sk", "pl"), "slavic"),
    **dict.fromkeys(("fi", "et", "hu"), "uralic"),
    **dict.fromkeys(("tr", "az", "kk", "uz", "tt"), "turkic"),
    **dict.fromkeys(("hi", "ur", "bn", "mr", "ne", "gu", "pa"), "indic"),
    **dict.fromkeys(("zh", "yue", "wuu"), "sinitic"),
}
DIMS = 1 << 13


def svms(x: np.ndarray, y: np.ndarray, strength: float = 1e-3, steps: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias, a column each, of linear support vector machines (squared
    hinge loss, accelerated gradient).  y has a column of +1, -1 and 0 (not looked at)
    for each; in each both classes weigh the same.

    Weights are sums of the rows, so the descent runs on the rows' coefficients with
    their inner products.
    """
    pos, neg = np.maximum((y > 0).sum(0), 1), np.maximum((y < 0).sum(0), 1)
    weight = np.where(y > 0, 0.5 / pos, np.where(y < 0, 0.5 / neg, 0)).astype(np.float32)
    y = y.astype(np.float32)
    k = x @ x.T
    v = np.ones(y.shape, np.float32)
    for _ in range(12):
        v = weight * (k @ v)
        v /= np.maximum(np.sqrt((v * v).sum(0)), 1e-30)
    rate = 1 / (2 * (np.sqrt(((weight * (k @ v)) ** 2).sum(0)) + 1) * 1.2 + strength)
    a, b = np.zeros(y.shape, np.float32), np.zeros(y.shape[1], np.float32)
    pa_, pb = a, b
    for i in range(steps):
        m = i / (i + 3)
        za, zb = a + m * (a - pa_), b + m * (b - pb)
        g = -2 * weight * y * np.maximum(0, 1 - y * (k @ za + zb))
        pa_, pb = a, b
        a, b = za - rate * (g + strength * za), zb - rate * g.sum(0)
    return x.T @ a, b


def fit(labelled: DataFrame, lang: str, text: str, families: dict[str, str], per_language: int, most_rows: int = 8_000) -> dict:
    """The model: languages by family, and a weight column with bias for each
    family and each pair.  It learns from `per_language` rows a language, or fewer so
    that all languages together have about `most_rows` (features.sampled)."""
    grams = features.Grams(DIMS, (2, 3), shape=False)
    names, rows = features.sampled(labelled, lang, text, per_language, most_rows)
    labels, counts = features.collected(rows, grams)
    labels = np.array(labels, dtype=object)
    names = sorted(set(labels.tolist()))
    groups: dict[str, list[str]] = {}
    for n in names:
        groups.setdefault(families.get(n, n), []).append(n)
    model = {"grams": grams, "families": sorted(groups), "groups": groups, "pairs": [], "weights": np.zeros((DIMS, 0), np.float32), "bias": np.zeros(0)}
    if not names:
        return model
    counts /= np.maximum(counts.sum(1, keepdims=True) / 2, 1)
    # in place and by columns, so that the sample is in memory once
    x, scale = counts, np.empty(DIMS, np.float32)
    for k in range(0, DIMS, 256):
        scale[k : k + 256] = 1 / (x[:, k : k + 256].std(0) + np.float32(1e-4))
    x *= scale
    whole = np.float32(np.sqrt(sum(float(np.einsum("ij,ij->", x[:, k : k + 256], x[:, k : k + 256])) for k in range(0, DIMS, 256)) / len(x)))
    x /= whole
    scale /= whole
    family = np.array([families.get(n, n) for n in labels], dtype=object)
    weights, bias = [np.zeros((DIMS, 0), np.float32)], [np.zeros(0)]
    if len(groups) > 1:
        w, b = svms(x, np.stack([np.where(family == f, 1, -1) for f in model["families"]], 1))
        weights.append(w), bias.append(b)
    for f in model["families"]:
        pairs = list(combinations(groups[f], 2))
        if pairs:
            at = family == f
            w, b = svms(x[at], np.stack([(labels[at] == a).astype(np.int8) - (labels[at] == c) for a, c in pairs], 1))
            model["pairs"] += [(f, a, c) for a, c in pairs]
            weights.append(w), bias.append(b)
    model["weights"] = (np.hstack(weights) * scale[:, None]).astype(np.float32)
    model["bias"] = np.concatenate(bias)
    return model


def _sure(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-4 * np.clip(x, -20, 20)))


def predict(model: dict, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """A language and a score for each text; `und` and 0 without a letter."""
    texts = texts.cast(pa.large_string()).fill_null("")
    letters = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
    names = sorted(n for g in model["groups"].values() for n in g)
    if not names:
        return ["und"] * len(texts), np.zeros(len(texts))
    margin = model["grams"].means(texts, model["weights"]) + model["bias"] if model["weights"].shape[1] else np.zeros((len(texts), 0))
    fams = model["families"]
    n_f = len(fams) if len(fams) > 1 else 0
    if n_f:
        p = _sure(margin[:, :n_f]) + 1e-9
        best, sure = margin[:, :n_f].argmax(1), p.max(1) / p.sum(1)
    else:
        best, sure = np.zeros(len(texts), np.int64), np.ones(len(texts))
    out, score = np.empty(len(texts), object), np.zeros(len(texts))
    for k, f in enumerate(fams):
        group, at = model["groups"][f], np.flatnonzero(best == k)
        votes = np.zeros((len(at), len(group)))
        for j, (g, a, b) in enumerate(model["pairs"]):
            if g == f:
                p = _sure(margin[at, n_f + j])
                votes[:, group.index(a)] += p
                votes[:, group.index(b)] += 1 - p
        total = votes.sum(1)
        share = votes.max(1) / np.maximum(total, 1e-9) * len(group) / 2 if len(group) > 1 else np.ones(len(at))
        out[at] = np.array(group, object)[votes.argmax(1)]
        score[at] = np.clip(sure[at] * share, 0, 1)
    out[~letters], score[~letters] = "und", 0.0
    return list(out), score


def identify(docs: DataFrame, learn_from: DataFrame, text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = ("doc_id",), families: dict[str, str] | None = None, per_language: int = 600, most_rows: int = 8_000) -> DataFrame:
    """The `keep` columns with lang_pred and score (0 to 1) of every whole text.

    learn_from: rows (text, lang) to learn from; null languages teach nothing.
    A null text, or one with no letter, is `und` with score 0, as is every text
    if there is nothing to learn from.  Ties go to the first language by code
    point.  Repeated rows stay.  Whole texts are read, a batch of about a megabyte or
    one longer text at a time.
    """
    model = fit(learn_from.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()), lang_col, text_col, FAMILIES if families is None else families, per_language, most_rows)
    out = T.StructType([*(docs.schema[c] for c in keep), T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False)])

    def run(parts):
        for p in parts:
            for q in textkit.batches(p, "__text", 1 << 20):
                names, score = predict(model, q.column(len(keep)))
                yield pa.RecordBatch.from_arrays([*(q.column(i) for i in range(len(keep))), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=out.names)

    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, out)
