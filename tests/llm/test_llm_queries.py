"""The registered queries and the pipeline on the smallest tables."""

from __future__ import annotations

import re
from pathlib import Path

import pytest

from tabulint.llm import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no tables here")

COLUMNS = {
    "op1_near_duplicates": {"doc_id", "n_shingles", "component_id", "kept"},
    "op2_decontamination": {"doc_id", "item_id"},
    "op3_mixing": {"doc_id", "size", "source_size", "target", "taken"},
    "op4_secrets": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op5_token_counts": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
    "op6_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op7_transport_streams": {"doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"},
    "op8_context_mixing": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op9_repeated_spans": {"doc_id", "n_words", "n_removed", "kept_sha256"},
    "op10_quality": {"doc_id", "held_out", "score", "predicted"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, name):
    out = registry.QUERIES[name](spark, DATA)
    assert COLUMNS[name] <= set(out.columns)
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    got = out.count()
    assert got <= n if name.startswith("op2") else got == n


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == columns, name
        after = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(after) == len(set(after)) and set(after) <= before
        before = set(after)
    assert not [r for r in docs.select("text").collect() if re.search(r"[0-9a-f]{24,}", r.text)]
    out = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    rows = out.collect()
    assert {r.doc_id for r in rows} <= before and set(columns) <= set(out.columns)
    copies = {}
    for r in rows:
        copies.setdefault(r.doc_id, set()).add(r.copy)
        assert 0 <= r.position <= 1 and r.copy < 3
    assert sum(len(c) for c in copies.values()) == len(rows)


def test_near_duplicates_of_a_whole_table(spark):
    """Every document of the small table against every other of fitting size."""
    data = "/root/testdata/sf0.01"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect())
    fold, word = {i: i + 32 for i in range(65, 91)}, re.compile(r"[^ \t-\r]+")
    sets = []
    for d, t in rows:
        w = word.findall((t or "").translate(fold))
        sets.append((d, frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset([tuple(w)]) if w else frozenset()))
    parent = {d: d for d, _ in sets}

    def find(d):
        while parent[d] != d:
            parent[d] = parent[parent[d]]
            d = parent[d]
        return d

    order = sorted((x for x in sets if x[1]), key=lambda x: len(x[1]))
    for i, (d, a) in enumerate(order):
        for e, b in order[i + 1 :]:
            if 100 * len(a) < 80 * len(b):
                break
            common = len(a & b)
            if 100 * common >= 80 * (len(a) + len(b) - common):
                x, y = find(d), find(e)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in registry.QUERIES["op1_near_duplicates"](spark, data).collect()}
    assert got == {d: (len(s), find(d), find(d) == d) for d, s in sets}
