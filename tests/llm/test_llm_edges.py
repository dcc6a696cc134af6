"""Samples, keys and rewordings: what must not depend on copies, ids or company."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabulint.llm import curriculum, decontaminate, features, langid, quality, secrets, substrings, transport
from tests.llm.conftest import sentence


def test_samples_hold_every_label_and_stay_bounded(spark):
    many = spark.range(0, 900).select((F.col("id") % 300).cast("string").alias("lang"), F.concat(F.lit("text "), "id").alias("text"))
    names, rows = features.sampled(many, "lang", "text", 600)
    assert len(names) == 300 and rows.groupBy("label").count().filter("count = 3").count() == 300
    copies = spark.range(0, 100_000).select(F.lit("xx").alias("lang"), F.lit("one and the same text").alias("text")).unionAll(spark.range(0, 40).select(F.lit("yy"), F.concat(F.lit("t"), "id")))
    counts = {r.label: r["count"] for r in features.sampled(copies, "lang", "text", 600)[1].groupBy("label").count().collect()}
    assert counts == {"xx": 600, "yy": 40}
    assert len(features.sampled(many.limit(0), "lang", "text", 600)[0]) == 0


def test_three_hundred_languages_are_learned(spark):
    rnd = random.Random(5)
    words = [["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(6)] for _ in range(300)]
    rows = [(i, " ".join(rnd.choice(words[i % 300]) for _ in range(30)), f"l{i % 300}") for i in range(1500)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(table, table.filter("doc_id < 1200"), keep=("doc_id", "lang"), families={}).collect()
    held = [r for r in got if r.doc_id >= 1200]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)


def test_quality_reads_the_words(spark):
    grams = features.Blocks(features.Words(64), features.Grams(256, (3,), shape=False), features.Grams(256, (2, 3), shape=True), features.Gaps())
    a, b, c = grams.counts(pa.array(["the cat sat on the mat", "xqz wvk jjj ql zzz pqr", "the the the the the the"]))
    assert (a != b).any() and (a != c).any()
    # same layout, other words: only the wording tells good from bad
    rnd = random.Random(2)
    good, bad = (["".join(rnd.choice(s) for _ in range(4)) for _ in range(30)] for s in ("abcdefgh", "qrstuvwx"))
    rows = [(i, " ".join(rnd.choice(good if i % 2 else bad) for _ in range(25)), i % 2) for i in range(400)]
    table = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 200], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.scores(table, labels, "quality").collect()}
    assert np.mean([(got[i] >= 0.5) == bool(y) for i, _, y in rows if i >= 200]) > 0.97


def test_quality_against_all_neighbours(spark):
    """The vote of the nearest rows, from plain cosines of the sample's vectors."""
    rnd = random.Random(7)
    rows = [(i, sentence(rnd, rnd.randint(5, 40)) if i % 3 else "!! ## " * rnd.randint(2, 9), int(i % 3 > 0)) for i in range(150)]
    table = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 90], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.scores(table, labels, "quality", neighbours=5).collect()}
    model = quality.fit(table, labels, "quality", "doc_id", "text", 1500)
    for i, text, _ in rows[90:100]:
        z = quality.weighed(model, model["grams"].counts(pa.array([text]))) @ model["basis"]
        z = z[0] / np.linalg.norm(z[0])
        near = sorted(((float(v @ z), -k) for k, v in enumerate(model["vectors"])), reverse=True)[:5]
        weight = [max(c, 0) ** 4 for c, _ in near]
        assert got[i] == pytest.approx(sum(w * model["labels"][-k] for w, (_, k) in zip(weight, near)) / sum(weight), abs=1e-4)


def vocabulary(rnd, n):
    return ["".join(rnd.choice(("ka", "lo", "mi", "tre", "su", "ban", "dor", "fe", "gul", "pos")) for _ in range(rnd.randint(2, 4))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Items, and texts that hold them verbatim, reworded or paraphrased, or do not."""
    rnd = random.Random(11)
    words = vocabulary(rnd, 6000)
    weight = [1 / (i + 3) for i in range(len(words))]
    prose = lambda n: rnd.choices(words, weight, k=n)
    items = [prose(rnd.randint(18, 36)) for _ in range(150)]
    texts, kinds = [], []
    for i, item in enumerate(items):
        w = list(item)
        kind = ("verbatim", "reworded", "paraphrase")[i % 3]
        if kind == "reworded":
            for k in rnd.sample(range(len(w)), len(w) // 5):
                w[k] = rnd.choice(words)
        if kind == "paraphrase":  # clauses in another order, some words replaced
            half = len(w) // 2
            w = w[half:] + prose(2) + w[:half]
            for k in rnd.sample(range(len(w)), len(w) // 8):
                w[k] = rnd.choice(words)
        texts.append(" ".join(prose(rnd.randint(20, 80)) + w + prose(rnd.randint(20, 80))))
        kinds.append(kind)
    texts += [" ".join(prose(rnd.randint(40, 160))) for _ in range(450)]
    return [" ".join(x) for x in items], texts, kinds


def test_paraphrases_are_found_and_clean_texts_left_alone(spark, corpus):
    items, texts, kinds = corpus
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench).collect()}
    share = {k: np.mean([(i, i) in got for i, x in enumerate(kinds) if x == k]) for k in set(kinds)}
    assert share["verbatim"] == 1 and share["reworded"] >= 0.9 and share["paraphrase"] >= 0.9, share
    assert len({d for d, _ in got if d >= len(items)}) == 0
    left = {r.doc_id for r in decontaminate.without(docs, bench).collect()}
    assert left == set(range(len(texts))) - {d for d, _ in got}
    # plain subsequences over whole texts: what covers an item is found
    for i in range(0, 30):
        item, text = items[i].split(), texts[i].split()
        row = [0] * (len(item) + 1)
        for w in text:
            last = 0
            for j, x in enumerate(item, 1):
                last, row[j] = row[j], last + 1 if w == x else max(row[j], row[j - 1])
        if row[-1] >= 0.9 * len(item):
            assert (i, i) in got


def test_an_item_is_found_whatever_else_is_searched(spark, corpus, monkeypatch):
    items, texts, _ = corpus
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = list(enumerate(items))
    find = lambda part: {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, spark.createDataFrame(part, "item_id long, text string")).collect()}
    whole = find(rows)
    parts = set().union(*(find(rows[i::3]) for i in range(3)))
    assert len(whole ^ parts) <= 0.02 * len(whole)
    monkeypatch.setattr(decontaminate, "ITEMS", 40)
    assert find(rows) == whole  # further scans, in the same space


def test_blank_answers_and_stop_word_items(spark):
    docs = spark.createDataFrame([(1, "to be or not to be that is it " + "the of and " * 400), (2, "the of and " * 500)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "to be or not to be that is it", None), (2, "the of and the of and the", " ")], "item_id long, text string, a string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench, answer="a").collect()}
    assert got == {(1, 1), (1, 2), (2, 2)}


def test_stages_judge_rows_not_ids(spark, tmp_path):
    """Ids that repeat, are null or belong to other texts; columns of any name."""
    import corpus_pipeline as P

    rnd = random.Random(3)
    base, other = sentence(rnd, 80), sentence(rnd, 70)
    rows = [(1, base, "en", "s", len(base), 9, 7), (1, other, "en", "s", len(other), 9, 7), (2, base, "en", "s", len(base), 9, 7), (None, base, "en", None, 3, 9, 7), (None, sentence(rnd, 60), None, None, 3, 9, 7), (3, None, None, "t", None, 9, 7), (4, "", "en", "t", 0, 9, 7), (5, "password = hunter2hunter2 " + sentence(rnd, 30), "en", "t", 40, 9, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int, secrets int")
    spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    item = " ".join(other.split()[5:40])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d = str(tmp_path)
    stages = dict(P.STAGES)
    good = stages["quality"](spark, docs, d)
    assert good.columns == docs.columns and good.count() == len(rows)
    unique = stages["near duplicates"](spark, docs, d)
    left = Counter(r.text for r in unique.collect())
    assert unique.columns == docs.columns and left == Counter({t: 1 for t in {r[1] for r in rows}})
    clean = stages["decontamination"](spark, docs, d)
    assert clean.columns == docs.columns and Counter(r.text for r in clean.collect()) == Counter(r[1] for r in rows if r[1] != other)
    safe = stages["secrets"](spark, docs, d)
    assert safe.columns == docs.columns and safe.count() == len(rows) and safe.filter("secrets = 7").count() == len(rows)
    (hidden,) = safe.filter("doc_id = 5").collect()
    assert "hunter2" not in hidden.text and hidden.n_chars == len(hidden.text)
    mixed = stages["mixing"](spark, docs, d)
    plan = curriculum.assign(docs).collect()
    assert mixed.count() == sum(len(r.positions) for r in plan)
    assert Counter(r.text for r in mixed.collect()).keys() <= {r[1] for r in rows}
    places = [r.position for r in mixed.collect()]
    assert places == sorted(places)
    for f in stages.values():
        assert f(spark, docs.limit(0), d).count() == 0


def test_stages_begin_without_what_others_left(spark, monkeypatch):
    """The driver gives back what it holds free: some 100 MB here, pinned by the last block."""
    import os
    import re

    import corpus_pipeline as P
    from tabulint.plans import durable

    class Begun(Exception):
        pass

    def begun(session):
        raise Begun

    def held():
        with open(f"/proc/{os.getpid()}/smaps_rollup") as f:
            return int(re.search(r"\nPss_Anon:\s+(\d+)", f.read())[1]) / 1024

    blocks = [bytes(2000) for _ in range(50_000)]
    pin = blocks[-1]
    del blocks
    before = held()
    assert durable.trimmed(spark)
    assert held() < before - 50 and len(pin) == 2000
    monkeypatch.setattr(P, "trimmed", begun)
    for _, stage in P.STAGES:
        with pytest.raises(Begun):
            stage(spark, None, "")


def packets_of(pid, body, start=True, counter=0):
    """A section or a piece of one in packets, with the pointer before it."""
    out, first = [], True
    data = (b"\0" if start else b"") + body
    while data or first:
        part, data = data[:184], data[184:]
        out.append(bytes([transport.SYNC]) + ((0x4000 if first and start else 0) | pid).to_bytes(2, "big") + bytes([0x10 | counter & 15]) + part.ljust(184, b"\xff"))
        counter, first = counter + 1, False
    return b"".join(out)


def section(table, body):
    head = bytes([table]) + (0xB000 | len(body) + 4).to_bytes(2, "big") + body
    return head + transport.crc32_mpeg(head).to_bytes(4, "big")


def long_tables(streams):
    pat = section(0, (1).to_bytes(2, "big") + b"\xc1\0\0" + (1).to_bytes(2, "big") + (0xE000 | transport.PMT_PID).to_bytes(2, "big"))
    listed = b"".join(bytes([transport.PRIVATE_DATA]) + (0xE000 | p).to_bytes(2, "big") + b"\xf0\x06" + b"\x05\x04abcd" for p in streams)
    pmt = section(2, (1).to_bytes(2, "big") + b"\xc1\0\0" + (0xE000 | streams[0]).to_bytes(2, "big") + b"\xf0\0" + listed)
    return packets_of(0, pat) + packets_of(transport.PMT_PID, pmt)


def test_tables_over_several_packets_and_in_pieces():
    payload = bytes(range(256)) * 300
    data = transport.write_stream(payload)[2 * transport.PACKET :]
    many = [transport.DATA_PID, *range(0x200, 0x23C)]
    stream = long_tables(many) + data
    got = transport.parse_stream(stream)
    assert len(long_tables(many)) > 4 * transport.PACKET and set(got["streams"]) == set(many) and (got["errors"], got["lost"]) == (0, 0)
    assert b"".join(u[4] for u in got["units"]) == payload
    # a table that begins in the packet in which another one ends
    pat = section(0, (1).to_bytes(2, "big") + b"\xc1\0\0" + (1).to_bytes(2, "big") + (0xE000 | transport.PMT_PID).to_bytes(2, "big"))
    both = packets_of(0, pat + pat)
    assert transport.parse_stream(both)["programs"] == {1: transport.PMT_PID}


def test_faults_are_counted_and_units_marked():
    payload = bytes(range(256)) * 400
    s = transport.write_stream(payload)
    whole = transport.parse_stream(s)
    assert not any(u[5] for u in whole["units"]) and len(whole["units"]) == 4
    size = transport.PACKET
    cut = s[: 10 * size] + s[10 * size + 7 :]  # bytes lost inside a packet
    got = transport.parse_stream(cut)
    assert got["errors"] >= 1 and [u[5] for u in got["units"]] == [True, False, False, False] and b"".join(u[4] for u in got["units"][1:]) == payload[transport.UNIT :]
    junk = transport.parse_stream(b"junk\x47" + s)
    assert junk["errors"] == 1 and junk["units"] == whole["units"]
    marked = bytearray(s)
    marked[5 * size + 1] |= 128
    got = transport.parse_stream(bytes(marked))
    assert got["errors"] >= 1 and got["units"][0][5] and not got["units"][1][5]
    hidden = bytearray(s)
    hidden[5 * size + 3] |= 128
    got = transport.parse_stream(bytes(hidden))
    assert got["scrambled"] == 1 and got["units"][0][5]
    twice = s[: 6 * size] + s[5 * size : 6 * size] + s[6 * size :]
    assert transport.parse_stream(twice)["units"] == whole["units"] and transport.parse_stream(twice)["lost"] == 0
    other = bytearray(s[5 * size : 6 * size])
    other[100] ^= 1  # the same counter with other bytes is no repeat
    assert transport.parse_stream(s[: 6 * size] + bytes(other) + s[6 * size :])["lost"] >= 1
    assert transport.parse_stream(b"")["packets"] == 0 and transport.parse_stream(b"\x47" * 50)["errors"] == 1


# words that the operator's own samples do not hold
HELD_OUT = """timer upload download render widget session ticket vector tensor kernel socket stream shader sprite canvas pixel matrix gradient optimizer learning
benutzer kennwort anmeldung verbindung einstellung datenbank tabelle spalte zeile schluessel rechnung bestellung kunde lieferung lager artikel preis menge""".split()


def test_random_parts_are_told_from_names(spark):
    """Keys by alphabet, length and what stands before them, and identifiers."""
    import string

    rnd = random.Random(5)
    alphabets = {"base64": string.ascii_letters + string.digits + "+/", "letters": string.ascii_letters + string.digits, "upper": string.ascii_uppercase + string.digits}
    before = ("", "aws_secret_access_key=", "database_connection_credential=", "services/billing/production/")
    rows = []
    for kind, letters in alphabets.items():
        for n in (20, 32, 40):
            for b in before:
                rows += [(f"{kind} {n}", "see " + b + "".join(rnd.choice(letters) for _ in range(n)) + " there") for _ in range(25)]
    for _ in range(400):
        w = [rnd.choice(HELD_OUT) for _ in range(rnd.randint(3, 5))]
        style = rnd.randrange(5)
        name = ("_".join(w), w[0] + "".join(x.capitalize() for x in w[1:]), "-".join(w), "/" + "/".join(w), "_".join(w).upper())[style]
        rows.append(("name", f"see {name} there"))
    table = spark.createDataFrame(rows, "kind string, text string")
    got = secrets.scan(table, secrets.default_samples(spark)).select("kind", F.exists("secrets", lambda s: s["kind"] == "markov").alias("hit")).collect()
    share = {k: np.mean([r.hit for r in got if r.kind == k]) for k in {r.kind for r in got}}
    assert share.pop("name") <= 0.03, share
    assert all(v >= (0.7 if k.endswith(" 20") else 0.93) for k, v in share.items()), share
    # the part is the key, not the name before it
    key = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzQ8hT2Lk4v"
    (one,) = secrets.scan(spark.createDataFrame([(f"x aws_secret_access_key={key} y",)], "text string"), secrets.default_samples(spark)).collect()
    (span,) = [s for s in one.secrets if s.kind == "markov"]
    assert span.start >= 18 and span.end <= 24 + len(key) and span.end - span.start >= 30


def test_longest_repeated_spans(spark):
    """Every window that also starts earlier lies in a span that its source holds too."""
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(400)}" for _ in range(160)]
    texts = [base[:120], base[10:75] + [f"x{i}" for i in range(9)] + base[70:130], [f"y{i}" for i in range(30)] + base[40:160], base[:120], base[:25] * 3]
    rows = [(f"d{i}", " ".join(t)) for i, t in enumerate(texts)] + [(None, " ".join(base[100:150])), ("d9", None)]
    table = spark.createDataFrame(rows, "doc_id string, text string")
    got = substrings.repeated_spans(table).collect()
    words = {d: (t or "").split() for d, t in rows}
    seen, covered = {}, set()
    order = sorted(words, key=lambda d: (d is not None, d or ""))
    for d in order:
        for i in range(len(words[d]) - 19):
            k = tuple(words[d][i : i + 20])
            if k in seen:
                covered |= {(d, i)}
            seen.setdefault(k, (d, i))
    spans = {(r.doc_id, i) for r in got for i in range(r.start, r.start + r.words - 19)}
    assert spans == covered
    for r in got:
        assert words[r.doc_id][r.start : r.start + r.words] == words[r.source_id][r.source_start : r.source_start + r.words]
        assert (r.source_id is not None, r.source_id or "", r.source_start) < (r.doc_id is not None, r.doc_id or "", r.start)
    assert max(r.words for r in got if r.doc_id == "d3") >= 100
    removed = {r.doc_id: r.n_removed for r in substrings.without_repeats(table).collect()}
    gone = {d: len({i + k for x, i in covered if x == d for k in range(20)}) for d in words}
    assert removed == gone


def test_empty_tables_and_very_long_texts(spark, nothing):
    """Every operator gives an empty table of its columns for one, and reads texts whole."""
    public = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    from tabulint.llm import tokens

    assert secrets.scan(nothing.drop("secrets"), secrets.default_samples(spark)).count() == 0
    assert tokens.token_counts(nothing, public, limit=1024).count() == 0
    assert langid.identify(nothing, nothing).count() == 0
    assert transport.stream_digests(nothing).count() == transport.store_texts(nothing).count() == 0
    assert quality.scores(nothing, spark.createDataFrame([], "doc_id long, quality int"), "quality").count() == 0
    long = "the cat sat on the mat and saw the dog. " * 30_000 + "password = hunter2hunter2 nachher"
    table = spark.createDataFrame([(1, long), (2, "the cat")], "doc_id long, text string")
    (one,) = secrets.scan(table.filter("doc_id = 1"), secrets.default_samples(spark)).collect()
    assert [(s.kind, s.start) for s in one.secrets] == [("assign", 40 * 30_000)]
    assert {r.n_bytes for r in transport.stream_digests(table.filter("doc_id = 1")).collect()} == {len(long)}
    learned = spark.createDataFrame([(1, "the cat sat on the mat", "en"), (2, "der hund und die katze", "de")], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in langid.identify(table, learned).collect()}[1] == "en"
    whole = tokens.token_counts(table, public, limit=1024).filter("doc_id = 1").first()
    assert whole.n_bytes == len(long) and whole.over_limit and whole.n_tokens > 300_000
