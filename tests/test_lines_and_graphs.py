"""Line kinds against a scan by characters, graphs by tables against one task, spans,
trees, name resolution and what the whole analysis adds."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tabulint.operators import aggregates as A
from tabulint.operators import chains, detectors
from tabulint.operators import graph as G
from tabulint.operators import joins as J
from tabulint.operators import lines as L
from tabulint.plans import analyse as Z
from tabulint.plans import explore as E
from tabulint.sources import extract as X
from tabulint.sources import files as S


def plain_kinds(lines: list[str], syntax: str) -> list[str]:
    """One character after the other."""
    out, inside = [], False
    for line in lines:
        if not line.strip():
            out.append("blank")
            continue
        if syntax in ("hash", "none"):
            out.append("comment" if syntax == "hash" and line.strip().startswith("#") else "code")
            continue
        i, code = 0, False
        while i < len(line):
            two, c = line[i : i + 2], line[i]
            if inside:
                inside, i = (False, i + 2) if two == "*/" else (True, i + 1)
            elif two == "//" or (c == "#" and "#" in syntax):
                break
            elif two == "/*":
                inside, i = True, i + 2
            elif c == '"' or (c == "'" and "'" in syntax):
                code, i = True, i + 1
                while i < len(line) and line[i] != c:
                    i += 2 if line[i] == "\\" else 1
                i += 1
            else:
                code |= not c.isspace()
                i += 1
        out.append("code" if code else "comment")
    return out


@pytest.mark.parametrize("syntax", ["c", "c'", "c'#", "hash", "none"])
def test_line_kinds_against_a_scan(spark, syntax):
    rnd = random.Random(syntax)
    parts = ["/*", "*/", "/*/", "//", '"', "'", "\\", "#", "a", " ", "\t", "x = 1;", "*", "/", "'/*'", '"*/"', "fn f<'a>", ""]
    rows, expected = [], {}
    for f in range(40):
        body = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 5))) for _ in range(30)]
        rows += [(f"f{f}", i, x) for i, x in enumerate(body, 1)]
        expected |= {(f"f{f}", i): k for i, k in enumerate(plain_kinds(body, syntax), 1)}
    table = spark.createDataFrame(rows, "path string, ln int, line string")
    got = {(r.path, r.ln): r.what for r in L.line_kinds(table, F.lit(syntax)).collect()}
    assert {k: (got[k], dict(((a, b), c) for a, b, c in rows)[k]) for k in got if got[k] != expected[k]} == {}


def test_line_kinds_of_the_probes(spark):
    rows = [("a.rs", 1, "// see src/*.rs"), ("a.rs", 2, "fn main() {}"), ("b.py", 1, "\t# x"), ("b.py", 2, "\t"), ("c.php", 1, "# y"), ("d.tf", 1, "x = 1 # z")]
    table = spark.createDataFrame(rows, "path string, ln int, line string").withColumn("lang", S.language(F.col("path")))
    got = {(r.path, r.ln): r.what for r in L.line_kinds(table, L.comment_syntax(F.col("lang"))).collect()}
    assert got == {("a.rs", 1): "comment", ("a.rs", 2): "code", ("b.py", 1): "comment", ("b.py", 2): "blank", ("c.php", 1): "comment", ("d.tf", 1): "code"}


def test_graphs_by_tables_and_in_one_task(spark, monkeypatch):
    rnd = random.Random(6)
    edges = [(f"n{rnd.randrange(40)}", f"n{rnd.randrange(40)}") for _ in range(55)] + [(f"m{i}", f"m{i + 1}") for i in range(12)]
    e = spark.createDataFrame(edges, "src string, dst string")
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(40)] + [(f"m{i}",) for i in range(13)] + [("alone",)], "node string")

    def everything():
        scc = G.strong_components(nodes, e).collect()
        table = spark.createDataFrame(scc, "node string, component string")
        sinks, entries = nodes.filter("node in ('n3', 'm5')"), nodes.filter("node in ('n1', 'n2', 'm0')")
        return [
            {tuple(r) for r in G.reachable(nodes.filter("node in ('n1', 'm3')"), e).collect()},
            {tuple(r) for r in G.impact(nodes.filter("node in ('n5', 'm9')"), e).collect()},
            {tuple(r) for r in scc},
            {tuple(r) for r in G.layers(table, e).collect()},
            {(r.node, round(r["rank"], 9)) for r in G.pagerank(nodes, e, rounds=8).collect()},
            {(r.entry, r.sink, r.depth, tuple(r.path)) for r in G.bounded_paths(entries, e, sinks, 6, None).collect()},
        ]

    alone = everything()
    assert all(alone[:5])
    monkeypatch.setattr(G, "SMALL", 0)
    assert everything() == alone
    with pytest.raises(RuntimeError):
        G.reachable(nodes.filter("node = 'm0'"), e, most_rounds=3)
    with pytest.raises(RuntimeError):
        G.layers(nodes.select("node", F.col("node").alias("component")), e.filter("src like 'm%'"), most_rounds=3)


def test_whole_graph_analysis(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 4), (4, 5)], "src long, dst long")
    got = G.analysed(spark.range(1, 6).withColumnRenamed("id", "node"), e)
    assert got["depth"].first().depth == 3 and got["violations"].count() == 2
    assert {r.node for r in got["articulation"].collect()} == {3, 4} and got["cycles"].first().members == [1, 2, 3]


def test_points_with_null_columns_find_their_span(spark):
    points = spark.createDataFrame([("f", 5, None), ("f", 5, "x"), (None, 5, "y"), ("f", None, "z")], "g string, at int, extra string")
    spans = spark.createDataFrame([("f", 1, 9, "wide"), ("f", 4, 6, "tight"), ("f", 6, 4, "inverted")], "g string, a int, z int, id string")
    got = {(r.g, r.at, r.extra): r.span for r in J.enclosing(points, spans, "g", "at", "a", "z", "id", 4).collect()}
    assert got == {("f", 5, None): "tight", ("f", 5, "x"): "tight", (None, 5, "y"): None, ("f", None, "z"): None}


def test_trees_are_listed_before_they_are_read(spark, tmp_path):
    for name, raw in {"a.py": b"x = 1\n", "bad.py": b"ok = 1\n\xff\xfe\nend = 2\n", "gen/b.py": b"y", "c.log": b"z", "keep.log": b"k", "node_modules/m.js": b"m", ".gitignore": b"*.log\n!keep.log\ngen/\n", "wide.css": b"a" * 6000, "wide.py": b"#" * 6000}.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(raw)
    got = {r.path: r.text for r in S.read_tree(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.py", "bad.py", "keep.log", "wide.py"} and got["bad.py"] == "ok = 1\n\nend = 2\n"


def test_methods_resolve_by_their_class(spark):
    rows = [("A", "a", "A", "Class", None), ("Am", "run", "a::A::run", "Method", "A"), ("As", "stop", "a::A::stop", "Method", "A"), ("B", "b", "B", "Class", None), ("Bm", "run", "b::B::run", "Method", "B"), ("f", "free", "a::free", "Function", None)]
    rows = [(i, n if k != "Class" else i, f, k, p, g, 1) for (i, n, f, k, p), g in zip(rows, "aaabba")]
    symbols = spark.createDataFrame(rows, "id string, name string, full_name string, kind string, parent_id string, group string, line_start int")
    calls = [(1, "$this->run", "z", "A"), (2, "self.run", "z", "B"), (3, "B::run", "z", None), (4, "A.run", "z", None), (5, "free", "z", None), (6, "x.run", "z", None), (7, "x.run", "b", None), (8, "parent::stop", "z", "A"), (9, "A::run", "z", None), (10, "nothing", "z", None)]
    table = spark.createDataFrame(calls, "call_id int, name string, group string, owner string")
    s, tiers = J.method_tiers(symbols)
    got = {r.call_id: r.target for r in J.resolve(table, s, tiers, ["group", "line_start"]).collect()}
    assert got == {1: "Am", 2: "Bm", 3: "Bm", 4: "Am", 5: "f", 6: None, 7: "Bm", 8: "As", 9: "Am", 10: None}
    assert {r.id: r.class_id for r in J.with_class(symbols).collect()} == {"A": "A", "Am": "A", "As": "A", "B": "B", "Bm": "B", "f": None}


def test_call_sites_originals_and_dependencies(spark):
    symbols = spark.createDataFrame([("1", "f"), ("2", "g"), ("3", "h")], "id string, name string")
    calls = spark.createDataFrame([("a", 1, "c", "1", None), ("a", 1, "c", "1", None), ("b", 2, "d", None, "x.f"), ("b", 3, "d", "2", None)], "path string, line_start int, caller_id string, callee_id string, callee_name string")
    got = {r.id: (r.sites, r.callers) for r in A.call_sites(symbols, calls).collect()}
    assert got == {"1": (2, ["c", "d"]), "2": (1, ["d"])}
    copies = spark.createDataFrame([(1, "h", 0), (2, "h", 5), (3, "h", None), (4, "k", 1)], "id int, x string, w int")
    assert {(r.id, r.canonical) for r in A.duplicate_cascade(copies, "id", [F.col("x")], F.col("w")).collect()} == {(1, 2), (2, 2), (3, 2)}
    locked = spark.createDataFrame([("a", "1.2.0"), ("a", "2.0.0"), ("b", "0.3.1"), ("b", "0.3.9"), ("c", "0.1.0"), ("c", "0.2.0"), ("d", "odd"), ("d", "1.0.0")], "name string, version string")
    assert {r.name: r.lines for r in A.duplicate_dependencies(locked).collect()} == {"a": ["1", "2"], "c": ["0.1", "0.2"]}


def test_one_symbol_or_an_error(spark):
    s = spark.createDataFrame([("a::run", "run"), ("b::run", "run"), ("c::stop", "stop")], "full_name string, name string")
    assert J.lookup_one(s, "stop").first().full_name == "c::stop"
    for q in ("run", "nothing"):
        with pytest.raises(LookupError):
            J.lookup_one(s, q)


def test_forbidden_functions_and_guarded_paths(spark):
    rows = [("a.php", 1, "Php", "x = md5(y)"), ("a.php", 2, "Php", "amd5(y); md5(z)"), ("a.php", 3, "Php", "# md5(z)"), ("vendor/a.php", 1, "Php", "md5(y)"), ("x/tests/a.php", 1, "Php", "md5(y)"), ("x/tests/fixtures/a.php", 1, "Php", "md5(y)"), ("a.rs", 1, "Rust", "md5(y)")]
    table = spark.createDataFrame(rows, "path string, ln int, lang string, line string")
    assert {(r.path, r.ln) for r in detectors.forbidden_calls(table, ["md5"]).collect()} == {("a.php", 1), ("x/tests/fixtures/a.php", 1)}
    assert detectors.forbidden_calls(table, []).count() == 0


def test_deletions_count_where_the_receiver_is_a_store(spark):
    rows = [("cart.delete", "JavaScript"), ("db.delete", "JavaScript"), ("model.destroy", "Python"), ("Vec::purge", "Rust"), ("repo.purge", "Rust"), ("x.forceDelete", "Rust"), ("$x->delete", "Php"), ("filesystemAdapter", "Php"), ("eval", "Python")]
    got = [r.k for r in spark.createDataFrame(rows, "n string, l string").select(chains.sink_of(F.col("n"), F.col("l")).alias("k")).collect()]
    assert got == [None, "Deletion", "Deletion", None, "Deletion", "Deletion", "Deletion", None, "Exec"]


def test_names_with_signs_are_renamed(spark):
    files = spark.createDataFrame([("f", "$a.b = $a.b + aXb;")], "path string, text string")
    at = spark.createDataFrame([("f", 1)], "path string, ln int")
    assert E.renamed(files, at, "$a.b", "$c").first().text == "$c = $c + aXb;"


def test_routes_of_annotations_and_calls():
    java = '@RequestMapping("/api")\nclass A {\n  @GetMapping("/x/{id}")\n  String one(\n    int a) {}\n  @RequestMapping(value = "/y", method = RequestMethod.POST)\n  String two() {}\n}\n@Path("/r")\nclass B {\n  @GET\n  @Path("z")\n  void z() {}\n}\n'
    assert [x[:2] for x in X.web_routes("Java", java)] == [("get", "/api/x/{id}"), ("post", "/api/y"), ("get", "/r/z")]
    assert [x[:2] for x in X.web_routes("Rust", '#[get("/a")]\nasync fn a() {}\nRouter::new().route("/b", get(h).post(k));')] == [("get", "/a"), ("get", "/b"), ("post", "/b")]
    assert [x[:2] for x in X.web_routes("Go", 'r.GET("/q", h)\nhttp.HandleFunc("/w", h)\nmux.Handle("POST /e", h)')] == [("get", "/q"), ("any", "/w"), ("post", "/e")]
    symbols = {r["name"]: r["param_count"] for r in X.pattern_facts("a.go", "Go", "func Long(\n  a int,\n  b string,\n) error {\n}\n") if r["rel"] == "symbol"}
    assert symbols == {"Long": 2}


def test_the_whole_analysis_reads_settings_locks_and_comments(spark):
    tree = {
        "src/a.py": "class Store:\n    def save(self):\n        self.check()\n\n    def check(self):\n        eval('1')  # lint:ignore EvalUsage\n\ndef BadName():\n    return hash_it(1)\n\nBadName()\n",
        "src/b.py": "# lint:ignore\nx = 1\n",
        "tests/test_a.py": "from src.a import Store\n\ndef test_save():\n    Store.save(1)\n",
        "routes/api.php": "<?php\nRoute::get('/open', 'A@b');\nRoute::middleware('auth')->get('/closed', 'A@c');\n",
        "Cargo.lock": '[[package]]\nname = "a"\nversion = "1.0.0"\n\n[[package]]\nname = "a"\nversion = "2.0.0"\n',
        "Cargo.toml": '[dependencies]\ntokio = "1"\n',
        "src/t.rs": "fn f() {\n    let t = interval(d);\n}\n",
    }
    files = spark.createDataFrame(list(tree.items()), "path string, text string").withColumn("lang", S.language(F.col("path")))
    known = spark.createDataFrame([("a", "1.0.5")], "package string, p string").select("package", F.struct(F.lit(1).cast("long").alias("major"), F.lit(0).cast("long").alias("minor"), F.lit(5).cast("long").alias("patch")).alias("patched"))
    base = spark.createDataFrame([("0",)], "fingerprint string")
    out = Z.analyse(files, advisories=known, baseline=base)
    got = {(r.file, r.line, r.kind) for r in out["findings"].collect()}
    assert ("src/a.py", 6, "EvalUsage") not in got
    for expected in [("src/b.py", 1, "StaleSuppression"), ("src/a.py", 8, "ConventionViolation"), ("routes/api.php", 2, "MissingAuthMiddleware"), ("Cargo.lock", 0, "DuplicateDependency"), ("Cargo.lock", 0, "VulnerableDependency"), ("src/t.rs", 2, "CrateApiMisuse")]:
        assert expected in got, expected
    assert ("routes/api.php", 3, "MissingAuthMiddleware") not in got
    calls = {(r.callee_name, r.target_kind) for r in out["calls"].collect()}
    assert ("self.check", "Resolved") in calls and ("Store.save", "Resolved") in calls
    assert out["score"].first().test_coverage > 0 and out["new"].count() > 0 and out["resolved"].count() == 1


def test_three_levels_of_copies(spark):
    rows = [("1", "a", "n", "f", 1, 4), ("2", "a", "n", "f", 1, 4), ("3", "b", "n", "f", 1, 4), ("4", "c", "m", "f", 1, 4), ("5", "d", "m", "f", 1, 4), ("6", "e", "o", "g", 1, 4), ("7", "h", "p", "g", 1, 4), ("8", "i", "q", "g", 1, 1)]
    symbols = spark.createDataFrame(rows, "id string, hash string, normalized_hash string, flow_hash string, line_start int, line_end int").withColumns({"kind": F.lit("Function"), "name": F.col("id"), "path": F.lit("x")})
    calls = spark.createDataFrame([("x", 1, "5", "7", None)], "path string, line_start int, caller_id string, callee_id string, callee_name string")
    got = {r.symbol: (r.kind, r.confidence) for r in Z.duplicates(symbols, calls).collect()}
    assert got == {"2": ("ExactDuplicate", 0.99), "5": ("RenamedDuplicate", 0.9), "6": ("SemanticDuplicate", 0.7)}


def test_rounds_over_tables_send_no_table_through_the_driver(spark, monkeypatch):
    plans, real = [], G.saved

    def saved(df, name, **options):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name, **options)

    monkeypatch.setattr(G, "saved", saved)
    monkeypatch.setattr(G, "SMALL", 0)
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    nodes = real(spark.range(1, 5).withColumnRenamed("id", "node"), "nodes")
    e = real(e, "edges")
    assert G.pagerank(nodes, e, rounds=2).count() == 4
    assert {r.layer for r in G.layers(real(G.strong_components(nodes, e), "components"), e).collect()} == {0, 1}
    assert len(plans) > 10 and not any("Broadcast" in p for p in plans)
