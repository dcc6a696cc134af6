from __future__ import annotations

from pyspark.sql import functions as F

from tabulint.operators import aggregates as A
from tabulint.operators import findings as P
from tabulint.operators import graph as G
from tabulint.operators import joins as J
from tabulint.operators import lines as L
from tabulint.operators.components import components


def test_lines(spark):
    files = spark.createDataFrame([("a", "x\r\ny\n"), ("b", ""), ("c", None), ("d", "\n\nz"), ("e", "q" * 10_001)], "path string, text string")
    got = {(r.path, r.ln): r.line for r in L.lines(files, "path", "text", longest=L.LONGEST).collect()}
    assert got == {("a", 1): "x", ("a", 2): "y", ("d", 1): "", ("d", 2): "", ("d", 3): "z"}


def test_secret_lines(spark):
    cases = {
        'password = "hunter2hunter2"': True, "api_key: 'configured'": False, 'token = "{value}xxxxxxx"': False, 'secret = "auth.login.name"': False,
        'secret = "sk-live-abc-defgh"': True, 'password = "a placeholder b"': False, "token = 'short'": False, 'token = "my-id-12345678"': True,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "line string")
    assert {r.line: r.x for r in rows.select("line", L.is_hardcoded_secret(F.col("line")).alias("x")).collect()} == cases


def test_line_kinds(spark):
    code = ["int a; // x", "/* one", "two", "three */ int b;", "", 'char *s = "// no";', "// c", "/* d */"]
    rows = spark.createDataFrame([("f", i, x) for i, x in enumerate(code)], "path string, ln int, line string")
    got = [r.what for r in L.line_kinds(rows, F.lit("c")).orderBy("ln").collect()]
    assert got == ["code", "comment", "comment", "code", "blank", "code", "comment", "comment"]


def test_suppression(spark):
    found = spark.createDataFrame([("a", 5, "X"), ("a", 6, "Y"), ("a", 8, "X"), ("a", 0, "X"), ("b", 5, "X")], "file string, line int, kind string")
    sites = spark.createDataFrame([("a", 5, ["X"]), ("a", 20, None), ("a", 7, ["Y"])], "file string, ln int, kinds array<string>")
    kept, gone, stale = J.suppress(found, sites)
    assert {tuple(r) for r in gone.collect()} == {("a", 5, "X")} and kept.count() == 4 and {r.ln for r in stale.collect()} == {20, 7}


def test_endpoints(spark):
    routes = spark.createDataFrame([(1, "get", "/api/v1/users"), (2, "any", "/users/{id}"), (3, "get", "/users/:id")], "route_seq int, verb string, path string")
    calls = spark.createDataFrame([(1, "get", "/users/7"), (2, "get", "/users"), (3, "post", "/users"), (4, "any", "/api/v1/users?x")], "call_seq int, verb string, path string")
    got = {r.call_seq: (r.route_seq, r.match) for r in J.link_endpoints(calls, routes).collect()}
    assert got == {1: (2, "exact"), 2: (1, "prefix"), 3: (None, None), 4: (1, "exact")}


def test_enclosing(spark):
    spans = spark.createDataFrame([("f", 1, 100, 1), ("f", 10, 20, 2), ("f", 10, 20, 3), ("f", 30, 25, 4)], "p string, a long, z long, id int")
    points = spark.createDataFrame([("f", 15), ("f", 27), ("f", 101), ("g", 15)], "p string, ln long")
    got = {(r.p, r.ln): r.span for r in J.enclosing(points, spans, "p", "ln", "a", "z", "id", 8).collect()}
    assert got == {("f", 15): 2, ("f", 27): 1, ("f", 101): None, ("g", 15): None}


def test_enclosing_spans_meet_no_place_twice(spark):
    rows = [("f", a, a + w, a * 100 + w) for a in range(-40, 60, 3) for w in (-2, 0, 1, 5, 17, 64)] + [("g", -7, -7, 1), ("g", -7, -7, 0)]
    at = [("f", x) for x in range(-50, 140)] + [("g", -7), ("g", 0)]

    def found(kind):
        spans = spark.createDataFrame(rows, "p string, a long, z long, id long").select("p", F.col("a").cast(kind), F.col("z").cast(kind), "id")
        return J.enclosing(spark.createDataFrame(at, "p string, ln long").select("p", F.col("ln").cast(kind)), spans, "p", "ln", "a", "z", "id", 8)

    wanted = {x: min(((z - a, a, z, i) for p, a, z, i in rows if p == x[0] and a <= x[1] <= z), default=(None,) * 4)[3] for x in at}
    for kind in ("int", "long", "double"):
        assert {(r.p, int(r.ln)): r.span for r in found(kind).collect()} == wanted
    # a join by bins compared each span with each place of its bin
    plan = found("long")._jdf.queryExecution().optimizedPlan().toString()
    assert not any(">=" in x for x in plan.splitlines() if "Join" in x)


def test_graphs(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (5, 6), (7, 7), (1, 2)]
    e = spark.createDataFrame(edges, "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in range(1, 9)], "node long")
    scc = {r.node: r.component for r in G.strong_components(nodes, e).collect()}
    assert scc == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8}
    assert {r.component: r.layer for r in G.layers(spark.createDataFrame(list(scc.items()), "node long, component long"), e).collect()} == {1: 0, 4: 1, 6: 2, 7: 0, 8: 0}
    assert {r.node for r in G.per_component(e, "articulation").collect()} == {3, 4, 5}
    n, rank = 8, {i: 1 / 8 for i in range(1, 9)}
    real = [x for x in edges if x[0] != x[1]]
    for _ in range(60):
        out = {i: sum(a == i for a, _ in real) for i in rank}
        lost = sum(rank[i] for i in rank if not out[i]) * 0.85 / n
        rank = {i: 0.15 / n + lost + 0.85 * sum(rank[a] / out[a] for a, b in real if b == i) for i in rank}
    got = {r.node: r["rank"] for r in G.pagerank(nodes, e).collect()}
    assert all(abs(got[i] - rank[i]) < 1e-9 for i in rank)
    chains = G.bounded_paths(nodes.filter("node = 1"), e, nodes.filter("node in (4, 6)"), 6, None).collect()
    assert {(r.sink, r.depth, tuple(r.path)) for r in chains} == {(4, 3, (1, 2, 3, 4))}
    assert {r.node: r.root for r in components(e.select(F.col("src").alias("u"), F.col("dst").alias("v"))).collect()} == {i: 1 for i in range(1, 7)}
    groups = {r.node: r.community for r in G.per_component(e, "community").collect()}
    assert set(groups) == set(range(1, 7))


def test_score_and_gate(spark):
    schema = "kind string, severity string, file string"
    clean = P.score(spark.createDataFrame([], schema), 10)
    assert clean.first().overall == 100 and clean.first().security == 100
    some = spark.createDataFrame([("SqlInjection", "Critical", "a")] * 2 + [("DeadFunction", "Low", "b")] * 3 + [("PanicRisk", "High", "c")], schema)
    s = P.score(some, 10).first()
    assert (s.security, s.architecture, s.overall) == (70, 85, 79)
    assert P.deploy_gate(P.score(spark.createDataFrame([], schema), 1), spark.createDataFrame([], schema), files=0).first().passed is False
    assert P.deploy_gate(clean, spark.createDataFrame([], schema), files=3).first().passed is True


def test_fingerprints_are_stable(spark):
    rows = [(1, "K", "a\\b.py", "f", "line 12 is long"), (2, "K", "a/b.py", "f", "line 99 is long"), (3, "K", "a/b.py", None, "x")]
    f = spark.createDataFrame(rows, "id int, kind string, file string, symbol string, message string")
    got = {r.id: r.fingerprint for r in P.fingerprints(f, ["id"]).collect()}
    moved = f.withColumn("message", F.regexp_replace("message", "12|99", "7")).repartition(3)
    assert {r.id: r.fingerprint for r in P.fingerprints(moved, ["id"]).collect()} == got and len(set(got.values())) == 3


def test_call_sites_of_a_common_name_are_put_together_once(spark):
    n = 30
    symbols = spark.createDataFrame([(i, "run") for i in range(n)] + [(0, "go"), (n, None), (n + 1, "go")], "id int, name string")
    calls = [("f", i, i, None, "x.run") for i in range(n)] + [("f", 0, 0, 1, "run"), ("f", 99, 5, 1, "run"), ("f", 98, -7, 2, "run"), ("g", 1, 50, None, "go"), (None, 3, 1, 77, "z"), ("h", 1, None, n, "z")]
    out = A.call_sites(symbols, spark.createDataFrame(calls, "path string, line_start int, caller_id int, callee_id int, callee_name string"))
    got = {r.id: (r.sites, r.callers) for r in out.collect()}
    every = list(range(n))
    wanted = {i: (n, every) for i in range(n)} | {0: (n + 1, [*every, 50]), 1: (n + 1, every), 2: (n + 1, [-7, *every]), n: (1, []), n + 1: (1, [50]), 77: (0, [1])}
    assert got == wanted
    # symbols meet the lists of their names last, and no aggregation follows with a row for each symbol and call
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
