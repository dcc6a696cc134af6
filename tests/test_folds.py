from __future__ import annotations


from tabulint.operators import folds as D
from tabulint.operators.libraries import misuse
from tabulint.operators.lines import lines
from tabulint.plans import explore as E
from tabulint.sources import extract as X
from tabulint.sources import files as S


def test_lock_over_await():
    code = ["async fn f() {", "  let g = m.lock().unwrap();", "  {", "    let h = m.borrow();", "  }", "  x().await;", "  y().await;", "}", "fn g() {", "  let a = m.lock();", "}"]
    assert [(x[0], x[4]) for x in D.lock_over_await(code)] == [(6, "guard `g` of line 2 lives over an await")]
    assert D.lock_over_await(["async fn f() {", "let g = m.lock().await;", "x().await;", "}"]) == []
    assert D.lock_over_await(["async fn f() {", "let g = m.lock().unwrap();", "drop(g);", "x().await;", "}"]) == []


def test_hooks():
    code = ["useEffect(() => { f(',') });", "useMemo(() => g([1]), [a]);", "// useEffect(() => 1)", "useCallback((a) => {", "  h(a);", "}, []);"]
    assert [x[0] for x in D.hook_dependencies(code)] == [1]


def test_eager_loading():
    code = ["class A extends TransformerAbstract {", "function transform($x) {", "  return $x->user->name;", "}", "}"]
    assert [x[0] for x in D.eager_loading(code, "app/ATransformer.php")] == [2]
    assert D.eager_loading([*code, "$q->with(['user']);"], "app/ATransformer.php") == [] and D.eager_loading(code, "app/A.php") == []


def test_nonces():
    assert [x[0] for x in D.static_nonces(["c.encrypt(&[0u8; 12], m);", "let n = [0u8; 24];", "c.seal(&n, m);"])] == [1, 3]
    assert D.static_nonces(["let mut n = [0u8; 12];", "OsRng.fill_bytes(&mut n);", "c.encrypt(&n, m);"]) == []


def test_transport(spark):
    code = "use UdpSocket;\nfn send(s: S) {\n  s.send(&len.to_be_bytes());\n  s.send(body);\n}\nfn one(s: S) {\n  s.send(x);\n}\nfn read() {\n  let size = u32::from_be_bytes(b);\n  let v = Vec::with_capacity(size);\n  let other = u32::from_be_bytes(c);\n  if other > MAX { return; }\n  let w = Vec::with_capacity(other);\n}\n"
    rows = lines(spark.createDataFrame([("a.rs", code)], "path string, text string"), "path", "text")
    assert [r.ln for r in D.split_messages(rows).collect()] == [3]
    assert [r.ln for r in D.unchecked_lengths(rows).collect()] == [11]


def test_routes(spark):
    routes = spark.createDataFrame([("web.php", 3, "get", "/a", ["auth"]), ("web.php", 4, "get", "/b", []), ("web.php", 9, "get", "/c", ["web"]), ("web.php", 10, "get", "/health", []), ("auth.php", 1, "get", "/d", [])], "file string, line int, verb string, route string, middleware array<string>")
    ranges = spark.createDataFrame([("web.php", 4, 6)], "file string, start int, end int")
    assert [(r.path, r.ln) for r in D.unauthenticated_routes(routes, ranges).collect()] == [("web.php", 9)]


def test_questions(spark):
    symbols = spark.createDataFrame([("1", "a", "p::a", "p.py", 1, 5), ("2", "b", "p::b", "p.py", 7, 9), ("3", "c", "q::c", "q.py", 1, 2)], "id string, name string, full_name string, path string, line_start int, line_end int")
    calls = spark.createDataFrame([("p.py", 2, "1", "2", "b", "Resolved"), ("q.py", 2, "3", "1", "a", "Resolved"), ("q.py", 2, "3", None, "x.b", "Unresolved")], "path string, line_start int, caller_id string, callee_id string, callee_name string, target_kind string")
    assert [r.caller for r in E.callers_of(symbols, calls, "2").collect()] == ["p::a"]
    assert E.callees_of(symbols, calls, "3").first().asDict() == {"resolved": ["p::a"], "unresolved": ["x.b"], "dynamic": []}
    assert [(r.path, r.resolved) for r in E.references_of(symbols, calls, "2").collect()] == [("p.py", True), ("q.py", False)]
    assert {r.full_name for r in E.impact_of(symbols, calls, "2").collect()} == {"p::a", "q::c"}
    maps = E.system_map(symbols, calls)
    assert {(r.src, r.dst, r.weight) for r in maps["edges"].collect()} == {("q.py", "p.py", 1)} and maps["cycles"].count() == 0
    found = spark.createDataFrame([("UnboundedChannel", "High", "f", 1), ("X", "Low", "g", 2)], "kind string, severity string, file string, line int")
    impacts = spark.createDataFrame(E.IMPACTS, "kind string, objective string, direction string, weight int")
    assert [(r.kind, r.relevance) for r in E.relevance(found, impacts, ["Latency", "Throughput"]).collect()] == [("UnboundedChannel", 2)]
    assert [(r.kind, r.relevance) for r in E.relevance(found, impacts, ["Latency", "Throughput"], signed=True).collect()] == [("UnboundedChannel", 1)]
    assert E.baseline_gate(found).first().passed is False
    assert [r.kind for r in E.audit(found, least="Medium").collect()] == ["UnboundedChannel"]
    text = spark.createDataFrame([("p", "foo(foo)\nfoo_bar\nfoo")], "path string, text string")
    at = spark.createDataFrame([("p", 1), ("p", 2)], "path string, ln int")
    assert E.renamed(text, at, "foo", "baz").first().text == "baz(baz)\nfoo_bar\nfoo"
    assert [(r.path, r.start) for r in E.deletions(symbols, symbols.filter("path = 'p.py'")).collect()] == [("p.py", 7), ("p.py", 1)]
    wrap = spark.createDataFrame([("api", "/x")], "via string, route string")
    assert E.promoted(wrap.select("route").limit(0), wrap, spark.createDataFrame([("api",)], "name string")).count() == 1


def test_library_rules(spark):
    rows = spark.createDataFrame([("a.rs", "Rust", 1, "let t = interval(d);"), ("b.rs", "Rust", 1, "interval(d)"), ("b.rs", "Rust", 2, "t.set_missed_tick_behavior(x)"), ("a.rs", "Rust", 2, "mem::forget(g)"), ("a.rs", "Rust", 3, "// mem::forget(g)"), ("a.rs", "Rust", 4, "UDP_BUFFER_SIZE")], "path string, lang string, ln int, line string")
    deps = spark.createDataFrame([("tokio",)], "name string")
    assert {(r.path, r.ln) for r in misuse(rows, deps).collect()} == {("a.rs", 1), ("a.rs", 2)}
    assert {(r.path, r.ln) for r in misuse(rows, deps.limit(0)).collect()} <= {("a.rs", 2)}


def test_framework(spark):
    of = lambda *rows: S.framework(spark.createDataFrame(list(rows), "path string, text string")).first().framework
    assert of(("composer.json", '{"require": {"laravel/framework": "^11"}}')) == "Laravel"
    assert of(("composer.json", '{"require": {"symfony/symfony": "1"}}')) == "Symfony"
    assert of(("composer.json", "{}"), ("wp-config.php", "")) == "WordPress" and of(("a.php", "")) == "Unknown"


def test_framework_routes():
    text = """<?php
Route::get('/open', 'A@b');
Route::middleware(['auth'])->prefix('admin')->group(function () {
    Route::post('users', [U::class, 'store'])->middleware('can:x');
    Route::apiResource('posts', P::class);
});
Route::match(['get', 'post'], 'both', 'A@c');
"""
    got = X.framework_routes(text, prefix="api")
    assert ("get", "/api/open", [], 2) in got and ("post", "/api/admin/users", ["auth", "can:x"], 4) in got
    assert [(v, p) for v, p, m, ln in got if ln == 5] == [("get", "/api/admin/posts"), ("post", "/api/admin/posts"), ("get", "/api/admin/posts/{post}"), ("put", "/api/admin/posts/{post}"), ("delete", "/api/admin/posts/{post}")]
    assert [(v, p, m) for v, p, m, ln in got if ln == 7] == [("get", "/api/both", []), ("post", "/api/both", [])]
