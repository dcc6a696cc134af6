"""The analysis of a small tree, and each part of it on its own fixtures."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tabulint.operators import infra, taint
from tabulint.operators.lines import lines
from tabulint.plans import analyse as Z
from tabulint.plans import report
from tabulint.sources import extract as X
from tabulint.sources import files as S
from tabulint.streaming import snapshots

TREE = {
    "app/main.py": "import os\n\ndef used(a):\n    return a + 1\n\ndef unused(b):\n    return b * 2\n\ndef main():\n    used(1)\n\nmain()\n",
    "app/copy.py": "def first(x):\n    y = x + 1\n    return y\n\ndef second(z):\n    q = z + 1\n    return q\n\nfirst(1)\nsecond(2)\n",
    "tests/test_main.py": "from app.main import used\n\ndef test_used():\n    assert used(1) == 2\n",
    "web/page.php": "<?php\nfunction show() {\n  $id = $_GET['id'];\n  mysql_query(\"SELECT * FROM t WHERE id = \" . $id);\n  $safe = intval($_GET['n']);\n  echo $safe;\n  return $id;\n}\n$hash = md5($password);\neval($x);\n",
    "web/api.js": "const password = \"hunter2hunter2\";\napp.get('/users/:id', show);\nfunction load() {\n  return fetch('/users/7');\n}\nload();\n",
    "net/server.rs": "use std::sync::Mutex;\nfn handle_packet(m: &Mutex<u8>) {\n    let b = buf.to_vec();\n    m.lock().unwrap();\n}\npub fn cold() {\n    value.unwrap();\n    unsafe { x() }\n}\nasync fn wait() {\n    std::thread::sleep(d);\n}\n",
    "Dockerfile": "FROM node:latest AS build\nRUN curl http://x | sh\nFROM build\nENV API_TOKEN=abc\nUSER root\n",
    "infra/main.tf": "resource \"aws_s3_bucket\" \"b\" {\n  acl = \"public-read\"\n}\nresource \"aws_security_group\" \"g\" {\n  ingress {\n    cidr_blocks = [\"0.0.0.0/0\"]\n  }\n  egress {\n  }\n}\n",
    "k8s/pod.yaml": "apiVersion: v1\nkind: Pod\nspec:\n  containers:\n  - name: a\n    image: app:latest\n    securityContext:\n      privileged: true\n    env:\n    - name: DB_PASSWORD\n      value: abc\n---\nkind: [\n",
    "broken.py": "def (:\n",
}


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in TREE.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    (root / "vendor").mkdir()
    (root / "vendor/lib.js").write_text("eval(x)\n")
    (root / "bin.py").write_bytes(b"\0\1\2")
    return S.read_tree(spark, str(root))


def test_tree(tree):
    got = {r.path: r.lang for r in tree.collect()}
    assert set(got) == set(TREE) and got["Dockerfile"] == "Dockerfile" and got["k8s/pod.yaml"] == "Yaml" and got["infra/main.tf"] == "Terraform"
    assert S.main_language(tree).first().lang == "Python"


def test_analysis(spark, tree):
    out = Z.analyse(tree)
    got = {(r.file, r.line, r.kind) for r in out["findings"].collect()}
    for expected in [
        ("app/main.py", 6, "DeadFunction"), ("web/page.php", 4, "SqlInjection"), ("web/page.php", 9, "WeakCrypto"), ("web/page.php", 10, "EvalUsage"), ("web/api.js", 1, "HardcodedSecret"),
        ("net/server.rs", 3, "HotPathAllocation"), ("net/server.rs", 4, "LockOnHotPath"), ("net/server.rs", 7, "PanicRisk"), ("net/server.rs", 8, "UnsafeUsage"), ("net/server.rs", 8, "MissingSafetyComment"), ("net/server.rs", 11, "BlockingInAsync"),
        ("Dockerfile", 1, "UnpinnedImage"), ("Dockerfile", 2, "EvalUsage"), ("Dockerfile", 4, "HardcodedCredential"), ("Dockerfile", 5, "RunningAsRoot"), ("infra/main.tf", 2, "PublicResource"), ("infra/main.tf", 1, "UnencryptedStorage"), ("infra/main.tf", 4, "OpenSecurityGroup"),
        ("k8s/pod.yaml", 1, "PrivilegedContainer"), ("k8s/pod.yaml", 1, "SecretInEnvVar"), ("broken.py", 1, "ParseFailure"),
    ]:
        assert expected in got, expected
    assert not [x for x in got if x[0] == "web/page.php" and x[1] == 6]
    assert {k for f, _, k in got if f == "app/copy.py"} & {"RenamedDuplicate"}
    assert {(r.verb, r.route) for r in out["routes"].collect()} == {("get", "/users/:id")}
    assert {(r.verb, r.route) for r in out["http_calls"].collect()} == {("get", "/users/7")}
    reach = {r.file: (r.functions, r.reached) for r in out["reachability"].collect()}
    assert reach["app/main.py"] == (3, 1)
    assert 0 <= out["score"].first().overall <= 79
    log = json.loads(report.sarif(out["findings"]).first().value)
    assert len(log["runs"][0]["results"]) == out["findings"].count()
    back = S.baseline(report.baseline_text(out["findings"]))
    assert {f for f, _ in back} == {r.fingerprint for r in out["findings"].collect()}
    shown = report.frames(out["findings"], out["lines"]).filter("file = 'web/page.php' and line = 4").orderBy("ln").collect()
    assert [r.ln for r in shown] == [2, 3, 4, 5, 6]
    assert "# Report" in report.markdown(out["score"], out["findings"])


def test_taint_rules():
    php = lambda *x: [(r[0], r[1], r[3]) for r in taint.fold(list(x), "Php", frozenset({"dirty"})) if r[1] == "hit"]
    assert php("$a = $_GET['x'];", "$a = intval($a);", "eval($a);") == []
    assert php("$q = $_GET['x'];", "$q .= 'safe';", "eval($q);") == [(3, "hit", "Exec")]
    assert php("$q = $_GET['x'];", "function f() {", "eval($q);") == []
    assert php("$b = dirty();", "echo $b;") == [(2, "hit", "Html")]
    assert taint.fold(["fn f() { sqlx::query(\"select $1\").bind(x); }"], "Rust", frozenset())[0:1] == []


def test_taint_across_functions(spark):
    files = spark.createDataFrame([("a.php", "Php", "function sinks($x) {\n  eval($x);\n}\nfunction enters() {\n  $v = $_GET['a'];\n  sinks($v);\n}\n")], "path string, lang string, text string")
    assert {(r.ln, r.kind, r.severity) for r in taint.findings(files).collect()} == {(6, "EvalUsage", "High")}


def test_formats(spark):
    text = {"l": "TN:\nSF:a.py\nDA:1,3\nDA:1,5\nDA:2,0\nFN:1,f,g\nFNDA:2,f,g\nend_of_record\n", "c": '[[package]]\nname = "a"\nversion = "1.2.3"\n\n[[package]]\nname = "b"\nversion = "0.1.0"\n', "t": '[dependencies]\nserde = "1"\ntokio = { version = "1" }\n[dev-dependencies.rand]\nversion = "0.8"\n[package]\nname = "x"\n', "y": "a: 1\n---\nb: 2\n"}
    rows = lines(spark.createDataFrame(list(text.items()), "path string, text string"), "path", "text")
    of = lambda p: rows.filter(F.col("path") == p)
    cov = S.lcov(of("l").withColumnRenamed("path", "report"))
    assert {(r.path, r.line, r.function, r.hits) for r in cov.collect()} == {("a.py", 1, None, 5), ("a.py", 2, None, 0), ("a.py", None, "f,g", 2)}
    assert {(r.name, r.version) for r in S.cargo_lock(of("c")).collect()} == {("a", "1.2.3"), ("b", "0.1.0")}
    assert {r.name for r in S.toml_dependencies(of("t")).collect()} == {"serde", "tokio", "rand"}
    assert {(r.doc, r.first_ln, r.text) for r in S.yaml_documents(of("y")).collect()} == {(0, 1, "a: 1"), (1, 3, "b: 2")}
    bad = lines(spark.createDataFrame([("l", "DA:1,2\n")], "report string, text string"), "report", "text")
    with pytest.raises(Exception, match="bad coverage record"):
        S.lcov(bad).collect()
    with pytest.raises(ValueError):
        S.baseline("{}")
    assert S.baseline('{"fingerprints": ["a|b"]}') == [("a|b", None)]


def test_ignore_lines():
    rules = ["*.log", "!keep.log", "/out/", "docs/*.md", "# note"]
    assert S.ignored("a/b.log", rules) and not S.ignored("keep.log", rules) and S.ignored("out/x", rules) and not S.ignored("a/out/x", rules) and S.ignored("docs/a.md", rules)


def test_front_ends():
    kinds = lambda lang, text: {(r["name"], r["kind"]) for r in X.facts("f", lang, text) if r["rel"] == "symbol"}
    assert kinds("Go", "type T struct {\n}\nfunc (t *T) Run(a int) {\n go()\n}\nfunc main() {\n}\n") == {("T", "Class"), ("Run", "Function"), ("main", "Function")}
    assert kinds("Java", "public class A {\n  public int f(int a, int b) {\n    return g(a);\n  }\n}\n") == {("A", "Class"), ("f", "Method")}
    assert kinds("TypeScript", "export class A {\n  run(a) {\n  }\n}\nexport const f = (a) => {\n};\n") == {("A", "Class"), ("run", "Method"), ("f", "Function")}
    flask = "@app.route('/x', methods=['POST'])\ndef x():\n    return requests.get('http://h/y')\n"
    assert {(r["rel"], r["verb"], r["route"]) for r in X.facts("f.py", "Python", flask) if r["rel"] in ("route", "http_call")} == {("route", "post", "/x"), ("http_call", "get", "/y")}
    page = "<p>\n<script>\nfunction go() {\n}\n</script>\n<a onclick=\"go()\">"
    assert [(r["name"], r["line_start"], r["is_entry_point"]) for r in X.facts("a.html", "JavaScript", page) if r["rel"] == "symbol"] == [("go", 3, True)]


def test_continued_docker_lines(spark):
    rows = spark.createDataFrame([("D", i + 1, x) for i, x in enumerate(["FROM a:1", "RUN apt-get install \\", "  curl", "CMD x", "CMD y"])], "path string, ln int, line string")
    got = {(r.ln, r.message) for r in infra.dockerfile(rows).collect()}
    assert (2, "apt-get without --no-install-recommends") in got and (1, "several CMD") in got and (1, "image without a digest") in got


def test_snapshots(spark, tmp_path):
    scan = lambda f: f.filter(F.col("text").contains("eval(")).select("path", F.lit("EvalUsage").alias("kind"))
    put = lambda *rows: spark.createDataFrame(rows, snapshots.SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))

    def turn():
        snapshots.keep_current(snapshots.changed_files(spark, str(tmp_path / "in")), scan, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
        return {r.path for r in snapshots.current(spark, str(tmp_path / "out")).collect()}

    put(("a", "Python", "eval(x)", 1), ("b", "Python", "eval(y)", 1))
    assert turn() == {"a", "b"}
    put(("a", "Python", "clean", 2))
    assert turn() == {"b"}


def test_sarif_in_lines_is_one_log(spark):
    rows = [("Zeta" if i % 3 else 'A"b', ("High", "Medium", "Info")[i % 3], f"src/{i % 7}.py", i % 11, f"m\n{i % 5}", "") for i in range(300)]
    findings = spark.createDataFrame(rows, "kind string, severity string, file string, line int, message string, fingerprint string").repartition(5)
    lines = [r.value for r in report.sarif_lines(findings).collect()]
    # a line for each result, none with all of them
    assert len(lines) == 302 and max(map(len, lines)) < 400
    assert json.loads("\n".join(lines)) == json.loads(report.sarif(findings).first().value)
    none = [r.value for r in report.sarif_lines(findings.limit(0)).collect()]
    assert json.loads("".join(none))["runs"][0]["results"] == []
