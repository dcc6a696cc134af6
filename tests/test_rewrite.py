"""Plans that change a tree, and reports for machines, pages and terminals."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tabulint.operators import findings as P
from tabulint.operators.lines import lines
from tabulint.plans import explore, report, rewrite
from tabulint.sources import files as S


def test_dead_code_goes_until_none_is_left(spark):
    text = "def main():\n    used()\n\ndef used():\n    return 1\n\ndef first():\n    second()\n\ndef second():\n    third()\n\ndef third():\n    return 3\n\nmain()\n"
    files = spark.createDataFrame([("a.py", text), ("b.txt", "plain\n")], "path string, text string").withColumn("lang", S.language(F.col("path")))
    out, rounds = rewrite.without_dead_code(files)
    got = {r.path: r.text for r in out.collect()}
    assert rounds == 3 and got["b.txt"] == "plain\n" and "second" not in got["a.py"] and "third" not in got["a.py"] and "def used" in got["a.py"]
    assert rewrite.without_dead_code(out)[1] == 0


def test_fix_plans_and_reports(spark):
    found = spark.createDataFrame([("a.py", 4, "DeadFunction", "Low", 0.95, "never used: f", "f"), ("a.py", 2, "HardcodedSecret", "Critical", 0.8, "<secret>", None), ("b.py", 1, "PanicRisk", "Info", 0.6, "x", None)], "file string, line int, kind string, severity string, confidence double, message string, symbol string")
    symbols = spark.createDataFrame([("a.py", 4, 9, "f", "Function")], "path string, line_start int, line_end int, name string, kind string")
    got = [tuple(r) for r in rewrite.fix_plan(found, symbols).select("file", "start", "end", "action", "unasked").collect()]
    assert got == [("a.py", 4, 9, "delete", True), ("a.py", 2, 2, "move", False)]
    score = P.score(found, 10)
    out = json.loads(report.verdict(score, found, P.deploy_gate(score, found, 1)))
    assert out["passed"] is False and out["total"] == 3 and out["first"][0]["kind"] == "HardcodedSecret"
    row = json.loads(report.statistics(score, found, "2026-01-01T00:00:00Z").first().value)
    assert row["critical"] == 1 and row["low"] == 1 and row["at"].startswith("2026")
    page = report.html(score, found)
    assert "3 findings" in page and "&lt;secret&gt;" in page and "<secret>" not in page
    source = lines(spark.createDataFrame([("a.py", "one\ntwo\nthree\nfour\n")], "path string, text string"), "path", "text")
    shown = report.terminal(found, source)
    assert ">     2 | two" in shown and "HardcodedSecret a.py:2" in shown


def test_questions_with_exact_totals(spark):
    rows = [("a", i, k, "Low", 0.9) for i in range(30) for k in ("ExactDuplicate", "NPlusOneQuery", "LongFunction")]
    found = spark.createDataFrame(rows, "file string, line int, kind string, severity string, confidence double")
    first, total = explore.copies_of(found, 10)
    assert total == 30 and first.count() == 10
    first, total = explore.performance_advice(found, ["Latency"], 5)
    assert total == 30 and {(r.kind, r.relevance) for r in first.collect()} == {("NPlusOneQuery", 3)}
    facts = "path string, seq long, verb string, route string, line_start int"
    routes = spark.createDataFrame([("s", 1, "get", "/users/{id}", 1), ("s", 2, "post", "/users", 2)], facts)
    calls = spark.createDataFrame([("c", 1, "get", "/users/7", 1), ("c", 2, "get", "/nowhere", 2)], facts)
    got = explore.endpoints(routes, calls)
    assert tuple(got["counts"].first()) == (1, 1, 1) and got["orphan_calls"].first().path == "/nowhere"
