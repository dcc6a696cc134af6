from __future__ import annotations

import json
import subprocess

import pytest

from tabulint.operators import findings as P
from tabulint.plans import reference
from tabulint.sources import config


def test_reference(spark):
    t = reference.table(spark)
    assert reference.lookup(t, "sql-injection").first().kind == "SqlInjection" and reference.lookup(t, "SQL_INJECTION").first().alias == "sql-injection"
    assert reference.suggestions(t, "EvalUsge").first().kind == "EvalUsage"
    known = {r.kind for r in t.collect()}
    assert {k for rules in P.PENALTIES.values() for kinds, _ in rules for k in kinds} - known <= {"WeakRandom", "OpenRedirect", "MissingRoleCheck", "StringConcatInLoop", "ObjectInstantiationInLoop"}
    found = spark.createDataFrame([("DeadFunction",), ("New",)], "kind string")
    assert {r.kind: r.fix for r in reference.explained(found, t).collect()} == {"DeadFunction": "delete it", "New": None}


def test_settings(tmp_path):
    s = config.load('{"deploy_gate": {"min_overall": 70}, "extra": [1, {"a/b": 2}]}')
    assert config.at(s, "/deploy_gate/min_overall") == 70 and config.at(s, "/deploy_gate/min_security") == 90
    assert config.at(s, "/extra/1/a~1b") == 2 and config.at(s, "/none/x", 5) == 5
    assert config.load(None) == json.loads(config.scaffold())
    with pytest.raises(ValueError):
        config.load("[]")
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a").write_text("1")
    git("add", "a")
    git("commit", "-qm", "x")
    (tmp_path / "a").write_text("2")
    (tmp_path / "b").write_text("1")
    assert config.changed_files(str(tmp_path)) == ["a", "b"]
