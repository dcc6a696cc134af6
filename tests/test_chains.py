from __future__ import annotations

from tabulint.operators import chains as C

SYMBOLS = [
    ("1", "index", "web::index", "web.php", "Php", "Function", True), ("2", "work", "lib::work", "lib.php", "Php", "Function", False), ("3", "authorizeUser", "lib::authorizeUser", "lib.php", "Php", "Function", False),
    ("4", "adminWipe", "admin::adminWipe", "admin.php", "Php", "Function", False), ("5", "Bad_name", "lib::Bad_name", "lib.php", "Php", "Function", False), ("6", "test_x", "t::test_x", "tests/t.php", "Php", "Function", True),
]
CALLS = [("1", "2", "work"), ("2", None, "shell_exec"), ("1", "3", "authorizeUser"), ("3", "4", "adminWipe"), ("4", None, "$db->truncate"), ("2", "1", "index"), ("6", None, "eval")]


def test_chains(spark):
    symbols = spark.createDataFrame(SYMBOLS, "id string, name string, full_name string, path string, lang string, kind string, is_entry_point boolean")
    calls = spark.createDataFrame(CALLS, "caller_id string, callee_id string, callee_name string")
    got = {(r.entry, r.sink, r.name, r.depth, r.gated, r.severity, tuple(r.path)) for r in C.chains(symbols, calls).collect()}
    # the entry itself passes a gate, so its chains count as gated
    assert got == {
        ("1", "Exec", "shell_exec", 2, True, "Low", ("web::index", "lib::work")),
        ("1", "Deletion", "truncate", 3, True, "Medium", ("web::index", "lib::authorizeUser", "admin::adminWipe")),
    }


def test_naming(spark):
    symbols = spark.createDataFrame(SYMBOLS, "id string, name string, full_name string, path string, lang string, kind string, is_entry_point boolean")
    assert {(r.name, r.suggestion) for r in C.naming(symbols).collect()} == {("Bad_name", "badName"), ("test_x", "testX")}


def test_work_grows_with_calls_not_with_what_entries_reach(spark, monkeypatch):
    kept = []
    real = C.saved
    monkeypatch.setattr(C, "saved", lambda df, name, **o: kept.append((name, real(df, name, **o))) or kept[-1][1])
    ids = [f"e{i}" for i in range(20)] + ["hub"] + [f"c{i}" for i in range(20)]
    symbols = spark.createDataFrame([(i, i, f"a::{i}", "a.php", "Php", i[0] == "e") for i in ids], "id string, name string, full_name string, path string, lang string, is_entry_point boolean")
    calls = [(f"e{i}", "hub", "x") for i in range(20)] + [("hub", f"c{i}", "x") for i in range(20)] + [("c7", None, "eval"), ("c3", None, "eval")]
    got = C.chains(symbols, spark.createDataFrame(calls, "caller_id string, callee_id string, callee_name string"), most_rows=None).collect()
    assert {(r.entry, r.depth, tuple(r.path)) for r in got} == {(f"e{i}", 3, (f"a::e{i}", "a::hub", "a::c3")) for i in range(20)}
    # each entry met each callee: 440 rows; from the sinks back a symbol is met once
    assert sum(df.count() for name, df in kept if name == "front") == 23
