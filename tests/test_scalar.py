from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tabulint.functions import scalar as S


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("x")).first()["x"]


def fnv(s: str) -> str:
    h = 0xCBF29CE484222325
    for b in s.encode():
        h = (h ^ b) * 0x100000001B3 % 2**64
    return f"{h:016x}"


@pytest.mark.parametrize("s", ["", "a", "src/main.py|é", "漢字" * 20])
def test_fnv(spark, s):
    assert one(spark, s, S.fnv1a64) == fnv(s)


@pytest.mark.parametrize(
    "url, pattern",
    [("/users/42/posts?x=1", "users/*/posts"), ("api/v1/{id}/:name#f", "api/v1/*/*"), ("/a/${b}c/", "a/*"), ("", ""), ("//x//", "x")],
)
def test_path_pattern(spark, url, pattern):
    assert one(spark, url, S.path_pattern) == pattern


@pytest.mark.parametrize("p, out", [("api/v1/users", "users"), ("api/users", "users"), ("api/v1", ""), ("orders", "orders"), ("api/vx/users", "vx/users")])
def test_api_prefix(spark, p, out):
    assert one(spark, p, S.without_api_prefix) == out


def test_cases(spark):
    assert one(spark, "getHTTPItem_list", S.to_snake) == "get_h_t_t_p_item_list"
    assert one(spark, "get_item", S.to_pascal) == "GetItem"
    assert one(spark, "Get_item", S.to_camel) == "getItem"
    assert one(spark, "getItem", S.to_screaming) == "GET_ITEM"
    check = lambda v, c: one(spark, v, lambda x: S.convention_ok(x, F.lit(c)))
    assert check("getItem", "camel") and not check("get_item", "camel") and check("get_item", "snake") and not check("_x", "snake") and not check("a__b", "snake")
    assert check("GetItem", "pascal") and check("MAX_SIZE", "screaming") and not check("Max", "screaming")


def test_paths(spark):
    aux = lambda p: one(spark, p, S.is_auxiliary)
    assert aux("a/vendor/b.js") and aux("x.min.js") and not aux("tests/fixtures/a.php") and not aux("src/testing.py") and aux("a\\tests\\b.py")
    test = lambda p: one(spark, p, S.is_test)
    assert test("test_a.py") and not test("latest_a.py") and test("x/conftest.py") and test("a/b_test.go") and not test("vendor/a.go")
    assert one(spark, "a.py", S.top_dir) == "." and one(spark, "src/a/b.py", S.top_dir) == "src"


def test_versions(spark):
    v = lambda s: one(spark, s, S.version)
    assert tuple(v("1.2.3-beta")) == (1, 2, 3) and tuple(v("2")) == (2, 0, 0) and v("x.1") is None
    hit = lambda a, b: one(spark, a, lambda c: S.affected(S.version(c), S.version(F.lit(b))))
    assert hit("0.4.19", "0.4.20") and not hit("0.3.1", "0.4.20") and hit("1.2.0", "1.6.1") and not hit("2.0.0", "1.6.1") and not hit("1.6.1", "1.6.1")


def test_text(spark):
    assert one(spark, " 12 lines over 50 ", S.without_digits) == "lines over"
    assert one(spark, "  # x", S.is_comment_line) and not one(spark, "x # y", S.is_comment_line)
    assert one(spark, "std::vec::push", S.last_segment) == "push" and one(spark, "$a->b", S.last_segment) == "b"
