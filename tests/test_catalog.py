"""Every registered query against its SQL in DuckDB."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from tabulint import catalog

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return c


def plain(value):
    if isinstance(value, float):
        return f"{value:.6f}"
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return f"{float(value):.6f}" if isinstance(value, int) and not isinstance(value, bool) else None if value is None else str(value)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    out = catalog.QUERIES[name](spark, str(DATA))
    columns = sorted(out.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in out.collect()), key=str)
    if name not in catalog.ORACLES:
        assert got
        return
    result = duck.sql(catalog.ORACLES[name])
    assert sorted(result.columns) == columns
    order = [result.columns.index(c) for c in columns]
    wanted = []
    for row in result.fetchall():
        wanted.append(tuple(plain(int(v) if type(v).__name__ == "Decimal" and v == int(v) else float(v) if type(v).__name__ == "Decimal" else v) for v in (row[i] for i in order)))
    assert got == sorted(wanted, key=str)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_halves_round_as_in_sql(spark, tmp_path):
    prices = [101000.0, 103000.0, 100999.99, 101000.01, 105000.0, 99000.0, 1000.0]
    rows = [(i * 2 + 1, 1, p) for i, p in enumerate(prices)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    wanted = sorted(tuple(map(str, r)) for r in c.sql(catalog.ORACLES["complexity_findings"]).fetchall())
    got = sorted(tuple(map(str, (r.symbol_id, r.finding, r.value))) for r in catalog.QUERIES["complexity_findings"](spark, str(tmp_path)).collect())
    assert got == wanted and len(wanted) >= 3
