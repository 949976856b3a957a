"""Driver contract: entry(), queries() and oracle_sql() against DuckDB at sf0.001."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SMOKE_DIR
from rostercast.sources.driver_tables import TABLES

ORACLE = E.oracle_sql()


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and df.columns == ["series", "week_end", "week", "week_label", "drivers"]


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(E.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SMOKE_DIR}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else (round(v, 4) + 0.0)
        return v
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SMOKE_DIR)
    res = duck.execute(ORACLE[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _norm([tuple(r) for r in df.collect()], df.columns) == _norm(res.fetchall(), dcols)
