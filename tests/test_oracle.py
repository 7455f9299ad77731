"""Every query of the catalog equals its DuckDB oracle (row count, columns, values) at sf0.001."""

import math

import pytest

import __spark_entry__ as E
from churnlens.plans.catalog import load_all

from .conftest import SF001

QUERIES = {name: fn for name, (fn, _) in load_all().items()}
SQL = {name: sql for name, (_, sql) in load_all().items() if sql is not None}


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else f"{round(v, 6):.6f}".replace("-0.000000", "0.000000")
    return str(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, duck, name):
    con = duck(SF001)
    sdf = QUERIES[name](spark, SF001)
    res = con.execute(SQL[name])
    dcols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(dcols)
    assert _rows(sdf.columns, [tuple(r) for r in sdf.collect()]) == _rows(dcols, res.fetchall())


def test_all_are_registered():
    assert set(QUERIES) <= set(E.queries()) and set(SQL) <= set(E.oracle_sql())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["Contract", "churn_rate", "n"]
    assert df.count() == 3
