"""Every registered query of the relational engine against its SQL."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from lakewarden.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6f}"
    return str([plain(y) for y in x]) if isinstance(x, (list, tuple)) else str(x)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, views, name):
    df = registry.queries()[name](spark, FOLDER)
    rows, columns = df.collect(), sorted(df.columns)
    assert rows
    if name in registry.oracle_sql():
        want = views.sql(registry.oracle_sql()[name])
        assert sorted(want.columns) == columns
        places = [want.columns.index(c) for c in columns]
        assert sorted(tuple(plain(r[c]) for c in columns) for r in rows) == sorted(tuple(plain(r[k]) for k in places) for r in want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
