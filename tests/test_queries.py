"""Registered queries against their SQL."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from foliograph.plans import queries as own


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(own.ORACLE_SQL))
def test_sql(spark, scale, name):
    sf = f"/root/testdata/{scale}"
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = own.QUERIES[name](spark, sf)
    r = con.execute(own.ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    order = lambda rows: sorted(repr(tuple(x[c] for c in sorted(names))) for x in rows)
    assert order(df.collect()) == order(dict(zip(names, x)) for x in r.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(own.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
