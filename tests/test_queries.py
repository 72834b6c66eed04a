"""Every registered query that has SQL agrees with it on the smallest tables; the others run."""

import glob
import os

import duckdb
import pytest

from loomgrid import plans

QUERIES, ORACLES = plans.queries(), plans.oracles()
SLOW = {"held_out_draws", "counterfactual_draws", "inner_blanket_check"}


def text(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 6) + 0.0)
    return str(v)


def lines(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(text(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, data, db, name):
    df = QUERIES[name](spark, data)
    rel = db.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert lines(df.columns, df.collect()) == lines(list(rel.columns), rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert len(df.collect()) > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
