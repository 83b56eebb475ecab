"""The driver's contract, and every query that SQL can express against that SQL."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def norm(rows):
    def value(v):
        if isinstance(v, float):
            return "" if v != v else repr(round(v, 6))
        return "" if v is None else str(v)

    return sorted(tuple(map(value, r)) for r in rows)


def test_entry(spark):
    assert entry.entry(spark).columns == ["cluster_id", "priority", "created_at", "likes", "dislikes", "n_articles"]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, con, name):
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    listed = ", ".join('"' + c + '"' for c in columns)
    assert norm(tuple(r) for r in got.select(*columns).collect()) == norm(con.sql(f"SELECT {listed} FROM ({entry.oracle_sql()[name]})").fetchall())
