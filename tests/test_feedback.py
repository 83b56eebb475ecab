"""The latest feedback where time and id tie."""

import duckdb

import __spark_entry__ as entry


def test_ties_of_feedback_go_by_place(spark, tmp_path):
    """Lines of one order, number and date: the first in the file decides, with whatever flag, as in the SQL."""
    c = duckdb.connect()
    c.execute("SET threads = 1")
    c.execute("CREATE TABLE orders AS SELECT k AS o_orderkey, 1::BIGINT AS o_custkey, 'O' AS o_orderstatus, 1.0::DOUBLE AS o_totalprice, TIMESTAMP '1997-01-01' AS o_orderdate, '1-URGENT' AS o_orderpriority FROM range(40) r(k)")
    line = "SELECT k AS l_orderkey, 1::BIGINT AS l_partkey, 1::BIGINT AS l_suppkey, (k % 3)::INT AS l_linenumber, CASE WHEN (k + n) % 2 = 0 THEN 'A' ELSE 'R' END AS l_returnflag, TIMESTAMP '1997-02-01' AS l_shipdate FROM range(40) r(k), range(4) s(n)"
    c.execute(f"CREATE TABLE lineitem AS {line} ORDER BY n, k")
    for t in ("orders", "lineitem"):
        c.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    columns = "cluster_id, likes, dislikes, latest"
    want = c.execute(f"SELECT {columns} FROM ({entry.oracle_sql()['feedback_summary']})").fetchall()
    got = [tuple(r) for r in entry.queries()["feedback_summary"](spark, str(tmp_path)).select(*columns.split(", ")).collect()]
    assert sorted(got) == sorted(want) and {r[3] for r in want} == {"like", "dislike"}


def test_feedback_of_several_files_and_without_time(spark, tmp_path):
    """The first file decides where rows of two files tie, whatever their places in these; times and numbers that are null are the latest."""
    c = duckdb.connect()
    c.execute("SET threads = 1")
    c.execute("CREATE TABLE orders AS SELECT k AS o_orderkey, 1::BIGINT AS o_custkey, 'O' AS o_orderstatus, 1.0::DOUBLE AS o_totalprice, TIMESTAMP '1997-01-01' AS o_orderdate, '1-URGENT' AS o_orderpriority FROM range(60) r(k)")
    c.execute(f"COPY orders TO '{tmp_path}/orders.parquet'")
    (tmp_path / "lineitem.parquet").mkdir()
    for n, order in ((0, "k"), (1, "-k")):
        line = f"""SELECT k AS l_orderkey, 1::BIGINT AS l_partkey, 1::BIGINT AS l_suppkey, CASE WHEN k % 4 < 3 OR {n} = 1 THEN 1 END::INT AS l_linenumber, CASE WHEN (k // 4 + {n}) % 2 = 0 THEN 'A' ELSE 'R' END AS l_returnflag,
          CASE WHEN k % 4 <> 2 OR {n} = 0 THEN TIMESTAMP '1997-02-01' END AS l_shipdate FROM range(60) r(k) ORDER BY {order}"""
        c.execute(f"COPY ({line}) TO '{tmp_path}/lineitem.parquet/part-{n}.parquet'")
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    columns = "cluster_id, likes, dislikes, latest"
    want = c.execute(f"SELECT {columns} FROM ({entry.oracle_sql()['feedback_summary']})").fetchall()
    got = [tuple(r) for r in entry.queries()["feedback_summary"](spark, str(tmp_path)).select(*columns.split(", ")).collect()]
    assert sorted(got) == sorted(want) and {r[3] for r in want} == {"like", "dislike"}
