"""Replication and retention of four related tables of the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyline import catalog as C
from storyline.operators import tables as G
from storyline.registry import query

GRAPH = (
    G.Table("lineitem", ("l_orderkey", "l_linenumber"), refers={"l_orderkey": "orders", "l_suppkey": "supplier"}, stamps=("l_shipdate",)),
    G.Table("orders", ("o_custkey", "o_orderdate", "o_totalprice"), "o_orderkey", {"o_custkey": "customer"}, ("o_orderdate",)),
    G.Table("customer", ("c_name",), "c_custkey", mode="insert"),
    G.Table("supplier", ("s_name",), "s_suppkey", mode="fill"),
)
SINCE = "1998-01-01"


def _source(spark, sf_dir):
    columns = {
        "lineitem": ("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_shipdate"), "orders": ("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus"),
        "customer": ("c_custkey", "c_name", "c_acctbal"), "supplier": ("s_suppkey", "s_name", "s_acctbal"),
    }
    return {name: C.table(spark, sf_dir, name).select(*listed) for name, listed in columns.items()}


def _replicated(spark, sf_dir):
    """A store that has some rows already, under other ids and with other values, after a copy of what is newer than a mark."""
    source = _source(spark, sf_dir)
    moved = lambda c, by: (F.col(c) + by).alias(c)
    target = {
        "customer": source["customer"].where("c_custkey % 3 <> 0").select(moved("c_custkey", 500000), "c_name", (F.col("c_acctbal") + 1).alias("c_acctbal")),
        "supplier": source["supplier"].where("s_suppkey % 4 <> 1").select(moved("s_suppkey", 7000), "s_name", F.when(F.col("s_suppkey") % 4 == 2, F.lit(-1.0)).alias("s_acctbal")),
        "orders": source["orders"].where("o_custkey % 3 <> 0 and o_orderkey % 2 = 0").select(moved("o_orderkey", 3000000), moved("o_custkey", 500000), "o_orderdate", "o_totalprice", F.lit("X").alias("o_orderstatus")),
        "lineitem": source["lineitem"].where("false"),
    }
    day = F.lit(SINCE).cast("timestamp_ntz")
    return G.replicate(GRAPH, source, target, {"orders": day, "lineitem": day})


_REPLICATED = f"""c AS (SELECT c_custkey AS old, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey + 500000 ELSE c_custkey + (SELECT max(c_custkey) + 500001 FROM customer WHERE c_custkey % 3 <> 0) - (SELECT min(c_custkey) FROM customer WHERE c_custkey % 3 = 0) END AS id FROM customer),
s AS (SELECT s_suppkey AS old, CASE WHEN s_suppkey % 4 <> 1 THEN s_suppkey + 7000 ELSE s_suppkey + (SELECT max(s_suppkey) + 7001 FROM supplier WHERE s_suppkey % 4 <> 1) - (SELECT min(s_suppkey) FROM supplier WHERE s_suppkey % 4 = 1) END AS id FROM supplier),
k AS (SELECT *, o_custkey % 3 <> 0 AND o_orderkey % 2 = 0 AS there, o_orderdate > TIMESTAMP '{SINCE}' AS changed FROM orders),
o AS (SELECT k.*, CASE WHEN there THEN o_orderkey + 3000000 WHEN changed THEN o_orderkey + coalesce((SELECT max(o_orderkey) FROM k WHERE there) + 3000000, 0) + 1 - (SELECT min(o_orderkey) FROM k WHERE changed AND NOT there) END AS id FROM k WHERE there OR changed)"""


@query(f"""WITH {_REPLICATED} SELECT o.id AS o_orderkey, c.id AS o_custkey, o_totalprice, CASE WHEN changed THEN o_orderstatus ELSE 'X' END AS o_orderstatus FROM o JOIN c ON c.old = o_custkey""")
def replicated_orders(spark, sf_dir):
    """Orders found by customer, day and price under the store's own ids; new and changed ones take the source's state."""
    return _replicated(spark, sf_dir)["orders"].select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")


@query(f"""WITH {_REPLICATED} SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity FROM
(SELECT o.id AS l_orderkey, l_linenumber, s.id AS l_suppkey, l_quantity, row_number() OVER (PARTITION BY o.id, l_linenumber ORDER BY s.id, l_quantity, l_shipdate) AS k FROM lineitem JOIN o ON l_orderkey = o.o_orderkey JOIN s ON s.old = l_suppkey WHERE l_shipdate > TIMESTAMP '{SINCE}') WHERE k = 1""")
def replicated_lines(spark, sf_dir):
    """Lines that follow the ids of their orders and suppliers; of lines with one order and number the first in order of their values."""
    return _replicated(spark, sf_dir)["lineitem"].select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")


@query("""SELECT s_suppkey + 7000 AS s_suppkey, s_name, CASE WHEN s_suppkey % 4 = 2 THEN -1 ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_suppkey % 4 <> 1
UNION ALL SELECT s_suppkey + (SELECT max(s_suppkey) + 7001 FROM supplier WHERE s_suppkey % 4 <> 1) - (SELECT min(s_suppkey) FROM supplier WHERE s_suppkey % 4 = 1), s_name, s_acctbal FROM supplier WHERE s_suppkey % 4 = 1""")
def replicated_suppliers(spark, sf_dir):
    """Suppliers whose missing balances are filled and whose own are kept."""
    return _replicated(spark, sf_dir)["supplier"]


@query("""WITH l AS (SELECT *, CASE WHEN l_shipdate >= TIMESTAMP '2000-01-01' THEN 'hot' ELSE 'cold' END AS part FROM lineitem),
o AS (SELECT *, CASE WHEN o_orderdate >= TIMESTAMP '2000-01-01' THEN 'hot' WHEN o_orderkey IN (SELECT l_orderkey FROM l WHERE part = 'hot') THEN 'held' ELSE 'cold' END AS part FROM orders),
c AS (SELECT CASE WHEN c_custkey IN (SELECT o_custkey FROM o WHERE part <> 'cold') THEN 'held' ELSE 'cold' END AS part FROM customer),
s AS (SELECT CASE WHEN s_suppkey IN (SELECT l_suppkey FROM l WHERE part = 'hot') THEN 'held' ELSE 'cold' END AS part FROM supplier)
SELECT name AS "table", part, count(*) AS n FROM (SELECT 'lineitem' AS name, part FROM l UNION ALL SELECT 'orders', part FROM o UNION ALL SELECT 'customer', part FROM c UNION ALL SELECT 'supplier', part FROM s) GROUP BY 1, 2""")
def retention_cascade(spark, sf_dir):
    """What stays of four tables: rows since a day and all that they refer to."""
    marked = G.retain(GRAPH, _source(spark, sf_dir), F.lit("2000-01-01").cast("timestamp_ntz"))
    counts = [rows.groupBy("part").agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "part", "n") for name, rows in marked.items()]
    out = counts[0]
    for more in counts[1:]:
        out = out.union(more)
    return out
