"""State transitions, replication, retention and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyline import catalog as C
from storyline.operators import clustering
from storyline.operators import state as S
from storyline.plans.feed import _CLUSTERS
from storyline.registry import query
from storyline.streaming import streams


@query("""SELECT count(*) AS n_changed FROM events WHERE ts > TIMESTAMP '2024-01-20 12:00:00'""")
def changed_since(spark, sf_dir):
    return streams.changed_count(C.table(spark, sf_dir, "events"), F.lit("2024-01-20 12:00:00").cast("timestamp_ntz"))


@query("""SELECT max(ts) AS high_water_mark FROM events""")
def high_water_mark(spark, sf_dir):
    return S.high_water_mark(C.table(spark, sf_dir, "events"), "ts")


@query("""WITH o AS (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 5 <> 0), n AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name || '*' END AS c_name, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 5 IN (0, 1, 2))
SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(n.c_name, o.c_name) AS c_name, coalesce(n.c_acctbal, o.c_acctbal) AS c_acctbal FROM o FULL JOIN n ON o.c_custkey = n.c_custkey""")
def upsert_preferences(spark, sf_dir):
    c = C.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = c.where("c_custkey % 5 in (0, 1, 2)").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.concat("c_name", F.lit("*"))).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return S.upsert(c.where("c_custkey % 5 <> 0"), new, ["c_custkey"])


@query(f"""WITH {_CLUSTERS}, m AS (SELECT cluster_id AS source, cluster_id - 1 AS target FROM clusters WHERE cluster_id % 10 = 1 AND cluster_id > 1),
a AS (SELECT coalesce(target, l_orderkey) AS cluster_id FROM lineitem LEFT JOIN m ON l_orderkey = source), k AS (SELECT cluster_id, count(*) AS n FROM a GROUP BY 1)
SELECT c.cluster_id, coalesce(n, 0) AS n_members, m.target IS NOT NULL AS discarded FROM clusters c LEFT JOIN k ON c.cluster_id = k.cluster_id LEFT JOIN m ON c.cluster_id = m.source""")
def merge_clusters_state(spark, sf_dir):
    c = C.clusters(spark, sf_dir)
    mapping = c.where("cluster_id % 10 = 1 and cluster_id > 1").select(F.col("cluster_id").alias("source"), (F.col("cluster_id") - 1).alias("target"))
    groups, _ = S.merge_groups(c.select("cluster_id"), C.cluster_articles(spark, sf_dir).select(F.col("cluster_id").alias("group_id")), mapping, "cluster_id", "group_id")
    return groups


@query("""WITH s AS (SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01'), t AS (SELECT o_custkey, o_orderdate, o_totalprice, min(o_orderkey + 1000000) AS target_id FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY 1, 2, 3),
m AS (SELECT o_orderkey AS source_id, target_id FROM s JOIN t USING (o_custkey, o_orderdate, o_totalprice)) SELECT target_id AS l_orderkey, l_linenumber FROM lineitem JOIN m ON l_orderkey = source_id""")
def replicate_idmap(spark, sf_dir):
    """Ids mapped by a natural key, and children that follow them."""
    o = C.table(spark, sf_dir, "orders")
    target = o.where("o_orderkey % 4 <> 0").withColumn("new_id", F.col("o_orderkey") + 1000000)
    mapping = S.id_map(S.changed_since(o, F.expr("timestamp_ntz'2000-12-31 23:59:59.999999'"), "o_orderdate"), target, ["o_custkey", "o_orderdate", "o_totalprice"], "o_orderkey", "new_id")
    return S.remap(C.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), mapping, "l_orderkey")


@query("""WITH o AS (SELECT o_orderkey, o_orderdate >= TIMESTAMP '1996-01-01' AS hot FROM orders), r AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
SELECT CASE WHEN hot THEN 'hot' WHEN l_orderkey IS NULL THEN 'cold' ELSE 'compacted' END AS part, count(*) AS n FROM o LEFT JOIN r ON o_orderkey = l_orderkey GROUP BY 1""")
def retention_split(spark, sf_dir):
    """Rows past retention go, but for those that feedback refers to, which are compacted."""
    hot, old = S.retain(C.table(spark, sf_dir, "orders"), "o_orderdate", F.lit("1996-01-01").cast("timestamp_ntz"))
    feedback = C.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    kept = S.referenced(old, "o_orderkey", (feedback, "l_orderkey"))
    cold = old.join(kept.select("o_orderkey"), "o_orderkey", "left_anti")
    tagged = [f.groupBy().agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for name, f in (("hot", hot), ("compacted", S.compact(kept, F.lit(True), empty=("o_orderpriority",))), ("cold", cold))]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).where("n > 0")


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE cast(o_orderdate AS DATE) <> DATE '1997-08-23' UNION ALL SELECT o_orderkey, o_totalprice * 2 FROM orders WHERE cast(o_orderdate AS DATE) = DATE '1997-08-23' AND o_orderkey % 2 = 0""")
def replace_day(spark, sf_dir):
    o = C.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    new = o.where((F.to_date("o_orderdate") == F.lit("1997-08-23").cast("date")) & (F.col("o_orderkey") % 2 == 0)).withColumn("o_totalprice", F.col("o_totalprice") * 2)
    return S.replace_days(o, new, "o_orderdate").select("o_orderkey", "o_totalprice")


@query(f"""WITH {_CLUSTERS} SELECT cluster_id, 'priority' AS field, priority AS old_value, 'P1_CRITICO' AS new_value, 'test' AS reason, 'system' AS changed_by FROM clusters WHERE cluster_id % 100 = 0""")
def audited_priority_update(spark, sf_dir):
    c = C.clusters(spark, sf_dir)
    changes = c.where("cluster_id % 100 = 0").select("cluster_id", F.lit("P1_CRITICO").alias("value"), F.lit("test").alias("reason"))
    return S.audited_update(c, changes, "cluster_id", "priority", F.lit("2024-01-01").cast("timestamp"))[1].drop("changed_at")


@query(f"""WITH {_CLUSTERS} SELECT count(*) AS found, count(*) FILTER (priority = 'P3_MONITORAMENTO') AS promoted, count(*) FILTER (priority <> 'P3_MONITORAMENTO') AS already FROM clusters WHERE cluster_id % 7 = 0""")
def promotion_counts(spark, sf_dir):
    c = C.clusters(spark, sf_dir)
    return clustering.promote(c, c.where("cluster_id % 7 = 0"))[1]


def _event_stream(spark, sf_dir):
    # A glob of one name: a file source reads folders, and the table is a file or a folder of files.
    batch = C.table(spark, sf_dir, "events")
    return streams.file_stream(spark, f"{sf_dir}/events.parque[t]", batch.schema)


@query("""SELECT CAST(cast(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def stream_day_counts(spark, sf_dir):
    """The events as a stream, counted by day and kind."""
    return streams.drain(streams.day_counts(_event_stream(spark, sf_dir)), "complete").withColumn("day", F.col("day").cast("string"))


@query("""SELECT DISTINCT user_id, event_type FROM events""")
def stream_dedup_48h(spark, sf_dir):
    """One row a key of the stream, in whatever batches and order its files come. Keys don't expire after 48 hours: the SQL is DISTINCT over all rows."""
    return streams.drain(streams.distinct_ever(_event_stream(spark, sf_dir).select("user_id", "event_type"), ["user_id", "event_type"]))


@query("""WITH g AS (SELECT user_id, ts, sum(CASE WHEN last IS NULL OR ts >= last + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last FROM events))
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM g GROUP BY user_id, s""")
def stream_sessions(spark, sf_dir):
    """Sessions of users with a gap of half an hour."""
    return streams.drain(streams.sessions(_event_stream(spark, sf_dir)), "complete").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")
