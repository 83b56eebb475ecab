"""The entity graph: line items tie orders (clusters) to parts (entities)."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyline import catalog as C
from storyline import domain as D
from storyline.functions import text as T
from storyline.operators import graph as G
from storyline.operators import state as S
from storyline.plans.feed import _ARTICLES, _CLUSTERS
from storyline.plans.stats import _SOURCES
from storyline.registry import query

#: The entity and the cluster that the graph queries start from.
ENTITY, CLUSTER = 12, 7


def _graph(spark, sf_dir):
    arts = C.cluster_articles(spark, sf_dir)
    # An order's lines are one story here, so that entities occur together.
    edges = arts.select(F.col("cluster_id").alias("article_id"), "entity_id", F.coalesce("feedback", F.lit("MENTIONED")).alias("relation"), F.round(F.col("line") / 10, 1).alias("sentiment"))
    stories = arts.select(F.col("cluster_id").alias("article_id"), (F.col("cluster_id") % 997).alias("cluster_id")).distinct()
    return edges, stories


@query(f"""WITH {_CLUSTERS}, {_ARTICLES}
SELECT DISTINCT c.cluster_id, c.created_at, c.priority, coalesce(feedback, 'MENTIONED') AS relation, round(line / 10.0, 1) AS sentiment FROM clusters c JOIN arts a ON c.cluster_id = a.cluster_id
WHERE entity_id = {ENTITY} AND status = 'ativo' AND c.created_at >= TIMESTAMP '1995-06-01' ORDER BY c.created_at DESC, c.cluster_id, relation, sentiment LIMIT 10""")
def entity_history(spark, sf_dir):
    edges, _ = _graph(spark, sf_dir)
    stories = edges.select("article_id", F.col("article_id").alias("cluster_id")).distinct()
    return G.history(C.clusters(spark, sf_dir), stories, edges, F.lit(ENTITY), F.lit("1995-06-01").cast("timestamp_ntz"))


@query(f"""WITH {_ARTICLES} SELECT entity_id, count(*) AS n FROM arts WHERE entity_id <> {ENTITY} AND cluster_id IN (SELECT cluster_id FROM arts WHERE entity_id = {ENTITY}) GROUP BY 1 ORDER BY n DESC, entity_id LIMIT 20""")
def entity_cooccurrence(spark, sf_dir):
    return G.co_occurring(_graph(spark, sf_dir)[0], F.lit(ENTITY))


_NEAR = f"""WITH {_ARTICLES}, named AS (SELECT cluster_id % 997 AS c, entity_id AS e FROM arts),
t AS (SELECT e, count(*) AS mentions FROM named WHERE c = {CLUSTER} GROUP BY 1 ORDER BY mentions DESC, e LIMIT 30),
s AS (SELECT c, count(DISTINCT e) AS shared FROM named WHERE c <> {CLUSTER} AND e IN (SELECT e FROM t) GROUP BY 1 ORDER BY shared DESC, c LIMIT 10)"""


@query(f"""{_NEAR} SELECT CAST(e AS VARCHAR) AS id, 'entity' AS kind, mentions AS size FROM t UNION ALL SELECT CAST(c AS VARCHAR), 'cluster', shared FROM s""")
def cluster_graph_nodes(spark, sf_dir):
    edges, stories = _graph(spark, sf_dir)
    return G.neighbourhood(edges, stories, F.lit(CLUSTER))[0]


@query(f"""{_NEAR} SELECT c AS cluster_id, e AS entity_id, count(*) AS weight FROM named WHERE c IN (SELECT c FROM s) AND e IN (SELECT e FROM t) GROUP BY 1, 2""")
def cluster_graph_edges(spark, sf_dir):
    edges, stories = _graph(spark, sf_dir)
    return G.neighbourhood(edges, stories, F.lit(CLUSTER))[1]


@query("""SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000) OR EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND event_type = 'error' AND value > 99)""")
def referenced_rows_exists(spark, sf_dir):
    o = C.table(spark, sf_dir, "orders").where("o_totalprice > 450000")
    e = C.table(spark, sf_dir, "events").where("event_type = 'error' and value > 99")
    return S.referenced(C.table(spark, sf_dir, "customer"), "c_custkey", (o, "o_custkey"), (e, "user_id")).select("c_custkey", "c_name")


@query(f"""WITH {_CLUSTERS} SELECT cluster_id, created_at, status FROM clusters WHERE cluster_id NOT IN (SELECT l_orderkey FROM lineitem) AND status IN ('ativo', 'arquivado') ORDER BY created_at DESC, cluster_id LIMIT 100""")
def unlinked_articles_anti(spark, sf_dir):
    rows = C.clusters(spark, sf_dir).where(F.col("status").isin("ativo", "arquivado"))
    out = rows.join(C.cluster_articles(spark, sf_dir).select("cluster_id"), "cluster_id", "left_anti")
    return out.orderBy(F.desc("created_at"), "cluster_id").limit(100).select("cluster_id", "created_at", "status")


@query(f"""WITH {_CLUSTERS}, {_ARTICLES}, {_SOURCES}, c AS (SELECT cluster_id, CASE WHEN cluster_id % 2 = 0 THEN 'internacional' ELSE 'brasil_fisico' END AS source_type FROM clusters)
SELECT c.cluster_id, c.source_type, count(*) AS n FROM c JOIN arts a ON a.cluster_id = c.cluster_id JOIN src s USING (source_id) WHERE s.source_type <> c.source_type GROUP BY 1, 2""")
def type_divergence(spark, sf_dir):
    """Clusters whose articles' sources are of another type, and how many."""
    c = C.clusters(spark, sf_dir).select("cluster_id", F.when(F.col("cluster_id") % 2 == 0, "internacional").otherwise("brasil_fisico").alias("source_type"))
    a = C.cluster_articles(spark, sf_dir).join(C.sources(spark, sf_dir), "source_id").groupBy("cluster_id", F.col("source_type").alias("own")).agg(F.count("*").alias("k"))
    return c.join(a, "cluster_id").where("own <> source_type").groupBy("cluster_id", "source_type").agg(F.sum("k").alias("n"))


@query("""SELECT 'entities' AS what, 'all' AS key, count(*) AS n FROM part UNION ALL SELECT 'entities', p_type, count(*) FROM part GROUP BY 2 UNION ALL SELECT 'edges', l_returnflag, count(*) FROM lineitem GROUP BY 2""")
def entity_stats(spark, sf_dir):
    p, e = C.table(spark, sf_dir, "part"), C.table(spark, sf_dir, "lineitem")
    total = p.agg(F.count("*").alias("n")).select(F.lit("entities").alias("what"), F.lit("all").alias("key"), "n")
    kinds = p.groupBy("p_type").agg(F.count("*").alias("n")).select(F.lit("entities").alias("what"), F.col("p_type").alias("key"), "n")
    relations = e.groupBy("l_returnflag").agg(F.count("*").alias("n")).select(F.lit("edges").alias("what"), F.col("l_returnflag").alias("key"), "n")
    return total.unionByName(kinds).unionByName(relations)


@query("""WITH d(name, kind, k) AS (VALUES ('vale', 'ORG', 0), ('oi', 'ORG', 1), ('gol', 'ORG', 2), ('azul', 'ORG', 3), ('rumo', 'ORG', 4), ('weg', 'ORG', 5), ('b3', 'GOV', 6), ('stf', 'GOV', 7), ('ans', 'GOV', 8)),
h AS (SELECT doc_id AS article_id, name, kind, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS place FROM documents, d WHERE contains(lower(substr(text, 1, 2000)), name))
SELECT article_id, CAST(place AS INTEGER) AS place, name, kind FROM h WHERE place < 10""")
def dictionary_ner(spark, sf_dir):
    names = [("vale", "ORG"), ("oi", "ORG"), ("gol", "ORG"), ("azul", "ORG"), ("rumo", "ORG"), ("weg", "ORG"), ("b3", "GOV"), ("stf", "GOV"), ("ans", "GOV")]
    return G.dictionary_entities(C.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), "text"), names)


@query()
def dictionary_companies(spark, sf_dir):
    """The whole dictionary of companies and agencies."""
    names = [(n, "ORG") for n in D.COMPANIES] + [(n, "GOV") for n in D.AGENCIES]
    return G.dictionary_entities(C.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), "text"), names)


@query("""WITH e AS (SELECT l_orderkey AS article_id, l_suppkey AS entity_id, l_shipdate AS shipped, l_linenumber AS line, l_discount AS confidence, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS snippet FROM lineitem)
SELECT article_id, entity_id, arg_min(CAST(line AS VARCHAR), (shipped, line)) AS relation, max(confidence) AS confidence, arg_min(snippet, (shipped, line)) FILTER (snippet IS NOT NULL) AS snippet FROM e GROUP BY 1, 2""")
def merge_edges(spark, sf_dir):
    line = C.table(spark, sf_dir, "lineitem")
    rows = line.select(
        F.col("l_orderkey").alias("article_id"), F.col("l_suppkey").alias("entity_id"), F.struct("l_shipdate", "l_linenumber").alias("created_at"), F.col("l_linenumber").cast("string").alias("relation"),
        F.col("l_discount").alias("confidence"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("snippet"),
    )
    return G.merge_edges(rows)


@query()
def entity_resolution(spark, sf_dir):
    """Names with small errors resolved to part names: exact, by name, by trigrams."""
    p = C.table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    entities = p.select(F.sha2("name", 256).alias("entity_id"), "name", T.canonical_entity(F.col("name")).alias("canonical_name"))
    names = p.select(F.when(F.char_length("name") % 3 == 0, F.upper("name")).when(F.char_length("name") % 3 == 1, F.concat("name", F.lit("s"))).otherwise(F.col("name")).alias("name")).union(spark.createDataFrame([("Lula",), ("zzz qqq",)], "name string"))
    return G.resolve(names, entities)
