"""Assignment of articles, digests and contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyline import catalog as C
from storyline.operators import assign as A
from storyline.plans.feed import _CLUSTERS
from storyline.registry import query


@query(f"""WITH {_CLUSTERS}, t AS (SELECT cluster_id, CASE WHEN cluster_id % 2 = 0 THEN 'internacional' ELSE 'nacional' END AS source_type FROM clusters),
a AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'internacional' ELSE 'nacional' END AS source_type, CASE WHEN doc_id % 3 = 0 THEN 'anexar' WHEN doc_id % 3 = 1 THEN 'novo_cluster' END AS kind, doc_id // 2 AS cluster, CASE WHEN doc_id % 3 = 1 THEN 'tema ' || (doc_id % 5) END AS theme FROM documents),
j AS (SELECT a.*, coalesce(kind = 'anexar' AND t.source_type = a.source_type, FALSE) AS attached FROM a LEFT JOIN t ON t.cluster_id = a.cluster),
h AS (SELECT theme, source_type, min(doc_id) AS head FROM j WHERE kind = 'novo_cluster' GROUP BY 1, 2)
SELECT doc_id AS article_id, CASE WHEN attached THEN cluster WHEN kind = 'novo_cluster' THEN head ELSE doc_id END AS cluster_id, NOT attached AS is_new FROM j LEFT JOIN h ON h.theme = j.theme AND h.source_type = j.source_type""")
def apply_decisions(spark, sf_dir):
    clusters = C.clusters(spark, sf_dir).select("cluster_id", F.when(F.col("cluster_id") % 2 == 0, "internacional").otherwise("nacional").alias("source_type"))
    i = F.col("article_id")
    articles = C.articles(spark, sf_dir).select("article_id", "source_type")
    decisions = articles.where(i % 3 != 2).select(
        F.when(i % 3 == 0, "anexar").otherwise("novo_cluster").alias("kind"), i.alias("article"), F.floor(i / 2).cast("long").alias("cluster"), F.when(i % 3 == 1, F.concat(F.lit("tema "), (i % 5).cast("string"))).alias("theme")
    )
    return A.apply_decisions(articles, clusters, decisions)


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings), c AS (SELECT * FROM v WHERE vec_id < 50), a AS (SELECT * FROM v WHERE vec_id >= 50),
p AS (SELECT a.vec_id AS article_id, c.vec_id AS cluster_id, list_cosine_similarity(a.e, c.e) AS s FROM a JOIN c USING (label)), b AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY s DESC, cluster_id) AS k FROM p WHERE s > 0.2)
SELECT a.vec_id AS article_id, b.cluster_id, round(b.s, 4) AS score FROM a LEFT JOIN b ON b.article_id = a.vec_id AND k = 1""")
def online_assignment(spark, sf_dir):
    v = C.table(spark, sf_dir, "embeddings").withColumnRenamed("label", "tag")
    clusters = v.where("vec_id < 50").select(F.col("vec_id").alias("cluster_id"), "tag", F.col("embedding").alias("centroid"))
    return A.assign_online(v.where("vec_id >= 50").select(F.col("vec_id").alias("article_id"), "tag", F.col("embedding").alias("vector")), clusters, 0.2)


@query("""SELECT doc_id AS article_id, CASE WHEN length(trim(text)) < 20 THEN 'short_text' END AS reasons FROM documents WHERE length(trim(text)) < 20""")
def rejected_records(spark, sf_dir):
    return A.validate(C.articles(spark, sf_dir))[1].select("article_id", F.array_join("reasons", ",").alias("reasons"))


@query(f"""WITH {_CLUSTERS} SELECT owner_id, string_agg('[' || strftime(created_at, '%Y-%m-%d') || '] (' || priority || ') ' || status, chr(10) ORDER BY created_at DESC, cluster_id) AS context
FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY created_at DESC, cluster_id) AS k FROM clusters) WHERE k <= 10 GROUP BY 1""")
def owner_context(spark, sf_dir):
    """Context lines a user, newest first, ten at most."""
    return A.context_lines(C.clusters(spark, sf_dir).withColumn("text", F.col("status")), "owner_id")


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings) SELECT v.label AS cluster_id, max(round(list_cosine_similarity(v.e, q.e), 4)) AS score FROM v, v q WHERE q.vec_id = 3 AND v.vec_id <> 3 AND round(list_cosine_similarity(v.e, q.e), 4) >= 0.1
GROUP BY 1 ORDER BY score DESC, cluster_id LIMIT 5""")
def neighbours_context(spark, sf_dir):
    v = C.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("article_id"), F.col("embedding").alias("vector"), F.col("label").alias("cluster_id"))
    return A.neighbours_context(v.where("article_id = 3"), v, 0.1)


@query("""SELECT c_custkey, c_mktsegment <> 'MACHINERY' OR c_custkey % 4 = 1 AS custom FROM customer""")
def custom_preferences(spark, sf_dir):
    c = C.table(spark, sf_dir, "customer")
    tags = F.when(F.col("c_mktsegment") != "MACHINERY", F.array("c_mktsegment"))
    extra = F.when(F.col("c_custkey") % 4 == 1, F.lit('{"setores": ["x"]}')).when(F.col("c_custkey") % 4 == 2, F.lit('{"setores": [], "empresas": null}'))
    return c.select("c_custkey", A.has_custom_preferences(tags, extra).alias("custom"))


@query()
def digest_without_repeats(spark, sf_dir):
    """One of each group of near-duplicate documents, with the sources of all."""
    from storyline.plans.dedup import near_dup_jaccard

    items = C.articles(spark, sf_dir).select(F.col("article_id").alias("item_id"), "text", F.col("outlet").alias("source"), F.when(F.col("article_id") % 7 == 0, "P1_CRITICO").otherwise("P3_MONITORAMENTO").alias("priority"))
    return A.digest_without_repeats(items, near_dup_jaccard(spark, sf_dir))


@query("""SELECT doc_id AS cluster_id, CASE WHEN contains(text, 'precat') OR doc_id % 9 = 0 THEN 'Dívida Ativa e Créditos Públicos' ELSE 'x' END AS tag FROM documents""")
def corrected_tags(spark, sf_dir):
    d = C.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("cluster_id"), "text")
    none = F.lit(None).cast("string")
    clusters = d.select("cluster_id", F.lit("x").alias("tag"), none.alias("title"), F.when(F.col("cluster_id") % 9 == 0, F.lit("Protesto de CDA em alta")).alias("summary"))
    return A.correct_tags(clusters, d.select("cluster_id", none.alias("title"), "text")).select("cluster_id", "tag")
