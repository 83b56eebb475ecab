"""The entity graph as two frames: entities, and edges (article_id, entity_id, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyline.functions import text as T
from storyline.operators.state import first_per_key


def entity_id(canonical: Column, kind: Column) -> Column:
    return F.sha2(F.concat(canonical, kind), 256)


def history(clusters: DataFrame, articles: DataFrame, edges: DataFrame, entity: Column, since: Column, most: int = 10) -> DataFrame:
    """Active clusters with an article that names the entity, newest first; one row a (cluster, role, sentiment)."""
    hit = edges.where(F.col("entity_id") == entity).join(articles.select("article_id", "cluster_id"), "article_id")
    out = clusters.where((F.col("status") == "ativo") & (F.col("created_at") >= since)).join(hit, "cluster_id")
    return out.select("cluster_id", "created_at", "priority", "relation", "sentiment").distinct().orderBy(F.desc("created_at"), "cluster_id", "relation", "sentiment").limit(most)


def co_occurring(edges: DataFrame, entity: Column, most: int = 20) -> DataFrame:
    """Other entities of the articles that name an entity, by shared edges: a semi join, not a self join of all edges."""
    own = edges.where(F.col("entity_id") == entity).select("article_id").distinct()
    out = edges.where(F.col("entity_id") != entity).join(own, "article_id", "left_semi")
    return out.groupBy("entity_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity_id").limit(most)


def neighbourhood(edges: DataFrame, articles: DataFrame, cluster: Column, entities: int = 30, clusters: int = 10) -> tuple[DataFrame, DataFrame]:
    """Depth one around a cluster: its top entities by mentions, then the other clusters that share most of them. (nodes, edges)."""
    named = edges.join(articles.select("article_id", "cluster_id"), "article_id")
    top = named.where(F.col("cluster_id") == cluster).groupBy("entity_id").agg(F.count("*").alias("mentions")).orderBy(F.desc("mentions"), "entity_id").limit(entities)
    shared = (
        named.where(F.col("cluster_id") != cluster).join(F.broadcast(top.select("entity_id")), "entity_id")
        .groupBy("cluster_id").agg(F.countDistinct("entity_id").alias("shared")).orderBy(F.desc("shared"), "cluster_id").limit(clusters)
    )
    nodes = top.select(F.col("entity_id").cast("string").alias("id"), F.lit("entity").alias("kind"), F.col("mentions").alias("size")).unionByName(
        shared.select(F.col("cluster_id").cast("string").alias("id"), F.lit("cluster").alias("kind"), F.col("shared").alias("size"))
    )
    ties = named.join(F.broadcast(shared.select("cluster_id")), "cluster_id").join(F.broadcast(top.select("entity_id")), "entity_id").groupBy("cluster_id", "entity_id").agg(F.count("*").alias("weight"))
    return nodes, ties


def resolve(names: DataFrame, entities: DataFrame, least: float = 0.6) -> DataFrame:
    """Each name's entity: by canonical name, else by name, else by the best trigram similarity over ``least``.

    The fuzzy step joins on shared trigrams instead of comparing every name with every entity.
    """
    wanted = names.select("name", F.lower(T.canonical_entity(F.col("name"))).alias("c")).distinct()
    known = entities.select("entity_id", F.lower("canonical_name").alias("k"), F.lower("name").alias("n"))
    exact = wanted.join(known, wanted["c"] == known["k"]).select("name", "entity_id", F.lit(1).alias("step"), F.lit(1.0).alias("score"))
    by_name = wanted.join(known, F.lower(F.trim("name")) == known["n"]).select(wanted["name"], "entity_id", F.lit(2).alias("step"), F.lit(1.0).alias("score"))
    left, right = wanted.withColumn("g", T.trigrams(F.col("c"))), known.withColumn("h", T.trigrams(F.col("k")))
    pairs = left.withColumn("t", F.explode("g")).join(right.withColumn("t", F.explode("h")), "t").select(left["name"], "entity_id", "g", "h").distinct()
    fuzzy = pairs.select("name", "entity_id", F.lit(3).alias("step"), T.set_similarity(F.col("g"), F.col("h")).alias("score")).where(F.col("score") > least)
    return first_per_key(exact.unionByName(by_name).unionByName(fuzzy), ["name"], [F.col("step"), F.col("score").desc(), F.col("entity_id")])


def merge_edges(edges: DataFrame) -> DataFrame:
    """One edge an (article, entity): first known values in order of arrival, the greatest confidence, snippets of 500 characters."""
    w = F.col("created_at")
    return edges.groupBy("article_id", "entity_id").agg(
        F.min_by("relation", w).alias("relation"), F.max("confidence").alias("confidence"), F.min_by(F.substring("snippet", 1, 500), F.when(F.col("snippet").isNotNull(), w)).alias("snippet")
    )


def dictionary_entities(articles: DataFrame, names: list[tuple[str, str]], most: int = 10) -> DataFrame:
    """Names of a dictionary (name, kind) that occur in the first 2000 characters, in the dictionary's order."""
    low = F.lower(F.substring("text", 1, 2000))
    hits = F.filter(F.array(*(F.when(low.contains(n), F.struct(F.lit(n).alias("name"), F.lit(k).alias("kind"))) for n, k in names)), lambda x: x.isNotNull())
    return articles.select("article_id", F.posexplode(F.slice(hits, 1, most)).alias("place", "entity")).select("article_id", "place", "entity.*")


def top_per_group(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= most)
