"""Grouping: exact merges, components of links, referents, promotion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyline.functions import text as T
from storyline.shared import shared_path


def merge_equal(rows: DataFrame, keys: list, id_col: str = "id") -> DataFrame:
    """Groups of rows with one normal key, and the least id, into which they merge."""
    return rows.groupBy(*keys).agg(F.min(id_col).alias("target"), F.count("*").alias("n"))


def title_key(title) -> F.Column:
    return F.trim(F.regexp_replace(F.lower(T.unaccent(title)), "[^a-z0-9]+", " "))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the least id that links reach. Labels spread along edges and jump to their label's label each round."""
    spark = edges.sparkSession

    def cut(df: DataFrame) -> DataFrame:
        path = shared_path(spark, "labels")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    ways = F.array(F.struct(F.col(a).alias("x"), F.col(b).alias("y")), F.struct(F.col(b).alias("x"), F.col(a).alias("y")))
    both = cut(edges.select(F.explode(ways).alias("way")).select("way.*").distinct())
    labels = cut(both.groupBy(F.col("x").alias("id")).agg(F.least(F.first("x"), F.min("y")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("id").alias("y"), F.col("component").alias("c")), "y").groupBy(F.col("x").alias("id")).agg(F.min("c").alias("near"))
        spread = labels.join(near, "id").select("id", F.least("component", "near").alias("component"))
        jump = spread.select(F.col("id").alias("component"), F.col("component").alias("next"))
        following = cut(spread.join(jump, "component", "left").select("id", F.coalesce("next", "component").alias("component")))
        if not following.join(labels.withColumnRenamed("component", "old"), "id").where("component != old").limit(1).count():
            return following
        labels = following


def referent(articles: DataFrame, key: str = "cluster_id", least: int = 20) -> DataFrame:
    """Each cluster's referent article: the earliest (nulls last) whose fact is long enough, else the one with the longest fact."""
    n = F.char_length(F.coalesce("fact", F.lit("")))
    order = F.struct((n < least).cast("int").alias("short"), F.when(n < least, -n).otherwise(0).alias("length"), F.col("created_at").isNull().alias("no_time"), F.col("created_at"), F.col("article_id"))
    return articles.groupBy(key).agg(F.min_by("article_id", order).alias("referent_id"))


def promote(clusters: DataFrame, selected: DataFrame, key: str = "cluster_id") -> tuple[DataFrame, DataFrame]:
    """Selected P3 clusters become P2. (next state, counts)."""
    hit = clusters.join(selected.select(key, F.lit(True).alias("__hit")).distinct(), key, "left")
    up = F.col("__hit") & (F.col("priority") == "P3_MONITORAMENTO")
    counts = hit.where("__hit").agg(F.count("*").alias("found"), F.count_if(F.col("priority") == "P3_MONITORAMENTO").alias("promoted"), F.count_if(F.col("priority") != "P3_MONITORAMENTO").alias("already"))
    return hit.withColumn("priority", F.when(up, "P2_ESTRATEGICO").otherwise(F.col("priority"))).select(*clusters.columns), counts
