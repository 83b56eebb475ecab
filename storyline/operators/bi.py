"""Counts and rates for dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def series_by_day(articles: DataFrame, clusters: DataFrame) -> DataFrame:
    """Articles a day, clusters of that day (0 if none); days with clusters only are left out."""
    a = articles.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n_articles"))
    c = clusters.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n_clusters"))
    return a.join(c, "day", "left").withColumn("n_clusters", F.coalesce("n_clusters", F.lit(0).cast("long")))


def top_counts(rows: DataFrame, key: Column, most: int, label: str = "Desconhecido", name: str = "name") -> DataFrame:
    """Null and empty keys are groups of their own that share a label."""
    out = rows.groupBy(key.alias("__k")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.col("__k").asc_nulls_first()).limit(most)
    return out.select(F.coalesce(F.when(F.col("__k") != "", F.col("__k")), F.lit(label)).alias(name), "n")


def top_and_rest(rows: DataFrame, key: str, most: int, rest: str = "Outros") -> DataFrame:
    """The top keys and one row for all others, if there are any."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), key).limit(most).select(F.col(key).alias("__top"))
    named = counts.join(F.broadcast(top), F.col(key) == F.col("__top"), "left").select(F.coalesce("__top", F.lit(rest)).alias(key), "n")
    return named.groupBy(key).agg(F.sum("n").alias("n"))


def rates(rows: DataFrame, key: Column, good: Column, least: int, name: str = "key") -> DataFrame:
    """Likes, dislikes and the dislike rate in whole percent (half to even) of keys with enough feedback."""
    out = rows.groupBy(key.alias(name)).agg(F.count_if(good).alias("likes"), F.count_if(~good).alias("dislikes")).where(F.col("likes") + F.col("dislikes") >= least)
    return out.withColumn("dislike_rate", F.bround(F.col("dislikes") * 100 / (F.col("likes") + F.col("dislikes")), 0).cast("long"))


def size_histogram(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n_groups"))


def precedence(rows: DataFrame, key: str, column: str, order: tuple[str, ...], default: str | None = None) -> DataFrame:
    """For each key the first of the values in ``order`` that occurs."""
    rank = F.coalesce(*(F.when(F.col(column) == v, F.lit(i)) for i, v in enumerate(order)))
    return rows.groupBy(key).agg(F.min(rank).alias("__r")).select(key, F.coalesce(F.get(F.array(*(F.lit(v) for v in order)), F.col("__r")), F.lit(default)).alias(column))


def named_counts(**frames: DataFrame) -> DataFrame:
    """(metric, n), a row a frame."""
    out = None
    for name, f in frames.items():
        row = f.agg(F.count("*").alias("n")).select(F.lit(name).alias("metric"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def batches(rows: DataFrame, partition: str, order: list[Column], size: int) -> DataFrame:
    """Numbers rows in batches of a size within each partition key."""
    return rows.withColumn("batch", F.ceil(F.row_number().over(Window.partitionBy(partition).orderBy(*order)) / size).cast("long"))


def token_cost(chars: Column, price_in: float, price_out: float, out_ratio: float = 0.2) -> Column:
    """Cost in USD of texts: four characters a token, prices a million tokens."""
    tokens = chars / 4
    return tokens / 1e6 * price_in + tokens * out_ratio / 1e6 * price_out


def feedback_patterns(rows: DataFrame) -> DataFrame:
    """(pattern, value, n): likes and dislikes by tag and by priority; whatever is not a like is a dislike, empty values don't count."""
    kind = F.when(F.col("feedback") == "like", "likes").otherwise("dislikes")
    pairs = F.array(*(F.struct(F.concat(kind, F.lit(f"_por_{name}")).alias("pattern"), F.col(c).alias("value")) for name, c in (("tag", "tag"), ("prioridade", "priority"))))
    return rows.select(F.explode(pairs).alias("p")).where(F.coalesce("p.value", F.lit("")) != "").groupBy("p.pattern", "p.value").agg(F.count("*").alias("n"))
