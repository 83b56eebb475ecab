"""Feeds: ranked pages of clusters with nested sources and feedback, grids with optional filters."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyline.domain import ACTIVE, IRRELEVANT, NATIONAL_TYPES

COMPARE = {"=": operator.eq, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}


def priority_rank(priority: Column) -> Column:
    return F.when(priority == "P1_CRITICO", 1).when(priority == "P2_ESTRATEGICO", 2).otherwise(3)


def relevant(clusters: DataFrame, start: Column | None = None, end: Column | None = None, priority: str | None = None, source_type: str | None = None) -> DataFrame:
    """Active, relevant clusters of a half-open range of time; a range of the stamp itself, so that scans prune by it."""
    out = clusters.where((F.col("status") == ACTIVE) & (F.col("priority") != IRRELEVANT))
    if start is not None:
        out = out.where(F.col("created_at") >= start)
    if end is not None:
        out = out.where(F.col("created_at") < end)
    if priority:
        out = out.where(F.col("priority") == priority)
    if source_type == "nacional":
        out = out.where(F.col("source_type").isin(*NATIONAL_TYPES))
    elif source_type:
        out = out.where(F.col("source_type") == source_type)
    return out


def page(rows: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> DataFrame:
    """One page of a total order: a top-k, not a sort of all rows."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def pagination(rows: DataFrame, number: int, size: int) -> DataFrame:
    total = F.count("*").cast("long")
    pages = F.ceil(total / size).cast("long")
    return rows.agg(total.alias("total"), pages.alias("pages"), (F.lit(number) < pages).alias("has_next"), F.lit(number > 1).alias("has_previous"))


def with_feedback(clusters: DataFrame, feedback: DataFrame, key: str = "cluster_id", place: Column | None = None) -> DataFrame:
    """Likes, dislikes and the latest feedback of each cluster, from one aggregate over the clusters at hand. A time or id that is null is the
    latest, as in the SQL. ``place``: of feedback of one time and id that with the least place counts; the value itself is the last word,
    so that reruns agree."""
    at, made, number = F.lit(0) if place is None else place, F.col("created_at"), F.col("feedback_id")
    newest = F.lit("1970-01-01").cast(feedback.schema["created_at"].dataType) - made
    order = F.struct(made.isNotNull(), newest, number.isNotNull(), F.bitwise_not(number), at, "feedback")
    own = feedback.join(clusters.select(key).distinct(), key, "left_semi")
    agg = own.groupBy(key).agg(F.count_if(F.col("feedback") == "like").alias("likes"), F.count_if(F.col("feedback") == "dislike").alias("dislikes"), F.min_by("feedback", order).alias("latest"))
    return clusters.join(agg, key, "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("likes", "dislikes")})


def with_sources(clusters: DataFrame, articles: DataFrame, key: str = "cluster_id", most: int = 5) -> DataFrame:
    """The first source names of each cluster in alphabetical order, and how many articles it has."""
    own = articles.join(clusters.select(key).distinct(), key, "left_semi")
    agg = own.groupBy(key).agg(F.slice(F.array_sort(F.collect_set("source")), 1, most).alias("sources"), F.count("*").alias("n_articles"))
    return clusters.join(agg, key, "left").withColumns({"sources": F.coalesce("sources", F.array().cast("array<string>")), "n_articles": F.coalesce("n_articles", F.lit(0).cast("long"))})


def grid(rows: DataFrame, equal: dict | None = None, like: dict | None = None, compare: dict | None = None, not_in: dict | None = None, day: tuple[str, Column] | None = None) -> DataFrame:
    """Admin grids: filters that are given are and-ed. ``not_in``: null, empty or outside the values; ``compare``: column -> (operator, value)."""
    conds = [F.col(c) == v for c, v in (equal or {}).items() if v is not None]
    conds += [F.col(c).ilike(f"%{v}%") for c, v in (like or {}).items() if v]
    conds += [COMPARE[o](F.col(c), F.lit(v)) for c, (o, v) in (compare or {}).items()]
    conds += [F.col(c).isNull() | (F.col(c) == "") | ~F.col(c).isin(*v) for c, v in (not_in or {}).items()]
    if day:
        conds += [F.col(day[0]) >= day[1].cast("timestamp"), F.col(day[0]) < F.date_add(day[1], 1).cast("timestamp")]
    return rows.where(reduce(lambda a, b: a & b, conds)) if conds else rows


def pending_notifications(clusters: DataFrame, most: int = 50) -> DataFrame:
    rows = relevant(clusters).where("not notified and summary is not null")
    return rows.orderBy(priority_rank(F.col("priority")), "created_at", "cluster_id").limit(most)


def day_temperature(clusters: DataFrame) -> DataFrame:
    """QUENTE, MORNO or FRIO by the day's count of P1 and P2 and of distinct tags."""
    day = clusters.groupBy(F.to_date("created_at").alias("day")).agg(
        F.count_if(F.col("priority") == "P1_CRITICO").alias("p1"), F.count_if(F.col("priority") == "P2_ESTRATEGICO").alias("p2"),
        F.count_if(F.col("priority") == "P3_MONITORAMENTO").alias("p3"), F.countDistinct("tag").alias("tags"),
    )
    top = F.col("p1") + F.col("p2")
    return day.withColumn("temperature", F.when((top >= 5) & (F.col("tags") >= 3), "QUENTE").when(top >= 2, "MORNO").otherwise("FRIO"))
