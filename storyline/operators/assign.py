"""Putting articles into clusters: decisions of a grouper, online assignment, digests without repeats, contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyline import domain as D
from storyline.functions import text as T
from storyline.functions import vectors as V
from storyline.operators.clustering import components
from storyline.operators.feed import priority_rank
from storyline.operators.state import first_per_key


def apply_decisions(articles: DataFrame, clusters: DataFrame, decisions: DataFrame) -> DataFrame:
    """(article_id, cluster_id, is_new): attach decisions hold where the cluster exists and is of the article's source type; all other
    articles, decided or not, found a cluster of their own, those of one new theme and type together under the least article id."""
    d = first_per_key(decisions.where("article is not null"), ["article"], [(F.col("kind") != "anexar").cast("int"), F.col("cluster"), F.col("theme")])
    own = articles.join(d, articles["article_id"] == d["article"], "left")
    target = clusters.select(F.col("cluster_id").alias("cluster"), F.col("source_type").alias("cluster_type"))
    joined = own.join(target, "cluster", "left").withColumn("attached", F.coalesce((F.col("kind") == "anexar") & (F.col("cluster_type") == F.col("source_type")), F.lit(False)))
    themed = F.when(~F.col("attached") & (F.col("kind") == "novo_cluster") & F.col("theme").isNotNull(), F.concat_ws("|", "theme", "source_type"))
    heads = joined.withColumn("group", themed).where("group is not null").groupBy("group").agg(F.min("article_id").alias("head"))
    out = joined.withColumn("group", themed).join(heads, "group", "left")
    return out.select("article_id", F.when(F.col("attached"), F.col("cluster")).otherwise(F.coalesce("head", "article_id")).alias("cluster_id"), (~F.col("attached")).alias("is_new"))


def assign_online(articles: DataFrame, clusters: DataFrame, threshold: float = 0.7) -> DataFrame:
    """A batch's articles against today's clusters of their tag: the most similar over the threshold, else null (a new cluster). For foreachBatch."""
    pairs = articles.select("article_id", "tag", F.col("vector").alias("a")).join(clusters.select("cluster_id", "tag", F.col("centroid").alias("c")), "tag")
    scored = pairs.withColumn("score", V.cosine(F.col("a"), F.col("c"))).where(F.col("score") > threshold)
    best = scored.groupBy("article_id").agg(F.max(F.struct("score", (-F.col("cluster_id")).alias("m"))).alias("x"))
    return articles.select("article_id").join(best, "article_id", "left").select("article_id", (-F.col("x.m")).alias("cluster_id"), F.round("x.score", 4).alias("score"))


def validate(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with reasons) of article records."""
    checks = {"no_text": F.col("text").isNull() | ~F.col("text").rlike(r"\S"), "no_source": F.col("outlet").isNull() | (F.trim("outlet") == ""), "short_text": F.char_length(F.trim("text")) < 20}
    reasons = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in checks.items())), lambda x: x.isNotNull())
    marked = records.withColumn("reasons", reasons)
    return marked.where(F.size("reasons") == 0).drop("reasons"), marked.where(F.size("reasons") > 0)


def digest_without_repeats(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of items that similar pairs connect one stays: best priority, then longest text, then least id; with the first four sources of all."""
    joined = components(pairs, "a_id", "b_id").withColumnRenamed("id", "item_id")
    rows = items.join(joined, "item_id", "left").withColumn("group", F.coalesce("component", "item_id"))
    named = rows.groupBy("group").agg(F.array_sort(F.collect_set("source")).alias("s"), F.count("*").alias("n_merged"))
    best = first_per_key(rows, ["group"], [priority_rank(F.col("priority")), F.char_length("text").desc(), F.col("item_id")])
    return best.join(named, "group").select("item_id", "priority", F.array_join(F.slice("s", 1, 4), ", ").alias("sources"), "n_merged")


def context_lines(rows: DataFrame, key: str, most: int = 10, chars: int = 300) -> DataFrame:
    """One text a key: '[date] (priority) text' lines, newest first."""
    line = F.concat(F.lit("["), F.date_format("created_at", "yyyy-MM-dd"), F.lit("] ("), F.col("priority"), F.lit(") "), F.substring("text", 1, chars))
    order = F.struct((-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("newest"), F.col("cluster_id"), line.alias("line"))
    lines = F.transform(F.slice(F.array_sort(F.collect_set(order)), 1, most), lambda x: x["line"])
    return rows.groupBy(key).agg(F.array_join(lines, "\n").alias("context"))


def neighbours_context(article: DataFrame, articles: DataFrame, least: float = 0.7, most: int = 5) -> DataFrame:
    """Distinct clusters of the nearest articles of one article, in order of similarity."""
    q = F.broadcast(article.select(F.col("vector").alias("__q"), F.col("article_id").alias("__id")).limit(1))
    scored = articles.join(q, F.col("article_id") != F.col("__id")).withColumn("score", F.round(V.cosine(F.col("vector"), F.col("__q")), 4)).where(F.col("score") >= least)
    return scored.groupBy("cluster_id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "cluster_id").limit(most)


def has_custom_preferences(tags: Column, extra: Column) -> Column:
    """Whether a user chose tags, or any of three settings in JSON."""
    chosen = T.any_of(F.coalesce(F.get_json_object(extra, f"$.{k}"), F.lit("")).isin("", "null", "false", "[]", "0") == F.lit(False) for k in ("empresas", "setores", "instrucoes"))
    return (F.coalesce(F.size(tags), F.lit(0)) > 0) | chosen


def correct_tags(clusters: DataFrame, articles: DataFrame) -> DataFrame:
    """Clusters whose title, summary or articles speak of public debt get its tag, unless they are irrelevant."""
    body = articles.groupBy("cluster_id").agg(F.max(F.concat_ws(" ", "title", "text").rlike(D.DEBT_PATTERN).cast("int")).alias("hit"))
    own = F.concat_ws(" ", "title", "summary").rlike(D.DEBT_PATTERN)
    fix = (F.col("tag") != D.IRRELEVANT) & (own | (F.coalesce("hit", F.lit(0)) == 1))
    return clusters.join(body, "cluster_id", "left").withColumn("tag", F.when(fix, D.DEBT_TAG).otherwise(F.col("tag"))).drop("hit")
