"""Stages of the day's run that decide by a model's reply: hygiene, classification, consolidation; and the templates and rules that go into prompts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyline import domain as D
from storyline.functions import jsonx as J
from storyline.functions import text as T
from storyline.llm.common import materialise
from storyline.operators.clustering import components
from storyline.operators.similarity import set_pairs, word_sets

#: Our statuses of replies and the names that reasons give them.
STATUS_NAMES = {"EMPTY": "RESPOSTA_VAZIA", "NO_JSON": "FALHA_SEM_JSON", "INVALID": "FALHA_PARSING_TOTAL"}


def hygiene(articles: DataFrame, junk: Callable[[Column, Column], Column], day: Column) -> DataFrame:
    """Ready articles of the day without a cluster become irrelevant where ``junk`` says so of their title (200 characters) and excerpt (800)."""
    title = F.substring(F.coalesce("title", F.lit("Sem título")), 1, 200)
    asked = (F.col("status") == D.READY) & F.col("cluster_id").isNull() & (F.to_date("created_at") == day)
    gone = asked & junk(title, F.substring(F.coalesce("processed", "text", F.lit("")), 1, 800))
    return articles.withColumn("status", F.when(gone, F.lit("irrelevante")).otherwise(F.col("status")))


def classify_clusters(clusters: DataFrame, replies: DataFrame) -> DataFrame:
    """Clusters with title, priority, tag and summary from a model's ``reply``; those whose reply can't be used are marked
    for review with the reason. Clusters without a row in ``replies`` stay as they are."""
    r = replies.select(F.col("cluster_id").alias("__id"), J.parse_reply(F.col("reply")).alias("__p"))
    joined = clusters.join(r, F.col("cluster_id") == F.col("__id"), "left")
    json, name = F.col("__p.json"), T.lookup(STATUS_NAMES, F.col("__p.status"))
    joined = joined.withColumn("__o", F.when(json.startswith("["), F.coalesce(F.get_json_object(json, "$[0]"), json)).otherwise(json))
    o = F.col("__o")
    lacking = T.any_of(F.coalesce(J.field(o, k), F.lit("")).isin("", "null", "false", "0", "[]", "{}") for k in ("prioridade", "tag", "resumo_final"))
    why = (
        F.when(name.isNotNull(), F.concat(F.lit("Falha na análise: "), name))
        .when(~o.startswith("{"), "Formato inválido (tipo list)")
        .when(lacking, "Resposta do LLM sem campos obrigatórios")
    )
    asked, failed = F.col("__id").isNotNull(), F.col("__why").isNotNull()

    def value(column: str, good: Column, bad: Column) -> Column:
        return F.when(~asked, F.col(column)).when(failed, bad).otherwise(good).alias(column)

    new = {
        "title": value("title", J.field_or(o, "titulo", F.col("title")), F.col("title")),
        "priority": value("priority", T.fix_priority(J.field(o, "prioridade")), F.lit("P3_REVISAR")),
        "tag": value("tag", T.canonical_tag(J.field(o, "tag"), F.col("source_type") == "internacional"), F.lit("ERRO")),
        "summary": value("summary", J.field(o, "resumo_final"), F.concat(F.lit("Falha na classificação automática. Motivo: "), F.substring("__why", 1, 200))),
    }
    return joined.withColumn("__why", F.when(asked, why)).select(*(new.get(c, F.col(c)) for c in clusters.columns))


def consolidation(clusters: DataFrame, least: float = 0.85) -> DataFrame:
    """(source, target) of clusters that merge without a model: those of one title, tag and source type into the least id, then of
    what is left P3 clusters of one tag and type whose titles' words have the Jaccard similarity ``least``, through any chain."""
    own = clusters.select("cluster_id", "title", "tag", "source_type", T.is_generic_title(F.col("title")).alias("generic"), F.coalesce(F.col("priority") == "P3_MONITORAMENTO", F.lit(False)).alias("p3"))
    signed = materialise(word_sets(own, "cluster_id", "title", "p3", ["tag", "source_type", "generic"]), "titles")
    named = signed.select("cluster_id", "tag", "source_type", "key").where(~F.col("generic") & F.col("key").isNotNull() & (F.coalesce("tag", F.lit("")) != ""))
    heads = named.groupBy("key", "tag", "source_type").agg(F.min("cluster_id").alias("target"))
    same = (named["key"] == heads["key"]) & (named["tag"] == heads["tag"]) & named["source_type"].eqNullSafe(heads["source_type"])
    exact = materialise(named.join(heads, same).where("cluster_id > target").select(F.col("cluster_id").alias("source"), "target"), "merged")
    left = signed.where(F.size("w") > 0).join(exact, F.col("cluster_id") == F.col("source"), "left_anti")
    sets = left.select(F.coalesce("tag", F.lit("")).alias("tag"), F.coalesce("source_type", F.lit("")).alias("source_type"), F.col("cluster_id").alias("id"), "w")
    near = components(set_pairs(sets, ["tag", "source_type"], least, forest=True), "a_id", "b_id").where("id <> component")
    return exact.unionByName(near.select(F.col("id").alias("source"), F.col("component").alias("target")))


def model_entities(articles: DataFrame, ask: Callable[[list[str]], list[list[str]]], size: int = 10, id_col: str = "article_id", text_col: str = "text") -> DataFrame:
    """(id, entity) that ``ask`` finds in batches of texts; a batch that fails is halved until one text is left, which then has none."""

    def asked(ids: list, texts: list[str]) -> list[tuple]:
        try:
            return [(i, e) for i, found in zip(ids, ask(texts), strict=True) for e in found]
        except Exception:
            half = len(ids) // 2
            return asked(ids[:half], texts[:half]) + asked(ids[half:], texts[half:]) if half else []

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for k in range(0, len(pdf), size):
                part = pdf.iloc[k : k + size]
                yield pd.DataFrame(asked(part[id_col].tolist(), part[text_col].tolist()), columns=[id_col, "entity"]).astype({id_col: pdf[id_col].dtype, "entity": object})

    rows = articles.select(id_col, F.coalesce(text_col, F.lit("")).alias(text_col))
    return rows.mapInPandas(batches, f"{id_col} {dict(articles.dtypes)[id_col]}, entity string")


def templates(defaults: DataFrame, stored: DataFrame) -> DataFrame:
    """(key, content): a stored template that isn't empty stands before the default; stored keys without a default count too."""
    s = stored.where(F.coalesce("content", F.lit("")) != "").groupBy("key").agg(F.min("content").alias("__stored"))
    return defaults.join(s, "key", "full_outer").select("key", F.coalesce("__stored", "content", F.lit("")).alias("content"))


def rendered(template: Column, **values: Column) -> Column:
    """A template with its placeholders filled, doubled braces made single; one that names an unknown placeholder stays as it is."""
    part = r"\{\{|\}\}|\{\w+\}"
    marks = F.regexp_extract_all(template, F.lit(part), F.lit(0))
    known = {"{{": F.lit("{"), "}}": F.lit("}")} | {f"{{{k}}}": F.coalesce(v.cast("string"), F.lit("None")) for k, v in values.items()}
    given = F.create_map(*(x for k, v in known.items() for x in (F.lit(k), v)))
    filled = F.array_join(F.zip_with(F.split(template, part, -1), marks, lambda s, m: F.concat(s, F.coalesce(given[m], F.lit("")))), "")
    return F.when(F.size(F.array_except(marks, F.map_keys(given))) == 0, filled).otherwise(template)


def feedback_rules(configs: DataFrame, fallback: str = "", enabled: bool = True) -> DataFrame:
    """One row, the rules learnt from feedback: those configured, else the fallback; empty where they are switched off."""
    found = configs.where((F.col("key") == "FEEDBACK_RULES") & (F.coalesce("value", F.lit("")) != "")).agg(F.min("value").alias("rules"))
    return found.select(F.when(F.lit(enabled), F.coalesce("rules", F.lit(fallback))).otherwise("").alias("rules"))
