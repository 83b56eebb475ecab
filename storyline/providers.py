"""Replaceable models: embeddings, grouping and classification, with repeatable stand-ins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyline import domain as D
from storyline.functions import text as T
from storyline.functions.vectors import stub_embedding

#: Name -> text column to vector column.
EMBEDDERS: dict[str, Callable[[Column], Column]] = {"stub": stub_embedding}
#: Name -> text column to struct(tag, priority).
CLASSIFIERS: dict[str, Callable[[Column], Column]] = {}


def keyword_classifier(text: Column) -> Column:
    """A stand-in for a model: the tag by keywords, P2 where there is one, else irrelevant."""
    # A fold over nothing binds the tag; as an expression it would be evaluated for each of its uses.
    both = lambda tag: F.struct(tag.alias("tag"), F.when(tag == D.IRRELEVANT, D.IRRELEVANT).otherwise("P2_ESTRATEGICO").alias("priority"))
    return F.aggregate(F.array().cast("array<string>"), T.fix_tag(F.substring(text, 1, 400)), lambda tag, _: tag, both)


CLASSIFIERS["keywords"] = keyword_classifier


def embed(rows: DataFrame, text_col: str = "text", provider: str = "stub", most: int = 8000, least: int = 10) -> DataFrame:
    """Adds ``vector``; texts are cut, and those too short have none."""
    text = F.substring(F.col(text_col), 1, most)
    return rows.withColumn("vector", F.when(F.char_length(F.col(text_col)) >= least, EMBEDDERS[provider](text)))


def classify(rows: DataFrame, text_col: str = "text", provider: str = "keywords") -> DataFrame:
    """Adds ``tag`` and ``priority``; what the provider can't tell is P3_REVISAR under the tag ERRO."""
    out = rows.withColumn("__c", CLASSIFIERS[provider](F.col(text_col)))
    return out.withColumns({"tag": F.coalesce("__c.tag", F.lit("ERRO")), "priority": F.coalesce("__c.priority", F.lit("P3_REVISAR"))}).drop("__c")


def process(articles: DataFrame) -> DataFrame:
    """Stage one of the pipeline: gate, title, tag, status; pending articles become ready or irrelevant."""
    gate = T.gatekeeper(F.col("text"))
    rows = classify(articles.withColumn("gate", gate))
    ad = T.is_advertisement(F.lit(None).cast("string"), F.col("text"))
    status = F.when(~F.col("gate.is_relevant") | ad | (F.col("tag") == D.IRRELEVANT), "irrelevante").otherwise(D.READY)
    return rows.withColumns({"title": T.short_title(F.col("text")), "status": status, "reason": F.col("gate.reason")}).drop("gate")
