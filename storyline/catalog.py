"""Schemas of the domain's tables, and bindings of its entities to the star schema that tests run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARTICLE_SCHEMA = (
    "id long, hash_unico string, texto_bruto string, url_original string, fonte_coleta string, metadados string, created_at timestamp, processed_at timestamp, status string, "
    "titulo_extraido string, texto_processado string, jornal string, autor string, pagina string, data_publicacao timestamp, categoria string, tag string, prioridade string, "
    "relevance_score double, relevance_reason string, tipo_fonte string, embedding binary, embedding_v2 binary, cluster_id long"
)
CLUSTER_SCHEMA = (
    "id long, titulo_cluster string, resumo_cluster string, tag string, prioridade string, embedding_medio binary, created_at timestamp, updated_at timestamp, status string, "
    "tipo_fonte string, total_artigos long, ultima_atualizacao timestamp, ja_notificado boolean, notificado_em timestamp"
)
ENTITY_SCHEMA = "id string, name string, canonical_name string, entity_type string, description string, aliases array<string>, created_at timestamp, updated_at timestamp"
EDGE_SCHEMA = "id long, artigo_id long, entity_id string, relation_type string, sentiment_score double, context_snippet string, confidence double, created_at timestamp"
FEEDBACK_SCHEMA = "id long, artigo_id long, feedback string, processed boolean, metadados string, created_at timestamp"
RECORD_SCHEMA = (
    "id_hash string, titulo string, subtitulo string, categoria string, link string, texto_completo string, data_publicacao string, data_ultima_modificacao string, tags array<string>, fonte string"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles; one a minute from 2024 on."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("article_id"), "text", F.col("source").alias("outlet"), "lang", "n_chars",
        F.when(F.col("lang") == "en", "internacional").otherwise("nacional").alias("source_type"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("doc_id").cast("int"), F.lit(0))).alias("created_at"),
    )


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as clusters."""
    o = table(spark, sf_dir, "orders")
    p = F.col("o_orderpriority")
    return o.select(
        F.col("o_orderkey").alias("cluster_id"), F.col("o_custkey").alias("owner_id"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("weight"),
        F.when(p == "1-URGENT", "P1_CRITICO").when(p == "2-HIGH", "P2_ESTRATEGICO").when(p == "5-LOW", "IRRELEVANTE").otherwise("P3_MONITORAMENTO").alias("priority"),
        F.when(F.col("o_orderstatus") == "O", "ativo").when(F.col("o_orderstatus") == "P", "arquivado").otherwise("descartado").alias("status"),
    )


def cluster_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as the clusters' articles, with their source and feedback."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        F.col("l_orderkey").alias("cluster_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("article_id"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("source_id"),
        F.col("l_partkey").alias("entity_id"), F.when(F.col("l_returnflag") == "A", "like").when(F.col("l_returnflag") == "R", "dislike").alias("feedback"), F.col("l_shipdate").alias("created_at"),
    )


def placed_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles' feedback with its place, file and row, in the table of line items, which repeat order and line number."""
    line = table(spark, sf_dir, "lineitem").withColumn("place", F.struct("_metadata.file_path", "_metadata.row_index"))
    feedback = F.when(F.col("l_returnflag") == "A", "like").when(F.col("l_returnflag") == "R", "dislike")
    article = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return line.select(F.col("l_orderkey").alias("cluster_id"), article.alias("feedback_id"), feedback.alias("feedback"), F.col("l_shipdate").alias("created_at"), "place").where("feedback is not null")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as outlets, with the type that their region stands for."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    typed = F.when(F.col("r_name") == "AMERICA", "brasil_fisico").when(F.col("r_name") == "EUROPE", "brasil_online").otherwise("internacional")
    return s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("source"), typed.alias("source_type")
    )


def run_sql(spark: SparkSession, sf_dir: str, text: str, names: tuple[str, ...]) -> DataFrame:
    """Free SQL over the named tables, which are registered as temporary views."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(text)
