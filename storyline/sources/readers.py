"""Sources: JSON dumps, crawler banks, paged PDF text, HTML listings, JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyline.catalog import RECORD_SCHEMA
from storyline.functions import text as T
from storyline.operators.state import first_per_key, merge_bank


def read_json_dump(spark: SparkSession, path: str) -> DataFrame:
    """Arrays of crawler records as articles: the full text (else the title), records without either go."""
    raw = spark.read.schema(RECORD_SCHEMA).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    body = F.coalesce(T.present(T.strip(F.col("texto_completo"))), T.present(T.strip(F.col("titulo"))))
    has_url = F.coalesce(F.col("link") != "", F.lit(False))
    by_name, by_text = T.source_type(F.col("fonte"), has_url, F.lit("json")), T.source_type_by_text(F.col("texto_completo"), has_url, F.lit("json"))
    rows = raw.withColumn("texto_bruto", body).where("texto_bruto is not null")
    return rows.select(
        "texto_bruto", F.col("titulo").alias("titulo_extraido"), F.col("link").alias("url_original"), F.col("fonte").alias("jornal"), "categoria",
        F.try_to_timestamp("data_publicacao").alias("data_publicacao"), T.content_hash(F.col("texto_bruto"), F.col("link")).alias("hash_unico"),
        F.when((by_name == "internacional") | (by_text == "internacional"), "internacional").otherwise(by_name).alias("tipo_fonte"), F.to_json(F.struct(*raw.columns)).alias("metadados"),
    )


def global_dump(spark: SparkSession, path: str) -> DataFrame:
    """The union of all dumps in a folder, newest first; times that can't be read come last."""
    return spark.read.schema(RECORD_SCHEMA).option("multiLine", True).option("pathGlobFilter", "*.json").json(path).orderBy(F.try_to_timestamp("data_publicacao").desc_nulls_last(), "id_hash")


def latest_records(records: DataFrame, key: str = "id_hash", stamp: str = "data_publicacao") -> DataFrame:
    """Keep-latest by key."""
    return first_per_key(records.where(F.col(key).isNotNull()), [key], [F.try_to_timestamp(stamp).desc_nulls_last()])


def update_bank(bank: DataFrame, new: DataFrame) -> DataFrame:
    return merge_bank(bank, new, "id_hash", "data_publicacao")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Text files of newspaper editions, a page between form feeds, as one record a page that isn't blank or a financial statement; the title is the first line."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    pages = files.select("path", F.posexplode(F.split(F.decode("content", "UTF-8"), "\f")).alias("page", "text")).withColumn("page", F.col("page") + 1)
    total = F.max("page").over(Window.partitionBy("path"))
    rows = pages.withColumn("pages", total).where(F.col("text").rlike(r"\S") & ~T.is_financial_page(F.col("text")))
    return rows.select("path", "page", "pages", F.trim(F.split(T.strip(F.col("text")), "\n")[0]).alias("title"), "text")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Content hash (16 hex digits), name and size of files, one row a distinct content."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", F.substring(F.sha2("content", 256), 1, 16).alias("file_hash"))
    return first_per_key(files, ["file_hash"], [F.col("path")])


def links(pages: DataFrame) -> DataFrame:
    """(page_id, place, href, title) of the anchors of HTML pages: listings as records."""
    anchors = F.regexp_extract_all("html", F.lit(r'(?is)<a\s[^>]*href="([^"]*)"[^>]*>.*?</a>'), F.lit(1))
    titles = F.regexp_extract_all("html", F.lit(r'(?is)<a\s[^>]*href="[^"]*"[^>]*>(.*?)</a>'), F.lit(1))
    rows = pages.select("page_id", F.posexplode(F.arrays_zip(anchors.alias("href"), titles.alias("title"))).alias("place", "a"))
    return rows.select("page_id", "place", F.col("a.href").alias("href"), T.strip_html(F.col("a.title")).alias("title"))


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int) -> DataFrame:
    """A database table in ranges of its key, read by as many tasks."""
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high, numPartitions=parts)
