"""Incremental pipelines on Structured Streaming. Event times are TIMESTAMP: NTZ columns are cast before a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyline.functions import text as T
from storyline.shared import shared_path


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files: int = 100, **options) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files).options(**options).load(path)


def event_time(rows: DataFrame, column: str = "ts") -> DataFrame:
    return rows.withColumn(column, F.col(column).cast("timestamp"))


def day_counts(rows: DataFrame, late: str = "1 day") -> DataFrame:
    """Tumbling daily counts by kind; state of days behind the watermark is dropped."""
    return event_time(rows).withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "event_type", "n")


def sliding_counts(rows: DataFrame, length: str = "2 hours", step: str = "1 hour", late: str = "1 hour") -> DataFrame:
    return event_time(rows).withWatermark("ts", late).groupBy(F.window("ts", length, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def distinct_within(rows: DataFrame, keys: list[str], horizon: str = "48 hours") -> DataFrame:
    """First row of each key within a horizon of event time."""
    return event_time(rows).withWatermark("ts", horizon).dropDuplicatesWithinWatermark(keys)


def distinct_ever(rows: DataFrame, keys: list[str]) -> DataFrame:
    """First row of each key, however late: no key expires, so the keys are the same in any number of batches; the state holds every key."""
    return rows.dropDuplicates(keys)


def sessions(rows: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    w = F.session_window("ts", gap)
    out = event_time(rows).withWatermark("ts", late).groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is (availableNow) into a Parquet table that it returns; for aggregates ``mode`` is complete or append."""
    spark = stream.sparkSession
    path = shared_path(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        # A batch's own folder: a batch that runs again overwrites itself.
        target = f"{path}/table" if mode == "complete" else f"{path}/table/batch={number}"
        batch.write.mode("overwrite").parquet(target)

    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/table") if mode == "complete" else spark.read.schema(stream.schema).parquet(f"{path}/table").select(*stream.columns)


def apply_batches(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """foreachBatch with a trigger: every so long, or over what there is."""
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def ingest(stream: DataFrame, text_col: str = "texto_bruto", url_col: str = "url_original", horizon: str = "48 hours") -> DataFrame:
    """Articles of a stream once each by content hash."""
    return distinct_within(stream.withColumn("hash_unico", T.content_hash(F.col(text_col), F.col(url_col))), ["hash_unico"], horizon)


def outbox(spark: SparkSession, state_path: str, pending: DataFrame, send: Callable[[DataFrame], None], key: str = "cluster_id") -> int:
    """Sends what the state table hasn't got and then records it: a crash between the two repeats a send, never loses one."""
    try:
        sent = spark.read.parquet(state_path)
        todo = pending.join(sent, key, "left_anti")
    except Exception as e:  # no state yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        todo = pending
    todo = todo.persist()
    n = todo.count()
    if n:
        send(todo)
        todo.select(key).write.mode("append").parquet(state_path)
    todo.unpersist()
    return n


def changed_count(rows: DataFrame, since: Column, stamp: str = "ts") -> DataFrame:
    return rows.where(F.col(stamp) > since).agg(F.count("*").alias("n_changed"))
