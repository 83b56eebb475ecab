"""Shared folders, lineage cuts and table access for the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyline.shared import shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder that driver and executors share, under ``spark.checkpoint.dir``; an error on a cluster without that setting."""
    return shared_path(spark, tag)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: a lineage cut that outlives executors."""
    return written(df, tag)[0]


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Like ``materialise``, with the path, for tables that are dropped again."""
    path = shared_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a written table that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete shuffle files of plans that are no longer referenced."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most so many rows, so that what Python makes of one stays small."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def ascii_lower(col):
    """Lower-cases A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bit_filter(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str, bits: int = 22) -> DataFrame:
    """Rows whose 64-bit key may be among the wanted ones; a join on the key must follow.

    The filter is a bitmap of 2**bits bits in words of 64, at most 2**(bits - 6) broadcast rows whatever the size of
    ``wanted``. It only spares shuffles: where it fills up it lets more rows pass and drops none that are wanted.
    """
    slot = lambda c: F.col(c).bitwiseAND(F.lit((1 << bits) - 1))
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.col(c).bitwiseAND(F.lit(63)).cast("int"))
    words = wanted.select(F.shiftright(slot(wanted_key), 6).alias("__word"), bit(wanted_key).alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    return rows.withColumn("__word", F.shiftright(slot(key), 6)).join(F.broadcast(words), "__word").where(F.col("__bits").bitwiseAND(bit(key)) != 0).drop("__word", "__bits")
