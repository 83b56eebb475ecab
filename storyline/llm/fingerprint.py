"""Document fingerprints: quartile bucket digests.

Byte triplets within five bytes of each other (three patterns) are hashed into 256 buckets and counted. The
digest holds the length's logarithm, the two lower quartiles over the upper one, and for each bucket the quartile
that its count lies in (two bits). Two digests differ by the sum of bucket differences (a jump over all quartiles
counts twice) and of the differences in length and quartile ratios; likeness is 1 less that sum over a bound,
at least 0. Equal texts have equal digests, digests have one length, and any two can be compared.

A null text is empty; texts too short for triplets have a digest of zero counts and their length. For the edited
text, documents are put in descending order of id without sorting them in one task: ids are cut into ranges of
like size, each range is sorted by itself, and the first document of each range is also sent to the range before
it. A null id comes last. Rows with equal ids are ordered by text (null first). With a single row the next
document is the row itself. Extra columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 256
#: A sum of differences of so much or more is a likeness of 0.
BOUND = 256
_PATTERNS = ((0, 1, 2), (0, 1, 3), (0, 2, 4))

_TABLES = np.random.default_rng(2024).integers(0, BUCKETS, (len(_PATTERNS), 3, 256), np.uint8)


def bucket_counts(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    total = np.zeros(BUCKETS, np.int64)
    for tables, (a, b, c) in zip(_TABLES, _PATTERNS, strict=True):
        n = len(data) - c
        if n > 0:
            # Tabulation hashing: one random byte for each place and value.
            total += np.bincount(tables[0][data[a : a + n]] ^ tables[1][data[b : b + n]] ^ tables[2][data[c : c + n]], minlength=BUCKETS)
    return total


def digest(text: str | None) -> str:
    raw = (text or "").encode()
    counts = bucket_counts(raw)
    # Quartiles by rank, so that each holds a quarter of the buckets; equal counts share a code.
    ordered = np.sort(counts)
    q1, q2, q3 = (int(ordered[k * BUCKETS // 4 - 1]) for k in (1, 2, 3))
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    packed = codes[0::4] << 6 | codes[1::4] << 4 | codes[2::4] << 2 | codes[3::4]
    length = min(255, round(8 * np.log2(1 + len(raw))))
    ratio = (16 * q1 // q3 if q3 else 0, 16 * q2 // q3 if q3 else 0)
    return (bytes([length, min(15, ratio[0]) << 4 | min(15, ratio[1])]) + packed.astype(np.uint8).tobytes()).hex()


def _codes(packed: np.ndarray) -> np.ndarray:
    return np.stack([packed >> 6, packed >> 4 & 3, packed >> 2 & 3, packed & 3], -1).reshape(*packed.shape[:-1], -1).astype(np.int16)


def difference(a: str, b: str) -> int:
    x, y = np.frombuffer(bytes.fromhex(a), np.uint8), np.frombuffer(bytes.fromhex(b), np.uint8)
    d = np.abs(_codes(x[2:]) - _codes(y[2:]))
    head = abs(int(x[0]) - int(y[0]))
    ratios = abs((int(x[1]) >> 4) - (int(y[1]) >> 4)) + abs((int(x[1]) & 15) - (int(y[1]) & 15))
    return int(d.sum() + 3 * (d == 3).sum()) + head + ratios


def likeness(a: str, b: str) -> float:
    return max(0.0, 1 - difference(a, b) / BOUND)


def edited(text: str, following: str) -> str:
    """The last floor(n / 2) code points give way to the first as many (or all) of the next document."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by range and place; the last of each range is the copy of the next range's first."""
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    held = None
    for b in batches:
        kind, out = b.schema.field("id").type, []
        columns = (b.column(n).to_pylist() for n in ("range", "id", "halo"))
        for i, (part, key, halo) in enumerate(zip(*columns, strict=True)):
            text = b.column("text")[i].as_py() or ""
            print_ = digest(text)
            if held is not None and held[0] == part:
                _, own_key, own, own_print = held
                new = edited(own, text)
                new_print = digest(new)
                out.append((own_key, len(own), hashlib.sha256(new.encode()).hexdigest(), own_print, new_print, likeness(own_print, new_print), likeness(own_print, print_)))
            # Of several copies with the next range's first id, only the first in order is the next document.
            held = None if halo else (part, key, text, print_)
        if out:
            types = (kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)


def with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: n_chars, SHA-256 of its edited text, both fingerprints, and their likeness to it and to the next document's."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    ids = docs.select(F.col(id_col).alias("id"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Bounds of ranges of like size: one number a range comes to the driver.
    bounds = sorted(set(ids.agg(F.percentile_approx("id", [k / parts for k in range(1, parts)], 10_000)).first()[0] or [])) if parts > 1 else []
    # A row's range counts down with its id; a null id is in the last.
    limits = F.array(*(F.lit(x) for x in bounds)).cast(f"array<{kind}>")
    place = F.when(F.col("id").isNull(), F.lit(len(bounds) + 1)).otherwise(F.size(F.filter(limits, lambda x: x > F.col("id"))))
    firsts = ids.withColumn("range", place).groupBy("range").agg(F.max("id").alias("first")).orderBy("range").collect()
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("range", place)
    if not firsts:
        return text.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_chars"), *(F.lit("").alias(n) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")), F.lit(0.0).alias("near_edited"), F.lit(0.0).alias("near_next"))
    # The first document of each range goes to the range before as well, that of the first to the last.
    sent = spark.createDataFrame([(r["first"], r["range"], firsts[k - 1]["range"]) for k, r in enumerate(firsts)], f"s_id {kind}, s_range int, s_to int")
    copies = text.join(F.broadcast(sent), F.col("id").eqNullSafe(F.col("s_id")) & (F.col("range") == F.col("s_range"))).select("id", "text", F.col("s_to").alias("range"), F.lit(1).alias("halo"))
    rows = text.select("id", "text", "range", F.lit(0).alias("halo")).unionByName(copies)
    ordered = rows.repartition(parts, "range").sortWithinPartitions("range", "halo", F.col("id").desc_nulls_last(), F.col("text").asc_nulls_first())
    out = ordered.mapInArrow(_rows, f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("id", id_col)
