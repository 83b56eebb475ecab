"""Suffix-array dedup with a logarithmic index family.

A byte is removed if a string of ``length`` bytes that covers it starts anywhere else in the corpus. Suffixes are
sampled at anchors: of any ``length - K + 1`` consecutive K-byte strings the one with the least hash is an anchor,
so equal strings of ``length`` bytes have an equal anchor at the same place. An anchor answers for the run of
consecutive strings whose least it is; it enters the index as (hash of its K bytes, hash of its whole run's bytes).

Index: a batch's array is sparse: its anchors' suffixes with the count of each, sorted by the hash of their first K
bytes and then of their run, not by their bytes. Suffixes that begin alike are neighbours in that order as they are
in the order of bytes, and that is all that the scan for matches uses; full arrays, eight bytes a suffix and a suffix
a byte, would take more than twice the disk that this operator may use. A new batch's array is merge-scanned (a
sort-merge join) against every level for anchors that match, and then becomes a level; while two levels are of one
size they are merged into one of twice that size, so an entry is rewritten log2(batches) times. The family lives in a
folder with a manifest: ``LevelFamily.open`` goes on with it in a later call, so batches may come at any time. What
comes out are the anchors that occur more than once, or with different runs.

Runs that occur twice are repeated throughout. Where one anchor has different runs, the runs' bytes are compared:
they come together in the order of the anchor's hash, and each string of ``length`` bytes in them that occurs twice
among the anchor's runs is repeated. Anchors with more than ``GROUP`` different runs are compared by shuffling one
hash a string instead, combined before the shuffle, so no group is held by one task.

Texts may have any length: a text is held whole by the task that reads it, and compared by its runs. Null and empty texts have no bytes and nothing is removed. Strings never cross documents, rows count as documents
even where they are equal in all columns. Rows equal in id and text get equal results. Extra columns are ignored;
an empty table gives an empty result. Strings are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyline.llm.common import bit_filter, drop, materialise, release, shared_dir, sliced, written
from storyline.llm.shingles import mix, ranges_hash

K = 100
GROUP = 20_000
BATCHES = 4


def _window_hashes(data: np.ndarray, k: int) -> np.ndarray:
    n = len(data) - k + 1
    starts = np.arange(n)
    return ranges_hash(data, starts, starts + k)


def _least_places(values: np.ndarray, w: int) -> np.ndarray:
    """Place of the least (by its upper half) of every w consecutive values, the first where several are least."""
    n = len(values)
    keys = (values & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // w)
    padded = np.full(blocks * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = keys
    grid = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[: n - w + 1], ahead[w - 1 : n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def runs(raw: bytes, length: int, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a document's anchors: hash, hash of the run, start of its first string, start of its last."""
    data = np.frombuffer(raw, np.uint8)
    if len(data) < length:
        empty = np.zeros(0, np.uint64)
        return empty, empty, np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = _window_hashes(data, k)
    place = _least_places(hashes, length - k + 1)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(place) - 1]])
    at = place[first]
    # The place of the anchor in its run is part of the run's hash.
    whole = mix(ranges_hash(data, first, last + length) + (at - first).astype(np.uint64))
    return hashes[at], whole, first, last


def _anchors(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 300):
            out = [runs((t.as_py() or "").encode(), length, k)[:2] for t in b.column("text")]
            a, r = (np.concatenate([x[i] for x in out]).view(np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(r)], names=["anchor", "run"])

    return run


def _places(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 200):
            parts: dict[str, list] = {n: [] for n in ("anchor", "run", "rk", "first", "last")}
            strings: list[bytes] = []
            for text, rk in zip(b.column("text"), b.column("rk").to_pylist(), strict=True):
                raw = (text.as_py() or "").encode()
                a, r, first, last = runs(raw, length, k)
                for n, x in zip(parts, (a.view(np.int64), r.view(np.int64), np.full(len(a), rk, np.int64), first, last), strict=True):
                    parts[n].append(x)
                strings += [raw[p : q + length] for p, q in zip(first.tolist(), last.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(x)) for x in parts.values()), pa.array(strings, pa.binary())], names=[*parts, "bytes"])

    return run


class LevelFamily:
    """Sparse suffix arrays of batches as levels that double in size; ``matched`` gathers anchors found again."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path or shared_dir(spark, "suffix-family")
        self.levels: list[tuple[int, DataFrame, str]] = []
        self.matched: list[tuple[DataFrame, str]] = []

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> LevelFamily:
        """The family that was kept in a folder."""
        family = cls(spark, path)
        for kind, size, at in sorted(map(tuple, spark.read.parquet(f"{path}/manifest").collect()), key=lambda r: -r[1]):
            if kind == "level":
                family.levels.append((size, spark.read.schema("anchor long, run long, n long").parquet(at), at))
            else:
                family.matched.append((spark.read.schema("anchor long").parquet(at), at))
        return family

    def _keep(self) -> None:
        """The manifest: a row a level and a row a batch."""
        rows = [("level", size, at) for size, _, at in self.levels] + [("matched", 0, at) for _, at in self.matched]
        self.spark.createDataFrame(rows, "kind string, size long, path string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest")

    @staticmethod
    def _array(entries: DataFrame, count: Column) -> tuple[DataFrame, str]:
        return written(entries.groupBy("anchor", "run").agg(count.cast("long").alias("n")).sortWithinPartitions("anchor", "run"), "suffix-level")

    def add(self, batch: DataFrame) -> None:
        """``batch``: anchor and run, a row an occurrence. A level that was merged into a larger one is deleted."""
        spark, merged = self.spark, []
        new, path = self._array(batch, F.count("*"))
        found = new.groupBy("anchor").agg(F.count("*").alias("runs"), F.max("n").alias("most")).where("runs > 1 or most > 1").select("anchor")
        for _, level, _ in self.levels:
            found = found.unionByName(level.select("anchor").join(new.select("anchor"), "anchor", "left_semi"))
        self.matched.append(written(found.distinct(), "suffix-matched"))
        size = 1
        while self.levels and self.levels[-1][0] == size:
            _, level, old = self.levels.pop()
            last, last_path = new, path
            new, path = self._array(last.unionByName(level), F.sum("n"))
            merged.append(old)
            drop(spark, last_path)
            size *= 2
        self.levels.append((size, new, path))
        self._keep()
        for old in merged:
            drop(spark, old)
        release(spark)

    def repeated(self) -> DataFrame:
        """(anchor, run, n, runs) of anchors that occur more than once."""
        anchors = materialise(self._union([m for m, _ in self.matched]).distinct(), "suffix-matched")
        entries = self._union([level for _, level, _ in self.levels])
        known = bit_filter(entries, "anchor", anchors, "anchor").join(anchors, "anchor", "left_semi").groupBy("anchor", "run").agg(F.sum("n").alias("n"))
        known = materialise(known, "suffix-known")
        return known.join(known.groupBy("anchor").agg(F.count("*").alias("runs")), "anchor")

    @staticmethod
    def _union(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out


def _ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge[::2], edge[1::2] - 1


def _compare(length: int):
    """Rows come sorted by anchor, one a run. Gives for runs that occur once the ranges of strings that other runs of the anchor hold."""

    def solve(rows: list[tuple[int, int, int, bytes]]) -> list[tuple[int, int, int, int]]:
        counts = [len(r[3]) - length + 1 for r in rows]
        data = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
        offsets = np.cumsum([0, *(len(r[3]) for r in rows)])
        starts = np.concatenate([np.arange(o, o + c) for o, c in zip(offsets, counts, strict=False)])
        anchor = np.repeat(np.array([r[0] for r in rows], np.int64), counts).view(np.uint64)
        h = mix(ranges_hash(data, starts, starts + length) ^ mix(anchor))
        weight = np.repeat(np.array([r[2] for r in rows]), counts)
        _, inverse = np.unique(h, return_inverse=True)
        again = np.bincount(inverse, weights=weight)[inverse] > 1
        out, at = [], 0
        for (a, r, n, _), c in zip(rows, counts, strict=True):
            if n == 1:
                out += [(a, r, p, q) for p, q in zip(*(x.tolist() for x in _ranges(again[at : at + c])), strict=True)]
            at += c
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(rows):
            found = solve(rows) if rows else []
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(4)], names=["anchor", "run", "p", "q"])

        held: list[tuple[int, int, int, bytes]] = []
        size = 0
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("anchor", "run", "n", "bytes")), strict=True):
                if size > 2_000_000 and row[0] != held[-1][0]:
                    yield emit(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        yield emit(held)

    return run


def _strings(length: int):
    """One row for each string of a run: its hash with the anchor, the run, its start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 500):
            for a, r, n, raw in zip(*(b.column(c).to_pylist() for c in ("anchor", "run", "n", "bytes")), strict=True):
                h = _window_hashes(np.frombuffer(raw, np.uint8), length)
                h = mix(h ^ mix(np.full(1, a, np.int64).view(np.uint64))).view(np.int64)
                k = len(h)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(k, a, np.int64)), pa.array(np.full(k, r, np.int64)), pa.array(np.full(k, n, np.int64)), pa.array(np.arange(k))], names=["h", "anchor", "run", "n", "p"])

    return run


def _finish(length: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 500):
            rows, texts = [], []
            for text, ps, qs in zip(b.column("text"), b.column("ps").to_pylist(), b.column("qs").to_pylist(), strict=True):
                raw = (text.as_py() or "").encode()
                gone: list[list[int]] = []
                for p, q in sorted(zip(ps or (), qs or (), strict=True)):
                    if gone and p <= gone[-1][1]:
                        gone[-1][1] = max(gone[-1][1], q + length)
                    else:
                        gone.append([p, q + length])
                keep, at = [], 0
                for p, q in gone:
                    keep.append(raw[at:p])
                    at = q
                kept = b"".join([*keep, raw[at:]])
                rows.append((len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()))
                texts.append(kept.decode("utf-8", "ignore") if with_text else None)
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column("id"), *columns, *([pa.array(texts, pa.string())] if with_text else [])], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])])

    return run


def suffixes(texts: DataFrame, length: int = 200) -> DataFrame:
    """(anchor, run) of every anchored suffix of a batch of texts (a frame of one column), for ``LevelFamily.add``."""
    return texts.toDF("text").mapInArrow(_anchors(length, min(K, length)), "anchor long, run long")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, batches: int = BATCHES, group: int = GROUP, with_text: bool = False) -> DataFrame:
    """One row a document: n_bytes, n_removed, n_spans, kept_sha256; ``with_text`` adds the bytes kept as text (what they leave of cut characters is dropped)."""
    kind = dict(docs.dtypes)[id_col]
    k = min(K, length)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("rk"))
    if 2 * length >= 1024:
        raise ValueError("strings of 512 bytes or more need another hash, see ranges_hash")
    family = LevelFamily(docs.sparkSession)
    for i in range(batches):
        part = docs.where(F.pmod("rk", F.lit(batches)) == i).select("text") if batches > 1 else docs.select("text")
        family.add(suffixes(part, length))
    known = materialise(family.repeated().where("n > 1 or runs > 1"), "suffix-repeated")
    del family
    release(docs.sparkSession)
    # The places of repeated anchors, with the run's bytes where different runs are to be compared.
    open_ = known.where("runs > 1")
    found = bit_filter(docs.mapInArrow(_places(length, k), "anchor long, run long, rk long, first long, last long, bytes binary"), "anchor", known, "anchor", bits=25)
    flagged = found.select("anchor", "run", "rk", "first", "last", "bytes").join(known, ["anchor", "run"])
    places = materialise(flagged.select("anchor", "run", "n", "runs", "rk", "first", "last", F.when(F.col("runs") > 1, F.col("bytes")).alias("bytes")), "suffix-places")
    distinct = places.where("runs > 1").groupBy("anchor", "run").agg(F.first("n").alias("n"), F.first("runs").alias("runs"), F.first("bytes").alias("bytes"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small = distinct.where(F.col("runs") <= group).select("anchor", "run", "n", "bytes").repartition(parts, "anchor").sortWithinPartitions("anchor", "run")
    ranges = small.mapInArrow(_compare(length), "anchor long, run long, p long, q long")
    strings = distinct.where(F.col("runs") > group).select("anchor", "run", "n", "bytes").mapInArrow(_strings(length), "h long, anchor long, run long, n long, p long")
    again = strings.groupBy("h").agg(F.sum("n").alias("times")).where("times > 1").select("h")
    ranges = materialise(ranges.union(strings.where("n = 1").join(again, "h", "left_semi").select("anchor", "run", "p", F.col("p").alias("q"))), "suffix-ranges")
    single = places.where("n = 1").join(ranges, ["anchor", "run"]).select("rk", (F.col("first") + F.col("p")).alias("p"), (F.col("first") + F.col("q")).alias("q"))
    whole = places.where("n > 1").select("rk", F.col("first").alias("p"), F.col("last").alias("q"))
    gone = whole.union(single).distinct().groupBy("rk").agg(F.collect_list("p").alias("ps"), F.collect_list("q").alias("qs"))
    out = docs.join(gone, "rk", "left").select("id", "text", "ps", "qs").mapInArrow(_finish(length, with_text), f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text)
    return out.withColumnRenamed("id", id_col)
