"""Hard-negative mining by a Voronoi-partitioned kNN join.

A row is a vector of whole numbers, floor(``unit`` * x) of each component, and scores with an anchor by their inner
product; higher scores come first, ties by the smaller id. An anchor's positives are its first rows of the same label,
and for each positive the negatives are the first rows of other labels with ``low`` * s <= score <= ``high`` * s, s being
the positive's score.

Nearest neighbours stand for highest products: with M the length of the longest vector, a row is augmented by
sqrt(M^2 - |v|^2) and an anchor by 0, so that their squared distance is |a|^2 + M^2 - 2 * score. Pivots are rows of a
sample of ``SAMPLE`` rows (by a hash of the id); every anchor belongs to the cell of its nearest pivot. Whatever an
anchor wants is a range of scores: a top k may begin at the k-th best score that the sample already reaches, which a row
of the answer can't fall short of. By the triangle inequality a row serves a cell only if its distance to the cell's
pivot lies within the cell's radius of the range of distances that the cell's anchors want; only to these cells is it
copied. In each cell, anchors meet rows in exact integer products, and the best of all parts are merged.

Cells are parted by the label's remainder where labels must be equal, so there are ``PIVOTS * LABELS`` of them at most,
and their bounds are sent to tasks whatever the input. A cell's anchors are dealt into parts of some ``ANCHORS``, rows
into chunks of some ``ROWS``, by their place in the table and not by key, so neither a frequent vector or label nor a
repeated id makes a task larger. No number of partners or candidates is capped; where bounds prune nothing, each row
meets each anchor, in blocks.

Rows with a null label, a null vector, or a component that is null, not finite or of 2**17 or more, take no part. Rows
of a null id are no anchors and rank last in ties. Shorter vectors are filled up by 0. Rows of an anchor's id are not
its partners; rows that repeat count as often as they stand, and equal anchors are asked once. An anchor without a
positive, or a positive without negatives, has no rows. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyline.llm.common import drop, materialise, sliced, written

UNIT = 256
LARGEST = 1 << 17
SAMPLE, PIVOTS, LABELS = 1024, 32, 32
ANCHORS, ROWS = 512, 8192
#: Scores below and above any that vectors of whole numbers under 2**25 in up to 8,000 components have.
_LEAST, _MOST = -(1 << 62), 1 << 62
_ANCHOR = "aid long, anchor_id long, label long, v array<int>, asked array<long>, lo array<long>, hi array<long>"


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """(id, label, v): the rows that take part, their components as whole numbers."""
    x = F.col("x")
    fit = F.forall("x", lambda c: c.isNotNull() & F.coalesce(F.abs(c) < LARGEST, F.lit(False)))
    plain = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.transform(vector_col, lambda c: c.cast("double")).alias("x"))
    return plain.where(x.isNotNull() & F.col("label").isNotNull() & fit).select("id", "label", F.transform("x", lambda c: F.floor(c * UNIT).cast("int")).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of vectors, filled up by 0, as doubles."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width).astype(np.float64)
    out = np.zeros((len(lengths), width))
    out[np.repeat(np.arange(len(lengths)), lengths), np.concatenate([np.arange(n) for n in lengths] or [np.zeros(0, int)]).astype(int)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers: in floating point as long as that holds them, in 64-bit integers beyond."""
    bound = np.sqrt((a * a).sum(axis=1).max(initial=0) * (b * b).sum(axis=1).max(initial=0))
    if bound < 2**23:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if bound < 2**52:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class Space:
    """The sample, the pivots among it, and the length of the longest vector; all of bounded size."""

    def __init__(self, ids: list[int | None], labels: np.ndarray, vectors: np.ndarray, longest: float):
        self.ids, self.labels, self.vectors, self.square = ids, labels, vectors, longest
        own = np.unique(vectors, axis=0)[:: max(1, len(vectors) // PIVOTS)][:PIVOTS]
        self.pivots = np.hstack([own, np.sqrt(np.maximum(longest - (own * own).sum(axis=1, keepdims=True), 0))])

    def to_pivots(self, v: np.ndarray, augmented: bool) -> np.ndarray:
        """Distances of rows (augmented) or anchors (not) to the pivots."""
        norm = (v * v).sum(axis=1)
        last = np.sqrt(np.maximum(self.square - norm, 0)) if augmented else np.zeros(len(v))
        p = self.pivots
        squares = norm[:, None] + (last * last)[:, None] + (p * p).sum(axis=1) - 2 * (v @ p[:, :-1].T + last[:, None] * p[:, -1])
        return np.sqrt(np.maximum(squares, 0))

    def reach(self, v: np.ndarray, score: float) -> float:
        """The distance at which a row has this score with an anchor."""
        return float(np.sqrt(max(v @ v + self.square - 2.0 * score, 0)))


def _space(rows: DataFrame, width: int, longest: int) -> Space:
    drawn = rows.select("id", "label", "v").orderBy(F.xxhash64("id"), "id", "label", "v").limit(SAMPLE).collect()
    vectors = _matrix(pa.array([r["v"] for r in drawn], pa.list_(pa.int32())), width)
    return Space([r["id"] for r in drawn], np.array([r["label"] for r in drawn], np.int64), vectors, float(longest))


def _tighten(space: Space, width: int, same: bool, k: int):
    """Anchors with their cell, their distance to its pivot, and the range of distances at which rows may serve them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 512):
            v = _matrix(b.column("v"), width)
            label, anchor = b.column("label").to_numpy(), b.column("anchor_id").to_pylist()
            scores = products(v, space.vectors)
            to_pivot = space.to_pivots(v, False)
            cell = to_pivot.argmin(axis=1)
            los, near, far = [], np.zeros(len(v)), np.zeros(len(v))
            for i, (lo, hi) in enumerate(zip(b.column("lo").to_pylist(), b.column("hi").to_pylist(), strict=True)):
                other = np.array([x != anchor[i] for x in space.ids], bool)
                may = other & ((space.labels == label[i]) == same)
                found = []
                for least, most in zip(lo, hi, strict=True):
                    held = scores[i][may & (scores[i] >= least) & (scores[i] <= most)]
                    found.append(max(least, int(np.partition(held, len(held) - k)[len(held) - k])) if len(held) >= k else least)
                los.append(found)
                most, least = max(hi), min(found)
                near[i], far[i] = (space.reach(v[i], x) for x in (np.inf if most == _MOST else most, -np.inf if least == _LEAST else least))
            columns = {n: b.column(n) for n in b.schema.names} | {
                "lo": pa.array(los, pa.list_(pa.int64())), "cell": pa.array(cell, pa.int32()), "radius": pa.array(to_pivot[np.arange(len(v)), cell]), "near": pa.array(near), "far": pa.array(far),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _serve(space: Space, width: int, bounds: np.ndarray, same: bool):
    """Rows with the cells that they may serve; ``bounds``: radius, near and far of each cell and remainder of the label, a radius below 0 where there are no anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 4096):
            d = space.to_pivots(_matrix(b.column("v"), width), True)
            slot = b.column("label").to_numpy() % LABELS if same else np.zeros(b.num_rows, np.int64)
            radius, near, far = (bounds[:, slot, k].T for k in range(3))
            # Distances are rounded; the slack keeps every row that exact ones would keep.
            slack = 1e-6 * (1 + np.sqrt(space.square)) + 1e-7 * d
            serves = (radius >= 0) & (d - radius <= far + slack) & (d + radius >= near - slack)
            cells = [np.flatnonzero(r).astype(np.int32) for r in serves]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.list_(pa.int32())), pa.array(slot.astype(np.int32))], names=[*b.schema.names, "cells", "slot"])

    return run


def _meet(width: int, same: bool, k: int):
    """The first k rows of each range that a part's anchors ask for, among a chunk of rows."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: dict[str, list] = {"aid": [], "asked": [], "score": [], "id": []}
        if anchors.num_rows and rows.num_rows:
            ids = np.array([_MOST if x is None else x for x in rows.column("id").to_pylist()], np.int64)
            order = np.argsort(ids, kind="stable")
            ids, label = ids[order], rows.column("label").to_numpy()[order]
            v = _matrix(rows.column("v").combine_chunks(), width)[order]
            for piece in anchors.to_batches(max_chunksize=64):
                scores = products(_matrix(piece.column("v"), width), v)
                for i, (aid, anchor, mine, asked, lo, hi) in enumerate(zip(*(piece.column(c).to_pylist() for c in ("aid", "anchor_id", "label", "asked", "lo", "hi")), strict=True)):
                    may = np.flatnonzero((scores[i] >= min(lo)) & (scores[i] <= max(hi)))
                    may = may[((label[may] == mine) == same) & (ids[may] != anchor)]
                    own = scores[i][may]
                    for q, least, most in zip(asked, lo, hi, strict=True):
                        at = np.flatnonzero((own >= least) & (own <= most))
                        if len(at) > k:
                            at = at[own[at] >= np.partition(own[at], len(at) - k)[len(at) - k]]
                        # rows stand by id, so a stable sort leaves ties in its order
                        at = at[np.argsort(-own[at], kind="stable")[:k]]
                        out["aid"] += [aid] * len(at)
                        out["asked"] += [q] * len(at)
                        out["score"] += own[at].tolist()
                        out["id"] += [None if x == _MOST else x for x in ids[may[at]].tolist()]
        return pa.table({n: pa.array(x, pa.int64()) for n, x in out.items()})

    return run


def knn_join(anchors: DataFrame, rows: DataFrame, space: Space, width: int, chunks: int, same: bool, k: int) -> DataFrame:
    """``anchors``: (aid, anchor_id, label, v, asked, lo, hi), a row an anchor, with ranges of scores under the names ``asked``;
    ``rows``: (id, label, v, spread). (aid, asked, score, id, rank): of each range the first k rows of the same label or of others."""
    spark = rows.sparkSession
    kinds = f"{_ANCHOR}, cell int, radius double, near double, far double"
    wanted = anchors.mapInArrow(_tighten(space, width, same, k), kinds).withColumn("slot", F.pmod("label", F.lit(LABELS)).cast("int") if same else F.lit(0))
    wanted = materialise(wanted, "negatives-anchors")
    bounds, parts = np.full((len(space.pivots), LABELS if same else 1, 3), -1.0), []
    # A row a cell and slot: at most PIVOTS * LABELS.
    for r in wanted.groupBy("cell", "slot").agg(F.max("radius").alias("radius"), F.min("near").alias("near"), F.max("far").alias("far"), F.count("*").alias("n")).collect():
        bounds[r["cell"], r["slot"]] = r["radius"], r["near"], r["far"]
        parts.append((r["cell"], r["slot"], -(-r["n"] // ANCHORS)))
    sizes = F.broadcast(spark.createDataFrame(parts, "cell int, slot int, parts int"))
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = wanted.join(sizes, ["cell", "slot"]).select(*(c.split()[0] for c in _ANCHOR.split(", ")), "cell", "slot", F.pmod(F.xxhash64("aid"), F.col("parts")).cast("int").alias("part"), each(F.lit(chunks)).alias("chunk"))
    dealt = rows.select("id", "label", "v", F.pmod("spread", F.lit(chunks)).cast("int").alias("chunk"))
    served = dealt.mapInArrow(_serve(space, width, bounds, same), "id long, label long, v array<int>, chunk int, cells array<int>, slot int")
    right = served.select("id", "label", "v", "chunk", F.explode("cells").alias("cell"), "slot").join(sizes, ["cell", "slot"]).select("cell", "slot", each(F.col("parts")).alias("part"), "chunk", "id", "label", "v")
    key = ("cell", "slot", "part", "chunk")
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_meet(width, same, k), "aid long, asked long, score long, id long")
    best = Window.partitionBy("aid", "asked").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label", is_anchor: Column | None = None, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); ``low`` and ``high`` are hundredths of the
    positive's score, ``is_anchor`` says of an ``id`` whether it is an anchor (default: it divides by 100)."""
    spark: SparkSession = rows.sparkSession
    taking = whole_vectors(rows, id_col, vector_col, F.col(label) if isinstance(label, str) else label)
    # Rows are dealt to chunks by their place; written, so that a task that runs again sees the same.
    taking, path = written(taking.withColumn("spread", F.xxhash64(F.monotonically_increasing_id())), "negatives-rows")
    square = F.aggregate("v", F.lit(0).cast("double"), lambda s, x: s + x.cast("double") * x)
    n, width, longest = taking.agg(F.count("*"), F.max(F.size("v")), F.max(square)).first()
    kind = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n:
        return spark.createDataFrame([], kind)
    width, chunks = max(width, 1), -(-n // ROWS)
    space = _space(taking, width, longest)
    asking = F.col("id") % 100 == 0 if is_anchor is None else is_anchor
    base = taking.where(asking & F.col("id").isNotNull()).select(F.xxhash64("id", "label", "v").alias("aid"), F.col("id").alias("anchor_id"), "label", "v").distinct()
    array = lambda *x: F.array(*(F.lit(y).cast("long") for y in x))
    first = base.select("*", array(0).alias("asked"), array(_LEAST).alias("lo"), array(_MOST).alias("hi"))
    near = knn_join(first, taking, space, width, chunks, True, positives)
    near = materialise(near.select("aid", F.col("rank").cast("long").alias("asked"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
    # In whole numbers: low * s <= 100 * score <= high * s; where s < 0 no score fits.
    s = F.col("positive_score")
    hundredths = lambda by, more: F.call_function("div", s.cast("decimal(20,0)") * F.lit(by).cast("decimal(3,0)") + more, F.lit(100).cast("decimal(3,0)"))
    ranges = near.where(s >= 0).groupBy("aid").agg(F.sort_array(F.collect_list(F.struct("asked", hundredths(low, 99).alias("lo"), hundredths(high, 0).alias("hi")))).alias("r"))
    second = base.join(ranges, "aid").select("aid", "anchor_id", "label", "v", *(F.col(f"r.{c}").alias(c) for c in ("asked", "lo", "hi")))
    far = knn_join(second, taking, space, width, chunks, False, negatives)
    out = far.join(near, ["aid", "asked"]).join(base.select("aid", "anchor_id"), "aid")
    out = materialise(out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
    drop(spark, path)
    return out
