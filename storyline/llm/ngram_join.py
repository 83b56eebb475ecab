"""N-gram Jaccard join by universe partition and pigeonhole, exact.

Documents are sets of word shingles; two link when their Jaccard similarity is at least ``percent`` / 100. Sets
are dealt into bands by size. For a band, tokens are hashed into m segments: a larger set X and a similar set Y
differ in at most H = 2 |X| (100 - percent) / (100 + percent) tokens, so of any H + 1 segments of X one is the same
in Y. Each set is indexed by its segments that are not empty, in its own band and, if it is large enough for it,
in the next. What a band needs besides is read off its sets: if some set fills fewer than H + 1 segments, the band
also indexes one-deletion neighbourhoods, by which a segment of two or more tokens counts twice; should that not
do for some set either, the band also indexes the prefixes of its sets (the least tokens, one of which similar
sets must share).

A set allocates its H + 1 probes by cost: first the segments that nobody else has, which cost nothing, then those
in the smallest buckets. A set whose free segments are H + 1 already is left out. Candidates are verified on whole
texts, the sets of a bucket against its most central one first (see ``linking``), so that a group of near copies
costs a few comparisons a set and no link between different sets is lost that would join components. Pairs whose
parity sketches differ in more bits than similar sets can differ in tokens are not compared: an exact bound.

Equal sets are one node. A text with no words has an empty set and is alone; with fewer words than a shingle, the
whole sequence is its one shingle. A null id takes no part in the choice of component ids; a component of null ids
only has a null id. Rows with equal ids stay apart as rows. Extra columns are ignored; an empty table gives an
empty result. Tokens and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyline.llm.common import bit_filter, materialise, release, sliced
from storyline.llm.components import components
from storyline.llm.linking import bucket_links
from storyline.llm.shingles import mix, shingle_set

EXACT, DELETIONS, PREFIXES = 1, 2, 3


def _lows() -> list[int]:
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * 1.5)))
    return out


LOWS = _lows()


def band_of(n: int) -> int:
    return int(np.searchsorted(LOWS, n, "right")) - 1


class Partition:
    """The segments of one band."""

    def __init__(self, band: int, percent: int):
        self.band, self.percent = band, percent
        r = LOWS[band + 1] - 1
        ratio = 2 * (100 - percent) / (100 + percent)
        self.m = math.ceil(1.06 * ratio * r + 3 + 0.25 * math.sqrt(r))
        self.salt = np.uint64(band * 0xD1B54A32D192ED03 + 0x2545F4914F6CDD1D & (1 << 64) - 1)

    def most_different(self, n: int) -> int:
        """H: how many tokens a set of n and a similar one no larger differ in at most."""
        return 2 * n * (100 - self.percent) // (100 + self.percent)

    def dealt(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per token its hash and its segment."""
        h = mix(tokens ^ self.salt)
        return h, ((h >> np.uint64(32)) * np.uint64(self.m)) >> np.uint64(32)

    def segments(self, tokens: np.ndarray) -> tuple[np.ndarray, ...]:
        """Per token, sorted by segment: its value; per segment that is not empty: number, first place, size, sum of values."""
        h, seg = self.dealt(tokens)
        order = np.argsort(seg, kind="stable")
        seg, values = seg[order], mix(h[order] + np.uint64(1))
        first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
        size = np.diff(np.concatenate([first, [len(seg)]]))
        return values, seg[first], first, size, np.add.reduceat(values, first)

    def need(self, tokens: np.ndarray) -> tuple[int, int]:
        """How many segments the set fills, and the level at which its segments are enough."""
        size = np.bincount(self.dealt(tokens)[1].astype(np.int64))
        filled, least = int(np.count_nonzero(size)), self.most_different(len(tokens)) + 1
        if filled >= least:
            return filled, EXACT
        return filled, DELETIONS if filled + int(np.count_nonzero(size > 1)) >= least else PREFIXES

    def signatures(self, tokens: np.ndarray, level: int) -> np.ndarray:
        values, seg, first, size, total = self.segments(tokens)
        tag = mix(seg + self.salt)
        out = [mix(total + tag)]
        if level >= DELETIONS:
            many = size > 1
            of = np.repeat(np.arange(len(size)), size)
            keep = many[of]
            out.append(mix(total[of][keep] - values[keep] + tag[of][keep]))
        if level >= PREFIXES:
            n = len(tokens)
            out.append(mix(tokens[: n - -(-n * self.percent // 100) + 1] + mix(self.salt + np.uint64(7))))
        return np.concatenate(out)


_PARTS: dict[tuple[int, int], Partition] = {}


def _part(band: int, percent: int) -> Partition:
    if (band, percent) not in _PARTS:
        _PARTS[band, percent] = Partition(band, percent)
    return _PARTS[band, percent]


SKETCH_WORDS = 16


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Parity of how many tokens fall on each of 1024 places. Two sets differ in at least as many tokens as their sketches in bits."""
    places = (mix(tokens + np.uint64(99)) >> np.uint64(54)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=64 * SKETCH_WORDS) & 1).astype(np.uint8)).view(np.int64)


def set_id(tokens: np.ndarray) -> int:
    """An even 64-bit id of a set; the lowest bit is free for a flag."""
    total = mix(tokens).sum(keepdims=True) + np.uint64(len(tokens))
    return int(mix(total).view(np.int64)[0]) & ~1


def _measure(percent: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1000):
            rows = []
            for text in b.column("text"):
                s = shingle_set(text.as_py(), k)
                band = band_of(len(s)) if len(s) else -1
                rows.append((len(s), set_id(s), band, *(_part(band, percent).need(s) if len(s) else (0, EXACT)), sketch(s).tolist()))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("rk"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], names=["id", "rk", "n", "sid", "band", "filled", "need", "sketch"])

    return run


def _sign(levels: dict[int, int], percent: int, k: int):
    """Rows (sig, node): node is the set's id, its lowest bit set where the signature is of its own band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 400):
            sigs, nodes = [], []
            for text in b.column("text"):
                s = shingle_set(text.as_py(), k)
                if not len(s):
                    continue
                node, band = set_id(s), band_of(len(s))
                for i in (band, band + 1):
                    if i in levels and 100 * len(s) >= percent * LOWS[i]:
                        got = _part(i, percent).signatures(s, levels[i])
                        sigs.append(got.view(np.int64))
                        nodes.append(np.full(len(got), node | (i == band), np.int64))
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(nodes))], names=["sig", "node"])

    return run


def _compare(percent: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}

        def tokens(node: int, text: pa.Scalar) -> np.ndarray:
            if node not in known:
                if len(known) > 200:
                    known.clear()
                known[node] = shingle_set(text.as_py(), k)
            return known[node]

        for b in batches:
            ok = []
            for i, (x, y) in enumerate(zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True)):
                s, t = tokens(x, b.column("ta")[i]), tokens(y, b.column("tb")[i])
                shared = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(100 * shared >= percent * (len(s) + len(t) - shared))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    return run


def _differing_bits(x: Column, y: Column) -> Column:
    return reduce(lambda a, b: a + b, (F.bit_count(x[i].bitwiseXOR(y[i])) for i in range(SKETCH_WORDS)))


def _links(pairs: DataFrame, measured: DataFrame, docs: DataFrame, percent: int, k: int) -> DataFrame:
    """Of candidate pairs (a, b) of sets those that are similar, by the texts of one document of each."""
    pairs = materialise(pairs, "join-pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    firsts = materialise(bit_filter(measured.select("sid", "rk"), "sid", wanted, "sid").join(wanted, "sid", "left_semi").groupBy("sid").agg(F.min("rk").alias("rk")), "join-firsts")
    texts = materialise(bit_filter(docs.select("rk", "text"), "rk", firsts, "rk").join(firsts, "rk").groupBy("sid").agg(F.first("text").alias("text")), "join-texts")
    both = pairs.join(texts.select(F.col("sid").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("sid").alias("b"), F.col("text").alias("tb")), "b")
    return materialise(both.select("a", "b", "ta", "tb").mapInArrow(_compare(percent, k), "a long, b long, ok boolean").where("ok").select("a", "b"), "join-links")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, k: int = 5) -> DataFrame:
    """One row a document: ``id``, ``rk`` (hash of id and text), ``n_shingles`` and ``class``, equal for documents that links connect, null for empty sets."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("rk"))
    kind = dict(docs.dtypes)["id"]
    measured = materialise(docs.select("id", "rk", "text").mapInArrow(_measure(percent, k), f"id {kind}, rk long, n long, sid long, band int, filled int, need int, sketch array<long>"), "join-sets")
    # One row a band, some sixty at most.
    levels = {r["band"]: r["level"] for r in measured.where("n > 0").groupBy("band").agg(F.max("need").alias("level")).collect()}
    # One text of each set is signed; where the filter fills up, copies are signed too, to no other effect than the time it takes.
    signers = materialise(measured.where("n > 0").groupBy("sid").agg(F.min("rk").alias("rk")), "join-signers")
    signed = bit_filter(docs.select("rk", "text"), "rk", signers, "rk").select("text").mapInArrow(_sign(levels, percent, k), "sig long, node long")
    sid = lambda c: F.col(c).bitwiseAND(F.lit(-2))
    buckets = materialise(
        signed.groupBy("sig").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("rows")).where(sid("low") != sid("high")), "join-buckets"
    )
    release(docs.sparkSession)
    larger = buckets.where("rows > 2").select("sig")
    members = (
        buckets.where("rows = 2").select("sig", F.explode(F.array("low", "high")).alias("node"))
        .unionByName(bit_filter(signed, "sig", larger, "sig").join(larger, "sig").select("sig", "node").distinct())
    )
    members = materialise(members.select("sig", sid("node").alias("sid"), F.col("node").bitwiseAND(F.lit(1)).alias("own")), "join-members")
    sets = measured.groupBy("sid").agg(F.first("n").alias("n"), F.first("band").alias("band"), F.first("filled").alias("filled"), F.first("sketch").alias("sketch"))
    levelled = F.coalesce(*(F.when(F.col("band") == b, F.lit(v)) for b, v in levels.items()), F.lit(EXACT)) if levels else F.lit(EXACT)
    sizes = members.groupBy("sig").agg(F.count("*").alias("cost"))
    known = materialise(bit_filter(sets, "sid", members, "sid").join(members.select("sid").distinct(), "sid", "left_semi").withColumn("level", levelled), "join-known")
    # Allocation of probes: free segments first, then shared ones by the size of their buckets.
    own = members.where("own = 1").join(sizes, "sig").join(known.drop("sketch"), "sid")
    w = Window.partitionBy("sid")
    most = F.floor(2 * F.col("n") * (100 - percent) / (100 + percent))
    probes = materialise(
        own.withColumn("shared", F.count("*").over(w)).withColumn("rank", F.row_number().over(w.orderBy("cost", "sig")))
        .where((F.col("level") > EXACT) | (F.col("rank") <= most + 1 - (F.col("filled") - F.col("shared"))))
        .select("sig", "sid"),
        "join-probes",
    )
    links = bucket_links(
        members.select(F.col("sig").alias("key"), F.col("sid").alias("id")), probes.select(F.col("sig").alias("key"), F.col("sid").alias("id")), known.select(F.col("sid").alias("id"), "n", "sketch"),
        lambda n, m, x, y: (m <= n) & (100 * m >= percent * n) & (_differing_bits(x, y) * (100 + percent) <= (n + m) * (100 - percent)), lambda pairs: _links(pairs, measured, docs, percent, k), "join",
    )
    joined = components(links, tag="join-components").select(F.col("id").alias("sid"), "component")
    return measured.join(joined, "sid", "left").select("id", "rk", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "sid")).alias("class"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, k: int = 5) -> DataFrame:
    """One row a document: id, size of its set, and the least id that links reach."""
    of = materialise(classes(docs, id_col, text_col, percent, k), "join-classes")
    least = of.where("class is not null").groupBy("class").agg(F.min("id").alias("component_id"))
    return of.join(least, "class", "left").select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, k: int = 5) -> DataFrame:
    """The documents, all columns kept, of which links connect none: of each class the least by (id, text hash) stays. Rows equal in id and text stay or go together."""
    of = materialise(classes(docs, id_col, text_col, percent, k), "join-classes")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "rk")
    first = of.where("class is not null").groupBy("class").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    gone = of.join(first, "class").where(F.col("rk") != F.col("first.rk")).select(F.col("rk").alias("__rk")).distinct()
    return docs.withColumn("__rk", F.xxhash64(id_col, text_col)).join(gone, "__rk", "left_anti").drop("__rk")
