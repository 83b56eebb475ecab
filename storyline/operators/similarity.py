"""Nearest neighbours of a vector, similarity joins over token sets within a block key, centroids."""

from __future__ import annotations

import hashlib
import re
import string
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyline.functions import text as T
from storyline.functions import vectors as V

#: Sets of a block that meet in one task, on either side.
PART = 16384


def knn(vectors: DataFrame, query: DataFrame, most: int = 5, least: float = 0.0, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """Exact nearest neighbours of one query vector (a one-row frame): a scan and a top-k, nothing is shuffled."""
    q = F.broadcast(query.select(F.col(vector_col).alias("__q"), F.col(id_col).alias("__qid")).limit(1))
    scored = vectors.join(q, F.col(id_col) != F.col("__qid")).withColumn("score", F.round(V.cosine(F.col(vector_col), F.col("__q"), -1.0), 4))
    return scored.where(F.col("score") >= least).orderBy(F.desc("score"), id_col).limit(most).select(id_col, "score")


def _bitmaps(hashes: np.ndarray, of: np.ndarray, rows: int, words: int) -> np.ndarray:
    """Rows of so many 64-bit words; each element of a set flips one bit of its row."""
    bits = np.zeros((rows, words * 64), np.uint8)
    np.bitwise_xor.at(bits, (of, (hashes.view(np.uint64) % np.uint64(words * 64)).astype(np.int64)), np.uint8(1))
    return np.packbits(bits, axis=1).view(np.uint64)


def _prefix_pairs(sets: list[np.ndarray], size: np.ndarray, left: np.ndarray, right: np.ndarray, one: bool, least: float, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Pairs that share one of the rarest tokens, of which like sets share one among the first n - least * n + 1; None if there are more than ``most``."""
    used = np.unique(np.concatenate([left, right]))
    of = np.repeat(used, size[used])
    _, token, count = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    key = np.sort(of.astype(np.int64) << 32 | rank[token])
    place = np.arange(len(key)) - np.repeat(np.cumsum(size[used]) - size[used], size[used])
    key = key[place < (size - np.ceil(least * size - 1e-6).astype(np.int64) + 1)[of]]
    of, token = key >> 32, key & 0xFFFFFFFF
    of = of[np.argsort(token, kind="stable")]
    n = np.unique(token, return_counts=True)[1]
    if (n * (n - 1) // 2).sum() > most:
        return None
    begin = np.cumsum(n) - n
    x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for m in np.unique(n[n > 1]):
        i, j = np.triu_indices(m, 1)
        group = of[begin[n == m][:, None] + np.arange(m)]
        x.append(group[:, i].ravel())
        y.append(group[:, j].ravel())
    x, y = np.divmod(np.unique(np.concatenate(x) * len(sets) + np.concatenate(y)), len(sets))
    if not one:
        on_left, on_right = np.zeros(len(sets), bool), np.zeros(len(sets), bool)
        on_left[left], on_right[right] = True, True
        as_is, turned = on_left[x] & on_right[y], on_left[y] & on_right[x]
        x, y = np.concatenate([x[as_is], y[turned]]), np.concatenate([y[as_is], x[turned]])
    return x, y


def _candidates(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, one: bool, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sets that may be alike. Bitmaps that differ in d bits belong to sets that differ in d elements at least; that bounds what they
    share from above, and only pairs within the bound are left. Bitmaps of all pairs meet unless the rarest tokens leave few."""
    size = np.array([len(x) for x in sets])
    right = right[np.argsort(size[right], kind="stable")]
    left = right if one else left[np.argsort(size[left], kind="stable")]
    words = 1
    while words * 32 < np.quantile(size[np.concatenate([left, right])], 0.9) and words < 64:
        words *= 2
    bits = np.zeros((len(sets), words), np.uint64)
    for side in (left,) if one else (left, right):
        for k in range(0, len(side), 1024):
            part = side[k : k + 1024]
            bits[part] = _bitmaps(np.concatenate([sets[i] for i in part]), np.repeat(np.arange(len(part)), size[part]), len(part), words)
    few = _prefix_pairs(sets, size, left, right, one, least, min(len(left) * len(right) // 16, 4_000_000))
    if few is not None:
        for k in range(0, len(few[0]), 4096):
            x, y = few[0][k : k + 4096], few[1][k : k + 4096]
            both = size[x] + size[y]
            near = both - np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64) >= 2 * least / (1 + least) * both - 1e-6
            yield x[near], y[near]
        return
    theirs = np.ascontiguousarray(bits[right].T)
    n = size[right]
    for k in range(0, len(left), 32):
        own = left[k : k + 32]
        mine, m = bits[own], size[own]
        low, high = np.searchsorted(n, [int(np.floor(least * m[0])), int(np.ceil(m[-1] / least)) + 1])
        low = max(low, k) if one else low
        if low >= high:
            continue
        differ = np.zeros((len(own), high - low), np.uint16)
        for w in range(words):
            differ += np.bitwise_count(mine[:, w, None] ^ theirs[w, None, low:high])
        both = m[:, None] + n[None, low:high]
        i, j = np.nonzero(both - differ >= 2 * least / (1 + least) * both - 1e-6)
        if one:
            i, j = i[(later := k + i < low + j)], j[later]
        yield own[i], right[low + j]


def _like(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, one: bool, least: float, forest: bool) -> Iterator[tuple[int, int, float]]:
    """(i, j, Jaccard similarity) of sets of two sides, or of one, that is at least ``least``. ``forest``: of these pairs only such
    as connect what earlier ones have not connected; pairs of connected sets aren't intersected."""
    part = np.arange(len(sets))
    for x, y in _candidates(sets, left, right, one, least):
        if forest:
            apart = part[x] != part[y]
            x, y = x[apart], y[apart]
        for i, j in zip(x, y, strict=True):
            if forest and part[i] == part[j]:
                continue
            shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            score = shared / (len(sets[i]) + len(sets[j]) - shared)
            if shared and score >= least:
                part[part == part[j]] = part[i]
                yield i, j, score


def _set_pairs(keys: list[str], least: float, forest: bool):
    """Pairs of like sets of a group: of one part or of two. Equal sets are compared once. ``forest``: no more pairs than connect what is
    alike; rows of one side with equal sets are connected where their part meets itself."""

    def run(group: pa.Table) -> pa.Table:
        ids, part = group.column("id").combine_chunks(), group.column("is_left").to_numpy()
        w = group.column("w").combine_chunks()
        values, ends = w.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(w.value_lengths().to_numpy(zero_copy_only=False))])
        one = bool(part.all())
        members: dict[bytes, tuple[list[int], list[int]]] = {}
        for i in range(len(part)):
            members.setdefault(np.sort(values[ends[i] : ends[i + 1]]).tobytes(), ([], []))[0 if part[i] else 1].append(i)
        sets, rows = [np.frombuffer(k, np.int64) for k in members], [(np.array(x, int), np.array(y, int)) for x, y in members.values()]
        found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]

        def meet(x: np.ndarray, y: np.ndarray, score: float) -> None:
            x, y = (x[:1], y[:1]) if forest else (x, y)
            found.append((np.repeat(x, len(y)), np.tile(y, len(x)), np.full(len(x) * len(y), score)))

        for x, y in rows:
            if one and len(x) > 1:
                i, j = (np.zeros(len(x) - 1, int), np.arange(1, len(x))) if forest else np.triu_indices(len(x), 1)
                found.append((x[i], x[j], np.ones(len(i))))
            elif len(x) and len(y):
                meet(x, y, 1.0)
        left, right = (np.array([k for k, r in enumerate(rows) if len(r[side])], int) for side in (0, 1))
        right = left if one else right
        if len(left) and len(right):
            for x, y, score in _like(sets, left, right, one, least, forest):
                if x != y:
                    meet(rows[x][0], rows[y][0 if one else 1], score)
        i, j, score = (np.concatenate(x) for x in zip(*found, strict=True))
        at = pa.array(i)
        return pa.table({k: group.column(k).combine_chunks().take(at) for k in keys} | {"a": ids.take(at), "b": ids.take(pa.array(j)), "score": pa.array(score)})

    return run


def _plain(c: str) -> str:
    """A character as ``T.tokens`` sees it: without its mark, in lower case, a space for what is no letter a to z or digit."""
    c = T.UNACCENTED.get(c, c)
    return "" if unicodedata.category(c) == "Mn" else "".join(x if x in _WORD else " " for x in c.lower())


_WORD = frozenset(string.ascii_lowercase + string.digits)
_ASCII = bytes(ord(_plain(chr(i))) if i < 128 else 32 for i in range(256))
_BEYOND = re.compile(r"[^\x00-\x7f]+")
#: Words whose hashes a task remembers.
KNOWN_WORDS = 1 << 18


def word_sets(rows: DataFrame, id_col: str, text_col: str, wanted: str, others: list[str]) -> DataFrame:
    """The other columns with ``key``, a hash of 128 bits of the text's words as ``title_key`` has them (null for a null text or none), and ``w``,
    64-bit hashes of the distinct ones of more than two characters where ``wanted`` is true: one pass over the texts, without Spark's translate."""
    names = [id_col, *others]

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, hashes = {}, {}

        def beyond(m: re.Match) -> str:
            return "".join([plain[c] if c in plain else plain.setdefault(c, _plain(c)) for c in m[0]])

        def hashed(words: set[bytes]) -> list[int]:
            if len(hashes) > KNOWN_WORDS:
                hashes.clear()
            return [hashes[w] if w in hashes else hashes.setdefault(w, int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little", signed=True)) for w in words]

        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                b = batch.slice(k, 1000)
                keys, sets = [], []
                for text, want in zip(b.column(text_col).to_pylist(), b.column(wanted).to_pylist(), strict=True):
                    words = [] if text is None else (text if text.isascii() else _BEYOND.sub(beyond, text)).encode().translate(_ASCII).split()
                    keys.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None)
                    sets.append(np.array(sorted(hashed({w for w in words if len(w) > 2})), np.int64) if want else None)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(keys, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], [*names, "key", "w"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.select(*names, text_col, wanted).mapInArrow(signed, f"{kinds}, key binary, w array<long>")


def token_pairs(rows: DataFrame, block: list[str], least: float, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(block, a_id, b_id, score): pairs of like token sets within a block. Tokens are told apart by 64-bit hashes, see ``set_pairs``."""
    known = rows.where(" and ".join(f"`{c}` is not null" for c in block)) if block else rows
    tok = known.select(*block, F.col(id_col).alias("id"), T.tokens(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    return set_pairs(tok.select(*block, "id", F.transform("w", lambda t: F.xxhash64(t)).alias("w")), block, least)


def set_pairs(sets: DataFrame, block: list[str], least: float, forest: bool = False) -> DataFrame:
    """(block, a_id, b_id, score): pairs of like sets ``w`` of 64-bit numbers, none empty, within a block. ``forest``: not all pairs, only links
    enough to connect all that they would.

    A block of more than ``PART`` sets is dealt into classes of sizes, so wide that like sets are of one class or of two
    neighbouring ones, and these into parts; each two parts that may hold like sets meet in one task, which compares those
    that share a rare token, or the bitmaps of all, and intersects only what is left, see ``_candidates``. No pair that fails is written.
    """
    kinds = ", ".join(f"{c} {sets.schema[c].dataType.simpleString()}" for c in block)
    kind = sets.schema["id"].dataType.simpleString()
    width = max(float(np.log(1 / least)) * (1 + 1e-9), 1e-4)
    tok = sets.select(*block, "id", "w", F.floor(F.log(F.size("w")) / width).cast("int").alias("class"))
    counts = tok.groupBy(*block, "class").agg(F.count("*").alias("n"))
    whole = counts.groupBy(*block).agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("class", F.ceil(F.col("n") / PART).cast("int")))).alias("parts"))
    dealt = tok.join(F.broadcast(whole), block).withColumn("small", F.col("total") <= PART)
    own = F.col("parts")[F.col("class")]
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("id"), own).cast("int"))
    key = lambda c, step, low, high, left: F.struct(c.alias("of"), F.lit(step).alias("step"), low.alias("low"), high.alias("high"), left.alias("is_left"))
    each = lambda n: F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    at, c = F.col("part"), F.col("class")
    among = F.transform(each(own), lambda o: key(c, 0, F.least(at, o), F.greatest(at, o), at <= o))
    larger = F.transform(each(F.col("parts")[c + 1]), lambda o: key(c, 1, at, o, F.lit(True)))
    smaller = F.transform(each(F.col("parts")[c - 1]), lambda o: key(c - 1, 1, o, at, F.lit(False)))
    alone = F.array(key(F.lit(0), 0, F.lit(0), F.lit(0), F.lit(True)))
    sent = dealt.select(*block, "id", "w", F.explode(F.when(F.col("small"), alone).otherwise(F.concat(among, larger, smaller))).alias("m")).select(*block, "id", "w", "m.*")
    pairs = sent.groupBy(*block, "of", "step", "low", "high").applyInArrow(_set_pairs(block, least, forest), f"{kinds + ', ' if block else ''}a {kind}, b {kind}, score double")
    return pairs.where("a != b").select(*block, F.least("a", "b").alias("a_id"), F.greatest("a", "b").alias("b_id"), "score")


def centroids(rows: DataFrame, key: str, vector_col: str = "vector") -> DataFrame:
    """(key, pos, value): the mean of each dimension; combined before the shuffle."""
    long = rows.select(key, F.posexplode(vector_col).alias("pos", "x"))
    return long.groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("value"))


def centroid_arrays(rows: DataFrame, key: str, vector_col: str = "vector", unit: bool = False) -> DataFrame:
    arrays = centroids(rows, key, vector_col).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("v")).select(key, F.transform("v", lambda x: x["value"]).alias("centroid"))
    return arrays.withColumn("centroid", V.normalised(F.col("centroid"))) if unit else arrays


def score_of(a: Column, b: Column) -> Column:
    return F.round(V.cosine(a, b), 4)
