"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts are lower-cased (A-Z), cut into words and joined by single spaces, with a space at either end; the
patterns are the windows of ``window`` words of the benchmark items (an item with fewer words is one window),
with a space at either end. Patterns of like length form a searcher. Of each pattern the first m bytes count,
m being the least length in the searcher: a shift table over hashed blocks says how far the search may move on,
the hash of the block that ends at m selects a bucket of patterns, and direct comparison confirms occurrences.
The longest move is the usual one, and as those moves do not depend on each other, NumPy takes them for a whole
text at once; only where a block occurs in some pattern does the search go on step by step.

A null or empty text has no words; an item without words has no windows; a null item id is skipped. Items with
equal ids count as one. Documents are searched one by one: repeated rows, ties and extra columns change
nothing, and empty tables give an empty result or one without hits.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyline.llm.common import sliced

#: Items are broadcast in groups of about so many bytes; each further group is one more pass within the same stage.
GROUP_BYTES = 4_000_000

_MAP = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    r"""The words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the text with A-Z lower-cased."""
    return (text or "").encode().translate(_MAP).split()


class WuManber:
    """Patterns (bytes) with values; all of about one length."""

    def __init__(self, patterns: dict[bytes, list]):
        self.patterns = patterns
        self.m = m = min(map(len, patterns))
        self.block = b = min(8, m)
        self.step = m - b + 1
        heads = np.frombuffer(b"".join(p[:m] for p in patterns), np.uint8).reshape(-1, m)
        self.bits = min(24, max(12, int(len(patterns) * self.step).bit_length() + 4))
        self.shift = np.full(1 << self.bits, self.step, np.uint16 if self.step < 1 << 16 else np.uint32)
        for q in range(self.step):
            self.shift[self._slot(self._values(np.ascontiguousarray(heads[:, q : q + b])))] = m - b - q
        self.buckets: dict[bytes, list[bytes]] = defaultdict(list)
        for p in patterns:
            self.buckets[p[m - b : m]].append(p)

    def _values(self, rows: np.ndarray) -> np.ndarray:
        if self.block == 8:
            return rows.view("<u8").ravel()
        out = np.zeros(len(rows), np.uint64)
        for i in range(self.block):
            out = (out << np.uint64(8)) | rows[:, i]
        return out

    def _slot(self, values: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (values * _MIX) >> np.uint64(64 - self.bits)

    def search(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        """Start and pattern of every occurrence, in no set order."""
        n, m, b = len(text), self.m, self.block
        if n < m:
            return
        data = np.frombuffer(text, np.uint8)
        blocks = np.lib.stride_tricks.sliding_window_view(data, b)
        # Ends of blocks, a longest move apart: an occurrence's first m bytes hold just one of them.
        ends = np.arange(b, n + 1, self.step)
        moves = self.shift[self._slot(self._values(blocks[ends - b]))]
        near = np.flatnonzero(moves < self.step)
        at, last = ends[near] + moves[near], np.minimum(ends[near] + self.step - 1, n)
        while len(at := at[open_ := at <= last]):
            last = last[open_]
            moves = self.shift[self._slot(self._values(blocks[at - b]))]
            for i in at[(moves == 0) & (at >= m)].tolist():
                for p in self.buckets.get(text[i - b : i], ()):
                    if text.startswith(p, i - m):
                        yield i - m, p
            at = at + np.maximum(moves, 1)


class Searcher:
    """The windows of benchmark items."""

    def __init__(self, items: Iterable[tuple[str, str]], window: int = 10):
        by_length: dict[int, dict[bytes, list[str]]] = defaultdict(lambda: defaultdict(list))
        for item, text in items:
            w = words(text)
            for k in range(max(1, len(w) - window + 1) if w else 0):
                p = b" " + b" ".join(w[k : k + window]) + b" "
                # The full windows share a searcher; shorter items are sorted by their length.
                owners = by_length[0 if len(w) >= window else len(p).bit_length()][p]
                if item not in owners:
                    owners.append(item)
        self.parts = [WuManber(dict(p)) for p in by_length.values()]

    def hits(self, texts: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set[str]]]:
        """For each text's words the ranges of hit words and the items that occur; texts are searched many at a time."""
        out: list[tuple[list[tuple[int, int]], set[str]]] = []
        part: list[bytes] = []
        size = 0
        for w in [*texts, None]:
            if part and (w is None or size > 1 << 20):
                out += self._hits(part)
                part, size = [], 0
            if w is not None:
                part.append(b" " + b" ".join(w) + b" ")
                size += len(part[-1])
        return out

    def _hits(self, texts: list[bytes]) -> list[tuple[list[tuple[int, int]], set[str]]]:
        out: list[tuple[list[tuple[int, int]], set[str]]] = [([], set()) for _ in texts]
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        whole = b"\n".join(texts)  # no pattern holds a line feed
        found = [(at, p, s) for s in self.parts for at, p in s.search(whole)]
        owners = np.searchsorted(starts, [f[0] for f in found], "right") - 1
        spaces: dict[int, np.ndarray] = {}
        for k, (at, p, s) in zip(owners.tolist(), found, strict=True):
            if k not in spaces:
                spaces[k] = np.flatnonzero(np.frombuffer(texts[k], np.uint8) == 32)
            first = int(np.searchsorted(spaces[k], at - starts[k]))
            out[k][0].append((first, first + p.count(b" ") - 1))
            out[k][1].update(s.patterns[p])
        return out


def merged(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


_SEARCHERS: dict[str, Searcher] = {}


def _searcher(key: str, items, window: int) -> Searcher:
    """A worker builds each group's searcher once and keeps the last."""
    if key not in _SEARCHERS:
        _SEARCHERS.clear()
        _SEARCHERS[key] = Searcher(items.value, window)
    return _SEARCHERS[key]


def _groups(benchmark: DataFrame) -> Iterator[tuple[str, object]]:
    """The items in broadcasts of about GROUP_BYTES bytes of text."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = -(-total // GROUP_BYTES) or 1
    for g in range(groups):
        own = [(r["item"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(groups)) == g).collect()]
        yield uuid.uuid4().hex, benchmark.sparkSession.sparkContext.broadcast(own)


def _pass(key: str, items, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = _searcher(key, items, window)
        for b in sliced(batches, 256):
            counts, ranges, owners = [], [], []
            texts = [words(t.as_py()) for t in b.column("text")]
            for w, had, own, (new, got) in zip(texts, b.column("hit_words").to_pylist(), b.column("items").to_pylist(), searcher.hits(texts), strict=True):
                flat = merged([*zip(had[::2], had[1::2], strict=True), *new]) if new else None
                counts.append(len(w))
                ranges.append([x for r in flat for x in r] if flat else had)
                owners.append(sorted({*own, *got}))
            columns = {n: b.column(n) for n in b.schema.names}
            columns |= {"n_words": pa.array(counts, pa.int64()), "hit_words": pa.array(ranges, pa.list_(pa.int64())), "items": pa.array(owners, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hit = [sum(r[1::2]) - sum(r[::2]) for r in b.column("hit_words").to_pylist()]
        items = b.column("items").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), b.column("n_words"), pa.array(hit, pa.int64()), pa.array([len(i) for i in items], pa.int64()),
             pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in items], pa.string()), pa.array([h > 0 for h in hit], pa.bool_()), b.column("items"), b.column("hit_words")],
            names=["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "hit_words"],
        )


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 10) -> DataFrame:
    """One row a document: words, hit words, items that occur (count, digest, list), hit word ranges (flat) and whether any word is hit."""
    kind = dict(docs.dtypes)[id_col]
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("n_words"), F.array().cast("array<long>").alias("hit_words"), F.array().cast("array<string>").alias("items"))
    for key, items in _groups(benchmark):
        out = out.mapInArrow(_pass(key, items, window), f"id {kind}, text string, n_words long, hit_words array<long>, items array<string>")
    return out.mapInArrow(_finish, f"id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, hit_words array<long>").withColumnRenamed("id", id_col)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 10) -> DataFrame:
    """The documents, all columns kept, in which no window of the benchmark occurs."""
    at, out = docs.columns.index(text_col), docs
    for key, items in _groups(benchmark):
        out = out.mapInArrow(_filter(key, items, window, at), docs.schema)
    return out


def _filter(key: str, items, window: int, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = _searcher(key, items, window)
        for b in sliced(batches, 256):
            yield b.filter(pa.array([not own for _, own in searcher.hits([words(t.as_py()) for t in b.column(at)])], pa.bool_()))

    return run
