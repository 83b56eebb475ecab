"""Source divergence audit: how far the term shares of sources of a language lie apart, by a heavy-light split.

Terms are runs of ASCII letters and of characters beyond ASCII, A-Z lower-cased. A language keeps the terms that
stand in at least ``min_docs`` of its documents. A group is a language and a source; of a group (and of a language)
with N occurrences of V kept terms, a term that occurs c times has the share p = 1 + floor(unit * (c + 5) / (N + 5V)),
a whole number. The distance of two groups is the sum of abs(p - q) over all kept terms.

A distance starts from that of two groups without any of the terms, and is corrected for the terms that a group holds.
Terms in at least a ``heavy``-th of a language's groups are heavy: their shares are laid out in dense tiles of terms
by groups, and numpy adds up the corrections of all pairs of a tile. The others are light, and postings correct for
them: by the groups that hold a term against those that may not (one-sided, summed by how many terms have which share),
and by pairs of groups that both hold it. All sums are whole numbers, so the parts add up exactly in any order.

Counting is of all documents: tasks count what they read before anything is shuffled, so a source that holds a third
of all rows sends as many counts as a task has terms. A tile holds ``TILE_TERMS`` terms, ``2 * TILE_GROUPS`` groups at
most; a light term has fewer postings than a heavy-th of the groups. A task holds one text at a time, however long.

Null text, language or source count as empty; a document without text or without terms still makes its group occur.
Repeated rows, also with the same id, count as documents of their own. Extra columns are ignored. A language without
kept terms has distances of 0 and no terms. A language of one group has no pairs. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyline.llm.common import drop, materialise, sliced, written

UNIT = 1_000_000_000
TILE_TERMS, TILE_GROUPS = 256, 128
#: A task sends its counts on once it holds so many.
HELD = 300_000
SALTS = 16

#: Bytes as terms see them: letters and what lies beyond ASCII stay, A-Z become lower-case, all else parts terms.
_AS_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of what a task reads; an empty term stands for the group itself."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = [b"", *n]
            k = len(terms)
            columns = [pa.array([lang] * k), pa.array([source] * k), pa.array(terms, pa.binary()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[t] for t in n)], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
        held.clear()

    for b in batches:
        for piece in sliced([b], 100):
            for text, lang, source in zip(*(piece.column(c).to_pylist() for c in ("text", "lang", "source")), strict=True):
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                once = Counter(text.translate(_AS_TERM).split())
                n.update(once)
                docs.update(once.keys())
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from out()
    yield from out()


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group; every group has a row of the empty term."""
    clean = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))))
    raw = clean.select(F.col("text").cast("binary").alias("text"), "lang", "source").mapInArrow(_count, "lang string, source string, term binary, n long, docs long")
    return raw.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column, total: Column) -> Column:
    """1 + floor(UNIT * (n + 5) / (total + 5 * kept)), exact beyond 64 bits."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", F.lit(UNIT).cast("decimal(12,0)") * wide(n + 5), wide(total + 5 * F.col("kept"))) + 1


def _tile(cells: pd.DataFrame) -> pd.DataFrame:
    """Sums of abs(p - q), less what it is without the term, over the terms of a tile, for its pairs of groups (a, b); rows of a null term hold what a group has for the terms it lacks."""
    lang, left, right = cells["lang"].iloc[0], cells["left"].iloc[0], cells["right"].iloc[0]
    base, filled = cells[cells["term"].isna()], cells[cells["term"].notna()]
    names, at = base["source"].to_numpy(), {s: k for k, s in enumerate(base["source"])}
    column, terms = pd.factorize(filled["term"])
    none = base["p"].to_numpy(np.int64)
    m = np.repeat(none[:, None], len(terms), axis=1)
    m[filled["source"].map(at).to_numpy(np.int64), column] = filled["p"].to_numpy(np.int64)
    mine, others = (np.flatnonzero(base["part"].to_numpy() == x) for x in (left, right))
    out = []
    for i in mine:
        near = others[others > i] if left == right else others
        sums = np.abs(m[near] - m[i]).sum(axis=1) - len(terms) * np.abs(none[near] - none[i])
        out.append(pd.DataFrame({"a": names[i], "b": names[near], "value": sums}))
    whole = pd.concat(out) if out else pd.DataFrame({"a": pd.Series(dtype=object), "b": pd.Series(dtype=object), "value": pd.Series(dtype="int64")})
    return whole.assign(lang=lang)[["lang", "a", "b", "value"]]


def _heavy(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value): the tiles' corrections. Groups fall into parts, terms into blocks, and a tile is a block of terms by a pair of parts."""
    part = F.pmod(F.xxhash64("source"), F.col("parts")).cast("int").alias("part")
    # A part meets every part, itself included; the lesser one comes first.
    partners = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with")
    rows = cells.select("lang", "source", "term", "p", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), part, "parts")
    blank = groups.where("blocks > 0").select("lang", "source", F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), part, "parts")
    dealt = rows.union(blank).select("lang", "source", "term", "p", "block", "part", partners).withColumns({"left": F.least("part", "with"), "right": F.greatest("part", "with")}).drop("with")
    sums = dealt.groupBy("lang", "block", "left", "right").applyInPandas(_tile, "lang string, a string, b string, value long")
    return sums.groupBy("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("value").alias("value"))


def _light(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value): what lies between two groups without any term, and the postings' corrections for the light ones."""
    end = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0"))
    pairs = groups.join(end, "lang").where(F.col("source") < F.col("other"))
    apart = pairs.select("lang", F.col("source").alias("a"), F.col("other").alias("b"), (F.col("kept") * F.abs(F.col("p0") - F.col("q0"))).alias("value"))
    # Shares at or above every group's least share lie on one side of all of them and are counted as one.
    held = cells.groupBy("lang", "source", F.least("p", "top").alias("step")).agg(F.sum("p").alias("sum_p"), F.count("*").alias("terms"), F.first("p0").alias("p0"))
    beyond = F.when(F.col("step") >= F.col("q0"), F.col("sum_p") - F.col("terms") * F.col("q0")).otherwise(F.col("terms") * F.col("q0") - F.col("sum_p"))
    # Salted, as a language may hold most of the rows.
    salted = held.withColumn("salt", F.pmod(F.xxhash64("source", "step"), F.lit(SALTS)))
    one_sided = salted.join(end.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["lang", "salt"]).where("source != other").select(
        "lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"), (beyond - F.col("terms") * F.abs(F.col("p0") - F.col("q0"))).alias("value")
    )
    postings = cells.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "p", "p0"))).alias("list")).where(F.size("list") > 1)
    both = postings.select("lang", "list", F.posexplode("list").alias("at", "x")).select("lang", "x", F.explode(F.slice("list", F.col("at") + 2, F.size("list"))).alias("y"))
    x, y = (lambda f: F.col(f"x.{f}")), (lambda f: F.col(f"y.{f}"))
    corrected = F.abs(x("p") - y("p")) - F.abs(x("p") - y("p0")) - F.abs(x("p0") - y("p")) + F.abs(x("p0") - y("p0"))
    two_sided = both.select("lang", x("source").alias("a"), y("source").alias("b"), corrected.alias("value"))
    return apart.union(one_sided.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))).union(two_sided.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))


def _ranked(found: DataFrame) -> DataFrame:
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return found.withColumn("rank", F.row_number().over(by))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 30, heavy: int = 8, top_terms: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` holds the distances of a group to all other sources of its
    language, part ``term`` its ``top_terms`` terms whose share lies furthest above the language's, with the difference."""
    spark = docs.sparkSession
    counts, counts_path = written(term_counts(docs, text_col, lang_col, source_col), "divergence-counts")
    by_term = counts.where("term != ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.count("*").alias("holders"))
    terms, terms_path = written(by_term.where(F.col("docs") >= min_docs).drop("docs"), "divergence-terms")
    kept, kept_path = written(counts.where("term != ''").join(terms, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n", "holders"), "divergence-kept")
    occurring = counts.where("term = ''").select("lang", "source")
    sizes = occurring.groupBy("lang").agg(F.count("*").alias("n_groups")).withColumn("heavy_from", F.greatest(F.lit(3), F.ceil(F.col("n_groups") / heavy)))
    vocabulary = terms.join(sizes, "lang").groupBy("lang").agg(
        F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"), F.sum((F.col("holders") >= F.col("heavy_from")).cast("long")).alias("n_heavy")
    )
    langs = vocabulary.join(sizes, "lang").select("*", F.ceil(F.col("n_heavy") / TILE_TERMS).cast("int").alias("blocks"), F.ceil(F.col("n_groups") / TILE_GROUPS).cast("int").alias("parts"))
    groups = occurring.join(langs, "lang").join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    groups = groups.withColumn("total", F.coalesce("total", F.lit(0).cast("long")))
    # ``p0`` is a group's share of a term that it lacks, ``top`` the most that any group can have for that.
    groups, groups_path = written(groups.withColumns({"p0": _share(F.lit(0), F.col("total")), "top": _share(F.lit(0), F.lit(0))}).drop("n_groups", "n_heavy"), "divergence-groups")

    cells = kept.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("total")))
    heavy_ones = F.col("holders") >= F.col("heavy_from")
    pieces = _heavy(cells.where(heavy_ones), groups).union(_light(cells.where(~heavy_ones), groups))
    # Languages without kept terms have pairs as well, at a distance of 0.
    bare = occurring.join(vocabulary, "lang", "left_anti")
    bare = bare.join(bare.select("lang", F.col("source").alias("b")), "lang").where("source < b").select("lang", F.col("source").alias("a"), "b", F.lit(0).cast("long").alias("value"))
    apart = pieces.union(bare).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pairs = apart.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value")
    pairs = _ranked(pairs.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value"))
    above = cells.withColumn("value", F.col("p") - _share(F.col("lang_n"), F.col("lang_total"))).where("value > 0")
    above = _ranked(above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")).where(F.col("rank") <= top_terms)
    out = materialise(pairs.union(above), "divergence")
    for path in (counts_path, terms_path, kept_path, groups_path):
        drop(spark, path)
    return out
