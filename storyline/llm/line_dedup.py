"""Line dedup: fuzzy lines by MinHash, verified exactly, one line kept of each component.

A line's shingles are its substrings of eight characters (UTF-16 units), a line of fewer is one shingle. Its signature
is the least hash in each of 32 equal ranges of hashes (MinHash by one permutation; hashes far above what 32 ranges
leave as least are passed over first), and the least hashes of four neighbouring ranges are a band. Two lines of Jaccard
similarity 0.8 share one of the eight bands in 98 to 99 of 100 cases, at 0.85 in over 99, at 0.4 in some 18.

Of the distinct lines that share a band, each is compared with the most central one, and where that leaves a band
in several ties, all lines of different ties are compared, see ``leaders``; no size of a band changes that. Before two
lines of different ties are compared in full, their ``SKETCH`` least hashes are: pairs that agree in so few that lines of
similarity 0.8 do so in 1 of 700 cases are passed over; of lines of no more shingles none that is similar is. Least hashes are
compared by 16 of their bits; those of a line that thereby fall together count as agreeing. Comparisons are of the exact
Jaccard similarity of all shingles.
Similar lines are joined by distributed union-find, and of each component the first line by (id, text hash, place) is
kept.

Everything is DataFrame expressions. Signing makes a row of each shingle of a distinct line, which the task that holds
the line counts down to a row of least hashes, so that no shingle is hashed by an interpreted function. Lines are compared without blanks at their ends; blank lines are kept as
they are. A null text stays null and an empty one empty. A null id comes last. Rows that are equal in id and text
are treated alike: what is kept in one is kept in the other. A text may have any length: its lines are rows, a line
itself is held whole by the task that reads its document. Extra columns pass through; an empty table gives an empty
result. Lines are told apart by 64-bit hashes; of 10**9 distinct lines some pair collides with a chance of 3 %, which
would take the one for a copy of the other.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyline.llm.common import bit_filter, drop, materialise, release, written
from storyline.llm.components import components
from storyline.llm.leaders import leader_links

SHINGLE = 8
#: What lines are compared without at their ends.
BLANKS = " \t\r"
#: Ranges of hashes as bits of the hash, of which a band takes neighbouring ones; the hashes looked at in a range, on average.
RANGE_BITS, BAND_BITS, LOOKED_AT = 5, 3, 2
#: Least hashes compared before two lines are, and how many standard deviations fewer may agree than similar lines share.
SKETCH, DEVIATIONS = 320, 3


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), f), 0)


def _starts(raw: Column) -> Column:
    """Where the shingles of a line, as bytes, begin."""
    return F.sequence(F.lit(1), F.greatest(F.octet_length(raw) - (2 * SHINGLE - 1), F.lit(1)), F.lit(2))


def _window(raw: Column, at: Column) -> Column:
    """The hash of the shingle that begins there."""
    return F.xxhash64(F.substring(raw, at, F.lit(2 * SHINGLE)))


def _windows(line: Column) -> Column:
    """The hashes of all shingles of a line, in their order."""
    return _bound(F.encode(line, "UTF-16BE"), lambda raw: F.transform(_starts(raw), lambda at: _window(raw, at)))


def _band_keys(lines: DataFrame) -> DataFrame:
    """(lid, key) of each distinct line and each of its bands that has a least hash.

    Windows are rows, so that hashing them is compiled with the stage; the task that holds the line makes one row of them, with a column for each range.
    """
    in_range = (1 << (64 - RANGE_BITS)) - 1
    share = F.least(F.lit(1.0), F.lit(float(LOOKED_AT << RANGE_BITS)) / F.greatest(F.char_length("line") - (SHINGLE - 1), F.lit(1)))
    most = F.when(share >= 1, F.lit(in_range)).otherwise((share * in_range).cast("long"))
    raw = lines.groupBy("lid").agg(F.first("line").alias("line")).select("lid", F.encode("line", "UTF-16BE").alias("raw"), most.alias("most"))
    hashed = raw.select("lid", "raw", "most", F.explode(_starts(F.col("raw"))).alias("at")).select("lid", "most", _window(F.col("raw"), F.col("at")).alias("h"))
    low = hashed.where(F.col("h").bitwiseAND(F.lit(in_range)) <= F.col("most"))
    within = F.shiftrightunsigned("h", 64 - RANGE_BITS)
    least = low.groupBy("lid").agg(*(F.min(F.when(within == k, F.col("h"))).alias(f"least_{k}") for k in range(1 << RANGE_BITS)))
    wide = 1 << (RANGE_BITS - BAND_BITS)

    def key(band: int) -> Column:
        # A range without a hash is left out of the key; a hash says itself of which range it is.
        held = [F.col(f"least_{k}") for k in range(wide * band, wide * (band + 1))]
        return F.when(F.coalesce(*held).isNotNull(), F.xxhash64(F.lit(band), *held))

    return least.select("lid", F.explode(F.array(*map(key, range(1 << BAND_BITS)))).alias("key")).where("key is not null")


def _row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row key, place, line, hash of the line) of each line that is not blank."""
    known = docs.where(F.col(text_col).isNotNull())
    # The key of a row is made before its lines are: above the generator it would be made of the whole text for each line.
    rows = known.select(F.col(id_col).alias("id"), _row_key(id_col, text_col).alias("rk"), F.split(F.col(text_col), "\n").alias("lines")).select("id", "rk", F.posexplode("lines").alias("pos", "line"))
    line = F.col("line")
    ends = reduce(or_, (f(blank) for blank in BLANKS for f in (line.startswith, line.endswith)))
    return rows.withColumn("line", F.when(ends, F.btrim(line, F.lit(BLANKS))).otherwise(line)).where("line != ''").withColumn("lid", F.xxhash64("line"))


def _sketched(lines: DataFrame) -> DataFrame:
    """(id, n, sketch, line) of lines: how many shingles, and 16 bits of each of the least hashes."""
    hashed = lines.select("id", F.sort_array(F.array_distinct(_windows(F.col("line")))).alias("h"), "line")
    sketch = F.array_distinct(F.transform(F.slice("h", 1, SKETCH), lambda x: (x.bitwiseAND(F.lit(0xFFFF)) - F.lit(0x8000)).cast("short")))
    return hashed.select("id", F.size("h").cast("long").alias("n"), sketch.alias("sketch"), "line")


def _agree(x: Column, y: Column, least: float) -> Column:
    """Whether two lines can be similar by their sizes, and are likely to be by their least hashes."""
    small, large = F.least(x["n"], y["n"]), F.greatest(x["n"], y["n"])
    # Of lines as similar as asked so many shingles are shared; of the larger one's least hashes so many are expected to be, give or take.
    shared = F.lit(least / (1 + least)) * (small + large)
    looked_at = F.least(F.lit(1.0), F.lit(float(SKETCH)) / large)
    spread = F.sqrt(F.greatest(F.lit(0.0), shared * looked_at * (1 - shared / large) * (1 - looked_at)))
    # Hashes of a line that fall together in the sketch may be shared ones.
    lost = lambda z: F.least(z["n"], F.lit(SKETCH)) - F.size(z["sketch"])
    agreeing = F.size(F.array_intersect(x["sketch"], y["sketch"])) + F.least(lost(x), lost(y))
    return (small >= F.lit(least) * large) & (agreeing >= shared * looked_at - DEVIATIONS * spread - 1e-6)


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Of pairs (a, b) of lines those whose shingle sets have the Jaccard similarity ``least`` or more."""
    side = lambda c: texts.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("line").alias(f"l{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("na", "nb") >= F.lit(least) * F.greatest("na", "nb"))
    # An intersection has each hash once, whatever the order and number in its sides. As a row of a generator it is made once, however often a filter names it.
    shared = F.size(F.array_intersect(_windows(F.col("la")), _windows(F.col("lb"))))
    met = both.select("a", "b", "na", "nb", F.explode(F.array(shared)).alias("shared"))
    return met.where(F.col("shared") >= F.lit(least) * (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b")


def similar_lines(docs: DataFrame, id_col: str, text_col: str, least: float) -> tuple[tuple[DataFrame, DataFrame], DataFrame]:
    """Places of all lines (id, rk, pos, lid) with the lines that stand in several (lid), and links (a, b) between similar distinct lines."""
    spark = docs.sparkSession
    lines = _lines(docs, id_col, text_col)
    places = materialise(lines.select("id", "rk", "pos", "lid"), "line-places")
    keys, keys_path = written(_band_keys(lines), "line-bands")
    # The session holds on to its last query: this one comes after the keys so that the shuffled lines can go.
    repeated = materialise(places.groupBy("lid").agg(F.count("*").alias("times")).where("times > 1").select("lid"), "line-copied")
    release(spark)
    shared = keys.groupBy("key").agg(F.min("lid").alias("low"), F.max("lid").alias("high"), F.count("*").alias("lines"))
    shared, shared_path = written(shared.where("lines > 1"), "line-met")
    release(spark)
    larger = shared.where("lines > 2").select("key")
    members, members_path = written(
        shared.where("lines = 2").select("key", F.explode(F.array("low", "high")).alias("id")).union(bit_filter(keys, "key", larger, "key").join(larger, "key").select("key", F.col("lid").alias("id"))),
        "line-shared",
    )
    drop(spark, keys_path)
    wanted = members.select("id").distinct()
    found = bit_filter(lines.select(F.col("lid").alias("id"), "line"), "id", wanted, "id").join(wanted, "id").groupBy("id").agg(F.first("line").alias("line"))
    texts, texts_path = written(_sketched(found), "line-texts")
    drop(spark, shared_path)
    release(spark)
    links = leader_links(members, texts.select("id", "n", "sketch"), lambda x, y: _agree(x, y, least), lambda p: _verified(p, texts, least), "line")
    drop(spark, members_path)
    drop(spark, texts_path)
    return (places, repeated), links


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """The documents, all columns kept, less the lines that are equal or similar to an earlier one; with ``n_lines`` and ``n_removed`` (columns of those names in ``docs`` are replaced)."""
    (places, repeated), links = similar_lines(docs, id_col, text_col, least)
    joined = components(links, tag="line-components").select(F.col("id").alias("lid"), F.col("component").alias("group"))
    grouped = materialise(joined.unionByName(repeated.join(joined, "lid", "left_anti").select("lid", F.col("lid").alias("group"))), "line-groups")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "rk", "pos")
    held = materialise(bit_filter(places, "lid", grouped, "lid").join(grouped, "lid").select("group", "rk", "pos", place.alias("place")), "line-held")
    keepers = held.groupBy("group").agg(F.min("place").alias("keeper"))
    removed = (
        held.join(keepers, "group").where((F.col("rk") != F.col("keeper.rk")) | (F.col("pos") != F.col("keeper.pos")))
        .groupBy(F.col("rk").alias("__rk")).agg(F.collect_set("pos").alias("__removed"))
    )
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    lines = F.split(F.col(text_col), "\n")
    # The places that stay, as a set difference: linear in a document's lines.
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "__removed")
    kept = F.get(F.transform(F.array(lines), lambda x: F.array_join(F.transform(stay, lambda i: F.get(x, i)), "\n")), 0)
    rows = docs.select(*own).withColumn("__rk", _row_key(id_col, text_col)).join(removed, "__rk", "left")
    return rows.select(
        *(F.when(F.col("__removed").isNull(), F.col(c)).otherwise(kept).alias(c) if c == text_col else F.col(c) for c in own),
        F.when(F.col(text_col).isNotNull(), F.size(lines)).otherwise(0).cast("long").alias("n_lines"),
        F.coalesce(F.size("__removed"), F.lit(0)).cast("long").alias("n_removed"),
    )
