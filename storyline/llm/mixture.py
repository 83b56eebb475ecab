"""Mixing sources to target weights: Pareto order sampling after allocating certain whole copies.

A source that is to give ``target`` words and has ``source_size`` is taken ``target / source_size`` times on
average. Each of its documents is certain to be taken as many whole times as that ratio's floor. The words that are
left, the rest, come from a sample without replacement of unequal probabilities: a document is included once more
with probability proportional to its size, p = min(1, c * size), where c makes the expected words the rest. Those
with p = 1 are certain. The others get the random odds u / (1 - u), u from a hash of the id, divided by their
inclusion odds p / (1 - p), and are taken in the order of that quotient: a Pareto order sample. Its size is fixed in
words, as targets are: the order is cut where the words reach the rest, and then at most one document a source is
turned (taken or left) if that brings the source nearer to its target.

``c`` is found from sums by size, in steps of a 64th of an octave, so a source is some two thousand rows at most. The
cut is found without sorting a source in one task: words are summed in buckets of the order, first 4096 for the
whole source, then 4096 within the bucket that holds the cut, and only the documents of that last bucket are ordered
one by one.

Null and blank texts have size 0 and are never counted as taken. A null source is a source of its own, the
last. Rows with equal ids get equal random numbers and are ordered by size and a hash of the text; rows that
are equal in all of these are exchangeable and are told apart by their order in the last bucket only. A source
without words has target 0. Texts may have any length, only their sizes travel. An empty table gives an empty
result. Extra columns are ignored; a column to ``keep`` that is named like one of the results gives way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyline.llm.common import materialise

#: Sources take these weights in turn, by code point.
WEIGHTS = (3, 1, 2)
BUCKETS = 4096


def word_count(text: Column) -> Column:
    r"""How many ``[^\x20\x09-\x0D]+`` a text holds."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def allocate(sizes: list[int], weights: list[int], share: float, most: float) -> list[float]:
    """Targets by weight that sum to ``share`` of all sizes, none above ``most`` times its size; the excess is reshared."""
    left, open_, targets = share * sum(sizes), [i for i, n in enumerate(sizes) if n], [0.0] * len(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        if not full:
            for i in open_:
                targets[i] = unit * weights[i]
            break
        for i in full:
            targets[i] = most * sizes[i]
            left -= targets[i]
        open_ = [i for i in open_ if i not in set(full)]
    return targets


def targets(docs: DataFrame, source_col: str, share: float, most: float, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row a source (``source``, ``source_size``, ``target``); the driver holds one number a source."""
    rows = sorted(docs.groupBy(F.col(source_col).alias("s")).agg(F.sum("size").alias("n")).collect(), key=lambda r: (r["s"] is None, r["s"] or ""))
    got = allocate([r["n"] for r in rows], [weights[i % len(weights)] for i in range(len(rows))], share, most)
    data = [(r["s"], int(r["n"]), float(t)) for r, t in zip(rows, got, strict=True)]
    return docs.sparkSession.createDataFrame(data, f"source {dict(docs.dtypes)[source_col]}, source_size long, target double")


def _cut(parts: DataFrame, bucket: str, *keep: str) -> DataFrame:
    """Of words summed by source and bucket, the bucket in which each source's rest is reached, and the words before it."""
    w = Window.partitionBy("source").orderBy(bucket)
    run = parts.withColumn("upto", F.sum("words").over(w)).withColumn("before", F.col("upto") - F.col("words"))
    return run.where((F.col("before") < F.col("rest")) & (F.col("upto") >= F.col("rest"))).select("source", "rest", "before", bucket, *keep)


def _slopes(live: DataFrame) -> DataFrame:
    """Of each source the c for which the expected words of min(1, c * size) are its rest."""
    step = F.floor(F.log2(F.col("size").cast("double")) * 64)
    size = F.col("size").cast("double")
    parts = live.groupBy("source", step.alias("step")).agg(F.sum(size).alias("words"), F.sum(size * size).alias("squares"), F.min(size).alias("low"), F.first("rest").alias("rest"))
    upto = Window.partitionBy("source").orderBy("step")
    certain = F.sum("words").over(Window.partitionBy("source")) - F.sum("words").over(upto)
    slope = (F.col("rest") - certain) / F.sum("squares").over(upto)
    fitting = parts.select("source", "step", "low", slope.alias("slope")).where((F.col("slope") > 0) & (F.col("slope") * F.col("low") <= 1))
    return fitting.groupBy("source").agg(F.max_by("slope", "step").alias("slope"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, most: float = 2.0, seed: int = 17, keep: tuple[str, ...] = ()) -> DataFrame:
    """All documents with ``size``, ``source_size``, ``target``, ``taken`` (words, repeats counted), ``copies`` and the columns to ``keep`` (but for those names)."""
    u = (F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    measures = (F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("th"), u.alias("u"))
    sized = materialise(docs.select(*measures), "mix-sizes")
    per_source = targets(sized, "source", share, most).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    per_source = per_source.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    per_source = F.broadcast(per_source)
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))

    def of_source(rows: DataFrame) -> DataFrame:
        own = per_source.withColumnRenamed("source", "__source")
        return rows.join(own, rows["source"].eqNullSafe(F.col("__source")), "left").drop("__source")

    wanted = of_source(sized).where((F.col("rest") > 0) & (F.col("size") > 0))
    slopes = F.broadcast(materialise(_slopes(wanted.select(key.alias("source"), "size", "rest")), "mix-slopes").withColumnRenamed("source", "key"))

    def rank(rows: DataFrame) -> DataFrame:
        """With p, the probability of inclusion, q, the Pareto rank, and its buckets."""
        p = F.least(F.lit(1.0), F.coalesce(F.col("slope") * F.col("size"), F.col("rest") / F.col("source_size")))
        with_p = of_source(rows).withColumn("key", key).join(slopes, "key", "left").withColumn("p", F.when((F.col("rest") > 0) & (F.col("size") > 0), p))
        return (
            with_p.withColumn("q", F.when(F.col("p") >= 1, 0.0).when(F.col("p") > 0, F.col("u") / (1 - F.col("u")) * (1 - F.col("p")) / F.col("p")))
            .withColumn("share", F.col("q") / (1 + F.col("q")))
            .withColumn("b1", F.when(F.col("p") >= 1, -1).otherwise(F.least(F.floor(F.col("share") * BUCKETS), F.lit(BUCKETS - 1))))
            .withColumn("b2", F.least(F.floor((F.col("share") * BUCKETS - F.col("b1")) * BUCKETS), F.lit(BUCKETS - 1)))
        )

    ranked = rank(sized)
    live = ranked.where(F.col("p") > 0).withColumn("source", F.col("key"))
    first = _cut(live.groupBy("source", "b1").agg(F.sum("size").alias("words"), F.first("rest").alias("rest")), "b1")
    inside = live.join(F.broadcast(first.select("source", "b1", F.col("before").alias("before1"))), ["source", "b1"])
    second = _cut(
        inside.groupBy("source", "b1", "b2").agg(F.sum("size").alias("words"), F.first("before1").alias("before1"), (F.first("rest") - F.first("before1")).alias("rest")),
        "b2", "b1", "before1",
    )
    second = second.select("source", "b1", "b2", (F.col("before") + F.col("before1")).alias("before"))
    w = Window.partitionBy("source").orderBy("q", "id", "size", "th")
    last = (
        live.join(F.broadcast(second), ["source", "b1", "b2"])
        .withColumn("upto", F.col("before") + F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .where((F.col("upto") - F.col("size") < F.col("rest")) & (F.col("upto") >= F.col("rest")))
        # the document on the cut is taken if that is nearer
        .select("source", "q", "id", F.col("size").alias("cut_size"), "th", (F.col("upto") - F.col("rest") <= F.col("rest") - (F.col("upto") - F.col("size"))).alias("with_cut"),
                F.when(F.col("upto") - F.col("rest") <= F.col("rest") - (F.col("upto") - F.col("size")), F.col("upto")).otherwise(F.col("upto") - F.col("size")).alias("got"))
    )
    cuts = materialise(last.select("source", F.struct("q", "id", F.col("cut_size").alias("size"), "th").alias("cut"), "with_cut", "got"), "mix-cuts")
    place = F.struct("q", "id", "size", "th")
    choose = lambda rows: (
        rows.join(F.broadcast(cuts.withColumnRenamed("source", "key")), "key", "left")
        .withColumn("extra", F.coalesce(F.when(F.col("size") > 0, (place < F.col("cut")) | ((place == F.col("cut")) & F.col("with_cut"))), F.lit(False)))
    )
    # One document a source may be turned: the one whose size is nearest to what the source is off by.
    off = F.col("rest") - F.col("got")
    gain = F.when(off > 0, F.when(~F.col("extra"), F.abs(off - F.col("size")))).otherwise(F.when(F.col("extra"), F.abs(-off - F.col("size"))))
    turned = (
        choose(ranked).where((F.col("size") > 0) & F.col("cut").isNotNull() & (gain < F.abs(off)))
        .groupBy("key").agg(F.min(F.struct(gain.alias("gain"), F.col("q"), F.col("id"), F.col("size"), F.col("th"))).alias("t"))
        .select("key", F.col("t.id").alias("turn_id"), F.col("t.th").alias("turn_th"), F.lit(True).alias("turn"))
    )
    # What is kept besides is read again from the documents and meets only broadcast rows, so texts are not shuffled.
    rows = rank(docs.select(*measures, F.struct(*keep).alias("kept"))) if keep else ranked
    out = choose(rows).join(F.broadcast(turned), "key", "left").withColumn(
        "extra", F.when(F.col("turn") & F.col("id").eqNullSafe(F.col("turn_id")) & F.col("th").eqNullSafe(F.col("turn_th")), ~F.col("extra")).otherwise(F.col("extra"))
    )
    return out.select(
        F.col("id").alias(id_col), "source", "size", F.coalesce("source_size", F.lit(0).cast("long")).alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"),
        (F.col("size") * (F.coalesce("whole", F.lit(0).cast("long")) + F.col("extra").cast("long"))).alias("taken"),
        (F.coalesce("whole", F.lit(0).cast("long")) + F.col("extra").cast("long")).alias("copies"),
        *(F.col("kept")[c].alias(c) for c in keep if c not in (id_col, "source", "size", "source_size", "target", "taken", "copies")),
    )
