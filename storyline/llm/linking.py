"""Links between members of buckets, as few comparisons as components need.

Each bucket is led by its most central member, the one that meets most others in all its buckets: of a text and
its edited copies that is the text. Members are compared with their leaders first, which ties up groups of copies
by a comparison or so a member. Then only members of different components that share a leader meet, a pair once
however many buckets it shares. Every pair in a bucket is either compared or in one component already, so no link
that would join components is lost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyline.llm.common import materialise
from storyline.llm.components import components


def bucket_links(
    members: DataFrame, probes: DataFrame, sizes: DataFrame, fits: Callable[..., Column], verify: Callable[[DataFrame], DataFrame], tag: str
) -> DataFrame:
    """``members``, ``probes``: (key, id), the probes being the members that comparisons start from; ``sizes``: (id, n, sketch);
    ``fits``: whether sets of n (the probe's) and m with their sketches can be similar; ``verify``: keeps the similar of pairs (a, b)."""
    cost = members.groupBy("key").agg(F.count("*").alias("cost"))
    central = members.join(cost, "key").groupBy("id").agg(F.sum("cost").alias("met")).join(sizes.select("id", "n"), "id").select("id", (F.col("met") / F.col("n")).alias("met"))
    leaders = materialise(members.join(central, "id").groupBy("key").agg(F.max(F.struct("met", "id")).alias("x")).select("key", F.col("x.id").alias("leader")), f"{tag}-leaders")
    led = materialise(members.join(leaders, "key").select("leader", "id").distinct(), f"{tag}-led")
    asked = materialise(probes.join(leaders, "key").select("leader", "id").distinct(), f"{tag}-asked")
    pair = (F.col("n"), F.col("m"), F.col("sketch"), F.col("other_sketch"))
    against = sizes.select(F.col("id").alias("leader"), F.col("n").alias("m"), F.col("sketch").alias("other_sketch"))
    star = asked.where("leader != id").join(sizes, "id").join(against, "leader").where(fits(*pair) | fits(pair[1], pair[0], *pair[2:]))
    first = verify(star.select(F.greatest("id", "leader").alias("a"), F.least("id", "leader").alias("b")).distinct())
    parts = components(first, tag=f"{tag}-parts")
    placed = materialise(led.join(parts, "id", "left").join(sizes, "id").select("leader", "id", "n", "sketch", F.coalesce("component", "id").alias("part")), f"{tag}-placed")
    mixed = placed.groupBy("leader").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p != q").select("leader")
    left = asked.join(placed, ["leader", "id"]).join(mixed, "leader")
    right = placed.join(mixed, "leader").select("leader", F.col("id").alias("other"), F.col("n").alias("m"), F.col("part").alias("other_part"), F.col("sketch").alias("other_sketch"))
    rest = left.join(right, "leader").where((F.col("part") != F.col("other_part")) & fits(*pair) & (F.col("other") != F.col("leader")))
    return first.union(verify(rest.select(F.greatest("id", "other").alias("a"), F.least("id", "other").alias("b")).distinct()))
