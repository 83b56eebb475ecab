"""Links between the members of bands, without comparing the members of a band that are known to belong together.

A band is led by its most central member, the one that meets most others in all its bands for its size: of a text
and its edited copies that is the text. Every member is compared with the leaders of its bands first, at a comparison
a membership, which ties up groups of copies; a tie is a component of these links. In a band that this leaves in several
ties, every member outside the band's largest tie is then compared with all members of other ties, whatever the size of the band: what shares a band
is compared or tied already. Bands are dealt out in blocks of both sides, so that a frequent band is shared by many
tasks, and a test inside the join keeps pairs that cannot be similar from being made.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyline.llm.common import bit_filter, drop, materialise, release, written
from storyline.llm.components import components

#: Members of a block: of those outside a band's largest tie, and of all.
BLOCK, AGAINST = 256, 4096


def _central(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """The members with n and ``met``: how many others they meet in all their bands, by their size."""
    cost = members.groupBy("key").agg(F.count("*").alias("cost"))
    met = members.join(cost, "key").groupBy("id").agg(F.sum("cost").alias("met")).join(sizes, "id")
    return members.join(met.select("id", "n", (F.col("met") / F.col("n")).alias("met")), "id").select("key", "id", "n", "met")


def _of_several_ties(tied: DataFrame) -> DataFrame:
    """Members (key, id, tie) of bands that hold several ties, with the largest tie and the number of blocks of either side."""
    of_key = tied.groupBy("key", "tie").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("tie", F.struct("n", "tie")).alias("main"), F.max("n").alias("held"), F.sum("n").alias("size"))
    mixed = of_key.where("held < size").select("key", "main", F.ceil((F.col("size") - F.col("held")) / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("size") / AGAINST).cast("int").alias("others"))
    return tied.join(mixed, "key")


def _between_ties(mixed: DataFrame, known: DataFrame, may: Callable[[Column, Column], Column]) -> DataFrame:
    """Pairs (a, b) of such members that share a band and not the tie, each once: in the least of the bands that it shares, which all are of several ties."""
    keys = mixed.groupBy("id").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    placed = mixed.join(bit_filter(known, "id", keys, "id").join(keys, "id"), "id")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    at = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    side = lambda name: F.struct("id", "tie", "n", "keys", "sketch").alias(name)
    left = placed.where("tie != main").select("key", at("blocks").alias("block"), each("others").alias("other"), side("x"))
    right = placed.select("key", each("blocks").alias("block"), at("others").alias("other"), (F.col("tie") == F.col("main")).alias("of_main"), side("y"))
    x, y = F.col("x"), F.col("y")
    # Two members outside the largest tie meet from both sides; the pair counts from the greater.
    once = (F.col("of_main") | (x["id"] > y["id"])) & (F.get(F.array_intersect(x["keys"], y["keys"]), F.lit(0)) == F.col("key"))
    met = left.join(right, ["key", "block", "other"]).where((x["tie"] != y["tie"]) & once & may(x, y))
    return met.select(F.greatest(x["id"], y["id"]).alias("a"), F.least(x["id"], y["id"]).alias("b"))


def leader_links(members: DataFrame, known: DataFrame, may: Callable[[Column, Column], Column], verify: Callable[[DataFrame], DataFrame], tag: str) -> DataFrame:
    """``members``: (key, id); ``known``: (id, n, sketch); ``may``: whether two of ``known``, as structs, can be similar; ``verify``: keeps the similar of pairs (a, b)."""
    spark = members.sparkSession
    central, central_path = written(_central(members, known.select("id", "n")), f"{tag}-members")
    leaders = central.groupBy("key").agg(F.max_by("id", F.struct("met", "id")).alias("leader"))
    star = central.join(leaders, "key").where("leader != id").select(F.greatest("id", "leader").alias("a"), F.least("id", "leader").alias("b")).distinct()
    first = materialise(verify(star), f"{tag}-star")
    ties = components(first, tag=f"{tag}-ties").select("id", F.col("component").alias("tie"))
    tied, tied_path = written(central.join(ties, "id", "left").select("key", "id", F.coalesce("tie", "id").alias("tie")), f"{tag}-tied")
    drop(spark, central_path)
    release(spark)
    mixed, mixed_path = written(_of_several_ties(tied), f"{tag}-mixed")
    drop(spark, tied_path)
    release(spark)
    met, met_path = written(_between_ties(mixed, known, may), f"{tag}-compared")
    release(spark)
    second = materialise(verify(met), f"{tag}-links")
    for path in (mixed_path, met_path):
        drop(spark, path)
    return first.union(second)
