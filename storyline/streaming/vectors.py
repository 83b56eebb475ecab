"""Streams of article vectors: online assignment to the day's clusters, and semantic duplicates within a horizon of event time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from storyline.operators import vectorjoin as X
from storyline.streaming.streams import event_time

ASSIGNED = "tag {tag}, day date, article_id long, cluster_id long, is_new boolean, score double"
CLUSTERS = "ids array<long>, centroids array<array<double>>"


class Centroids:
    """A tag's clusters of a day: a row each, the mean of the last centroid and each article that joined."""

    def __init__(self, ids: list[int], centroids: list[list[float]]):
        self.ids, self.rows = list(ids), [np.asarray(c, float) for c in centroids]

    def place(self, article: int, vector, threshold: float) -> tuple[int, bool, float | None]:
        """(cluster, whether it is new, score): the most similar cluster over the threshold, the oldest on a tie, else a new one.
        An article without a direction is a cluster that no other joins."""
        v = None if vector is None else np.asarray(vector, float)
        if v is None or not len(v) or not np.isfinite(v).all() or not v.any():
            return article, True, None
        scores = [float(c @ v / np.sqrt((c @ c) * (v @ v))) if len(c) == len(v) and c.any() else -1.0 for c in self.rows]
        best = int(np.argmax(scores)) if scores else -1
        if best >= 0 and scores[best] > threshold:
            self.rows[best] = (self.rows[best] + v) / 2
            return self.ids[best], False, round(scores[best], 4)
        self.ids.append(article)
        self.rows.append(v)
        return article, True, None


def assign(rows: DataFrame, threshold: float = 0.7, late: str = "1 hour") -> DataFrame:
    """(tag, day, article_id, cluster_id, is_new, score) of a stream (article_id, tag, vector, ts): each article joins the most
    similar of its tag's clusters of its day, whose centroid moves half way to it, or founds one.

    A tag's day is the state of one key. Within a batch articles go in order of event time and id and meet one another;
    batches go in their order, so the result is that of one loop over them. The state of a day ends with the watermark,
    and articles that come still later found clusters anew. Articles without time or id are left out.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = Centroids(*state.get) if state.exists else Centroids([], [])
        parts = list(batches)
        batch = (pd.concat(parts) if len(parts) > 1 else parts[0]).sort_values(["ts", "article_id"], kind="stable")
        placed = [held.place(int(a), v, threshold) for a, v in zip(batch["article_id"], batch["vector"], strict=True)]
        state.update((held.ids, [c.tolist() for c in held.rows]))
        over = int((pd.Timestamp(key[1]) + pd.Timedelta(days=1)).timestamp() * 1000)
        state.setTimeoutTimestamp(max(over, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({
            "tag": batch["tag"].to_numpy(), "day": key[1], "article_id": batch["article_id"].to_numpy(), "cluster_id": [p[0] for p in placed], "is_new": [p[1] for p in placed], "score": pd.array([p[2] for p in placed], "Float64"),
        })

    kind = rows.schema["tag"].dataType.simpleString()
    known = event_time(rows.where("ts is not null and article_id is not null").select("article_id", "tag", "vector", "ts")).withWatermark("ts", late)
    return known.withColumn("day", F.to_date("ts")).groupBy("tag", "day").applyInPandasWithState(step, ASSIGNED.format(tag=kind), CLUSTERS, "append", GroupStateTimeout.EventTimeTimeout)


def similar_within(rows: DataFrame, pivots: np.ndarray, least: float = 0.85, horizon: str = "48 hours", late: str = "48 hours") -> DataFrame:
    """(article_id, match_id, score) of a stream (article_id, tag, vector, ts): pairs of a tag whose times are at most the horizon
    apart and whose rounded cosine is at least ``least``, the later article (by time, then id) first.

    Rows meet in cells around the given pivots (any directions serve; good ones part the rows), which lose no pair, see
    ``vectorjoin``. Both sides of the join are kept by event time: a row is forgotten once the watermark has passed it by
    the horizon. The result is defined by event times alone, in any number of batches, as long as no row is later than
    ``late``; rows without time, id, tag or direction, or of another length than the pivots, have no pairs.
    """
    known = event_time(rows.where("ts is not null and article_id is not null and tag is not null").select("article_id", "tag", "ts", X.unit(F.col("vector")).alias("u")))
    bound = least - 6e-5
    dealt = known.withWatermark("ts", late).withColumn("c", X.cells(pivots, bound)("u")).where("c.home is not null")
    home = dealt.select("tag", F.col("c.home").alias("cell"), F.col("article_id").alias("x"), F.col("ts").alias("x_ts"), F.col("u").alias("x_u"))
    guests = dealt.select(F.col("tag").alias("y_tag"), F.explode(F.filter("c.visited", lambda v: v <= F.col("c.home"))).alias("y_cell"), F.col("c.home").alias("y_home"), F.col("article_id").alias("y"), F.col("ts").alias("y_ts"), F.col("u").alias("y_u"))
    x_later = (F.col("x_ts") > F.col("y_ts")) | ((F.col("x_ts") == F.col("y_ts")) & (F.col("x") > F.col("y")))
    cosine = F.round(F.aggregate(F.zip_with("x_u", "y_u", lambda a, b: a * b), F.lit(0.0), lambda s, z: s + z), 4)
    span = F.expr(f"interval {horizon}")
    near = (F.col("y_ts") >= F.col("x_ts") - span) & (F.col("y_ts") <= F.col("x_ts") + span)
    met = home.join(guests, (F.col("tag") == F.col("y_tag")) & (F.col("cell") == F.col("y_cell")) & near & ((F.col("y_home") != F.col("cell")) | x_later) & (F.col("x") != F.col("y")) & (cosine >= least))
    return met.select(F.when(x_later, F.col("x")).otherwise(F.col("y")).alias("article_id"), F.when(x_later, F.col("y")).otherwise(F.col("x")).alias("match_id"), cosine.alias("score"))


def best_match(pairs: DataFrame) -> DataFrame:
    """For each article its most similar earlier one, the least id on a tie."""
    best = F.max_by(F.struct("match_id", "score"), F.struct("score", (-F.col("match_id")).alias("m"))).alias("b")
    return pairs.groupBy("article_id").agg(best).select("article_id", "b.match_id", "b.score")
