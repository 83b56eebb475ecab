"""Cosine joins, leaders in rounds and streams of vectors against plain loops."""

import datetime as dt
import glob
import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from storyline import registry
from storyline.operators import similarity
from storyline.operators import vectorjoin as X
from storyline.streaming import streams
from storyline.streaming import vectors as W

SCHEMA = "id long, tag string, vector array<double>"


def clustered(seed, n=400, width=6, spread=0.15):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, width))
    return [(i, "ab"[int(rng.random() < 0.3)], (centres[rng.integers(7)] * rng.uniform(0.5, 2) + spread * rng.normal(size=width)).tolist()) for i in range(n)]


def cosine(v, w):
    if v is None or w is None or len(v) != len(w) or not len(v) or None in v or None in w:
        return 0.0
    v, w = np.array(v), np.array(w)
    d = np.linalg.norm(v) * np.linalg.norm(w)
    return float(v @ w / d) if d else 0.0


def plain_pairs(rows, least):
    return {(min(i, j), max(i, j)) for i, t, v in rows for j, u, w in rows if i < j and t == u and t is not None and cosine(v, w) >= least}


@pytest.mark.parametrize("least", [0.3, 0.7, 0.95])
def test_pairs_equal_all_pairs(spark, least, monkeypatch):
    monkeypatch.setattr(X, "PART", 20)
    rows = [*clustered(1), (900, "a", None), (901, "a", []), (902, "a", [0.0] * 6), (903, None, [1.0] * 6), (904, "a", [1.0, 2.0]), (905, "a", [2.0, 4.0]), (906, "b", [1.0, 2.0])]
    rows += [(1000 + k, "b", [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for k in range(60)]
    got = X.cosine_pairs(spark.createDataFrame(rows, SCHEMA), "tag", least).collect()
    assert len(got) == len({(r["a_id"], r["b_id"]) for r in got}) and {(r["a_id"], r["b_id"]) for r in got} == plain_pairs(rows, least)


def test_index_prunes(spark):
    """Of clustered vectors few pairs meet that are not similar."""
    rows = clustered(2, n=600, spread=0.05)
    at_home, visiting, _ = X.placed(spark.createDataFrame(rows, SCHEMA), "tag", 0.95)
    met = sum(r["compared"] for r in X.comparisons(at_home, visiting).collect())
    n = [sum(t == x for _, t, _ in rows) for x in "ab"]
    assert len(plain_pairs(rows, 0.95)) <= met < 0.5 * sum(k * (k - 1) / 2 for k in n)


def plain_leaders(rows, threshold):
    leaders, out = {}, {}
    for i, t, v in sorted(rows):
        hit = next((k for k, w in leaders.get(t, []) if t is not None and cosine(v, w) > threshold), None)
        if hit is None:
            leaders.setdefault(t, []).append((i, v))
        out[i] = i if hit is None else hit
    return out


@pytest.mark.parametrize(("seed", "threshold"), [(3, 0.7), (4, 0.5), (5, 0.9)])
def test_leaders_equal_the_loop(spark, seed, threshold):
    rows = [*clustered(seed, 250, 3, 0.8), (900, "a", None), (901, None, [1.0, 1.0, 1.0]), (902, None, [1.0, 1.0, 1.0]), (903, "c", [0.0, 0.0, 0.0])]
    got = {r["id"]: r["leader"] for r in X.leaders(spark.createDataFrame(rows, SCHEMA), "tag", threshold).collect()}
    assert got == plain_leaders(rows, threshold)


def test_empty_and_lone_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert X.cosine_pairs(empty, "tag", 0.5).count() == 0 and X.leaders(empty, "tag").count() == 0
    lone = spark.createDataFrame([(1, "a", [1.0])], SCHEMA)
    assert [tuple(r) for r in X.leaders(lone, "tag").collect()] == [("a", 1, 1)] and X.best_earlier(lone, "tag", 0.1).count() == 0


def test_vectors_without_structure_are_not_copied_to_cells(spark):
    """Where pivots part nothing, a row visits one cell, and its norm is no part of what is done for each component."""
    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([(i, "a", rng.normal(size=32).tolist()) for i in range(300)], SCHEMA)
    at_home, visiting, _ = X.placed(rows, "tag", 0.3)
    assert at_home.count() == visiting.count() == 300
    plan = rows.select(X.unit(F.col("vector")).alias("u"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("aggregate(") == 1


def test_best_earlier_breaks_ties_by_rounded_scores(spark, monkeypatch):
    monkeypatch.setattr(X, "PART", 30)
    rows = [(i, t, [round(x, 1) for x in v]) for i, t, v in clustered(10, 200, 3, 0.3)]
    want = {}
    for j, t, v in rows:
        near = [(-round(cosine(v, w), 4), i) for i, u, w in rows if i < j and t == u and round(cosine(v, w), 4) >= 0.5]
        if near:
            want[j] = min(near)
    got = {r["id"]: (-r["score"], r["match_id"]) for r in X.best_earlier(spark.createDataFrame(rows, SCHEMA), "tag", 0.5).collect()}
    assert got == want
    few = X.scored_pairs(spark.createDataFrame(rows, SCHEMA), "tag", 0.5, near_best=1.1e-4).count()
    assert few < X.scored_pairs(spark.createDataFrame(rows, SCHEMA), "tag", 0.5).count() / 4


def test_leaders_write_no_links(spark):
    """What rounds write grows with the rows, not with the pairs of a large group of copies."""
    def written():
        return sum(pq.read_metadata(f).num_rows for f in glob.glob(f"{spark.conf.get('spark.checkpoint.dir').removeprefix('file:')}/leader-*/*.parquet"))

    before = written()
    got = X.leaders(spark.createDataFrame([(i, "a", [1.0, 2.0]) for i in range(500)], SCHEMA), "tag", 0.5)
    assert {r["leader"] for r in got.collect()} == {0} and written() - before <= 1500


def test_leaders_in_many_rounds(spark, monkeypatch):
    monkeypatch.setattr(X, "FIRST", 32)
    monkeypatch.setattr(X, "PART", 64)
    rows = clustered(9, 400, 6, 1.5)
    got = {r["id"]: r["leader"] for r in X.leaders(spark.createDataFrame(rows, SCHEMA), "tag", 0.8).collect()}
    assert got == plain_leaders(rows, 0.8)


def arrivals(spark, folder, rows, files):
    """Rows (id, tag, vector) a minute apart and in so many files of their order, as a stream of a few files a batch."""
    folder.mkdir()
    start = dt.datetime(2024, 1, 1, 20)
    for k, part in enumerate(np.array_split(np.arange(len(rows)), files)):
        of = [rows[i] for i in part]
        table = pa.table({
            "article_id": pa.array([r[0] for r in of], pa.int64()), "tag": [r[1] for r in of], "vector": pa.array([r[2] for r in of], pa.list_(pa.float64())),
            "ts": pa.array([start + dt.timedelta(minutes=r[0]) for r in of], pa.timestamp("us")),
        })
        pq.write_table(table, folder / f"{k:03}.parquet")
        os.utime(folder / f"{k:03}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    return streams.file_stream(spark, str(folder), "article_id long, tag string, vector array<double>, ts timestamp_ntz", files=1 if files <= 4 else 25)


def plain_assignment(rows, threshold):
    held, out = {}, {}
    for i, t, v in rows:
        day = (dt.datetime(2024, 1, 1, 20) + dt.timedelta(minutes=i)).date()
        clusters = held.setdefault((t, day), [])
        scores = [cosine(v, c) for _, c in clusters]
        k = int(np.argmax(scores)) if scores else -1
        if k >= 0 and scores[k] > threshold:
            clusters[k] = (clusters[k][0], ((np.array(clusters[k][1]) + np.array(v)) / 2).tolist())
            out[i] = clusters[k][0]
        else:
            if cosine(v, v):
                clusters.append((i, v))
            out[i] = i
    return out


@pytest.mark.parametrize("files", [1, 4, 100])
def test_assignment_equals_the_loop(spark, tmp_path, files):
    """Articles of one batch meet, state goes on over batches, a day's clusters end with it (midnight falls among the rows)."""
    rows = [*clustered(6, 500, 4, 0.4), (500, "a", None), (501, "a", [0.0] * 4), (502, "b", [1.0, 0.0, 0.0, 0.0])]
    got = {r["article_id"]: r["cluster_id"] for r in streams.drain(W.assign(arrivals(spark, tmp_path / "in", rows, files), 0.7)).collect()}
    want = plain_assignment(rows, 0.7)
    assert got == want and 10 < len(set(want.values())) < 300


@pytest.mark.parametrize("files", [1, 100])
def test_semantic_window_is_that_of_event_time(spark, tmp_path, files):
    rows = clustered(7, 500, 5, 0.5)
    rows = [(i if i < 250 else i + 4000, t, v) for i, t, v in rows] + [(4500, "a", None), (4501, "a", [0.0] * 5)]
    to = X.pivots(spark.createDataFrame(rows, SCHEMA), "id", "vector", 8)
    pairs = streams.drain(W.similar_within(arrivals(spark, tmp_path / "in", rows, files), to, 0.8)).collect()
    want = {(j, i) for i, j in plain_pairs([r for r in rows if r[2]], 0.8 - 5e-5) if j - i <= 48 * 60}
    assert {(r["article_id"], r["match_id"]) for r in pairs} == want and len(pairs) == len(want) > 100


def test_best_match(spark):
    pairs = spark.createDataFrame([(5, 1, 0.9), (5, 2, 0.9), (5, 3, 0.8), (6, 5, 0.7)], "article_id long, match_id long, score double")
    assert sorted(tuple(r) for r in W.best_match(pairs).collect()) == [(5, 1, 0.9), (6, 5, 0.7)]


def test_centroids_of_batches(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 4.0])], "tag string, vector array<double>")
    assert [tuple(r) for r in similarity.centroid_arrays(df, "tag").collect()] == [("a", [2.0, 3.0])]


def test_a_name_is_registered_once():
    def feed_page(spark, sf_dir):
        return None

    with pytest.raises(ValueError, match="feed_page"):
        registry.query()(feed_page)
