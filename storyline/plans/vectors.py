"""Queries over the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyline import catalog as C
from storyline.functions import vectors as V
from storyline.operators import similarity as N
from storyline.operators import vectorjoin as X
from storyline.registry import query
from storyline.streaming import streams
from storyline.streaming import vectors as W


def _vectors(spark, sf_dir):
    return C.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("tag"))


_V = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vector, label AS tag FROM embeddings)"


@query(f"""WITH {_V} SELECT v.id, round(list_cosine_similarity(v.vector, q.vector), 4) AS score FROM v, v q WHERE q.id = 3 AND v.id <> 3 AND round(list_cosine_similarity(v.vector, q.vector), 4) >= 0.1 ORDER BY score DESC, v.id LIMIT 5""")
def knn_topk(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return N.knn(v, v.where("id = 3"), 5, 0.1)


@query(f"""WITH {_V}, p AS (SELECT a.id AS a_id, b.id AS b_id, round(list_cosine_similarity(a.vector, b.vector), 4) AS score FROM v a JOIN v b ON a.tag = b.tag AND a.id < b.id) SELECT * FROM p WHERE score >= 0.3""")
def vector_pairs_blocked(spark, sf_dir):
    return X.scored_pairs(_vectors(spark, sf_dir), "tag", 0.3).select("a_id", "b_id", "score")


@query("""SELECT label AS tag, CAST(pos - 1 AS INTEGER) AS pos, round(avg(x), 6) AS value FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2""")
def centroids(spark, sf_dir):
    return N.centroids(_vectors(spark, sf_dir), "tag").select("tag", "pos", F.round("value", 6).alias("value"))


@query(f"""WITH {_V}, p AS (SELECT b.id, a.id AS m, round(list_cosine_similarity(a.vector, b.vector), 4) AS s FROM v a JOIN v b ON a.tag = b.tag AND a.id < b.id)
SELECT id, m AS match_id, s AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, m) AS k FROM p WHERE s >= 0.2) WHERE k = 1""")
def semantic_dup_best_match(spark, sf_dir):
    return X.best_earlier(_vectors(spark, sf_dir), "tag", 0.2)


@query(f"""WITH RECURSIVE {_V}, e AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.tag = b.tag AND a.id < b.id AND list_cosine_similarity(a.vector, b.vector) > 0.3),
o AS (SELECT id, tag, row_number() OVER (PARTITION BY tag ORDER BY id) AS k FROM v), n AS (SELECT o.id, o.tag, o.k, coalesce(list(e.a) FILTER (e.a IS NOT NULL), []) AS near FROM o LEFT JOIN e ON e.b = o.id GROUP BY ALL),
r(tag, k, heads) AS (SELECT tag, 0, CAST([] AS BIGINT[]) FROM (SELECT DISTINCT tag FROM v) UNION ALL SELECT n.tag, n.k, CASE WHEN list_has_any(r.heads, n.near) THEN r.heads ELSE list_append(r.heads, n.id) END FROM r JOIN n ON n.tag = r.tag AND n.k = r.k + 1),
h AS (SELECT tag, unnest(arg_max(heads, k)) AS head FROM r GROUP BY tag)
SELECT v.tag, v.id, coalesce(min(e.a), v.id) AS leader FROM v LEFT JOIN h g ON g.head = v.id LEFT JOIN (SELECT e.* FROM e JOIN h ON h.head = e.a) e ON e.b = v.id AND g.head IS NULL GROUP BY v.tag, v.id""")
def leader_clusters(spark, sf_dir):
    """Order-dependent greedy clustering within a tag, in rounds."""
    return X.leaders(_vectors(spark, sf_dir), "tag", 0.3)


@query()
def vector_codec(spark, sf_dir):
    """float32 blobs there and back, and the stand-in embedding's length and norm."""
    v = _vectors(spark, sf_dir).withColumn("back", V.decode_float32(V.encode_float32("vector")))
    s = V.stub_embedding(F.col("id").cast("string"))
    return v.select("id", (F.col("back") == F.col("vector")).alias("same"), F.size(s).alias("n"), F.round(V.norm(s), 3).alias("norm"))


@query(f"""WITH {_V}, f AS (SELECT tag, count(*) AS n FROM v GROUP BY 1) SELECT tag, n FROM f""")
def running_centroids(spark, sf_dir):
    """Tags with their late-weighted centroid (its length is checked here, its values in tests)."""
    g = _vectors(spark, sf_dir).groupBy("tag").agg(F.array_sort(F.collect_list(F.struct("id", "vector"))).alias("r"))
    c = g.withColumn("centroid", V.running_centroid(F.transform("r", lambda x: x["vector"])))
    return c.where(F.size("centroid") == 64).select("tag", F.size("r").cast("long").alias("n"))


def _arrivals(spark, sf_dir, files=100):
    """The embeddings as a stream of articles, one a minute."""
    batch = C.table(spark, sf_dir, "embeddings")
    stream = streams.file_stream(spark, f"{sf_dir}/embeddings.parque[t]", batch.schema, files=files)
    at = F.timestamp_seconds(F.lit(1704067200) + 60 * F.col("vec_id"))
    return stream.select(F.col("vec_id").alias("article_id"), F.col("label").alias("tag"), F.col("embedding").alias("vector"), at.alias("ts"))


@query("""WITH RECURSIVE v AS (SELECT vec_id AS id, label AS tag, vec_id // 1440 AS day, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER (PARTITION BY label, vec_id // 1440 ORDER BY vec_id) AS k FROM embeddings),
r(tag, day, k, id, cluster_id, score, ids, cents) AS (SELECT tag, day, k, id, id, CAST(NULL AS DOUBLE), [id], [e] FROM v WHERE k = 1
UNION ALL SELECT tag, day, k, id, CASE WHEN best > 0.2 THEN ids[p] ELSE id END, CASE WHEN best > 0.2 THEN round(best, 4) END, CASE WHEN best > 0.2 THEN ids ELSE list_append(ids, id) END,
  CASE WHEN best > 0.2 THEN list_transform(cents, lambda c, i: CASE WHEN i = p THEN list_transform(list_zip(c, e), lambda z: (z[1] + z[2]) / 2) ELSE c END) ELSE list_append(cents, e) END
  FROM (SELECT *, list_max(s) AS best, list_position(s, list_max(s)) AS p FROM (SELECT r.tag, r.day, v.k, v.id, v.e, r.ids, r.cents, list_transform(r.cents, lambda c: list_cosine_similarity(c, v.e)) AS s FROM r JOIN v ON v.tag = r.tag AND v.day = r.day AND v.k = r.k + 1)))
SELECT id AS article_id, cluster_id, score FROM r""")
def stream_assignment(spark, sf_dir):
    """Articles of a stream put into the clusters of their tag and day, whose centroids run along."""
    return streams.drain(W.assign(_arrivals(spark, sf_dir), 0.2)).select("article_id", "cluster_id", "score")


@query(f"""WITH {_V}, p AS (SELECT b.id, a.id AS m, round(list_cosine_similarity(a.vector, b.vector), 4) AS s FROM v a JOIN v b ON a.tag = b.tag AND a.id < b.id AND b.id - a.id <= 2880)
SELECT id AS article_id, m AS match_id, s AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, m) AS k FROM p WHERE s >= 0.3) WHERE k = 1""")
def stream_semantic_window(spark, sf_dir):
    """The most similar earlier article of the tag within 48 hours of event time."""
    to = X.pivots(C.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 16)
    return W.best_match(streams.drain(W.similar_within(_arrivals(spark, sf_dir), to, 0.3)))
