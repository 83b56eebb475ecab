"""Exact and near duplicates, merges and components."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyline import catalog as C
from storyline.functions import text as T
from storyline.operators import clustering
from storyline.operators import similarity as N
from storyline.operators import state as S
from storyline.registry import query

_TOKENS = """t AS (SELECT doc_id, lang, source, list_distinct(list_filter(string_split(trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) > 2)) AS w FROM (SELECT doc_id, lang, source, translate(text, 'ß', ' ') AS text FROM documents)),
p AS (SELECT a.lang, a.source, a.doc_id AS a_id, b.doc_id AS b_id, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) AS score FROM t a JOIN t b ON a.lang = b.lang AND a.source = b.source AND a.doc_id < b.doc_id WHERE len(a.w) > 0 AND len(b.w) > 0)"""


@query("""SELECT doc_id, sha256(text) AS hash FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k = 1""")
def dedup_exact_hash(spark, sf_dir):
    """First document of each content hash: a minimum by hash, combined before the shuffle."""
    d = C.table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text"), F.lit(None).cast("string")).alias("hash"))
    return d.groupBy("hash").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "hash")


@query("""SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def latest_per_key(spark, sf_dir):
    e = C.table(spark, sf_dir, "events")
    last = e.groupBy("user_id", "event_type").agg(F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("x"))
    return last.select("x.event_id", "user_id", "event_type", "x.value")


@query(f"""WITH {_TOKENS} SELECT a_id, b_id, round(score, 6) AS score FROM p WHERE score >= 0.6""")
def near_dup_jaccard(spark, sf_dir):
    d = C.table(spark, sf_dir, "documents").select("lang", "source", F.col("doc_id").alias("id"), F.translate("text", "ß", " ").alias("text"))
    return N.token_pairs(d, ["lang", "source"], 0.6).select("a_id", "b_id", F.round("score", 6).alias("score"))


@query(f"""WITH RECURSIVE {_TOKENS}, e AS (SELECT a_id AS x, b_id AS y FROM p WHERE score >= 0.6 UNION SELECT b_id, a_id FROM p WHERE score >= 0.6),
r(id, reach) AS (SELECT x, x FROM e UNION SELECT r.id, e.y FROM r JOIN e ON r.reach = e.x) SELECT id, min(reach) AS component FROM r GROUP BY 1""")
def components_near_dup(spark, sf_dir):
    """Components of the near-duplicate links, by label propagation with jumps."""
    return clustering.components(near_dup_jaccard(spark, sf_dir), "a_id", "b_id")


@query("""SELECT trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g')) AS key, lang, min(doc_id) AS target, count(*) AS n FROM documents GROUP BY 1, 2""")
def exact_merge_to_min_id(spark, sf_dir):
    d = C.table(spark, sf_dir, "documents")
    return clustering.merge_equal(d, [clustering.title_key(F.col("text")).alias("key"), "lang"], "doc_id")


@query("""WITH s AS (SELECT doc_id, sha256(text) AS h, source FROM documents WHERE doc_id % 2 = 0), n AS (SELECT sha256(text) AS h, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents WHERE doc_id % 2 = 1 GROUP BY 1)
SELECT doc_id, h AS hash, source FROM s UNION ALL SELECT doc_id, h, source FROM n WHERE h NOT IN (SELECT h FROM s)""")
def insert_if_absent(spark, sf_dir):
    """Odd documents inserted into a store of even ones, unless their content is there."""
    d = C.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"), "source")
    return S.insert_absent(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"), ["hash"], [F.col("doc_id")])
