"""Counts, profiles and rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyline import catalog as C
from storyline import domain as D
from storyline.functions import dates, jsonx
from storyline.functions import text as T
from storyline.operators import bi
from storyline.plans.feed import _ARTICLES, _CLUSTERS
from storyline.registry import query

_SOURCES = """src AS (SELECT s_suppkey AS source_id, s_name AS source, CASE r_name WHEN 'AMERICA' THEN 'brasil_fisico' WHEN 'EUROPE' THEN 'brasil_online' ELSE 'internacional' END AS source_type
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


@query(f"""WITH {_ARTICLES}, {_SOURCES} SELECT count(*) FILTER (source_type <> 'internacional') AS nacional, count(*) FILTER (source_type = 'brasil_fisico') AS fisico, count(*) FILTER (source_type = 'brasil_online') AS online,
count(*) FILTER (source_type = 'internacional') AS internacional FROM arts JOIN src USING (source_id)""")
def counts_by_source_type(spark, sf_dir):
    t = F.col("source_type")
    rows = C.cluster_articles(spark, sf_dir).join(C.sources(spark, sf_dir), "source_id")
    return rows.agg(F.count_if(t != "internacional").alias("nacional"), F.count_if(t == "brasil_fisico").alias("fisico"), F.count_if(t == "brasil_online").alias("online"), F.count_if(t == "internacional").alias("internacional"))


@query("""WITH a AS (SELECT cast(ts AS DATE) AS day, count(*) AS n_articles FROM events GROUP BY 1), c AS (SELECT cast(ts AS DATE) AS day, count(*) AS n_clusters FROM events WHERE event_type = 'purchase' AND value > 60 GROUP BY 1)
SELECT CAST(a.day AS VARCHAR) AS day, n_articles, coalesce(n_clusters, 0) AS n_clusters FROM a LEFT JOIN c ON a.day = c.day""")
def series_by_day(spark, sf_dir):
    e = C.table(spark, sf_dir, "events").withColumnRenamed("ts", "created_at")
    return bi.series_by_day(e, e.where("event_type = 'purchase' and value > 60")).withColumn("day", F.col("day").cast("string"))


@query("""SELECT source AS name, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10""")
def top_sources(spark, sf_dir):
    return bi.top_counts(C.table(spark, sf_dir, "documents"), F.col("source"), 10)


@query("""WITH c AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1), r AS (SELECT p_type, n, row_number() OVER (ORDER BY n DESC, p_type) AS k FROM c)
SELECT CASE WHEN k <= 3 THEN p_type ELSE 'Outros' END AS p_type, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1""")
def top_tags_others(spark, sf_dir):
    return bi.top_and_rest(C.table(spark, sf_dir, "part"), "p_type", 3)


@query(f"""WITH {_CLUSTERS} SELECT priority, count(*) AS n FROM clusters WHERE status = 'ativo' AND priority <> 'IRRELEVANTE' GROUP BY 1""")
def by_priority(spark, sf_dir):
    return C.clusters(spark, sf_dir).where((F.col("status") == D.ACTIVE) & (F.col("priority") != D.IRRELEVANT)).groupBy("priority").agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS total, count(DISTINCT source) AS n_sources, count(DISTINCT lang) AS n_langs, count(*) FILTER (lang = 'en') AS n_foreign, count(*) FILTER (lang <> 'en') AS n_national, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents""")
def general_stats(spark, sf_dir):
    d = C.table(spark, sf_dir, "documents")
    return d.agg(F.count("*").alias("total"), F.countDistinct("source").alias("n_sources"), F.countDistinct("lang").alias("n_langs"), F.count_if(F.col("lang") == "en").alias("n_foreign"), F.count_if(F.col("lang") != "en").alias("n_national"), F.sum("n_chars").alias("chars"))


@query("""SELECT 'documents' AS metric, count(*) AS n FROM documents UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'orders_open', count(*) FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'events', count(*) FROM events""")
def db_stats(spark, sf_dir):
    o = C.table(spark, sf_dir, "orders")
    return bi.named_counts(documents=C.table(spark, sf_dir, "documents"), orders=o, orders_open=o.where("o_orderstatus = 'O'"), events=C.table(spark, sf_dir, "events"))


@query("""SELECT lang, count(*) AS n, count(text) AS n_text, round(avg(length(text)), 4) AS avg_chars, min(length(text)) AS min_chars, max(length(text)) AS max_chars, count(*) FILTER (length(text) < 500) AS n_short FROM documents GROUP BY lang""")
def doc_profile_by_lang(spark, sf_dir):
    n = F.char_length("text")
    return C.table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count("*").alias("n"), F.count("text").alias("n_text"), F.round(F.avg(n), 4).alias("avg_chars"), F.min(n).cast("long").alias("min_chars"), F.max(n).cast("long").alias("max_chars"), F.count_if(n < 500).alias("n_short")
    )


@query("""SELECT json_extract_string(props, '$.k') AS k, count(*) AS n, count(*) FILTER (value > 50) AS n_high FROM events GROUP BY 1 ORDER BY n DESC, k LIMIT 20""")
def json_group(spark, sf_dir):
    rows = C.table(spark, sf_dir, "events").groupBy(jsonx.field(F.col("props"), "k").alias("k")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("n_high"))
    return rows.orderBy(F.desc("n"), "k").limit(20)


@query("""SELECT size, count(*) AS n_groups FROM (SELECT count(*) AS size FROM lineitem GROUP BY l_orderkey) GROUP BY size""")
def cluster_size_histogram(spark, sf_dir):
    return bi.size_histogram(C.table(spark, sf_dir, "lineitem"), "l_orderkey")


@query(f"""WITH {_ARTICLES}, {_SOURCES} SELECT cluster_id, CASE min(CASE source_type WHEN 'internacional' THEN 0 WHEN 'brasil_fisico' THEN 1 ELSE 2 END) WHEN 0 THEN 'internacional' WHEN 1 THEN 'brasil_fisico' ELSE 'brasil_online' END AS source_type
FROM arts JOIN src USING (source_id) GROUP BY 1""")
def source_type_precedence(spark, sf_dir):
    rows = C.cluster_articles(spark, sf_dir).join(C.sources(spark, sf_dir), "source_id")
    return bi.precedence(rows, "cluster_id", "source_type", ("internacional", "brasil_fisico", "brasil_online"))


@query("""SELECT source AS key, count(*) FILTER (quality = 1) AS likes, count(*) FILTER (quality <> 1) AS dislikes, CAST(round_even(count(*) FILTER (quality <> 1) * 100.0 / count(*), 0) AS BIGINT) AS dislike_rate
FROM documents JOIN labels USING (doc_id) GROUP BY 1 HAVING count(*) >= 5""")
def feedback_patterns(spark, sf_dir):
    rows = C.table(spark, sf_dir, "documents").select("doc_id", "source").join(C.table(spark, sf_dir, "labels"), "doc_id")
    return bi.rates(rows, F.col("source"), F.col("quality") == 1, 5)


@query("""WITH w AS (SELECT unnest(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\x0B]+')) AS w FROM documents),
k AS (SELECT regexp_replace(w, '^[.,;:!?()\\[\\]{}"'']+|[.,;:!?()\\[\\]{}"'']+$', '', 'g') AS word FROM w WHERE length(w) > 3 AND w NOT IN ('para', 'como', 'mais', 'entre', 'sobre'))
SELECT word, count(*) AS n FROM k GROUP BY 1 HAVING count(*) >= 3 ORDER BY n DESC, word LIMIT 15""")
def word_counts(spark, sf_dir):
    words = C.table(spark, sf_dir, "documents").select(F.explode(T.keywords(F.col("text"))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where("n >= 3").orderBy(F.desc("n"), "word").limit(15)


@query("""SELECT CAST(cast(ts - INTERVAL 3 HOUR AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY 1""")
def brazil_day_bucket(spark, sf_dir):
    return C.table(spark, sf_dir, "events").groupBy(dates.local_date(F.col("ts").cast("timestamp")).cast("string").alias("day")).agg(F.count("*").alias("n"))


@query("""SELECT event_id, CASE WHEN s >= 86400 THEN 'há ' || (s // 86400) || ' dias' WHEN s >= 3600 THEN 'há ' || (s // 3600) || ' horas' WHEN s >= 60 THEN 'há ' || (s // 60) || ' minutos' ELSE 'há poucos segundos' END AS label
FROM (SELECT event_id, CAST(epoch(TIMESTAMP '2024-02-01') AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)""")
def relative_time_label(spark, sf_dir):
    return C.table(spark, sf_dir, "events").select("event_id", dates.age_label(F.col("ts").cast("timestamp"), F.lit("2024-02-01").cast("timestamp")).alias("label"))


@query("""SELECT round(sum(length(text)) / 4.0 / 1e6 * 0.3 + sum(length(text)) / 4.0 * 0.2 / 1e6 * 2.5, 6) AS usd, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents""")
def token_cost(spark, sf_dir):
    chars = F.sum(F.char_length("text"))
    return C.table(spark, sf_dir, "documents").agg(F.round(bi.token_cost(chars, *D.MODEL_PRICES[1]), 6).alias("usd"), chars.alias("chars"))


@query(f"""WITH {_CLUSTERS} SELECT owner_id, cluster_id FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY created_at DESC, cluster_id DESC) AS k FROM clusters) WHERE k = 1""")
def latest_summary_per_user(spark, sf_dir):
    return C.clusters(spark, sf_dir).groupBy("owner_id").agg(F.max_by("cluster_id", F.struct("created_at", "cluster_id")).alias("cluster_id"))


@query("""SELECT c_mktsegment AS level, string_agg(c_name, ',' ORDER BY c_custkey) AS items, count(*) AS n FROM customer GROUP BY 1""")
def grouped_lists(spark, sf_dir):
    rows = C.table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("level")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))).alias("i"), F.count("*").alias("n"))
    return rows.select("level", F.array_join(F.transform("i", lambda x: x["c_name"]), ",").alias("items"), "n")
