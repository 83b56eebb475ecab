"""Feed, grids, lookups and nested joins over clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyline import catalog as C
from storyline.functions import text as T
from storyline.operators import bi
from storyline.operators import feed as O
from storyline.registry import query

_CLUSTERS = """clusters AS (SELECT o_orderkey AS cluster_id, o_custkey AS owner_id, o_orderdate AS created_at, o_totalprice AS weight,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'P1_CRITICO' WHEN '2-HIGH' THEN 'P2_ESTRATEGICO' WHEN '5-LOW' THEN 'IRRELEVANTE' ELSE 'P3_MONITORAMENTO' END AS priority,
  CASE o_orderstatus WHEN 'O' THEN 'ativo' WHEN 'P' THEN 'arquivado' ELSE 'descartado' END AS status FROM orders)"""
_ARTICLES = """arts AS (SELECT l_orderkey AS cluster_id, l_orderkey * 10 + l_linenumber AS article_id, l_linenumber AS line, l_suppkey AS source_id, l_partkey AS entity_id,
  CASE l_returnflag WHEN 'A' THEN 'like' WHEN 'R' THEN 'dislike' END AS feedback, l_shipdate AS created_at FROM lineitem)"""
_RANK = "CASE priority WHEN 'P1_CRITICO' THEN 1 WHEN 'P2_ESTRATEGICO' THEN 2 ELSE 3 END"
_RELEVANT = "status = 'ativo' AND priority <> 'IRRELEVANTE'"
START, END = "1997-01-01", "1998-01-01"
_SPAN = f"created_at >= TIMESTAMP '{START}' AND created_at < TIMESTAMP '{END}'"


def _year(clusters):
    return O.relevant(clusters, F.lit(START).cast("timestamp_ntz"), F.lit(END).cast("timestamp_ntz"))


def _feed_order():
    return [O.priority_rank(F.col("priority")), F.desc("created_at"), F.col("cluster_id")]


@query(f"""WITH {_CLUSTERS}, {_ARTICLES},
p AS (SELECT * FROM clusters WHERE {_RELEVANT} AND {_SPAN} ORDER BY {_RANK}, created_at DESC, cluster_id LIMIT 20 OFFSET 20),
f AS (SELECT cluster_id, count(*) FILTER (feedback = 'like') AS likes, count(*) FILTER (feedback = 'dislike') AS dislikes, count(*) AS n_articles FROM arts GROUP BY 1)
SELECT p.cluster_id, p.priority, p.created_at, coalesce(likes, 0) AS likes, coalesce(dislikes, 0) AS dislikes, coalesce(n_articles, 0) AS n_articles FROM p LEFT JOIN f ON p.cluster_id = f.cluster_id""")
def feed_page(spark, sf_dir):
    """The second page of the feed: ranked, paged first, and only then joined with what belongs to its clusters."""
    page = O.page(_year(C.clusters(spark, sf_dir)), _feed_order(), 2, 20)
    arts = C.cluster_articles(spark, sf_dir)
    own = arts.join(F.broadcast(page.select("cluster_id")), "cluster_id", "left_semi")
    agg = own.groupBy("cluster_id").agg(F.count_if(F.col("feedback") == "like").alias("likes"), F.count_if(F.col("feedback") == "dislike").alias("dislikes"), F.count("*").alias("n_articles"))
    out = page.join(agg, "cluster_id", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("likes", "dislikes", "n_articles")})
    return out.select("cluster_id", "priority", "created_at", "likes", "dislikes", "n_articles")


@query(f"""WITH {_CLUSTERS} SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages, 2 < ceil(count(*) / 20.0) AS has_next, TRUE AS has_previous FROM clusters WHERE {_RELEVANT} AND {_SPAN}""")
def feed_pagination(spark, sf_dir):
    return O.pagination(_year(C.clusters(spark, sf_dir)), 2, 20)


@query(f"""WITH {_CLUSTERS}, {_ARTICLES},
p AS (SELECT * FROM clusters WHERE {_RELEVANT} AND {_SPAN}),
s AS (SELECT a.cluster_id, array_to_string(list_sort(list(DISTINCT s_name))[1:5], ', ') AS sources, count(*) AS n_articles FROM arts a JOIN supplier ON source_id = s_suppkey GROUP BY 1)
SELECT p.cluster_id, coalesce(sources, '') AS sources, coalesce(n_articles, 0) AS n_articles FROM p LEFT JOIN s ON p.cluster_id = s.cluster_id""")
def feed_sources_nested(spark, sf_dir):
    arts = C.cluster_articles(spark, sf_dir).join(C.sources(spark, sf_dir), "source_id")
    out = O.with_sources(_year(C.clusters(spark, sf_dir)).select("cluster_id"), arts)
    return out.select("cluster_id", F.array_join("sources", ", ").alias("sources"), "n_articles")


@query(f"""WITH {_CLUSTERS}, {_ARTICLES},
f AS (SELECT cluster_id, count(*) FILTER (feedback = 'like') AS likes, count(*) FILTER (feedback = 'dislike') AS dislikes,
  arg_max(feedback, (created_at, article_id)) AS latest FROM arts WHERE feedback IS NOT NULL GROUP BY 1)
SELECT c.cluster_id, coalesce(likes, 0) AS likes, coalesce(dislikes, 0) AS dislikes, latest FROM clusters c LEFT JOIN f ON c.cluster_id = f.cluster_id WHERE status = 'ativo'""")
def feedback_summary(spark, sf_dir):
    """Of feedback of one time and id the first in the table is the latest, as arg_max keeps what it meets first."""
    active = C.clusters(spark, sf_dir).where("status = 'ativo'").select("cluster_id")
    return O.with_feedback(active, C.placed_feedback(spark, sf_dir), place=F.col("place"))


@query(f"""WITH {_CLUSTERS}, {_ARTICLES}
SELECT c.cluster_id, c.priority, c.created_at, string_agg(CAST(article_id AS VARCHAR), ',' ORDER BY a.created_at DESC, article_id) AS articles, count(article_id) AS n
FROM clusters c LEFT JOIN arts a ON c.cluster_id = a.cluster_id GROUP BY 1, 2, 3""")
def cluster_details(spark, sf_dir):
    """Clusters with their articles nested, newest first."""
    arts = C.cluster_articles(spark, sf_dir).select("cluster_id", "article_id", F.col("created_at").alias("at"))
    order = F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("at").cast("timestamp"))).alias("newest"), "article_id")))
    agg = arts.groupBy("cluster_id").agg(order.alias("a"))
    out = C.clusters(spark, sf_dir).join(agg, "cluster_id", "left")
    ids = F.array_join(F.transform("a", lambda x: x["article_id"].cast("string")), ",")
    return out.select("cluster_id", "priority", "created_at", ids.alias("articles"), F.coalesce(F.size("a"), F.lit(0)).cast("long").alias("n"))


@query(f"""WITH {_CLUSTERS} SELECT cluster_id, created_at, priority, weight, c_name AS owner FROM clusters JOIN customer ON owner_id = c_custkey
WHERE c_name ILIKE '%00012%' AND weight >= 100000 AND priority NOT IN ('P1_CRITICO', 'P2_ESTRATEGICO') AND created_at >= TIMESTAMP '1996-01-01' ORDER BY weight DESC, cluster_id LIMIT 25 OFFSET 5""")
def admin_grid_filters(spark, sf_dir):
    """Optional filters of the admin grids, dynamic order, offset."""
    owners = C.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner_id"), F.col("c_name").alias("owner"))
    rows = C.clusters(spark, sf_dir).where(F.col("created_at") >= F.lit("1996-01-01").cast("timestamp_ntz")).join(owners, "owner_id")
    found = O.grid(rows, like={"owner": "00012"}, compare={"weight": (">=", 100000.0)}, not_in={"priority": ("P1_CRITICO", "P2_ESTRATEGICO")})
    return found.orderBy(F.desc("weight"), "cluster_id").offset(5).limit(25).select("cluster_id", "created_at", "priority", "weight", "owner")


@query("""SELECT doc_id, CASE WHEN length(text) > 600 THEN substr(text, 1, 600) || '...' ELSE text END AS excerpt FROM documents
WHERE lower(text) LIKE '%ouwhea%' OR lower(text) LIKE '%zu und%' ORDER BY doc_id LIMIT 30""")
def keyword_search(spark, sf_dir):
    rows = C.table(spark, sf_dir, "documents").where(T.contains_any(F.col("text"), "Ouwhea, zu und"))
    return rows.orderBy("doc_id").limit(30).select("doc_id", T.excerpt(F.col("text"), 600).alias("excerpt"))


@query(f"""WITH {_CLUSTERS} SELECT cluster_id, created_at, priority FROM clusters WHERE created_at >= TIMESTAMP '1997-03-04' AND created_at < TIMESTAMP '1997-03-11' AND {_RELEVANT}
ORDER BY created_at DESC, cluster_id LIMIT 50""")
def keyword_search_range(spark, sf_dir):
    """A range of dates given the wrong way round, cut to its last seven days."""
    a, b = F.to_date(F.lit("1997-03-10")), F.to_date(F.lit("1997-02-01"))
    low, high = F.least(a, b), F.greatest(a, b)
    low = F.greatest(low, F.date_sub(high, 6))
    rows = O.relevant(C.clusters(spark, sf_dir), low.cast("timestamp_ntz"), F.date_add(high, 1).cast("timestamp_ntz"))
    return rows.orderBy(F.desc("created_at"), "cluster_id").limit(50).select("cluster_id", "created_at", "priority")


@query(f"""WITH {_CLUSTERS} SELECT cluster_id, priority, created_at FROM clusters WHERE {_RELEVANT} AND weight > 50000 AND cluster_id % 3 <> 0 ORDER BY {_RANK}, created_at, cluster_id LIMIT 50""")
def pending_notifications(spark, sf_dir):
    rows = C.clusters(spark, sf_dir).withColumns({"notified": F.col("cluster_id") % 3 == 0, "summary": F.when(F.col("weight") > 50000, F.lit("s"))})
    return O.pending_notifications(rows).select("cluster_id", "priority", "created_at")


@query(f"""WITH {_CLUSTERS}, {_ARTICLES} SELECT c.cluster_id, c.created_at, count(*) AS n FROM clusters c JOIN arts a ON c.cluster_id = a.cluster_id GROUP BY 1, 2 HAVING count(*) >= 3 ORDER BY c.created_at DESC, c.cluster_id LIMIT 5""")
def join_having_multi_source(spark, sf_dir):
    counts = C.cluster_articles(spark, sf_dir).groupBy("cluster_id").agg(F.count("*").alias("n")).where("n >= 3")
    return C.clusters(spark, sf_dir).join(counts, "cluster_id").orderBy(F.desc("created_at"), "cluster_id").limit(5).select("cluster_id", "created_at", "n")


@query(f"""WITH {_CLUSTERS}, {_ARTICLES} SELECT cluster_id, priority FROM clusters c WHERE EXISTS (SELECT 1 FROM arts a WHERE a.cluster_id = c.cluster_id AND a.created_at >= TIMESTAMP '2001-08-01' AND a.created_at < TIMESTAMP '2001-09-01')""")
def clusters_touched(spark, sf_dir):
    """SELECT DISTINCT over a join as the semi join that it is."""
    hit = C.cluster_articles(spark, sf_dir).where(F.col("created_at").between(F.lit("2001-08-01").cast("timestamp_ntz"), F.expr("timestamp_ntz'2001-08-31 23:59:59.999999'")))
    return C.clusters(spark, sf_dir).join(hit, "cluster_id", "left_semi").select("cluster_id", "priority")


@query(f"""WITH {_CLUSTERS} SELECT CAST(cast(created_at AS DATE) AS VARCHAR) AS day, count(*) FILTER (priority = 'P1_CRITICO') AS p1, count(*) FILTER (priority = 'P2_ESTRATEGICO') AS p2, count(*) FILTER (priority = 'P3_MONITORAMENTO') AS p3,
count(DISTINCT c_mktsegment) AS tags, CASE WHEN count(*) FILTER (priority IN ('P1_CRITICO', 'P2_ESTRATEGICO')) >= 5 AND count(DISTINCT c_mktsegment) >= 3 THEN 'QUENTE' WHEN count(*) FILTER (priority IN ('P1_CRITICO', 'P2_ESTRATEGICO')) >= 2 THEN 'MORNO' ELSE 'FRIO' END AS temperature
FROM clusters JOIN customer ON owner_id = c_custkey WHERE {_RELEVANT} GROUP BY 1""")
def day_temperature(spark, sf_dir):
    tags = C.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner_id"), F.col("c_mktsegment").alias("tag"))
    return O.day_temperature(O.relevant(C.clusters(spark, sf_dir)).join(tags, "owner_id")).withColumn("day", F.col("day").cast("string"))


@query("""SELECT conv_id, count(*) AS turns, string_agg(role || ':' || text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id""")
def conversation_history(spark, sf_dir):
    t = C.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return t.select("conv_id", "turns", F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n").alias("transcript"))


@query(f"""WITH {_CLUSTERS}, {_ARTICLES} SELECT CAST(ceil(row_number() OVER (PARTITION BY priority ORDER BY cluster_id) / 200.0) AS BIGINT) AS batch, cluster_id, priority FROM clusters WHERE status = 'ativo'""")
def batch_numbers(spark, sf_dir):
    return bi.batches(C.clusters(spark, sf_dir).where("status = 'ativo'"), "priority", [F.col("cluster_id")], 200).select("batch", "cluster_id", "priority")


@query(f"""WITH {_CLUSTERS}, {_ARTICLES},
n AS (SELECT a.cluster_id, count(DISTINCT a.source_id) AS n_sources FROM arts a GROUP BY 1),
d AS (SELECT cast(created_at AS DATE) AS day, count(*) AS n_clusters, count(*) FILTER (priority <> 'IRRELEVANTE') AS n_relevant, CAST(coalesce(sum(n_sources), 0) AS BIGINT) AS n_sources FROM clusters LEFT JOIN n USING (cluster_id) WHERE status = 'ativo' GROUP BY 1)
SELECT d.* REPLACE (CAST(d.day AS VARCHAR) AS day), p.n_clusters AS previous_n_clusters FROM d LEFT JOIN d p ON d.day = p.day + 1""")
def kpis_by_day(spark, sf_dir):
    """Daily figures with those of the calendar day before."""
    from storyline.operators.export import previous_day

    n = C.cluster_articles(spark, sf_dir).groupBy("cluster_id").agg(F.countDistinct("source_id").alias("n_sources"))
    rows = C.clusters(spark, sf_dir).where("status = 'ativo'").join(n, "cluster_id", "left")
    d = rows.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n_clusters"), F.count_if(F.col("priority") != "IRRELEVANTE").alias("n_relevant"), F.coalesce(F.sum("n_sources"), F.lit(0).cast("long")).alias("n_sources"))
    return previous_day(d).select(F.col("day").cast("string").alias("day"), "n_clusters", "n_relevant", "n_sources", "previous_n_clusters")
