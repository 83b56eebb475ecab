"""Hygiene, classification and consolidation of a day, templates, logs and free SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyline import catalog as C
from storyline import domain as D
from storyline.functions import text as T
from storyline.operators import bi
from storyline.operators import stages as G
from storyline.operators import state as S
from storyline.plans.dedup import _TOKENS
from storyline.plans.feed import _CLUSTERS
from storyline.registry import query


@query("""SELECT doc_id AS article_id, CASE WHEN doc_id % 3 = 0 THEN 'processado' WHEN doc_id % 5 <> 0 AND doc_id < 1440 AND (contains(substr(text, 1, 800), 'the') OR substr(source, 1, 200) = 'src7') THEN 'irrelevante' ELSE 'pronto_agrupar' END AS status FROM documents""")
def hygiene_filter(spark, sf_dir):
    """Ready articles of one day that a predicate calls junk become irrelevant."""
    i = F.col("article_id")
    rows = C.articles(spark, sf_dir).select("article_id", "text", F.col("outlet").alias("title"), F.lit(None).cast("string").alias("processed"), "created_at",
                                            F.when(i % 3 == 0, "processado").otherwise(D.READY).alias("status"), F.when(i % 5 == 0, i).alias("cluster_id"))
    junk = lambda title, excerpt: excerpt.contains("the") | (title == "src7")
    return G.hygiene(rows, junk, F.lit("2024-01-01").cast("date")).select("article_id", "status")


@query(f"""WITH {_CLUSTERS}, r AS (SELECT *, cluster_id % 8 AS k FROM clusters)
SELECT cluster_id, CASE WHEN k IN (0, 2) THEN 'novo ' || cluster_id ELSE 'velho' END AS title,
  CASE WHEN k IN (0, 1, 2) THEN CASE WHEN priority = 'IRRELEVANTE' THEN 'IRRELEVANTE' ELSE priority END WHEN k = 7 THEN 'P3_MONITORAMENTO' ELSE 'P3_REVISAR' END AS priority,
  CASE WHEN k IN (0, 1, 2) THEN 'M&A e Transações Corporativas' WHEN k = 7 THEN 'PENDING' ELSE 'ERRO' END AS tag,
  CASE WHEN k IN (0, 1, 2) THEN 'resumo' WHEN k = 7 THEN NULL ELSE 'Falha na classificação automática. Motivo: ' ||
    CASE k WHEN 3 THEN 'Resposta do LLM sem campos obrigatórios' WHEN 4 THEN 'Falha na análise: RESPOSTA_VAZIA' WHEN 5 THEN 'Falha na análise: FALHA_SEM_JSON' ELSE 'Formato inválido (tipo list)' END END AS summary FROM r""")
def classified_clusters(spark, sf_dir):
    """Clusters classified by replies of all kinds: an object, one in a list, one that breaks off, without a field, blank, prose, a list of numbers, none."""
    c = C.clusters(spark, sf_dir)
    k, i = F.col("cluster_id") % 8, F.col("cluster_id").cast("string")
    body = F.concat(F.lit('"prioridade": "'), F.col("priority"), F.lit('", "tag": "m&a e transações corporativas", "resumo_final": "resumo"'))
    titled = F.concat(F.lit('{"titulo": "novo '), i, F.lit('", '), body)
    reply = (
        F.when(k == 0, F.concat(F.lit("```json\n"), titled, F.lit("}\n```"))).when(k == 1, F.concat(F.lit("[{"), body, F.lit("}]"))).when(k == 2, titled)
        .when(k == 3, F.lit('{"titulo": "x", "prioridade": "P1_CRITICO", "tag": "", "resumo_final": "y"}')).when(k == 4, " ").when(k == 5, "nada a dizer").otherwise("[1, 2]")
    )
    old = c.select("cluster_id", F.lit("velho").alias("title"), F.lit("P3_MONITORAMENTO").alias("priority"), F.lit("PENDING").alias("tag"), F.lit(None).cast("string").alias("summary"), F.lit("nacional").alias("source_type"))
    return G.classify_clusters(old, c.where(k < 7).select("cluster_id", reply.alias("reply"))).drop("source_type")


@query(f"""WITH RECURSIVE n AS (SELECT doc_id, lang, source, trim(regexp_replace(strip_accents(lower(translate(text, 'ß', ' '))), '[^a-z0-9]+', ' ', 'g')) AS key FROM documents),
x AS (SELECT doc_id AS source, target FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY key, lang, source) AS target FROM n WHERE key <> '') WHERE doc_id > target),
{_TOKENS.replace('FROM documents', 'FROM documents WHERE doc_id NOT IN (SELECT source FROM x) AND doc_id % 4 <> 0')},
e AS (SELECT a_id AS u, b_id AS v FROM p WHERE score >= 0.85 UNION SELECT b_id, a_id FROM p WHERE score >= 0.85),
r(id, reach) AS (SELECT u, u FROM e UNION SELECT r.id, e.v FROM r JOIN e ON r.reach = e.u)
SELECT source, target FROM x UNION ALL SELECT id, min(reach) FROM r GROUP BY 1 HAVING id <> min(reach)""")
def consolidated_clusters(spark, sf_dir):
    """Documents as clusters with their text as title: merges of equal titles, then of near ones among P3."""
    d = C.table(spark, sf_dir, "documents")
    rows = d.select(F.col("doc_id").alias("cluster_id"), F.replace("text", F.lit("ß"), F.lit(" ")).alias("title"), F.col("lang").alias("tag"), F.col("source").alias("source_type"),
                    F.when(F.col("doc_id") % 4 == 0, "P1_CRITICO").otherwise("P3_MONITORAMENTO").alias("priority"))
    return G.consolidation(rows)


@query("""SELECT o_orderkey FROM orders WHERE NOT (o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1996-01-01')""")
def cleared_range(spark, sf_dir):
    o = C.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return S.clear_range(o, "o_orderdate", F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("1995-12-31").cast("timestamp_ntz")).select("o_orderkey")


@query("""SELECT count(*) FILTER (event_type = 'view' AND cast(ts AS DATE) = (SELECT min(cast(ts AS DATE)) FROM events)) > 0 AS sent FROM events""")
def already_sent(spark, sf_dir):
    """Whether the log that events stand for holds a success on its first day."""
    e = C.table(spark, sf_dir, "events")
    logs = S.log_rows(e, F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO"), F.when(F.col("event_type") == "view", "broadcaster").otherwise("x"), F.col("event_type"), F.col("ts"), F.col("props"))
    first = e.agg(F.to_date(F.min("ts")).alias("first"))
    return S.already_sent(logs.crossJoin(F.broadcast(first)), F.col("first"))


@query(f"""WITH {_CLUSTERS}, f AS (SELECT CASE WHEN l_returnflag = 'A' THEN 'likes' ELSE 'dislikes' END AS kind, nullif('line ' || l_linenumber, 'line 1') AS tag, priority FROM lineitem JOIN clusters ON l_orderkey = cluster_id WHERE l_returnflag <> 'N')
SELECT kind || '_por_tag' AS pattern, tag AS value, count(*) AS n FROM f WHERE tag IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT kind || '_por_prioridade', priority, count(*) FROM f GROUP BY 1, 2""")
def feedback_counters(spark, sf_dir):
    """Likes and dislikes by tag and by priority."""
    line = C.table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'")
    rows = line.join(C.clusters(spark, sf_dir), F.col("l_orderkey") == F.col("cluster_id"))
    return bi.feedback_patterns(rows.select(F.when(F.col("l_returnflag") == "A", "like").otherwise("dislike").alias("feedback"), F.expr("nullif('line ' || l_linenumber, 'line 1')").alias("tag"), "priority"))


@query("""SELECT c_custkey, c_custkey % 3 = 0 OR c_custkey % 5 = 0 AS hit FROM customer""")
def journal_files(spark, sf_dir):
    """Customers as a channel's files, by name and message."""
    c, k = C.table(spark, sf_dir, "customer"), F.col("c_custkey")
    message = F.when(k % 5 == 0, "CORREIO\u00a0 Braziliense").when(k % 5 == 1, "ESTAD\u00c3O").otherwise(F.col("c_mktsegment"))
    return c.select("c_custkey", T.is_journal(F.concat("c_name", F.when(k % 3 == 0, ".PDF").otherwise(".txt")), message).alias("hit"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '{"n": "' || p_name || '", "b": "' || p_brand || '"}' WHEN 1 THEN p_brand || ' of {outro}: {nome}' ELSE p_brand || ' - ' || p_name END AS prompt FROM part""")
def rendered_prompts(spark, sf_dir):
    """Templates filled with values; an unknown placeholder leaves its template as it is."""
    p = C.table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 3
    template = F.when(k == 0, F.lit('{{"n": "{nome}", "b": "{marca}"}}')).when(k == 1, F.concat("p_brand", F.lit(" of {outro}: {nome}"))).otherwise("{marca} - {nome}")
    return p.select("p_partkey", G.rendered(template, nome=F.col("p_name"), marca=F.col("p_brand")).alias("prompt"))


FREE_SQL = "SELECT n_name, count(*) AS n, max(c_acctbal) AS most FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name HAVING count(*) > 1"


@query(FREE_SQL)
def free_sql(spark, sf_dir):
    return C.run_sql(spark, sf_dir, FREE_SQL, ("customer", "nation"))
