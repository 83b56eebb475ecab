"""Scalar text functions over documents, pages and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyline import catalog as C
from storyline import domain as D
from storyline.functions import jsonx
from storyline.functions import text as T
from storyline.operators import export
from storyline.plans.feed import _CLUSTERS
from storyline.registry import query


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '[ \t\n\r\f\x0B]+', ' ', 'g')) AS text FROM pages""")
def html_sanitize(spark, sf_dir):
    return C.table(spark, sf_dir, "pages").select("page_id", T.strip_html(F.col("html")).alias("text"))


@query(r"""WITH b AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, 'https?://[^ \t\n\r\f\x0B]+', ' ', 'g'), '[ \t\n\r\f\x0B]+', ' ', 'g')) AS b FROM documents),
s AS (SELECT doc_id, coalesce(nullif(regexp_extract(b, '^(.*?[.!?])( |$)', 1), ''), b) AS s FROM b),
t AS (SELECT doc_id, trim(CASE WHEN len(string_split(s, ' ')) > 10 THEN array_to_string(string_split(s, ' ')[1:10], ' ') ELSE s END, ' -—:;,') AS t FROM s)
SELECT doc_id, CASE WHEN t = '' THEN 'Sem título' ELSE t END AS title FROM t""")
def title_fallback(spark, sf_dir):
    return C.table(spark, sf_dir, "documents").select("doc_id", T.short_title(F.col("text")).alias("title"))


@query()
def noise_and_ads_flags(spark, sf_dir):
    d = C.table(spark, sf_dir, "documents")
    t = F.col("text")
    return d.select("doc_id", T.is_noise(t).alias("noise"), T.is_advertisement(F.lit(None).cast("string"), t).alias("ad"), T.gatekeeper(t)["reason"].alias("reason"), T.is_financial_page(t).alias("financial"), T.is_portuguese(t).alias("portuguese"))


@query(r"""SELECT s_suppkey, trim(regexp_replace(lower(strip_accents(s_name)), '[^a-z0-9]+', ' ', 'g')) AS outlet_key, regexp_replace(lower(s_name), '[^a-z0-9_ ]', '', 'g') AS entity_key, regexp_replace(lower(s_name), '[^a-z0-9_ -]', '', 'g') AS slug FROM supplier""")
def normalize_names(spark, sf_dir):
    n = F.col("s_name")
    return C.table(spark, sf_dir, "supplier").select("s_suppkey", T.outlet_key(n).alias("outlet_key"), T.entity_key(n).alias("entity_key"), T.slug(n).alias("slug"))


@query("""SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, host LIMIT 20""")
def host_of_url(spark, sf_dir):
    none = F.lit(None).cast("string")
    return C.table(spark, sf_dir, "pages").groupBy(T.source_name(none, url=F.col("url")).alias("host")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "host").limit(20)


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events""")
def json_fields(spark, sf_dir):
    p = F.col("props")
    return C.table(spark, sf_dir, "events").select("event_id", jsonx.field(p, "k").alias("k"), jsonx.field_or(p, "missing", F.lit("none")).alias("missing"))


@query("""SELECT event_id, CASE event_id % 10 WHEN 0 THEN 'OK' WHEN 1 THEN 'REPAIRED' WHEN 2 THEN 'INVALID' WHEN 3 THEN 'REPAIRED' WHEN 4 THEN 'TRUNCATED' WHEN 5 THEN 'NO_JSON' WHEN 6 THEN 'EMPTY' WHEN 7 THEN 'EMPTY' WHEN 8 THEN 'INVALID' ELSE 'OK' END AS status,
CASE event_id % 10 WHEN 0 THEN '[{"tipo": "anexar", "noticia_id": ' || event_id || ', "cluster_id_existente": 9}]' WHEN 1 THEN '{"a": ' || event_id || ', "b": [1, 2]}' WHEN 3 THEN '{"a": "it''s"}' WHEN 4 THEN '[{"a": ' || event_id || '}]' WHEN 9 THEN '{"k": [' || event_id || ']}' END AS json,
CASE WHEN event_id % 10 = 0 THEN event_id END AS attached FROM events""")
def json_salvage(spark, sf_dir):
    """Model replies of every status, made from events: parsed, repaired, cut; decisions salvaged."""
    n = F.col("event_id").cast("string")
    text = lambda *parts: F.concat(*(n if x is None else F.lit(x) for x in parts))
    replies = (
        text('```json\n[{"tipo": "anexar", "noticia_id": ', None, ', "cluster_id_existente": 9}]\n```'), text('Sure: {"a": ', None, ', "b": [1, 2,]}'), text('[{"a": [1, ', None), text('{"a": "it\'s"'),
        text('[{"a": ', None, '}] that is all'), text("no json ", None), text("  \n"), F.lit(None).cast("string"), text('{"k": [1, {"b": ', None), text('{"k": [', None, "]}"),
    )
    reply = F.coalesce(*(F.when(F.col("event_id") % 10 == i, r) for i, r in enumerate(replies)))
    parsed = jsonx.parse_reply(F.col("reply"))
    rows = C.table(spark, sf_dir, "events").select("event_id", reply.alias("reply"))
    return rows.select("event_id", parsed["status"].alias("status"), parsed["json"].alias("json"), F.get(jsonx.salvage_decisions(F.col("reply")), 0)["article"].alias("attached"))


@query("""SELECT o_orderkey, 2 AS n, o_orderkey AS target, '1,' || o_custkey AS sources, 'Title ' || o_orderkey AS title, CASE WHEN o_orderkey % 2 = 0 THEN 'P1_CRITICO' END AS priority, o_custkey AS kept FROM orders WHERE o_orderkey > 0""")
def merge_suggestions(spark, sf_dir):
    """Merge and keep suggestions salvaged from replies that break off."""
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    level = F.when(F.col("o_orderkey") % 2 == 0, "P1_CRITICO").otherwise("P9")
    reply = F.concat(
        F.lit('[{"tipo": "MERGE", "destino": '), k, F.lit(', "fontes": [1, "'), c, F.lit('"], "novo_titulo": " Title '), k, F.lit('", "nova_prioridade": "'), level, F.lit('"},\n{"tipo": "merge", "destino": 3},\n'),
        F.lit('{"tipo": "keep", "cluster_id": '), c, F.lit('}, {"tipo": "keep", "cluster'),
    )
    m = F.col("m")
    rows = C.table(spark, sf_dir, "orders").where("o_orderkey > 0").select("o_orderkey", jsonx.salvage_merges(reply).alias("m"))
    return rows.select(
        "o_orderkey", F.size(m).alias("n"), F.get(m, 0)["target"].alias("target"), F.array_join(F.transform(F.get(m, 0)["sources"], lambda x: x.cast("string")), ",").alias("sources"),
        F.get(m, 0)["title"].alias("title"), F.get(m, 0)["priority"].alias("priority"), F.get(m, 1)["cluster"].alias("kept"),
    )


@query("""SELECT event_id, 1 AS n, event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'P2_ESTRATEGICO' ELSE 'IRRELEVANTE' END AS priority, event_type AS tag FROM events""")
def executive_priorities(spark, sf_dir):
    """Decisions of an executive ranking salvaged from replies that break off."""
    level = F.when(F.col("event_id") % 3 == 0, "P2_ESTRATEGICO").otherwise("IRRELEVANTE")
    reply = F.concat(F.lit('[{"id": '), F.col("event_id").cast("string"), F.lit(', "decisao_prioridade_final": "'), level, F.lit('", "tag_final": "'), "event_type", F.lit('"}, {"id": 5, "decisao_prioridade_final": "P7"}, {"id": 6, "decisao'))
    rows = C.table(spark, sf_dir, "events").select("event_id", jsonx.salvage_priorities(reply).alias("p"))
    return rows.select("event_id", F.size("p").alias("n"), F.get("p", F.lit(0))["id"].alias("id"), F.get("p", F.lit(0))["priority"].alias("priority"), F.get("p", F.lit(0))["tag"].alias("tag"))


@query("""SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'Política Econômica (Brasil)' WHEN 1 THEN 'Distressed Assets e NPLs' WHEN 2 THEN 'Tecnologia e Setores Estratégicos' WHEN 3 THEN 'Internacional (Economia e Política)'
 WHEN 4 THEN 'Sovereign Debt and Credit' WHEN 5 THEN 'Geopolitics and Trade' WHEN 6 THEN 'Mercado de Capitais e Finanças Corporativas' ELSE 'IRRELEVANTE' END AS tag,
 CASE p_partkey % 8 WHEN 6 THEN 'Mercado de Capitais e Finanças Corporativas' ELSE 'Internacional (Economia e Política)' END AS migrated FROM part""")
def canonical_tags(spark, sf_dir):
    """Tags of a model made canonical, and tags of an earlier version migrated."""
    k = F.col("p_partkey") % 8
    raw = ("Política Econômica (Brasil)", " distressed assets e npls ", "Tecnologia", "  ", "SOVEREIGN DEBT AND CREDIT", "Empresas", "Empresas Privadas", "zzz")
    tag = F.coalesce(*(F.when(k == i, F.lit(t)) for i, t in enumerate(raw)))
    return C.table(spark, sf_dir, "part").select("p_partkey", T.canonical_tag(tag, k.isin(4, 5)).alias("tag"), T.migrated_tag(tag).alias("migrated"))


@query(f"""WITH {_CLUSTERS}, r AS (SELECT cluster_id, priority, CASE WHEN cluster_id % 4 < 2 THEN weight END AS score, CASE WHEN cluster_id % 4 IN (0, 2) THEN 'why' END AS reason FROM clusters)
SELECT cluster_id, CASE WHEN score IS NOT NULL AND score <> 0 THEN score WHEN priority = 'P1_CRITICO' THEN 85.0 WHEN priority = 'P2_ESTRATEGICO' THEN 65.0 ELSE 35.0 END AS score,
coalesce(reason, 'Migrado: Classificado como ' || CASE WHEN priority IN ('P1_CRITICO', 'P2_ESTRATEGICO') THEN priority ELSE 'P3_MONITORAMENTO' END) AS reason FROM r""")
def migrated_records(spark, sf_dir):
    """Scores and reasons of old records filled by priority."""
    score = F.when(F.col("cluster_id") % 4 < 2, F.col("weight"))
    reason = F.when((F.col("cluster_id") % 4).isin(0, 2), F.lit("why"))
    filled, why = T.migrated_score(F.col("priority"), score, reason)
    return C.clusters(spark, sf_dir).select("cluster_id", filled.alias("score"), why.alias("reason"))


@query(f"""WITH {_CLUSTERS}, f AS (SELECT l_orderkey AS cluster_id, s_name, l_linenumber, 'Quantity ' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || '.' AS t FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
g AS (SELECT cluster_id, s_name, min(l_linenumber) AS first, max(l_linenumber) AS last, count(DISTINCT l_linenumber) AS k, string_agg(t, chr(10) || chr(10) ORDER BY l_linenumber, t) AS body,
  (SELECT string_agg(CAST(x AS VARCHAR), ', ' ORDER BY x) FROM (SELECT DISTINCT unnest(list(l_linenumber)) AS x)) AS pages FROM f GROUP BY 1, 2),
r AS (SELECT c.cluster_id, priority, string_agg('## Line ' || first || chr(10) || '*' || s_name || ', p. ' || CASE WHEN k > 1 AND last - first + 1 = k THEN first || '-' || last ELSE pages END || '*' || chr(10) || chr(10) || body, chr(10) || chr(10) ORDER BY first, s_name) AS body,
  string_agg(s_name, ', ' ORDER BY first, s_name) AS names FROM clusters c JOIN g ON g.cluster_id = c.cluster_id GROUP BY 1, 2)
SELECT cluster_id, '---' || chr(10) || 'title: Order ' || cluster_id || chr(10) || 'priority: ' || priority || chr(10) || 'sources: "' || names || '"' || chr(10) || '---' || chr(10) || chr(10) || body AS markdown FROM r""")
def markdown_export(spark, sf_dir):
    """One Markdown text a cluster; the lines of one supplier are fragments of one story."""
    s = C.table(spark, sf_dir, "supplier")
    arts = C.table(spark, sf_dir, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_orderkey").alias("cluster_id"), F.col("l_linenumber").alias("article_id"), F.col("s_name").alias("source"), F.col("l_linenumber").cast("string").alias("page"),
        F.concat(F.lit("Line "), F.col("l_linenumber").cast("string")).alias("title"), F.concat(F.lit("Quantity "), F.col("l_quantity").cast("int").cast("string"), F.lit(".")).alias("text"),
    )
    cl = C.clusters(spark, sf_dir).join(arts, "cluster_id", "left_semi").withColumn("title", F.concat(F.lit("Order "), F.col("cluster_id").cast("string")))
    # Names hold no character that YAML quotes but the comma between them and the number sign in them.
    return export.cluster_markdown(cl, arts)


@query()
def stage_one(spark, sf_dir):
    """Stage one of article processing with the stand-in classifier."""
    from storyline.providers import process

    return process(C.articles(spark, sf_dir)).select("article_id", "title", "tag", "priority", "status", "reason")


@query()
def message_parts(spark, sf_dir):
    return export.message_parts(C.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("message"))).select("doc_id", "part", "piece")


@query(f"""SELECT p_partkey, CASE WHEN p_type IN ('P1_CRITICO', 'P2_ESTRATEGICO', 'P3_MONITORAMENTO') THEN p_type ELSE 'IRRELEVANTE' END AS priority, CASE WHEN length(p_name) > 8 THEN substr(p_name, 1, 5) || '...' ELSE p_name END AS short FROM part""")
def priority_and_truncate(spark, sf_dir):
    return C.table(spark, sf_dir, "part").select("p_partkey", T.fix_priority(F.col("p_type")).alias("priority"), T.truncate(F.col("p_name"), 8).alias("short"))


@query(f"""SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS a FROM pages) GROUP BY 1""")
def page_links(spark, sf_dir):
    from storyline.sources.readers import links

    return links(C.table(spark, sf_dir, "pages")).groupBy("page_id").agg(F.count("*").alias("n"))


assert D.DEFAULT_TAG in D.TAG_KEYWORDS.values()
