"""Text outputs: Markdown of clusters and articles, messages, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyline.functions import text as T


def stitched(texts: Column) -> Column:
    """Joins ordered fragments of one story, dropping words that a fragment's head repeats from the last one's tail (6 to 120 words)."""

    def join(a: Column, b: Column) -> Column:
        left, right = F.regexp_replace(a, r"(?U)\s+$", ""), F.regexp_replace(b, r"(?U)^\s+", "")
        wa, wb = F.split(left, r"(?U)\s+"), F.split(right, r"(?U)\s+")
        na, nb = F.transform(F.slice(wa, -F.least(F.size(wa), F.lit(120)), F.least(F.size(wa), F.lit(120))), T.edge_word), F.transform(F.slice(wb, 1, 120), T.edge_word)
        most = F.least(F.size(na), F.size(nb))
        lengths = F.filter(F.sequence(F.lit(6), F.greatest(most, F.lit(6))), lambda k: (k <= most) & (F.slice(na, -k, k) == F.slice(nb, F.lit(1), k)) & ~F.array_contains(F.slice(nb, F.lit(1), k), ""))
        best = F.coalesce(F.array_max(lengths), F.lit(0))
        # The words kept of the left end where its last ``best`` words begin.
        tail = F.regexp_replace(left, F.concat(F.lit(r"(?Us)(?:\s*\S+){"), best.cast("string"), F.lit(r"}$")), F.lit(""))
        running = ~left.rlike(r"[.!?:…”\"')\]}]$") & right.rlike(r"^\p{Ll}")
        return F.when(left == "", right).when(right == "", left).when(best > 0, F.when(tail == "", right).otherwise(F.concat(tail, F.lit(" "), right))).otherwise(F.concat(left, F.when(running, " ").otherwise("\n\n"), right))

    return F.aggregate(texts, F.lit(""), lambda acc, t: F.when(acc == "", t).otherwise(join(acc, F.coalesce(t, F.lit("")))))


def fragments(articles: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Articles of one source in a cluster as one story: fragments in order of page and id, stories in order of their first fragment."""
    f = F.array_sort(F.collect_list(F.struct(T.page_number(F.col("page")).alias("page"), "article_id", "title", "text"))).alias("f")
    g = articles.groupBy(key, "source").agg(f)
    title = F.array_max(F.transform(F.filter("f", lambda x: F.trim(F.coalesce(x["title"], F.lit(""))) != ""), lambda x: F.struct(F.char_length(F.trim(x["title"])).alias("n"), (-x["article_id"]).alias("o"), F.trim(x["title"]).alias("t"))))["t"]
    return g.select(
        key, "source", F.col("f")[0]["page"].alias("first_page"), F.col("f")[0]["article_id"].alias("first_id"), F.coalesce(title, F.lit("Sem título")).alias("title"),
        T.pages_label(F.transform("f", lambda x: x["page"])).alias("pages"), stitched(F.transform("f", lambda x: x["text"])).alias("text"),
    )


def cluster_markdown(clusters: DataFrame, articles: DataFrame, key: str = "cluster_id") -> DataFrame:
    """(key, markdown): YAML front matter and one section a source."""
    sections = F.array_sort(F.collect_list(F.struct("first_page", "first_id", "source", "title", "pages", "text"))).alias("s")
    stories = fragments(articles.join(clusters.select(key), key, "left_semi"), key).groupBy(key).agg(sections)
    body = F.array_join(F.transform("s", lambda x: F.concat(F.lit("## "), x["title"], F.lit("\n*"), x["source"], F.when(x["pages"] != "", F.concat(F.lit(", "), x["pages"])).otherwise(""), F.lit("*\n\n"), x["text"])), "\n\n")
    names = F.array_join(F.array_distinct(F.transform("s", lambda x: x["source"])), ", ")
    head = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("title: "), T.yaml_value(F.col("title"))), F.concat(F.lit("priority: "), F.col("priority")), F.concat(F.lit("sources: "), T.yaml_value(F.coalesce(names, F.lit("")))), F.lit("---"))
    return clusters.join(stories, key, "left").select(key, F.concat(head, F.lit("\n\n"), F.coalesce(body, F.lit(""))).alias("markdown"))


def orphan_markdown(articles: DataFrame) -> DataFrame:
    rows = articles.where(F.col("cluster_id").isNull() & F.col("text").rlike(r"\S"))
    return rows.select("article_id", F.concat(F.lit("---\ntitle: "), T.yaml_value(F.coalesce("title", T.short_title(F.col("text")))), F.lit("\n---\n\n"), T.strip(F.col("text"))).alias("markdown"))


def write_markdown(rows: DataFrame, path: str) -> None:
    """One text file a partition, a document a record; partitioned by day where there is one."""
    rows.select("markdown").write.mode("overwrite").option("lineSep", "\n\f\n").text(path)


def telegram_message(clusters: DataFrame) -> DataFrame:
    text = F.concat(F.lit("*"), T.escape_markdown(F.col("title")), F.lit("*\n"), T.escape_markdown(T.excerpt(F.coalesce("summary", F.lit("")), 600)))
    return clusters.select("cluster_id", text.alias("message"))


def message_parts(rows: DataFrame, text_col: str = "message", limit: int = 4000) -> DataFrame:
    """Messages in parts of at most ``limit`` characters, cut after line breaks where there are some. A line over the limit is cut through."""
    pieces = F.flatten(F.transform(F.split(text_col, "(?<=\n)"), lambda p: F.regexp_extract_all(p, F.lit(rf"(?s)(.{{1,{limit}}})"), F.lit(1))))
    packed = F.aggregate(
        pieces, F.array().cast("array<string>"),
        lambda acc, p: F.when((F.size(acc) > 0) & (F.char_length(F.element_at(acc, -1)) + F.char_length(p) <= limit), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), p)))).otherwise(F.concat(acc, F.array(p))),
    )
    return rows.select("*", F.posexplode(packed).alias("part", "piece"))


def digest_sources(rows: DataFrame, key: str = "cluster_id", most: int = 3) -> DataFrame:
    """Each cluster's first source names, distinct regardless of case, in order of place."""
    first = rows.withColumn("rn", F.row_number().over(Window.partitionBy(key, F.lower("source")).orderBy("place"))).where("rn = 1")
    names = F.transform(F.array_sort(F.collect_list(F.struct("place", "source"))), lambda x: x["source"])
    return first.groupBy(key).agg(F.array_join(F.slice(names, 1, most), ", ").alias("label"))


def previous_day(rows: DataFrame, day: str = "day") -> DataFrame:
    """Each day's row with the row of the calendar day before: an equality on the day, so gaps stay gaps."""
    before = rows.select(F.date_add(F.col(day), 1).alias(day), *(F.col(c).alias(f"previous_{c}") for c in rows.columns if c != day))
    return rows.join(before, day, "left")
