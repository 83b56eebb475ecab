"""Templates, rules, logs, model entities and writing by day."""

from pyspark.sql import functions as F

from storyline.functions import text as T
from storyline.operators import stages as G
from storyline.operators import state as S


def test_templates_and_rules(spark):
    defaults = spark.createDataFrame([("A", "a {x}"), ("B", "b")], "key string, content string")
    stored = spark.createDataFrame([("A", "A {x}"), ("B", ""), ("C", "c")], "key string, content string")
    assert {r["key"]: r["content"] for r in G.templates(defaults, stored).collect()} == {"A": "A {x}", "B": "b", "C": "c"}
    t = spark.createDataFrame([("{x}{{{x}}} {{x}}",), ("{y} {x}",), ("plain",), ("",), (None,)], "t string").select(G.rendered(F.col("t"), x=F.lit("{y}")).alias("t"))
    assert [r["t"] for r in t.collect()] == ["{y}{{y}} {x}", "{y} {x}", "plain", "", None]
    configs = spark.createDataFrame([("FEEDBACK_RULES", "r"), ("X", "y")], "key string, value string")
    assert G.feedback_rules(configs).first()[0] == "r"
    assert G.feedback_rules(configs.where("key = 'X'"), "f").first()[0] == "f"
    assert G.feedback_rules(configs, enabled=False).first()[0] == ""


def test_model_entities_halve_what_fails(spark):
    def ask(texts):
        if any("bad" in t for t in texts):
            raise ValueError("no reply")
        return [t.split() for t in texts]

    rows = spark.createDataFrame([(1, "a b"), (2, "bad"), (3, None), (4, "c"), (5, "d")], "article_id long, text string").coalesce(1)
    assert sorted(tuple(r) for r in G.model_entities(rows, ask, size=4).collect()) == [(1, "a"), (1, "b"), (4, "c"), (5, "d")]
    assert G.model_entities(rows.limit(0), ask).collect() == []


def test_consolidation_keeps_generic_titles_apart(spark):
    rows = [
        (1, "Fusão aprovada", "t", "n", "P1_CRITICO"), (2, "fusao  APROVADA!", "t", "n", "P2_ESTRATEGICO"), (3, "Fusão aprovada", "t", "i", "P1_CRITICO"),
        (4, "Sem título", "t", "n", "P1_CRITICO"), (5, "Sem título", "t", "n", "P1_CRITICO"), (6, None, "t", "n", "P3_MONITORAMENTO"),
        (7, "one two three four five six seven", "t", "n", "P3_MONITORAMENTO"), (8, "one two three four five six seven eight", "t", "n", "P3_MONITORAMENTO"),
        (9, "one two three four five six seven nine", "t", "n", "P1_CRITICO"),
    ]
    df = spark.createDataFrame(rows, "cluster_id long, title string, tag string, source_type string, priority string")
    assert sorted(tuple(r) for r in G.consolidation(df).collect()) == [(2, 1), (8, 7)]


def test_logs_ranges_and_days(spark, tmp_path):
    at = F.lit("2024-01-02 10:00:00").cast("timestamp")
    events = spark.createDataFrame([(7, "x")], "cluster_id long, m string")
    logs = S.log_rows(events, F.lit("INFO"), F.lit("broadcaster"), F.col("m"), at)
    assert tuple(logs.first())[:6] == ("INFO", "broadcaster", "x", "{}", None, 7)
    assert S.already_sent(logs, F.lit("2024-01-02").cast("date")).first()[0] is True
    assert S.already_sent(logs, F.lit("2024-01-03").cast("date")).first()[0] is False
    assert S.clear_range(logs).count() == 0
    assert S.clear_range(logs, "created_at", at - F.expr("INTERVAL 3 DAYS"), at - F.expr("INTERVAL 1 DAY")).count() == 0
    assert S.clear_range(logs, "created_at", at - F.expr("INTERVAL 3 DAYS"), at - F.expr("INTERVAL 2 DAYS")).count() == 1
    path = str(tmp_path / "days")
    rows = spark.createDataFrame([(1, "2024-01-01 05:00:00"), (2, "2024-01-02 05:00:00")], "k int, at string").withColumn("at", F.col("at").cast("timestamp"))
    S.write_days(rows, path, "at")
    S.write_days(rows.where("k = 2").withColumn("k", F.lit(9)), path, "at")
    assert sorted(r["k"] for r in spark.read.parquet(path).collect()) == [1, 9]


def test_journal_names(spark):
    rows = spark.createDataFrame([("Valor Econômico.epub", None), ("notes.txt", "REUTERS today"), ("x.PDF", ""), ("notes.txt", "hello"), (None, None)], "f string, m string")
    assert [r[0] for r in rows.select(T.is_journal(F.col("f"), F.col("m"))).collect()] == [True, True, True, False, False]
