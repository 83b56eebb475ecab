"""Scalar functions against tables of literals."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyline import domain as D
from storyline.functions import dates, jsonx
from storyline.functions import text as T
from storyline.functions import vectors as V
from storyline.operators import export


def apply(spark, values, fn, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r["r"] for r in df.select("i", fn(F.col("v")).alias("r")).orderBy("i").collect()]


CASES = [
    (T.fix_tag, {"": D.DEFAULT_TAG, None: D.DEFAULT_TAG, " STF ": "Jurídico, Falências e Regulatório", "fusão de bancos": "M&A e Transações Corporativas", "zzz": "IRRELEVANTE", "Política Pública hoje": "Política Econômica (Brasil)"}),
    (T.fix_priority, {"P1_CRITICO": "P1_CRITICO", "p1": "IRRELEVANTE", None: "IRRELEVANTE"}),
    (T.outlet_key, {"O Estado de S. Paulo": "estadao", "Estadão": "estadao", "Valor  PRO": "valor economico", None: "", "New Paper": "new paper"}),
    (T.outlet_name, {"SP O Estado de S Paulo - 150326": "O Estado de S.Paulo", "ines249": "", "Valor Econômico": "Valor Econômico", "WSJ Pro Edition": "The Wall Street Journal", "12 34": "", "My Paper": "My Paper", None: ""}),
    (T.source_nationality, {"FT Weekend": "internacional", "Folha": "nacional", None: "nacional", "The Times": "internacional"}),
    (T.is_generic_title, {None: True, "  ": True, "Sem título 3": True, "Novo cluster": True, "Selic sobe": False}),
    (T.short_title, {None: "Sem título", "": "Sem título", "Alta http://x.y/z da Selic. Depois cai.": "Alta da Selic.", "a b c d e f g h i j k l": "a b c d e f g h i j", " - Oi: ": "Oi"}),
    (T.strip_html, {"<p>a</p>\n <b>b</b>": "a b", None: "", "x": "x"}),
    (T.slug, {"Ação & Reação: hoje!": "acao-reacao-hoje", None: "sem-titulo", "---": "sem-titulo"}),
    (T.yaml_value, {"": '""', "plain": "plain", 'a: "b"': '"a: \\"b\\""'}),
    (T.page_number, {"p. 12-A": 12, None: 999999, "N/A": 999999}),
    (T.edge_word, {"(Olá!)": "olá", "x": "x"}),
    (T.entity_key, {" Itaú  Unibanco, S.A.": "itau unibanco sa"}),
    (T.canonical_entity, {"BACEN": "Banco Central do Brasil", "joão da silva": "João Da Silva", "vale s.a.": "Vale S.A.", "o'neil": "O'Neil"}),
    (T.canonical_source, {"SP O Estado de S Paulo - 150326": "O Estado de S. Paulo", "n/a": None, None: None, "Barra O Globo": "O Globo", "gazeta do povo 12.03.25": "Gazeta Do Povo", "ab": None}),
    (T.title_case, {"vale s.a.": "Vale S.A.", "": ""}),
    (T.after_marker, {"x Atualizado às 12h30m\nTexto": "Texto", " a\nb ": "ab"}),
    (T.is_noise, {"Horóscopo do dia": True, "Selic": False, None: False}),
    (T.is_portuguese, {None: True, "short": True, "the cat sat on the mat and looked at the other cat there": False, "o banco de todos e a casa do povo que em tudo manda": True}),
    (lambda c: T.is_advertisement(F.lit(None).cast("string"), c), {"Grande promoção": True, "loja na rua x": True, "das 10h às 12h na praça": True, "Selic sobe": False, "uma loja": False}),
    (lambda c: T.truncate(c, 8), {"123456789": "12345...", "12345678": "12345678", None: None}),
    (lambda c: T.gatekeeper(c)["reason"], {"sudoku de hoje": "noise", "curto": "too_short", "x" * 60: "ok"}),
    (T.safe_file_name, {None: "arquivo_sem_nome", "a b/ç-1.pdf": "abç-1.pdf"}),
    (T.escape_markdown, {"a_b*c[d`": "a\\_b\\*c\\[d\\`"}),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_text(spark, k):
    fn, table = CASES[k]
    assert dict(zip(table, apply(spark, list(table), fn))) == table


def test_source_type(spark):
    rows = [("Folha", True, "json", "brasil_online"), ("Folha", False, "json", "brasil_fisico"), ("BBC", True, "json", "internacional"), (None, True, "json", "brasil_online"), ("", True, "pdf", "brasil_fisico"), ("Xyz", True, "json", "internacional"), ("Xyz", False, "json", "brasil_online"), ("Xyz", True, "pdf", "brasil_fisico")]
    df = spark.createDataFrame(rows, "n string, u boolean, f string, want string")
    assert df.where(T.source_type(F.col("n"), F.col("u"), F.col("f")) != F.col("want")).count() == 0


def test_pages_label(spark):
    assert apply(spark, [[4], [5, 4, 4], [4, 7, 999999], [999999], []], T.pages_label, "array<int>") == ["p. 4", "p. 4-5", "p. 4, 7", "", ""]


def test_trigram_similarity(spark):
    a = spark.sql("select 'word' a, 'two words' b").select(T.set_similarity(T.trigrams(F.col("a")), T.trigrams(F.col("b")))).first()[0]
    assert round(a, 6) == 0.363636


def test_dates(spark):
    now = F.lit("2025-03-10 12:00:00").cast("timestamp")
    ts = ["2025-03-10 11:59:30", "2025-03-10 11:58:00", "2025-03-10 09:00:00", "2025-03-07 12:00:00"]
    assert apply(spark, ts, lambda c: dates.age_label(c.cast("timestamp"), now)) == ["há poucos segundos", "há 2 minutos", "há 3 horas", "há 3 dias"]
    assert apply(spark, ["x"], lambda c: dates.age_label_of_text(c, now)) == ["timestamp inválido"]
    day = dt.date
    assert apply(spark, ["2025-03-10", "10/03/2025", "2025-03-10 02:00:00", "x"], dates.parse_local_date) == [day(2025, 3, 10), day(2025, 3, 9), day(2025, 3, 9), None]
    assert apply(spark, ["3 de março de 2025 às 14:05", "3 de xyz de 2025", None], dates.long_date) == [dt.datetime(2025, 3, 3, 14, 5), None, None]
    assert apply(spark, ["3 de março de 2025"], lambda c: dates.long_date(c, True)) == [dt.datetime(2025, 3, 3, 23, 59, 59)]
    assert apply(spark, ["2025-03-09 11:00:00", "2025-03-09 13:00:00", "2025-03-10 13:00:00"], lambda c: dates.in_last_day(c.cast("timestamp"), now)) == [False, True, False]


def test_json(spark):
    cases = {
        '```json\n[1]\n```': "OK", 'x {"a": [1, 2,]} y': "TRUNCATED", 'x {"a": [1, 2,]}': "REPAIRED", "{'a': 'b'}": "INVALID", "none": "NO_JSON", "": "EMPTY", None: "EMPTY", '{"a": }': "INVALID",
        '[{"a": [1, 2': "INVALID", '{"k": [1, {"b": 2': "INVALID", '{"a": "it\'s"': "REPAIRED", '[{"a": 1}, {"b"': "INVALID", '{"a": [1], "b': "INVALID", '[{"a": 1}] so': "TRUNCATED", '[1], [2]': "INVALID",
    }
    assert apply(spark, list(cases), lambda c: jsonx.parse_reply(c)["status"]) == list(cases.values())
    got = apply(spark, ['[{"tema_principal": "T", "ids_originais": [3, 1, 3]}, {"tema_principal": "U", "ids_originais": ["2"'], jsonx.salvage_groups)[0]
    assert [(g["theme"], g["ids"]) for g in got] == [("T", [1, 3])]
    assert apply(spark, ['{"k": null}', "{}"], lambda c: jsonx.field_or(c, "k", F.lit("d"))) == [None, "d"]
    assert apply(spark, ["{a} {c}"], lambda c: jsonx.missing_placeholders(c, ["a", "b"])) == [["b"]]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0]), (None, [1.0])], "a array<float>, b array<float>")
    assert [round(r[0], 4) for r in df.select(V.cosine(F.col("a"), F.col("b"), -1.0)).collect()] == [0.7071, -1, -1, -1]
    c = spark.createDataFrame([([[2.0, 0.0], [0.0, 2.0], [4.0, 4.0]],)], "v array<array<float>>").select(V.running_centroid(F.col("v"))).first()[0]
    assert c == [2.5, 2.5]
    e = spark.range(1).select(V.stub_embedding(F.lit("abc")).alias("a"), V.stub_embedding(F.lit("abc")).alias("b")).first()
    assert e["a"] == e["b"] and abs(np.linalg.norm(e["a"]) - 1) < 1e-5


def test_stitching(spark):
    overlap = ["O banco central subiu a taxa de juros nesta quarta", "subiu a taxa de juros nesta quarta-feira, disse."]
    exact = ["O banco central subiu a taxa de juros hoje", "Subiu a taxa de juros hoje. Depois caiu."]
    running, apart = ["a taxa subiu", "e caiu depois"], ["Fim da frase.", "Outra frase."]
    got = apply(spark, [overlap, exact, running, apart, ["só um"], ["", "x"]], export.stitched, "array<string>")
    assert got == ["O banco central subiu a taxa de juros nesta quarta subiu a taxa de juros nesta quarta-feira, disse.", "O banco central Subiu a taxa de juros hoje. Depois caiu.", "a taxa subiu e caiu depois", "Fim da frase.\n\nOutra frase.", "só um", "x"]


def test_message_parts(spark):
    df = spark.createDataFrame([(1, "aaaa\nbbbb\ncccccccccccc\nd")], "i int, message string")
    assert [r["piece"] for r in export.message_parts(df, limit=10).orderBy("part").collect()] == ["aaaa\nbbbb\n", "cccccccccc", "cc\nd"]


def test_vector_udfs_keep_arrays():
    """A batch of vectors stays in arrays of four bytes a component; lists of Python numbers take some ten times that."""
    import numpy as np
    import pandas as pd

    from storyline.functions import vectors as V

    held = V.stub_embedding.func(pd.Series(["a", None]))
    back = V.decode_float32.func(V.encode_float32.func(pd.Series([np.array([1.5, -2.0]), None])))
    assert held[0].dtype == back[0].dtype == np.float32 and back[0].tolist() == [1.5, -2.0] and held[1] is None and back[1] is None


def test_a_text_is_classified_once(spark):
    """The tag is evaluated once for the tag and the priority."""
    from pyspark.sql import functions as F

    from storyline import providers
    from storyline.functions import text as T

    rows = spark.createDataFrame([("x",)], "text string")
    plan = lambda c: rows.select(c.alias("c"))._jdf.queryExecution().analyzed().toString().count("substring(text")
    assert plan(providers.keyword_classifier(F.col("text"))) == plan(T.fix_tag(F.substring("text", 1, 400))) > 0
