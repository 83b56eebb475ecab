"""Merges of clusters: one pass over the titles, links by rare tokens."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyline.functions import text as T
from storyline.operators import similarity
from storyline.operators import stages as G
from storyline.operators.clustering import components, title_key


def test_word_sets_see_words_as_the_columns_do(spark):
    """Marks, capitals, other scripts and blanks; equal keys and words where the Column functions have equal ones."""
    odd = "".join(chr(i) for i in [*range(1, 0x600), 0x1E9E, 0x1EA5, 0x2028, 0x212A, 0x3000, 0xFB01, 0xFF21, 0x1D400])
    texts = [None, "", "  ", "Ação é ÇA", "acao e ca", "été ete", "ete ete", "İstanbul İ straße", "x yz1_abc--ABC", "ab cd", "!?"] + [f"ab{c}cd {c}" for c in odd]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("p3", F.lit(True))
    got = {r["id"]: r for r in similarity.word_sets(df, "id", "text", "p3", []).collect()}
    want = df.select("id", title_key(F.col("text")).alias("key"), T.tokens(F.col("text")).alias("w")).collect()
    keys, words = {}, {}
    for r in want:
        assert keys.setdefault(r["key"] or None, got[r["id"]]["key"]) == got[r["id"]]["key"], texts[r["id"]]
        s = frozenset(r["w"] or [])
        assert words.setdefault(s, set(got[r["id"]]["w"])) == set(got[r["id"]]["w"]) and len(got[r["id"]]["w"]) == len(s), texts[r["id"]]
    assert len(set(keys.values())) == len(keys) and len({frozenset(w) for w in words.values()}) == len(words)


@pytest.mark.parametrize(("least", "part", "common"), [(0.85, 16384, 400), (0.85, 10, 400), (0.85, 16384, 100000), (0.85, 20, 100000), (0.5, 30, 100000)])
def test_links_connect_what_all_pairs_do(spark, monkeypatch, least, part, common):
    """Copies, near copies and others, with few tokens and with rare ones; in one part and in many."""
    monkeypatch.setattr(similarity, "PART", part)
    rng = np.random.default_rng(common)
    sets = []
    for n in rng.integers(1, 120, 60):
        s = rng.choice(common, int(n), replace=False)
        sets += [s, s] + [np.union1d(s[rng.random(len(s)) > drop], [common + len(sets)]) for drop in (0.02, 0.05, 0.1, 0.4)]
    df = spark.createDataFrame([(i, "ab"[i % 7 == 0], s.tolist()) for i, s in enumerate(sets)], "id long, block string, w array<long>")
    all_pairs = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if (i % 7 == 0) == (j % 7 == 0) and (n := len(np.intersect1d(sets[i], sets[j]))) / (len(sets[i]) + len(sets[j]) - n) >= least}
    got = [(r["a_id"], r["b_id"]) for r in similarity.set_pairs(df, ["block"], least).collect()]
    assert set(got) == all_pairs and len(got) == len(all_pairs) >= 60
    links = [(r["a_id"], r["b_id"]) for r in similarity.set_pairs(df, ["block"], least, forest=True).collect()]
    assert set(links) <= all_pairs
    of = lambda pairs: {r["id"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert of(links) == of(got)


def test_equal_sets_are_linked_not_paired(spark):
    """Clusters of one title under two tags of their own, all P3: n - 1 links a group, where pairs would be n * (n - 1) / 2."""
    df = spark.createDataFrame([(i, "t", [1, 2, 3, 4, 5, 6, 7, 8 + i % 2]) for i in range(300)], "id long, block string, w array<long>")
    assert similarity.set_pairs(df, ["block"], 0.85, forest=True).count() == 298
    assert similarity.set_pairs(df, ["block"], 0.5, forest=True).count() == 299


def test_consolidation_reads_titles_once(spark, tmp_path):
    """The titles' file is read by one scan: what follows works on the hashes that it wrote."""
    rows = [(i, f"Título número {i // 2} com palavras próprias{i // 2} iguais", "t", "n", "P3_MONITORAMENTO") for i in range(40)] + [(90, None, None, None, None)]
    spark.createDataFrame(rows, "cluster_id long, title string, tag string, source_type string, priority string").write.parquet(str(tmp_path / "c"))
    out = G.consolidation(spark.read.parquet(str(tmp_path / "c")))
    assert str(tmp_path) not in out._jdf.queryExecution().optimizedPlan().toString() and not any(str(tmp_path) in f for f in out.inputFiles())
    assert sorted(tuple(r) for r in out.collect()) == [(i + 1, i) for i in range(0, 40, 2)]
