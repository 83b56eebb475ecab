"""Language identification: kernels against plain sets, held-out accuracy, and small cases."""

import zlib

import numpy as np
import pytest

from storyline.llm import langid

SF = "/root/testdata/sf0.01"


def test_kernel_counts_shared_grams():
    """The kernel of presence vectors is that of the sets of n-grams, but for hash collisions."""

    def grams(text):
        raw = b" " + b" ".join("".join(c if c.isalpha() else " " for c in text.lower()).encode().split()) + b" "
        return {raw[i : i + n] for n in langid.SPANS for i in range(len(raw) - n + 1)}

    texts = ["The quick brown fox", "the QUICK, brown dog!", "ação é útil", "x", "über 12 straße"]
    x = langid.spectra(texts)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            p, q = grams(a), grams(b)
            assert float(x[i] @ x[j]) == pytest.approx(len(p & q) / np.sqrt(len(p) * len(q)), abs=0.06)


def test_pieces_join(monkeypatch):
    """A text looked at in pieces has the n-grams of the whole."""
    text = "".join(chr(97 + (k * k) % 26) for k in range(5000)) + " fim"
    whole = langid.spectra([text])
    monkeypatch.setattr(langid, "_PIECE", 64)
    assert (langid.spectra([text]) == whole).all()


def test_nystroem_is_exact_on_landmarks():
    """With all rows as landmarks the features give the kernel matrix back."""
    x = langid.spectra([f"w{chr(97 + k)}rd {chr(110 + k)}x yz" for k in range(12)])
    model = langid.fit(x, ["a", "b"] * 6, landmarks=12)
    z = (x @ model.landmarks.T) @ model.root
    assert np.allclose(z @ z.T, x @ x.T, atol=1e-4)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    out = langid.identify(docs).collect()
    assert {r["doc_id"]: r["held_out"] for r in out} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in lang}
    tested = [r for r in out if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in tested) / len(tested) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in out)


def test_only_texts_and_taught_languages_count(spark):
    """Held-out languages, sources and ids change nothing."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    first = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs).collect()}
    f = langid.F
    changed = docs.withColumns({"lang": f.when(langid.held_out(f.col("doc_id")), "zz").otherwise(f.col("lang")), "source": f.lit("x")})
    assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(changed).collect()} == first


def test_small_cases(spark):
    rows = [(i, t, g) for i, (t, g) in enumerate([("the cat and the dog", "en"), ("o gato e o cão não", "pt"), ("der hund und die katze", "de")] * 20)]
    rows += [(100, None, "en"), (101, "", "en"), (102, "123 !?", "pt"), (103, "the dog", None), (None, "the dog", "en"), (104, "não " * 300_000, "pt"), (0, "the cat and the dog", "en"), (0, "the cat and the dog", "en"), (105, "ª", "pt"), (106, "猫", "pt")]
    schema = "doc_id long, text string, lang string, score double, lang_pred string, h long, id int"
    out = langid.identify(spark.createDataFrame([(*r, 7.0, "x", 1, 2) for r in rows], schema)).collect()
    assert len(out) == len(rows) and sum(r["doc_id"] == 0 for r in out) == 3
    by = {r["doc_id"]: r for r in out}
    assert [by[k]["lang_pred"] for k in (100, 101, 102)] == ["und"] * 3 and by[100]["score"] == 0
    assert by[103]["lang_pred"] == "en" and by[104]["lang_pred"] == "pt" and by[None]["held_out"] is False and by[106]["lang_pred"] in ("en", "pt", "de")


def test_nothing_to_learn(spark):
    schema = "doc_id long, text string, lang string"
    assert langid.identify(spark.createDataFrame([], schema)).count() == 0
    out = langid.identify(spark.createDataFrame([(1, "a b", None), (2, None, "en")], schema)).collect()
    assert {(r["lang_pred"], r["score"]) for r in out} == {("und", 0.0)}


def test_rare_languages_are_learnt(spark):
    rows = [(i, "the cat and the dog were here", "en") for i in range(2000)] + [(5000 + i, "gato cão pássaro não está", "pt") for i in range(12)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_lang=30, most=40)
    assert model.langs == ("en", "pt") and model.predict(["gato e cão"])[0] == ["pt"]
