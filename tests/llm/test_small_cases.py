"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, operator by operator."""

import hashlib
import random

import pytest

from storyline.llm import decontaminate, fingerprint, line_dedup, mixture, ngram_join, pii, quality, suffix_dedup, url_filter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, id string, rk string, component int, score double"


def docs(spark, rows):
    """(doc_id, text, source) rows with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 1, "x", "y", 2, 0.5) for i, t, s in rows], DOCS)


WORDS = "the quick brown fox jumps over the lazy dog while seven tall ships sail past a quiet harbour at dawn under pale skies".split()
random.seed(4)
LONG = " ".join(random.choices(WORDS, k=30_000))
PROSE = [" ".join(random.choices([f"w{j}" for j in range(500)], k=60)) for _ in range(6)]
ROWS = [
    (1, PROSE[0], "a"), (2, PROSE[0], "a"), (3, PROSE[0] + " tail", None), (4, None, "b"), (5, "", "b"), (6, "  \n\t ", "b"), (7, LONG, "c"), (8, "one two", "c"), (9, "One  TWO", None),
    (10, PROSE[1], "a"), (10, PROSE[1], "a"), (None, PROSE[2], "c"), (11, "naïve ação 🙂 " + PROSE[3], "c"), (12, "x" * 5000, "c"), (13, "a@b.co, +1 (212) 555-0100; 10.0.0.1; 4111 1111 1111 1111", "c"),
]


def by_id(df, key="doc_id"):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], []).append(r)
    return out


OPERATORS = {
    "pii": lambda s, d: pii.find_pii(d),
    "mask": lambda s, d: pii.mask_pii(d),
    "quality": lambda s, d: quality.score_documents(d, s.createDataFrame([(1, 1), (4, 0), (None, 1), (7, None), (12, 0), (10, 1)], "doc_id long, quality int")),
    "contamination": lambda s, d: decontaminate.find_contamination(d, s.createDataFrame([(1, PROSE[0]), (2, None), (None, "x"), (3, ""), (4, "one two"), (4, "one two")], "item_id long, text string")),
    "fingerprint": lambda s, d: fingerprint.with_edited(d),
    "lines": lambda s, d: line_dedup.dedup_lines(d),
    "join": lambda s, d: ngram_join.jaccard_components(d),
    "suffixes": lambda s, d: suffix_dedup.remove_repeats(d),
    "mixture": lambda s, d: mixture.mix(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_gets_a_result(spark, name):
    out = by_id(OPERATORS[name](spark, docs(spark, ROWS)))
    assert {k: len(v) for k, v in out.items()} == {i: sum(r[0] == i for r in ROWS) for i, _, _ in ROWS}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    full, empty = (OPERATORS[name](spark, docs(spark, r)) for r in (ROWS[:1], []))
    assert empty.count() == 0 and empty.columns == full.columns


def test_pii_of_small_cases(spark):
    out = by_id(pii.find_pii(docs(spark, ROWS)))
    assert out[4][0]["spans"] == "" and out[5][0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert [out[13][0][f"n_{k}"] for k in pii.KINDS] == [1, 1, 1, 1]
    masked = by_id(pii.mask_pii(docs(spark, ROWS)))
    assert masked[13][0]["text"] == "<email>, <phone>; <ip>; <card>" and masked[4][0]["text"] is None


def test_lines_of_small_cases(spark):
    a, b = "The committee met on Tuesday to discuss the annual harbour budget.", "Ships left the port early in the morning before the storm arrived."
    rows = [(2, f"{a}\n\n{b}", "s"), (1, f"{a}\nOther.", "s"), (3, f"{b[:-1]}!\n  {a}  \nOther.\nown line of three", "s"), (4, None, "s"), (5, "", "s"), (6, f"{a}\n{a}", None), (6, f"{a}\n{a}", None)]
    out = {k: v[0] for k, v in by_id(line_dedup.dedup_lines(docs(spark, rows))).items()}
    assert out[1]["text"] == f"{a}\nOther." and out[2]["text"] == f"\n{b}" and out[3]["text"] == "own line of three"
    assert out[4]["text"] is None and out[5]["text"] == "" and out[6]["text"] == "" and out[6]["n_removed"] == 2
    assert set(DOCS.replace(" ", ",").split(",")) & {"component"} and out[1]["component"] == 2


def test_contamination_of_small_cases(spark):
    out = by_id(OPERATORS["contamination"](spark, docs(spark, ROWS)))
    assert out[1][0]["n_hit"] == 60 and out[3][0]["n_hit"] == 60 and out[3][0]["n_words"] == 61 and out[1][0]["items"] == ["1"]
    assert out[8][0]["items"] == ["4"] and out[9][0]["contaminated"] and out[4][0]["n_words"] == 0 and not out[10][0]["contaminated"]
    bench = spark.createDataFrame([(1, PROSE[0])], "item_id long, text string")
    kept = decontaminate.drop_contaminated(docs(spark, ROWS), bench)
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [4, 5, 6, 7, 8, 9, 10, 10, 11, 12, 13] and kept.columns == docs(spark, []).columns


def test_contamination_in_several_groups(spark, monkeypatch):
    bench = spark.createDataFrame([(i, p) for i, p in enumerate(PROSE)], "item_id long, text string")
    one = sorted(map(str, decontaminate.find_contamination(docs(spark, ROWS), bench).collect()))
    monkeypatch.setattr(decontaminate, "GROUP_BYTES", 500)
    assert sorted(map(str, decontaminate.find_contamination(docs(spark, ROWS), bench).collect())) == one


def test_join_of_small_cases(spark):
    out = {k: v[0] for k, v in by_id(ngram_join.jaccard_components(docs(spark, ROWS))).items()}
    assert [out[i]["component_id"] for i in (1, 2, 3, 4, 5, 6, 8, 9, None)] == [1, 1, 1, 4, 5, 6, 8, 8, None]
    assert [out[i]["n_shingles"] for i in (1, 3, 4, 6, 8, 12)] == [56, 57, 0, 0, 1, 1]
    kept = [r["doc_id"] for r in ngram_join.keep_one(docs(spark, ROWS)).collect()]
    assert sorted(k for k in kept if k is not None) == [1, 4, 5, 6, 7, 8, 10, 10, 11, 12, 13] and None in kept


def test_suffixes_of_small_cases(spark):
    out = {k: v[0] for k, v in by_id(suffix_dedup.remove_repeats(docs(spark, ROWS))).items()}
    assert out[1]["n_removed"] == out[1]["n_bytes"] == out[2]["n_removed"] and out[1]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert out[3]["n_removed"] == len(PROSE[0]) and out[12]["n_removed"] == 5000 and out[10]["n_removed"] == out[10]["n_bytes"]
    assert out[4]["n_bytes"] == 0 and out[13]["n_removed"] == 0 and out[11]["n_removed"] == 0


def test_fingerprints_of_small_cases(spark):
    rows = [r for r in ROWS if r[0] is not None and r[0] != 10]
    out = {k: v[0] for k, v in by_id(fingerprint.with_edited(docs(spark, rows))).items()}
    order = sorted(rows, key=lambda r: -r[0])
    for k, (i, t, _) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        new = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        r = out[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert r["fingerprint"] == fingerprint.digest(t) and r["edited_fingerprint"] == fingerprint.digest(new)
        assert r["near_next"] == fingerprint.likeness(fingerprint.digest(t), fingerprint.digest(nxt))
    assert out[1]["fingerprint"] == out[2]["fingerprint"]
    assert fingerprint.with_edited(docs(spark, [(1, "abcd", "s")])).first()["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()


def test_mixture_of_small_cases(spark):
    rows = [r for d in (mixture.mix(docs(spark, ROWS)).collect(), mixture.mix(docs(spark, ROWS).repartition(3)).collect()) for r in [sorted(map(str, d))]]
    assert rows[0] == rows[1]
    for r in mixture.mix(docs(spark, ROWS)).collect():
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["size"] or not r["taken"])
    kept = mixture.mix(docs(spark, ROWS), keep=("text", "lang", "size", "rk"))
    assert {"text", "lang", "rk"} < set(kept.columns) and len(kept.columns) == len(set(kept.columns))


def test_quality_of_small_cases(spark):
    out = {k: v[0] for k, v in by_id(OPERATORS["quality"](spark, docs(spark, ROWS))).items()}
    assert out[4]["score"] == out[5]["score"] == out[6]["score"] == 0 and all(0 <= r["score"] <= 1 for r in out.values())
    none = quality.score_documents(docs(spark, ROWS), spark.createDataFrame([], "doc_id long, quality int"))
    assert {round(r["score"], 6) for r in none.where("length(trim(text_)) > 0" if "text_" in none.columns else "doc_id = 1").collect()} == {0.7}
    kept = quality.keep_good(docs(spark, ROWS), spark.createDataFrame([(1, 1), (12, 0)], "doc_id long, quality int"))
    assert kept.columns == docs(spark, []).columns


PAGES = [(1, "http://a.org/x", "p" * 1200), (2, "http://a.org/x", "p" * 1200), (3, None, "p" * 1200), (4, "u\r\nX: y", "short"), (5, "u5", "short"), (6, "u6", None), (None, "n", "p" * 1200), (7, "u7", "é\r\n\r\nWARC/1.1\r\n" * 300), (8, "u8", ""), (3, None, "p" * 1200)]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(*p, "z", 1) for p in PAGES], "page_id long, url string, html string, payload string, record_type int")
    path = warc.deduplicated_archive(pages)
    back = warc.read_warc(spark, path, with_payload=True)
    rows = sorted(((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"], r["url"]) for r in back.collect()), key=str)
    digest = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    exp = sorted(((i or 0, "revisit" if t and len(t) == 1200 and i != 3 else "response", 3 if t and len(t) == 1200 and i != 3 else None, len((t or "").encode()), digest(t), u) for i, u, t in PAGES), key=str)
    assert rows == exp
    whole = {r["page_id"]: r["payload"] for r in warc.restore_payloads(back).collect()}
    assert whole == {i: t or "" for i, _, t in PAGES}
    empty = warc.read_warc(spark, warc.deduplicated_archive(pages.limit(0)))
    assert empty.count() == 0


def test_warc_reader_finds_damage():
    with pytest.raises(ValueError):
        list(warc.parse_warc(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort\r\n\r\n"))


def test_url_rules(spark):
    rules = [url_filter.host_rule(*r) for r in (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))] + [url_filter.word_rule("casino", "block")]
    cases = {
        "http://example.org/en/123": ("example.org", "/en/123", "example.org/en/1", "block"), "http://A.Example.ORG/en/2?x": ("a.example.org", "/en/2", "org/", "allow"),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"), "https://x.com/de/a#b": ("x.com", "/de/a", "com/de/", "block"), "http://x.com/DE/": ("x.com", "/DE/", None, "allow"),
        "http://x.org": ("x.org", "", None, "allow"), "http://big-casino.net?/org/": ("big-casino.net", "", None, "block"), "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"),
        "http://casinos.net/": ("casinos.net", "/", None, "allow"), "x://com/fr/ü": ("com", "/fr/ü", "com/fr/", "allow"), "a://b://c/d": ("b:", "//c/d", None, "allow"),
    }
    df = spark.createDataFrame([(k, u, "h", "p") for k, u in enumerate(cases)], "page_id long, url string, host string, path string")
    out = {r["page_id"]: tuple(r)[1:] for r in url_filter.filter_urls(df, rules).collect()}
    assert out == dict(enumerate(cases.values()))
    assert url_filter.filter_urls(df.limit(0), rules).count() == 0
