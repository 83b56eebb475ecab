"""The source divergence audit against plain loops, and its small cases."""

import random
import re
from collections import Counter, defaultdict

import pytest

from storyline.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, min_docs, top):
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
        n[lang, source].update(found)
        docs[lang].update(set(found))
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for t, k in docs[lang].items() if k >= min_docs)
        whole = Counter()
        for s in sources:
            whole.update({t: n[lang, s][t] for t in kept})

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return [1 + 10**9 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept]

        q = shares(whole)
        of = {s: shares(n[lang, s]) for s in sources}
        for s in sources:
            pairs = sorted(((sum(abs(x - y) for x, y in zip(of[s], of[o], strict=True)), o) for o in sources if o != s), key=lambda x: (-x[0], x[1].encode()))
            terms = sorted(((p - b, t) for p, b, t in zip(of[s], q, kept, strict=True) if p > b and n[lang, s][t]), key=lambda x: (-x[0], x[1].encode()))
            out |= {(lang, s, "pair", o, v, k + 1) for k, (v, o) in enumerate(pairs)} | {(lang, s, "term", t, v, k + 1) for k, (v, t) in enumerate(terms[:top])}
    return out


def made(seed, n_sources):
    r = random.Random(seed)
    common, out = [f"c{chr(97 + k)}x" for k in range(20)], []
    for _ in range(500):
        s = r.randrange(n_sources) if r.random() < 0.7 else 0
        own = [f"own{chr(97 + s)}{chr(97 + r.randrange(4))}", f"pair{chr(97 + s // 2)}", "Ação", "NAÏVE", "naïve"]
        words = r.choices(common, weights=range(1, 21), k=r.randrange(12)) + r.choices(own, k=r.randrange(8))
        out.append((" 1,".join(words), r.choice(["en", "de"]), f"s{s}"))
    return [*out, (None, "en", "quiet"), ("", "en", None), ("alone", "xx", "one"), ("x y", None, None), ("x", None, "b"), ("x", None, "b"), ("Z" * 200_000 + " caX", "en", "s1")]


@pytest.mark.parametrize(("heavy", "n_sources"), [(8, 12), (1, 12), (100, 12), (8, 2)])
def test_against_loops(spark, heavy, n_sources, monkeypatch):
    monkeypatch.setattr(divergence, "TILE_TERMS", 7)
    monkeypatch.setattr(divergence, "TILE_GROUPS", 4)
    rows = made(heavy, n_sources)
    docs = spark.createDataFrame([(i, *r, 1, "z", 0) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, value int, term string, p int")
    got = [tuple(r) for r in divergence.audit(docs, min_docs=6, heavy=heavy, top_terms=9).collect()]
    want = plain(rows, 6, 9)
    assert len(got) == len(want) and set(got) == want


def test_shares_beyond_64_bits(spark):
    big = 10**12
    df = spark.createDataFrame([(big, 3 * big, 7)], "n long, total long, kept long")
    assert df.select(divergence._share(divergence.F.col("n"), divergence.F.col("total"))).first()[0] == 1 + 10**9 * (big + 5) // (3 * big + 35)


def test_empty_table(spark):
    out = divergence.audit(spark.createDataFrame([], "doc_id long, text string, lang string, source string"))
    assert out.count() == 0 and out.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_counts_are_sent_in_pieces(spark, monkeypatch):
    """What a task holds does not change what is counted."""
    docs = spark.createDataFrame([(f"a b{chr(97 + k % 26)} c", "en", "s") for k in range(300)], "text string, lang string, source string")
    whole = sorted(tuple(r) for r in divergence.term_counts(docs).collect())
    assert ("en", "s", "a", 300, 300) in whole and ("en", "s", "", 0, 0) in whole
