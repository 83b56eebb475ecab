"""Operators against plain loops over generated texts."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyline.llm import decontaminate, leaders, line_dedup, mixture, ngram_join, pii, quality, suffix_dedup
from storyline.llm.components import components


def union_find(n, edges):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return [root(i) for i in range(n)]


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(300, 380)] + [(400, k) for k in range(401, 480)]
    got = {x["id"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = union_find(480, edges)
    assert got == {i: want[i] for e in edges if e[0] != e[1] for i in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for k, p in PATTERNS.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": k != "ip" or all(int(x) <= 255 for x in m.group().split(".")), "card": 12 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[k]
            if ok:
                out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda s: (s[0], list(PATTERNS).index(s[2])))


def test_pii_base_spans():
    r = random.Random(2)
    for _ in range(20_000):
        text = "".join(r.choice(r.choice(["0123456789. -", "ab@.+%-é", "+()0123456789 -.", "4111 1111-"])) for _ in range(r.randint(0, 45)))
        assert pii.find(text) == plain_spans(text)


@pytest.mark.parametrize("text,found", [
    ("mail john [at] example [dot] com now", "john [at] example [dot] com"), ("john at example dot com", "john at example dot com"), ("jоhn@exаmple.com!", "jоhn@exаmple.com"),
    ("john(at)mail.example.com", "john(at)mail.example.com"), ("card ４１１１ １１１１ １１１１ １１１１ x", "４１１１ １１１１ １１１１ １１１１"), ("bob&#64;site&#46;org", "bob&#64;site&#46;org"),
    ("plus four four two zero seven nine four six zero nine five eight", "plus four four two zero seven nine four six zero nine five eight"),
    ("one nine two dot one six eight dot zero dot one", "one nine two dot one six eight dot zero dot one"), ("192[.]168[.]0[.]1", "192[.]168[.]0[.]1"), ("4111 11l1 11I1 1111", "4111 11l1 11I1 1111"),
    ("jo\u200bhn@example.com", "jo\u200bhn@example.com"),
])
def test_pii_disguises(text, found):
    base, every = pii.spans_of(text)
    assert found in [text[s:e] for s, e, _ in every] and set(base) <= set(every)


@pytest.mark.parametrize("kind,found", [
    ("card", "four two " * 7 + "four two"), ("card", "four " + "one " * 14 + "one"), ("card", "four 242 4242 4242 4242"), ("phone", "plus " + "four two " * 5 + "four"),
    ("email", "jane at example.com"), ("email", "jane dot doe at example.com"), ("email", "jane at mail.example dot com"), ("email", "jane at mail.example.co.uk"),
])
def test_pii_spelled_by_identifier(kind, found):
    """Identifiers of few different digits, and a bare at before a dotted domain."""
    text = f"ask: {found}, please"
    assert (5, 5 + len(found), kind) in pii.spans_of(text)[1]


@pytest.mark.parametrize("text", ["he arrived at 10.30 or at 3.5 km", "un " * 15, "two two two and one four one four", "s\u0130x pens at noon"])
def test_pii_leaves_runs_that_are_no_identifier(text):
    assert pii.spans_of(text) == ([], [])


@pytest.mark.parametrize("text", ["look at me dot, at the dot com", "un un un un un un un un un un un un un", "one two three four", "meet at noon dot", "été à Málaga, niño"])
def test_pii_leaves_clean_texts(text):
    assert pii.spans_of(text) == ([], [])


def test_wu_manber():
    r = random.Random(3)
    for _ in range(150):
        voc = ["a", "b", "ab", "ba", "é", "aba", "abab", "x1", "zzzzzzzzzzzzz"][: r.randint(2, 9)]
        items = [(str(i), " ".join(r.choices(voc, k=r.choice([0, 1, 2, 3, 5, 9, 10, 11, 15, 30])))) for i in range(r.randint(1, 6))]
        doc = " ".join(r.choices(voc, k=r.randint(0, 200))) + " " + items[0][1]
        w, hit, own = decontaminate.words(doc), set(), set()
        for i, t in items:
            x = decontaminate.words(t)
            n = min(10, len(x))
            for k in range(len(x) - n + 1 if x else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == x[k : k + n]:
                        hit |= set(range(p, p + n))
                        own.add(i)
        (ranges, got), _ = decontaminate.Searcher(items).hits([w, w[:2]])
        assert {q for a, b in ranges for q in range(a, b)} == hit and got == own


def near_copies(r, n, most_edits, voc=2000, sizes=(4, 12, 40, 120)):
    out = []
    for _ in range(n):
        base = [f"w{int(voc * r.random() ** 2)}" for _ in range(r.choice(sizes))]
        out.append(" ".join(base))
        for _ in range(r.choice([0, 0, 1, 4])):
            t = list(base)
            for _ in range(r.randint(1, most_edits)):
                k = r.randrange(len(t) + 1)
                t[k : k + r.randint(0, 1)] = [f"w{r.randrange(voc)}"] * r.randint(0, 1)
            out.append(" ".join(t))
    r.shuffle(out)
    return out


def shingles(text, k=5):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.mark.parametrize("seed,edits", [(1, 2), (2, 5)])
def test_ngram_join_is_exact(spark, seed, edits):
    texts = near_copies(random.Random(seed), 180, edits) + ["", "w1", "w1 w2 w3", "W1 w2 W3"]
    sets = [shingles(t) for t in texts]
    at = defaultdict(list)
    links = []
    for i, s in enumerate(sets):
        for j, n in Counter(j for g in s for j in at[g]).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                links.append((j, i))
        for g in s:
            at[g].append(i)
    out = ngram_join.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()} == {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, union_find(len(sets), links)))}


def test_partition_levels_are_complete():
    """At every level a similar pair shares a signature that the larger set probes."""
    r = np.random.default_rng(5)
    for n in (1, 2, 5, 6, 9, 14, 30, 77, 300):
        for _ in range(40):
            x = np.unique(r.integers(0, 1 << 63, n, np.uint64))
            part = ngram_join.Partition(ngram_join.band_of(len(x)), 80)
            drop = part.most_different(len(x))
            y = np.sort(r.permutation(x)[: len(x) - r.integers(0, drop + 1)]) if drop else x
            if len(np.intersect1d(x, y)) * 100 < 80 * len(np.union1d(x, y)) or not len(y):
                continue
            level = part.need(x)[1]
            assert len(np.intersect1d(part.signatures(x, level), part.signatures(y, level)))
            assert len(np.intersect1d(part.signatures(x, ngram_join.PREFIXES), part.signatures(y, ngram_join.PREFIXES)))


def test_join_signs_a_set_once(spark, monkeypatch):
    """Of texts with equal sets one is signed in each of the two passes; copies still end in one class."""
    signed, sign = spark.sparkContext.accumulator(0), ngram_join._sign

    def counted(*args):
        def run(batches):
            for b in batches:
                signed.add(b.num_rows)
                yield from sign(*args)(iter([b]))

        return run

    monkeypatch.setattr(ngram_join, "_sign", counted)
    base = " ".join(f"word{i}" for i in range(60))
    texts = [base] * 40 + [base.upper() + " more"] * 10 + ["quite another text of seven words here", None]
    got = {x["id"]: x["class"] for x in ngram_join.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len({got[i] for i in range(50)}) == 1 and got[50] not in (None, got[0]) and got[51] is None
    assert 3 <= signed.value <= 6


def char_shingles(line, k=8):
    return {line[i : i + k] for i in range(len(line) - k + 1)} if len(line) >= k else {line}


def test_line_dedup(spark):
    r = random.Random(6)
    lines = []
    for _ in range(250):
        base = " ".join(f"{'abcdefgh'[int(8 * r.random())] * r.randint(1, 3)}{int(900 * r.random() ** 2)}" for _ in range(r.choice([1, 3, 8, 15, 40])))
        lines.append(base)
        for _ in range(r.choice([0, 1, 3])):
            t = list(base)
            for _ in range(r.randint(1, max(1, len(t) // 70))):
                t[r.randrange(len(t))] = "*"
            lines.append("".join(t))
    r.shuffle(lines)
    rows = [(i, "\n".join(lines[4 * i : 4 * i + 4])) for i in range(len(lines) // 4)]
    distinct = list(dict.fromkeys(x.strip() for _, t in rows for x in t.split("\n")))
    sets = [char_shingles(x) for x in distinct]
    truth = [(i, j) for j in range(len(sets)) for i in range(j) if (n := len(sets[i] & sets[j])) >= 0.8 * (len(sets[i]) + len(sets[j]) - n)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {x["doc_id"]: x["text"] for x in line_dedup.dedup_lines(df).collect()}
    place = {x: i for i, x in enumerate(distinct)}
    ids = {x["lid"]: place[x["line"]] for x in line_dedup._lines(df, "doc_id", "text").select("lid", "line").distinct().collect()}
    _, links = line_dedup.similar_lines(df, "doc_id", "text", 0.8)
    got = [tuple(sorted((ids[x["a"]], ids[x["b"]]))) for x in links.collect()]
    assert set(got) <= set(truth)
    component = union_find(len(sets), got)
    assert sum(component[a] == component[b] for a, b in truth) >= 0.97 * len(truth)
    seen = set()
    for i, t in rows:
        kept = []
        for x in t.split("\n"):
            if (c := component[place[x.strip()]]) not in seen:
                seen.add(c)
                kept.append(x)
        assert out[i] == "\n".join(kept)


def test_line_dedup_signs_all_shingles(spark):
    """Lines with a long token among many words, and repeated words at different lengths, are linked whatever their length."""
    r = random.Random(11)
    word = lambda: "".join(r.choices("abcdefghij", k=5))
    pairs = []
    for _ in range(60):
        token = "".join(r.choices("0123456789abcdef", k=900))
        pairs.append([" ".join([token, *(word() for _ in range(18))]) for _ in range(2)])
    for unit in ("ha ", "buy now ", "- - "):
        pairs.append([(unit * 100)[:59].strip(), (unit * 100)[:199].strip()])
    for a, b in pairs:
        x, y = char_shingles(a), char_shingles(b)
        assert len(x & y) >= 0.8 * len(x | y)
    df = spark.createDataFrame([(i, "\n".join(p)) for i, p in enumerate(pairs)], "doc_id long, text string")
    out = {x["doc_id"]: x["n_removed"] for x in line_dedup.dedup_lines(df).collect()}
    assert all(out[i] == 1 for i in range(60, 63))
    assert sum(out[i] == 1 for i in range(60)) >= 0.9 * 60


def test_line_signing_is_compiled(spark):
    """Distinct lines are signed once, each band by one key, without interpreted functions on shingles."""
    long, short = "a line of some forty characters, or more " * 5, "brief"
    df = spark.createDataFrame([(1, f"{long}\n{short}\n\n{long}"), (2, long), (3, None), (4, short + " 1")], "doc_id long, text string")
    keys = line_dedup._band_keys(line_dedup._lines(df, "doc_id", "text"))
    got = [tuple(x) for x in keys.collect()]
    of = Counter(lid for lid, _ in got)
    assert len(got) == len(set(got)) and sorted(of.values())[:2] == [1, 1] and len(of) == 3 and 4 <= max(of.values()) <= 8
    assert "lambda" not in keys._jdf.queryExecution().executedPlan().toString()


def test_lines_do_not_carry_their_text(spark):
    """The key of a document is made once, not of the whole text for each of its lines."""
    df = spark.createDataFrame([(1, " a\r\n\n b\tc\t\n\t"), (2, None), (None, "")], "doc_id long, text string")
    lines = line_dedup._lines(df, "doc_id", "text")
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Generate")]
    assert "xxhash64(doc_id" not in above and [(x["id"], x["pos"], x["line"]) for x in lines.collect()] == [(1, 0, "a"), (1, 2, "b\tc")]


def test_sketches_pass_similar_lines(spark):
    """Lines of no more shingles than a sketch holds are passed over only if they aren't similar, whatever falls together in its 16 bits."""
    r, pairs = random.Random(8), []
    for _ in range(150):
        line = [r.choice("abcdefgh") for _ in range(r.randint(60, line_dedup.SKETCH))]
        copy = list(line)
        for _ in range(r.randint(1, max(1, len(line) // 60))):
            copy[r.randrange(len(copy))] = r.choice("XYZ#")
        pairs.append(("".join(line), "".join(copy)))
    df = spark.createDataFrame([(2 * i + k, p[k]) for i, p in enumerate(pairs) for k in range(2)], "id long, line string")
    known = line_dedup._sketched(df)
    assert known.schema["sketch"].dataType.simpleString() == "array<smallint>" and known.count() == 300
    side = lambda c: known.select(F.floor(F.col("id") / 2).alias("pair"), (F.col("id") % 2).alias(f"{c}k"), F.struct("n", "sketch").alias(c))
    met = side("x").where("xk = 0").join(side("y").where("yk = 1"), "pair").select("pair", line_dedup._agree(F.col("x"), F.col("y"), 0.8).alias("may"))
    may = {x["pair"]: x["may"] for x in met.collect()}
    close = [len(a & b) >= 0.8 * len(a | b) for a, b in ((char_shingles(x), char_shingles(y)) for x, y in pairs)]
    assert 20 < sum(close) < 140 and all(may[i] for i in range(150) if close[i])


def templated(r, common, own, n):
    """Lines of one template, each with a part of its own and an edited copy, and some of unlike length."""
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=r.randint(2, 9)))
    text = lambda k: " ".join(word() for _ in range(k))[:k]
    template, out = text(common), []
    for _ in range(n):
        line = template + " " + text(own)
        copy = list(line)
        for _ in range(1 if own < 50 else 4):
            copy[r.randrange(len(copy))] = r.choice("XYZ#")
        out += [line, "".join(copy)]
        if r.random() < 0.1:
            out.append(line + " " + text(own // 2))
    return out


@pytest.mark.parametrize(("common", "own"), [(260, 70), (200, 80), (90, 30)])
def test_line_dedup_of_templates(spark, common, own):
    """Lines of one template fall into large bands; the similar ones among them are still found."""
    lines = templated(random.Random(common), common, own, 300)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    sets = [char_shingles(x) for x in lines]
    near = {}
    for j in range(len(sets)):
        for i in range(j):
            n = len(sets[i] & sets[j])
            if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n):
                near[i, j] = n / (len(sets[i]) + len(sets[j]) - n)
    place = {x["lid"]: x["id"] for x in line_dedup._lines(df, "doc_id", "text").collect()}
    _, links = line_dedup.similar_lines(df, "doc_id", "text", 0.8)
    got = {tuple(sorted((place[x["a"]], place[x["b"]]))) for x in links.collect()}
    assert got <= set(near)
    component = union_find(len(sets), got)
    found = {p for p in near if component[p[0]] == component[p[1]]}
    closer = [p for p, similarity in near.items() if similarity >= 0.85]
    assert len(near) > 100 and len(found) >= 0.95 * len(near) and sum(p in found for p in closer) >= 0.98 * len(closer)


def test_line_bands_do_not_depend_on_blocks(spark, monkeypatch):
    """Every pair of a band meets, however a band is cut into blocks."""
    lines = templated(random.Random(3), 200, 80, 60)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    links = lambda: {tuple(x) for x in line_dedup.similar_lines(df, "doc_id", "text", 0.8)[1].collect()}
    whole = links()
    monkeypatch.setattr(leaders, "BLOCK", 3)
    monkeypatch.setattr(leaders, "AGAINST", 5)
    assert whole and links() == whole


def plain_repeats(texts, length):
    raw = [t.encode() for t in texts]
    n = Counter(b[p : p + length] for b in raw for p in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 2, bool)
        for p in range(len(b) - length + 1):
            if n[b[p : p + length]] > 1:
                gone[p + 1 : p + length + 1] = True
        kept = bytes(c for c, g in zip(b, gone[1:]) if not g)
        out.append((len(b), int(gone.sum()), int(((~gone[:-1]) & gone[1:]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("group", [20_000, 1])
def test_suffix_dedup(spark, group):
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcé", k=r.randint(1, 6)))
    passages = [" ".join(word() for _ in range(r.randint(40, 90))) for _ in range(4)]
    texts = []
    for _ in range(60):
        parts = [" ".join(word() for _ in range(r.randint(0, 80))) for _ in range(2)]
        if r.random() < 0.6:
            p = r.choice(passages)
            a = r.randint(0, 60)
            parts.insert(1, p[a : len(p) - r.randint(0, 60)])
        texts.append(" ".join(parts))
    texts += [texts[0], texts[1] + "x", "z" * 450, "ab" * 150, "z" * 199]
    out = suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), group=group)
    assert {x["doc_id"]: tuple(x)[1:] for x in out.collect()} == dict(enumerate(plain_repeats(texts, 200)))


def test_suffix_levels_in_separate_calls(spark):
    """Batches added to a family that is opened anew each time give the entries of one batch of all."""
    r = random.Random(31)
    passage = "".join(r.choices("abcdef ", k=400))
    texts = ["".join(r.choices("ghijkl ", k=300)) + (passage if i % 4 == 0 else "") for i in range(24)]
    rows = lambda part: suffix_dedup.suffixes(spark.createDataFrame([(t,) for t in part], "text string"))
    once = suffix_dedup.LevelFamily(spark)
    once.add(rows(texts))
    family = suffix_dedup.LevelFamily(spark)
    family.add(rows(texts[:8]))
    for k in (8, 16):
        family = suffix_dedup.LevelFamily.open(spark, family.path)
        family.add(rows(texts[k : k + 8]))
    assert sorted(n for n, _, _ in family.levels) == [1, 2]
    got, want = (sorted(map(tuple, f.repeated().select("anchor", "run", "n", "runs").collect())) for f in (family, once))
    assert got == want and want


def test_long_words_do_not_collide_by_structure():
    """The Thue-Morse word and its complement are equal under polynomials modulo 2**64."""
    from storyline.llm.shingles import shingle_set, word_hashes

    word = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    assert word_hashes(word)[0] != word_hashes(other)[0]
    assert not set(shingle_set(" ".join([word] * 9))) & set(shingle_set(" ".join([other] * 9)))
    r = random.Random(5)
    words = list({"".join(r.choices("aB\u00e9", k=r.randint(1, 90))) for _ in range(20_000)})
    lower = {w.translate({c: c + 32 for c in range(65, 91)}) for w in words}
    assert len(set(word_hashes(" ".join(words)).tolist())) == len(lower) == len(set(word_hashes("\n".join(lower)).tolist()))
    assert word_hashes("x" + " y" * 3).tolist()[1] == word_hashes("zzzzzzzzz y").tolist()[1]


def test_mixture_meets_targets(spark):
    r = random.Random(9)
    rows = [(i, " ".join(["w"] * int(1 + 400 * r.random() ** 3)), r.choice(["a", "a", "a", "b", "c", None])) for i in range(1500)]
    out = mixture.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    total = Counter()
    for x in out:
        total[x["source"]] += x["taken"]
        assert x["size"] == len(rows[x["doc_id"]][1].split()) and x["taken"] in (0, x["size"], 2 * x["size"])
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = mixture.allocate([size[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5, 2.0)
    assert abs(sum(want) - 1.5 * sum(size.values())) < 1e-6
    for s, t in zip(order, want):
        assert t <= 2 * size[s] + 1e-6 and abs(total[s] - t) <= 0.01 * t
        assert {x["target"] for x in out if x["source"] == s} == {t}


def plain_targets(sizes, share, most):
    """Weights 3, 1, 2 in turn; sources that would exceed ``most`` sizes stop there one by one, the rest is dealt anew."""
    weight, stopped, total = [(3, 1, 2)[i % 3] for i in range(len(sizes))], set(), share * sum(sizes)
    while True:
        left = total - sum(most * sizes[i] for i in stopped)
        open_ = [i for i in range(len(sizes)) if i not in stopped]
        got = {i: left * weight[i] / sum(weight[k] for k in open_) for i in open_}
        over = [i for i in open_ if got[i] > most * sizes[i]]
        if not over:
            return [got.get(i, most * sizes[i]) for i in range(len(sizes))]
        stopped |= set(over)


def plain_pareto(docs, rest):
    """docs: (id, size, u). The ids that a Pareto order sample of unequal probabilities takes up to ``rest`` words."""
    low, high = 0.0, 1.0
    for _ in range(200):
        c = (low + high) / 2
        low, high = (c, high) if sum(min(1, c * s) * s for _, s, _ in docs) < rest else (low, c)
    p = {i: min(1.0, c * s) for i, s, _ in docs}
    order = sorted(docs, key=lambda d: (0.0 if p[d[0]] > 1 - 1e-9 else d[2] / (1 - d[2]) * (1 - p[d[0]]) / p[d[0]], d[0]))
    taken, words = [], 0
    for i, s, _ in order:
        if words + s >= rest:
            if words + s - rest <= rest - words:
                taken, words = [*taken, i], words + s
            break
        taken, words = [*taken, i], words + s
    return set(taken), words, p


def test_mixture_is_a_pareto_sample(spark):
    """But for at most one turned document a source, the copies are those of a plain Pareto order sample; targets are a plain loop's."""
    r = random.Random(21)
    rows = [(i, " ".join(["w"] * r.choice([1, 2, 5, 9, 17, 33, 61, 88])), r.choice("aaabbcd")) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    u = dict(df.selectExpr("doc_id", f"(pmod(xxhash64(doc_id, 17), {1 << 52}L) + 0.5D) / {1 << 52}L as u").collect())
    out = {x["doc_id"]: x for x in mixture.mix(df).collect()}
    by = defaultdict(list)
    for i, t, s in rows:
        by[s].append((i, len(t.split()), u[i]))
    sizes = [sum(d[1] for d in by[s]) for s in sorted(by)]
    unequal = 0
    for s, n, target in zip(sorted(by), sizes, plain_targets(sizes, 1.5, 2.0)):
        assert all(abs(out[i]["target"] - target) < 1e-6 for i, _, _ in by[s])
        whole = int(target // n)
        rest = target - whole * n
        if rest < 1e-6:
            continue
        want, words, p = plain_pareto(by[s], rest)
        got = {i for i, _, _ in by[s] if out[i]["copies"] > whole}
        assert len(want ^ got) <= 1 and all(out[i]["copies"] - whole in (0, 1) for i, _, _ in by[s])
        assert abs(sum(out[i]["taken"] for i, _, _ in by[s]) - target) <= abs(words - rest) + 1e-6
        unequal += len({round(x, 9) for x in p.values()}) > 1
    assert unequal


def test_mixture_includes_by_size(spark):
    """Over seeds, documents are taken as often as their inclusion probabilities say."""
    rows = [(i, " ".join(["w"] * (10 + 20 * (i % 4))), "b" if i < 400 else "a") for i in range(440)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    often, p = Counter(), {}
    for seed in range(6):
        for x in mixture.mix(df, seed=seed, share=0.5).collect():
            if x["source"] == "b":
                often[x["size"]] += x["copies"]
                p[x["size"]] = x["target"] / x["source_size"]
    df.unpersist()
    sizes = [10, 30, 50, 70]
    c = p[10] * sum(sizes) / sum(s * s for s in sizes)
    for s in sizes:
        assert abs(often[s] / 600 - min(1, c * s)) < 0.06


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    out = quality.score_documents(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    rows = out.where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    good, bad = ([x["score"] for x in rows if x["quality"] == q] for q in (1, 0))
    assert sum(a > b for a in good for b in bad) >= 0.97 * len(good) * len(bad)
    assert sum(x["predicted"] == x["quality"] for x in rows) >= 0.95 * len(rows)
