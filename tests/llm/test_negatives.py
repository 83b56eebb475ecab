"""Hard negatives against plain loops, and their small cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from storyline.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score long, cell int, aid long"


def plain(rows, positives=5, count=10):
    held = []
    for vec_id, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) or abs(x) >= 1 << 17 for x in v):
            continue
        held.append((vec_id, label, [math.floor(256 * x) for x in v]))
    out, last = [], math.inf
    for a, label, v in {(h[0], h[1], tuple(h[2])) for h in held if h[0] is not None and h[0] % 100 == 0}:
        scored = sorted(((-sum(x * y for x, y in zip(v, w, strict=False)), last if i is None else i, m) for i, m, w in held if i != a))
        for p, i, _ in [x for x in scored if x[2] == label][:positives]:
            fit = [x for x in scored if x[2] != label and 30 * -p <= 100 * -x[0] <= 90 * -p][:count]
            out += [(a, None if i == last else i, k + 1, None if j == last else j, -p, -n) for k, (n, j, _) in enumerate(fit)]
    return sorted(out, key=str)


def floats(*x):
    import numpy as np

    return [float(np.float32(y)) for y in x]


def check(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in negatives.mine(df).collect()), key=str)
    assert got == plain(rows)
    return got


@pytest.mark.parametrize("spread", [0.05, 0.6])
def test_against_loops(spark, spread, monkeypatch):
    """Clustered and scattered vectors, parts and chunks smaller than the table, a vector held by a third of the rows."""
    monkeypatch.setattr(negatives, "ROWS", 300)
    monkeypatch.setattr(negatives, "ANCHORS", 2)
    monkeypatch.setattr(negatives, "SAMPLE", 200)
    r = random.Random(3)
    centres = [[r.gauss(0, 1) for _ in range(8)] for _ in range(9)]
    rows = []
    for i in range(1200):
        c = centres[0] if i % 3 == 0 else [x + r.gauss(0, spread) for x in r.choice(centres)]
        rows.append((i, floats(*c), r.randrange(4)))
    assert len(check(spark, rows)) > 50


def test_bounds_prune(spark):
    """Rows far from all that an anchor may want are not copied to its cell."""
    r = random.Random(5)
    far = [(i, floats(*(50 * (k == i % 4) + r.random() / 10 for k in range(4))), i % 3) for i in range(2000)]
    df = spark.createDataFrame(far, "vec_id long, embedding array<float>, label int")
    rows = negatives.whole_vectors(df, "vec_id", "embedding", F.col("label"))
    longest = max(sum(math.floor(256 * x) ** 2 for x in v) for _, v, _ in far)
    space = negatives._space(rows, 4, longest)
    anchors = rows.where("id % 100 = 0").selectExpr("id as aid", "id as anchor_id", "label", "v", "array(0L) as asked", f"array({negatives._LEAST}L) as lo", f"array({negatives._MOST}L) as hi")
    wanted = anchors.mapInArrow(negatives._tighten(space, 4, True, 5), f"{negatives._ANCHOR}, cell int, radius double, near double, far double").collect()
    bounds = negatives.np.full((len(space.pivots), negatives.LABELS, 3), -1.0)
    for w in wanted:
        b = bounds[w["cell"], w["label"] % negatives.LABELS]
        b[:] = (max(b[0], w["radius"]), w["near"] if b[0] < 0 else min(b[1], w["near"]), max(b[2], w["far"]))
    copies = rows.selectExpr("*", "0 as chunk").mapInArrow(negatives._serve(space, 4, bounds, True), "id long, label long, v array<int>, chunk int, cells array<int>, slot int")
    cells = sum((bounds[:, k, 0] >= 0).sum() for k in range(3)) / 3
    assert copies.select(F.sum(F.size("cells"))).first()[0] < 0.5 * cells * len(far)


def test_small_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, floats(1, 1), 1), (100, floats(1, 0.5), 1), (1, floats(0.9, 0.9), 1), (1, floats(0.9, 0.9), 1), (None, floats(0.5, 0.5), 2), (2, floats(0.5, 0.5), 2), (3, floats(0.5, 0.5), 2), (4, None, 2), (5, [nan, 1.0], 2), (6, [inf, 1.0], 2),
        (7, [None, 1.0], 2), (8, floats(0.4, 0.4), None), (9, floats(0.6), 2), (10, [], 2), (11, floats(0.5, 0.4, 9.0), 3), (200, floats(-1, -1), -3), (300, floats(2, 2), 9), (None, floats(1, 1), 1), (12, floats(1e9, 1), 2), (400, [], 4), (13, [], 4),
        (0, floats(1, 1), 1), (0, floats(0.2, 1), 2),
    ]
    assert check(spark, rows)
    assert check(spark, rows[:1]) == [] and check(spark, []) == []


def test_large_components(spark):
    """Products that floating point does not hold are still exact."""
    rows = [(100 * k, floats(100_000 + k, 99_999 - k, 3.25), k % 2) for k in range(12)] + [(k + 1, floats(50_000 + k, 50_001 + 3 * k, k / 7), k % 2) for k in range(40)]
    assert check(spark, rows)


def test_products():
    import numpy as np

    r = np.random.default_rng(1)
    for top in (200, 1 << 20, (1 << 25) - 1):
        a, b = (r.integers(-top, top, (n, 33)).astype(float) for n in (5, 7))
        want = [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]
        assert negatives.products(a, b).tolist() == want
