"""Quality classifier: Bradley-Terry pairwise ranking.

Documents become feature vectors (shares of byte classes, repetition and shape of words and lines; nothing but
the text). Labelled documents give preference pairs, one of label 1 over one of label 0, and the weights
minimise the logistic loss of the pairs on the differences of their features. A document's strength is the
weighted sum of its features. The cut between the classes is a quantile of the strengths of the labelled
documents, the one that decides most of them rightly with either class counting half, and strengths are scaled so
that the score 0.7 lies on it.

Learning uses a sample of at most ``MAX_LABELLED`` labelled rows, chosen by a hash of the id; scoring is of all
rows. A null, empty or blank text has the score 0. Labels that are null, and ids that
are null, teach nothing; ids labelled both ways count as both. Without labels of both classes every score is
0.7. Rows are scored one by one; repeated rows and extra columns change nothing.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyline.llm.common import sliced

#: The most labelled rows that a model is fitted on, and the most pairs.
MAX_LABELLED = 20_000
MAX_PAIRS = 60_000
CUT_SCORE = 0.7

_CLASSES = ("upper", "lower", "digit", "space", "newline", "mark", "stop", "symbol", "bar", "high")


def _class_of(b: int) -> int:
    c = chr(b)
    if b >= 128:
        return 9
    if "A" <= c <= "Z":
        return 0
    if "a" <= c <= "z":
        return 1
    if "0" <= c <= "9":
        return 2
    if c == "\n":
        return 4
    if c in " \t\r":
        return 3
    if c in "!?":
        return 5
    if c in ".,;:'\"-()":
        return 6
    return 8 if c == "|" else 7


_CLASS = np.array([_class_of(b) for b in range(256)])
_ONE_HOT = np.eye(len(_CLASSES))[_CLASS]
FEATURES = (
    *(f"share_{c}" for c in _CLASSES), *(f"root_{c}" for c in _CLASSES),
    "upper_of_letters", "log_bytes", "log_words", "word_length", "word_length_spread", "same_as_last", "root_same_as_last", "distinct", "top_word", "same_line", "log_line", "letters_missing",
)


def features(text: str | None) -> np.ndarray:
    raw = (text or "").encode()
    n = len(raw)
    if not n:
        return np.zeros(len(FEATURES))
    share = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _ONE_HOT / n
    words = raw.split()
    k = len(words)
    lengths = np.fromiter(map(len, words), np.int64, k)
    same = sum(map(operator.eq, words, words[1:])) / max(1, k - 1)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = raw.split(b"\n")
    letters = share[0] + share[1] + share[9]
    more = (
        share[0] / max(letters, 1e-9), np.log1p(n), np.log1p(k), lengths.mean() if k else 0.0, lengths.std() if k else 0.0, same, np.sqrt(same),
        len(counts) / max(1, k) ** 0.8, max(counts.values(), default=0) / max(1, k), 1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)), 1 - letters,
    )
    return np.concatenate([share, np.sqrt(share), more])


@dataclass(frozen=True)
class Model:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def strength(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.centre) / self.scale, -8, 8) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        z = self.slope * (self.strength(rows) - self.cut) + np.log(CUT_SCORE / (1 - CUT_SCORE))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Logistic regression without intercept."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        d = np.linalg.solve(h, g)
        w -= d
        if np.abs(d).max() < 1e-6:
            break
    return w


def fit(rows: np.ndarray, labels: np.ndarray, seed: int = 5) -> Model:
    """Bradley-Terry on pairs of a row of label 1 and one of label 0."""
    d = len(FEATURES)
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(good) or not len(bad):
        return Model(np.zeros(d), np.ones(d), np.zeros(d), 0.0, 1.0)
    centre, scale = rows.mean(0), rows.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.clip((rows - centre) / scale, -8, 8)
    pairs = min(MAX_PAIRS, 20 * max(len(good), len(bad)))
    r = np.random.default_rng(seed)
    diff = z[r.choice(good, pairs)] - z[r.choice(bad, pairs)]
    w = _newton(diff, np.ones(pairs), np.ones(pairs), ridge=pairs * 1e-4)
    s = z @ w
    # The cut: a quantile of the strengths, half way between two rows, at which the classes are told apart best.
    order = np.argsort(s, kind="stable")
    below_bad, below_good = np.cumsum(labels[order] == 0) / len(bad), np.cumsum(labels[order] == 1) / len(good)
    gain = below_bad - below_good
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    k = int(best[len(best) // 2])
    cut = float((s[order[k]] + s[order[min(k + 1, len(s) - 1)]]) / 2)
    half = np.where(labels == 1, 0.5 / len(good), 0.5 / len(bad)) * len(s)
    slope = float(_newton((s - cut)[:, None], (labels == 1).astype(float), half, ridge=1e-3)[0])
    # No steeper than leaves the outermost rows apart from 0 and 1.
    return Model(centre, scale, w, cut, max(min(slope, 12 / max(1e-9, float(np.abs(s - cut).max()))), 1e-3))


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept from learning: the CRC-32 of its id as text has remainder 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [features(t.as_py()).tolist() for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), b.column("y")], names=["x", "y"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MAX_LABELLED) -> Model:
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).distinct()
    # The sample is bounded by ``most`` and so small enough to broadcast.
    sample = known.orderBy(F.xxhash64("id"), "id", "y").limit(most)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    got = texts.join(F.broadcast(sample), "id").select("text", "y").mapInArrow(_featurise, "x array<double>, y int").toPandas()
    if got.empty:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    x, y = np.array(got["x"].tolist()), got["y"].to_numpy()
    order = np.lexsort((*x.T[::-1], y))  # the order in which tasks end must not matter
    return fit(x[order], y[order])


def _score(model: Model, at: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1000):
            texts = [t.as_py() for t in b.column(at)]
            score = model.score(np.array([features(t) for t in texts]).reshape(-1, len(FEATURES)))
            score[[not t or t.isspace() for t in texts]] = 0.0
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.float64())], names=[*b.schema.names, name])

    return run


def with_score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """The documents, all columns kept, and a column of scores."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_score(model, docs.columns.index(text_col), name), f"{kinds}, `{name}` double")


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, held_out, score and predicted."""
    model = train(docs, labels, id_col, text_col)
    scored = with_score(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model)
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= CUT_SCORE).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns kept, that the classifier does not reject."""
    name = "score"
    while name in docs.columns:
        name += "_"
    return with_score(docs, train(docs, labels, id_col, text_col), text_col, name).where(F.col(name) >= CUT_SCORE).drop(name)
