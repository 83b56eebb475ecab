"""Language identification by string kernels: n-gram presence, Nyström landmarks, ridge regression one against the rest.

A text is seen as its letters, lower-cased, anything else one blank between them. The blended spectrum of a text is the
set of its byte n-grams of ``SPANS`` lengths, hashed into ``BITS`` places, present or not; the kernel of two texts is
the number of places that both have, over the root of the product of how many each has. ``landmarks`` texts stand for
all: a text is described by its kernels with them, multiplied by the inverse root of the landmarks' own kernel matrix
(Nyström), and for each language ridge regression tells its texts from the rest. Both steps are matrix products over
batches of texts, in learning and in scoring.

Learning uses a sample of at most ``per_lang`` texts of a language, chosen by a hash of the id, and ``most`` in all,
taken in turn from the languages, so that rare languages are learnt too; scoring is of all rows. The landmarks are the
first of the sample. The model (landmarks by places, places by languages) is sent to tasks; its size is fixed by these
parameters. Languages that the sample does not hold are not learnt, nor are null ones.

Null texts and texts without a letter are ``und`` with the score 0, as is every text where nothing could be learnt. The
score of others is the winner's share of the languages' odds, where a regression value of 1 is sure and 0 is not.
Equal texts have equal results; ties go to the lesser name. Repeated rows and extra columns change nothing, null ids
are neither learnt from nor held out. A text is held whole by a task, and its n-grams are looked at in pieces, so that
a text of any length needs a few times its own memory. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyline.llm.common import sliced

SPANS = (1, 2, 3, 4)
BITS = 14
PLACES = 1 << BITS
#: The sample that a model is fitted on: texts of a language, texts in all, and of these the landmarks.
PER_LANG, MOST, LANDMARKS = 600, 6_000, 192
RIDGE = 1e-3
SALTS = 16
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
#: ASCII other than letters parts words; bytes of other characters stay.
_AS_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_PIECE = 1 << 20


def _mixed(code: np.ndarray) -> np.ndarray:
    """Hash places of n-gram codes of up to four bytes."""
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def presence(text: str, out: np.ndarray) -> None:
    """Sets ``out`` (of ``PLACES``) to 1 where an n-gram of the text falls."""
    raw = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_AS_LETTERS).split()) + b" "
    for k in range(0, len(raw), _PIECE):
        b = np.frombuffer(raw, np.uint8, min(_PIECE + max(SPANS) - 1, len(raw) - k), k).astype(np.uint32)
        code = np.zeros(len(b), np.uint32)
        for n in range(1, max(SPANS) + 1):
            if n > len(b):
                break
            # the n-gram that begins at each byte, after the bytes before it; lengths do not share codes
            code = (code[: len(b) - n + 1] << np.uint32(8)) | b[n - 1 :]
            if n in SPANS:
                out[_mixed(code ^ np.uint32(0x9E3779B9 * n & 0xFFFFFFFF))] = 1


def spectra(texts: list[str]) -> np.ndarray:
    """Rows of presence, each of length 1."""
    x = np.zeros((len(texts), PLACES), np.float32)
    for row, text in zip(x, texts, strict=True):
        presence(text, row)
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    landmarks: np.ndarray
    root: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    def values(self, x: np.ndarray) -> np.ndarray:
        """The regression values of spectra, a column a language."""
        return (x @ self.landmarks.T).astype(np.float64) @ self.root @ self.weights + self.offset

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        v = self.values(spectra(texts))
        odds = np.exp(6 * np.clip(v, -2, 2))
        best = v.argmax(axis=1)
        return [self.langs[k] for k in best], odds[np.arange(len(v)), best] / odds.sum(axis=1)


def fit(x: np.ndarray, langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """Kernel ridge regression on Nyström features, one language against the rest; rows are spectra, landmarks the first."""
    if not len(x):
        return None
    names = tuple(sorted(set(langs)))
    marks = x[:landmarks]
    value, vector = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    held = value > 1e-6 * value[-1]
    root = vector[:, held] / np.sqrt(value[held])
    z = (x @ marks.T).astype(np.float64) @ root
    y = (np.array(langs)[:, None] == np.array(names)[None, :]).astype(np.float64)
    # every language counts alike, however many of its texts were drawn
    weight = (1 / y.sum(axis=0))[y.argmax(axis=1)]
    weight /= weight.sum()
    centre, mean = weight @ z, weight @ y
    zc = z - centre
    w = np.linalg.solve((zc * weight[:, None]).T @ zc + ridge * np.eye(z.shape[1]), (zc * weight[:, None]).T @ (y - mean))
    return Model(names, marks, root, w, mean - centre @ w)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: the CRC-32 of its id as text divides by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _spectra(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches, 64):
        texts = b.column("text").to_pylist()
        bits = np.zeros((len(texts), PLACES), np.uint8)
        for row, text in zip(bits, texts, strict=True):
            presence(text, row)
        yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("h"), b.column("turn"), pa.array([r.tobytes() for r in np.packbits(bits, axis=1)], pa.binary())], names=["lang", "h", "turn", "bits"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, most: int = MOST) -> Model | None:
    """A model, or None where no row can be learnt from."""
    rows = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col)) & F.col(text_col).rlike(r"\p{L}"))
    rows = rows.select(F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("h"), F.col(text_col).alias("text"))
    # In two steps, as a language may hold most rows: the first of each salt, then the first of these.
    first = lambda df, *by: df.withColumn("turn", F.row_number().over(Window.partitionBy("lang", *by).orderBy("h"))).where(F.col("turn") <= per_lang)
    salted = first(rows.select("lang", "h").distinct().withColumn("salt", F.pmod("h", F.lit(SALTS))), "salt").select("lang", "h")
    sample = first(salted).orderBy("turn", "lang").limit(most)
    # The sample is bounded by ``most`` and so small enough to broadcast.
    drawn = rows.join(F.broadcast(sample), ["lang", "h"]).select("lang", "h", "turn", "text").mapInArrow(_spectra, "lang string, h long, turn int, bits binary")
    got = drawn.groupBy("turn", "lang", "h").agg(F.min("bits").alias("bits")).toPandas().sort_values(["turn", "lang"])
    x = np.unpackbits(np.frombuffer(b"".join(map(bytes, got["bits"])), np.uint8).reshape(-1, PLACES // 8), axis=1).astype(np.float32)
    x /= np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
    return fit(x, list(got["lang"]))


def _predict(model: Model | None, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 128):
            texts = b.column(at).to_pylist()
            read = [k for k, t in enumerate(texts) if t is not None and _LETTER.search(t)] if model else []
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if read:
                best, sure = model.predict([texts[k] for k in read])
                for k, name in zip(read, best, strict=True):
                    lang[k] = name
                score[read] = sure
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    return run


def with_language(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The documents with ``lang_pred`` and ``score``; columns of those names are replaced."""
    docs = docs.drop("lang_pred", "score")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_predict(model, docs.columns.index(text_col)), f"{kinds}, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row a document: id, held_out, lang_pred and score."""
    model = train(docs, id_col, text_col, lang_col)
    named = with_language(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model)
    return named.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")
