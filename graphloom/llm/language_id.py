"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts become letters and single gaps; their 1- to 3-grams are hashed. Document frequencies
come from every learnable document; the weights are fitted, by follow-the-regularised-leader
with elastic-net penalties, on a bounded sample of them (``PER_LANGUAGE`` documents a
language, those of the smallest hashes); a temperature fitted on a part kept apart from that
sample calibrates the probabilities.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, table

BITS = 14
PER_LANGUAGE = 600
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.5
UNKNOWN = "und"
_CHUNK = 1 << 18
_DRAWS = 1 << 30
_lut: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For each code point of the basic plane its lower-case letter, or 0."""
    global _lut
    if _lut is None:
        low = (chr(i).lower() for i in range(1 << 16))
        _lut = np.array([ord(c[0]) if c[0].isalpha() else 0 for c in low], np.uint32)
    return _lut


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams that a text holds, in order, and how often; none if it is null or has no letter. Long texts are counted piece by piece."""
    counts = np.zeros(1 << BITS, np.int64)
    tail = np.zeros(1, np.uint32)
    any_ = False
    for at in range(0, len(text or ""), _CHUNK):
        codes = np.frombuffer(text[at : at + _CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)
        if codes.max() >= 1 << 16:
            far = codes >= 1 << 16
            wide = np.array([c if chr(c).isalpha() else 0 for c in codes[far]], np.uint32)
            codes = _letters()[np.where(far, 0, codes)]
            codes[far] = wide
        else:
            codes = _letters()[codes]
        any_ = any_ or bool(codes.any())
        old = len(tail)
        codes = np.concatenate([tail, codes, np.zeros(int(at + _CHUNK >= len(text)), np.uint32)])
        codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]
        a, b = codes[:-1] * np.uint32(0x9E3779B1), codes[1:] * np.uint32(0x85EBCA77)
        one = (codes[old if at else 0 :] * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - BITS)
        two = (a + b + np.uint32(0x27D4EB2F)) * np.uint32(0x2545F491) >> np.uint32(32 - BITS)
        three = ((a[:-1] + b[:-1]) * np.uint32(0x165667B1) + codes[2:] * np.uint32(0x61C88647)) * np.uint32(0x2545F491) >> np.uint32(32 - BITS)
        counts += np.bincount(np.concatenate([one, two[max(0, old - 1) if at else 0 :], three]), minlength=1 << BITS)
        tail = codes[-2:]
    if not any_:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    held = np.flatnonzero(counts)
    return held, counts[held]


def vector(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sublinear TF-IDF of unit length."""
    held, counts = grams(text)
    x = (1 + np.log(counts)) * idf[held]
    norm = np.sqrt((x * x).sum())
    return held, x / norm if norm else x


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2, seed: int = 5) -> np.ndarray:
    """Weights (features + 1 for the intercept, classes) by FTRL-proximal, one document at a time."""
    size = (1 << BITS) + 1
    z, n = np.zeros((size, classes)), np.zeros((size, classes))
    order = np.random.default_rng(seed)

    def weights(at) -> np.ndarray:
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = np.append(rows[i][0], size - 1), np.append(rows[i][1], 1.0)
            w = weights(at)
            error = _softmax(x @ w)
            error[y[i]] -= 1
            g = x[:, None] * error
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    return weights(slice(None))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm."""
    if not len(y):
        return 1.0
    loss = lambda t: -np.log(_softmax(logits / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean()
    low, high, g = -3.5, 3.5, (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def document_frequencies(learn: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """How many documents hold each hashed n-gram, and how many have any, over all of ``learn``; the table has 2**BITS + 1 rows whatever the corpus."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for text in batch[text_col]:
                at = grams(text)[0]
                held[at] += 1
                n += bool(len(at))
        at = np.flatnonzero(held)
        yield pd.DataFrame({"gram": np.append(at, -1), "docs": np.append(held[at], n)})

    rows = learn.select(text_col).mapInPandas(count, "gram long, docs long").groupBy("gram").agg(F.sum("docs").alias("docs")).toPandas()
    df, n = np.zeros(1 << BITS), 0
    for gram, docs in rows.itertuples(index=False):
        if gram < 0:
            n = int(docs)
        else:
            df[gram] = docs
    return df, n


class Model:
    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, heat: float):
        self.langs, self.idf, self.weights, self.heat = langs, idf.astype(np.float32), weights.astype(np.float32), heat

    def predict(self, text: str | None) -> tuple[str, float]:
        """A learned language and its calibrated probability; ``und`` and 0 for a null text, one without letters, or if nothing was learned."""
        held, x = vector(text, self.idf)
        if not len(held) or not self.langs:
            return UNKNOWN, 0.0
        p = _softmax((x @ self.weights[held] + self.weights[-1]) / self.heat)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def fit(learn: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Learns from rows whose ``lang`` is not null. The sample brought to the driver holds ``per_language`` documents a language."""
    learn = learn.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    df, n = document_frequencies(learn, text_col)
    idf = np.log((1 + n) / (1 + df)) + 1
    sizes = learn.groupBy(lang_col).agg(F.count(F.lit(1)).alias("n")).collect()  # a row per language
    if not sizes:
        return Model([], idf, np.zeros(((1 << BITS) + 1, 0)), 1.0)
    # twice the sample by hash first, so that ranks are only taken among a bounded number of rows
    share = F.element_at(F.create_map(*[F.lit(x) for r in sizes for x in (r[0], min(_DRAWS, math.ceil(2 * per_language * _DRAWS / r[1])))]), F.col(lang_col))
    drawn = F.xxhash64(F.lit(3), F.col(id_col))
    order = Window.partitionBy(lang_col).orderBy("_h", id_col)
    few = learn.select(id_col, lang_col, drawn.alias("_h")).where(F.pmod(F.xxhash64(F.lit(4), F.col(id_col)), F.lit(_DRAWS)) < share)
    ids = few.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_language)
    picked = learn.select(id_col, lang_col, text_col).join(F.broadcast(ids.select(id_col, lang_col, F.pmod("_h", F.lit(5)).alias("_part"))), [id_col, lang_col])

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [vector(t, idf) for t in batch[text_col]]
            yield pd.DataFrame({"id": batch[id_col].astype(str), "lang": batch[lang_col], "part": batch["_part"], "at": [a.astype(np.int32) for a, _ in out], "x": [x.astype(np.float32) for _, x in out]})

    rows = picked.mapInPandas(vectors, "id string, lang string, part long, at array<int>, x array<float>").toPandas()
    rows = rows[rows["at"].map(len) > 0].sort_values(["id", "lang", "part"], kind="stable").reset_index(drop=True)
    langs = sorted(rows["lang"].unique())
    if not langs:
        return Model([], idf, np.zeros(((1 << BITS) + 1, 0)), 1.0)
    y = rows["lang"].map({c: i for i, c in enumerate(langs)}).to_numpy()
    xs = [(np.asarray(a, np.int64), np.asarray(x, np.float64)) for a, x in zip(rows["at"], rows["x"], strict=True)]
    apart = (rows["part"] == 0).to_numpy() & (len(rows) >= 50)
    weights = ftrl([x for x, a in zip(xs, apart, strict=True) if not a], y[~apart], len(langs))
    logits = np.array([x @ weights[at] + weights[-1] for (at, x), a in zip(xs, apart, strict=True) if a])
    return Model(langs, idf, weights, temperature(logits, y[apart]))


def guesses(model: Model, text_col: str = "text") -> Column:
    """A struct (lang, score) of each text; the text alone decides."""

    @F.pandas_udf("lang string, score double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([model.predict(t) for t in batch], columns=["lang", "score"])

    return of(F.col(text_col))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; columns of these names are replaced."""
    rows = docs.drop("lang_pred", "score").withColumn("_gl_guess", guesses(model, text_col))
    return rows.withColumns({"lang_pred": F.col("_gl_guess.lang"), "score": F.col("_gl_guess.score")}).drop("_gl_guess")


def query(spark, sf_dir: str) -> DataFrame:
    """Learns outside fold 0 of 5 and predicts every document. A null id is in no fold: it counts as held out and is not learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("_fold", fold(F.col("doc_id"), 5))
    model = fit(docs.where("_fold <> 0"))
    held = F.coalesce(F.col("_fold") == 0, F.lit(True)).alias("held_out")
    return predict(docs.select("doc_id", held, "text"), model).select("doc_id", "held_out", "lang_pred", "score")
