"""A quality score from histogram gradient-boosted trees over statistics of the whole text.

Statistics are computed for every document and written once; labelled rows, at most
``SAMPLE`` of them by hash, train the trees on the driver (a few floats a row). Trees are
complete binary trees laid out in arrays, so scoring is vectorised numpy over batches.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, table, written

SAMPLE = 40_000
TREES, DEPTH, BINS, RATE, LEAST_ROWS, L2 = 60, 4, 48, 0.15, 10.0, 2.0
KEEP_AT = 0.7
NAMES = ("chars", "words", "lines", "word_length", "unique", "top_word", "adjacent", "pairs", "dup_lines", "upper", "digit", "symbol", "punctuation", "exclaim", "other", "non_ascii", "line_words", "short_words", "all_caps", "entropy")
_SYMBOLS = "#*$%&|<>"
_classes: np.ndarray | None = None


def _kinds() -> np.ndarray:
    """Kinds of code points of the basic plane: 0 lower or other letter, 1 upper, 2 digit, 3 space, 4 symbol, 5 punctuation, 6 exclamation, 7 other."""
    global _classes
    if _classes is None:

        def kind(c: str) -> int:
            if c in _SYMBOLS:
                return 4
            if c == "!":
                return 6
            if c.isspace():
                return 3
            if c.isdigit():
                return 2
            if c.isalpha():
                return int(c.isupper())
            return 5 if c in ".,;:?'\"()-" else 7

        _classes = np.array([kind(chr(i)) for i in range(1 << 16)], np.uint8)
    return _classes


def statistics(text: str | None) -> np.ndarray:
    """The numbers named in NAMES; all zero for a null or empty text."""
    out = np.zeros(len(NAMES), np.float32)
    if not text:
        return out
    kinds, size, wide, histogram = np.zeros(8, np.int64), len(text), 0, np.zeros(128, np.int64)
    for at in range(0, size, 1 << 18):
        codes = np.frombuffer(text[at : at + (1 << 18)].encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds += np.bincount(_kinds()[np.minimum(codes, 0xFFFF)], minlength=8)
        wide += int((codes > 127).sum())
        histogram += np.bincount(np.minimum(codes, 127), minlength=128)
    words = text.split()
    n = max(1, len(words))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = len(set(zip(words, words[1:])))
    p = histogram[histogram > 0] / size
    letters = max(1, int(kinds[0] + kinds[1]))
    out[:] = (
        np.log1p(size), np.log1p(len(words)), np.log1p(len(lines)), (size - kinds[3]) / n, len(counts) / n, max(counts.values(), default=0) / n,
        sum(map(str.__eq__, words, words[1:])) / n, pairs / max(1, len(words) - 1), 1 - len(set(lines)) / max(1, len(lines)), kinds[1] / letters, kinds[2] / size,
        kinds[4] / size, kinds[5] / size, kinds[6] / size, kinds[7] / size, wide / size, np.log1p(len(words) / max(1, len(lines))),
        sum(c for w, c in counts.items() if len(w) <= 3) / n, sum(c for w, c in counts.items() if w.isupper()) / n, -(p * np.log(p)).sum(),
    )
    return out


class Trees:
    """Boosted complete trees in flat arrays: ``feature`` and ``cut`` (trees, inner nodes), ``leaf`` (trees, leaves)."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray, depth: int):
        self.base, self.feature, self.cut, self.leaf, self.depth = base, feature, cut, leaf, depth

    def score(self, x: np.ndarray) -> np.ndarray:
        margin, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            margin += leaf[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-margin))


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, least: float = LEAST_ROWS, l2: float = L2) -> Trees:
    """Logistic loss, second-order gains over histograms of quantile bins. No rows give a score of 0.5, one class its (smoothed) share."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    inner, leaves = 2**depth - 1, 2**depth
    features, cuts, values = [], [], []
    if len(y) >= 2 * least and 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
        margin = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
            node = np.zeros(len(y), np.int64)
            for level in range(depth):
                first, wide = 2**level - 1, 2**level
                best, pick = np.full(wide, 1e-6), np.full((wide, 2), -1)
                local = node - first
                total_g, total_h = np.bincount(local, g, wide), np.bincount(local, h, wide)
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    at = local * (len(e) + 1) + binned[:, f]
                    left = [np.bincount(at, w, wide * (len(e) + 1)).reshape(wide, -1).cumsum(axis=1)[:, :-1] for w in (g, h, np.ones(len(y)))]
                    rows = np.bincount(local, minlength=wide)[:, None]
                    gain = left[0] ** 2 / (left[1] + l2) + (total_g[:, None] - left[0]) ** 2 / (total_h[:, None] - left[1] + l2) - (total_g**2 / (total_h + l2))[:, None]
                    gain[(left[2] < least) | (rows - left[2] < least)] = 0
                    k = gain.argmax(axis=1)
                    top = gain[np.arange(wide), k]
                    better = top > best
                    best[better], pick[better] = top[better], np.stack([np.full(wide, f), k], axis=1)[better]
                for i, (f, k) in enumerate(pick):
                    if f >= 0:
                        feature[first + i], cut[first + i] = f, edges[f][k]
                node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
            local = node - inner
            leaf = -rate * np.bincount(local, g, leaves) / (np.bincount(local, h, leaves) + l2)
            margin += leaf[local]
            features.append(feature), cuts.append(cut), values.append(leaf)
    shape = (len(features), -1)
    return Trees(base, np.array(features, np.int64).reshape(shape if features else (0, inner)), np.array(cuts, np.float64).reshape(shape if cuts else (0, inner)), np.array(values).reshape(shape if values else (0, leaves)), depth)


def with_statistics(docs: DataFrame, text_col: str = "text", out: str = "stats") -> DataFrame:
    @F.pandas_udf("array<float>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([statistics(t) for t in batch])

    return docs.withColumn(out, of(F.col(text_col)))


def fit(rows: DataFrame, id_col: str = "doc_id", label_col: str = "quality", stats_col: str = "stats", sample: int = SAMPLE) -> Trees:
    """Trains on at most ``sample`` labelled rows (label 0 or 1), those of the smallest hashes of their ids."""
    drawn = rows.where(F.col(label_col).isin(0, 1)).orderBy(F.xxhash64(F.lit(9), F.col(id_col)), id_col).limit(sample).select(id_col, label_col, stats_col).toPandas()
    x = np.array(drawn[stats_col].tolist(), np.float32).reshape(len(drawn), len(NAMES))
    return train(x, drawn[label_col].to_numpy(np.float64))


def score(rows: DataFrame, model: Trees, stats_col: str = "stats") -> DataFrame:
    """``rows`` with ``score``."""

    @F.pandas_udf("double")
    def of(stats: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in stats:
            yield pd.Series(model.score(np.array(batch.tolist(), np.float32).reshape(len(batch), len(NAMES))))

    return rows.withColumn("score", of(F.col(stats_col)))


def query(spark, sf_dir: str) -> DataFrame:
    """Learns outside fold 2 of 4 and scores every document. Labels of one id are taken once (the greater); a null id is in no fold: held out, never learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = written(with_statistics(docs).select("doc_id", fold(F.col("doc_id"), 4).alias("_fold"), "stats"), "statistics")
    labels = table(spark, sf_dir, "labels").where("quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    model = fit(stats.where("_fold <> 2").join(labels, "doc_id"))
    held = F.coalesce(F.col("_fold") == 2, F.lit(True)).alias("held_out")
    return score(stats, model).select("doc_id", held, "score", (F.col("score") >= KEEP_AT).cast("int").alias("predicted"))
