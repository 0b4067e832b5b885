"""Evaluation of predictions against labels: calibration, ranking, thresholds, agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def brier(df: DataFrame, p: str, y: str) -> DataFrame:
    return df.agg(F.avg(F.pow(F.col(p) - F.col(y), F.lit(2))).alias("brier"), F.count(F.lit(1)).alias("n"))


def multiclass_brier(predictions: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over items of the mean over classes of (p - y)^2; (keys, class, p) against (keys, class, y), missing values 0."""
    both = predictions.join(truth, [*keys, "class"], "full_outer")
    each = both.groupBy(*keys).agg(F.avg(F.pow(F.coalesce("p", F.lit(0.0)) - F.coalesce("y", F.lit(0.0)), F.lit(2))).alias("b"))
    return each.agg(F.avg("b").alias("brier"), F.count(F.lit(1)).alias("items"))


def calibration_error(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins, the last one closed."""
    at = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    rows = df.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("conf"), F.avg(F.col(y).cast("double")).alias("acc"))
    return rows.agg((F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n")).alias("ece"))


def by_score(df: DataFrame, p: str, y: str) -> DataFrame:
    """Per distinct score the positives and rows at it or above; sums are over distinct scores, in few rows."""
    steps = df.groupBy(F.col(p).alias("score")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    down = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy()
    return steps.withColumns({"tp": F.sum("pos").over(down), "k": F.sum("n").over(down), "positives": F.sum("pos").over(all_), "rows": F.sum("n").over(all_)})


def thresholds(df: DataFrame, p: str, y: str) -> DataFrame:
    """Precision, recall and F1 of predicting 1 at each score or above."""
    t = by_score(df, p, y)
    return t.select("score", (F.col("tp") / F.col("k")).alias("precision"), F.when(F.col("positives") > 0, F.col("tp") / F.col("positives")).otherwise(0.0).alias("recall"), F.when(F.col("k") + F.col("positives") > 0, 2 * F.col("tp") / (F.col("k") + F.col("positives"))).otherwise(0.0).alias("f1"))


def best_threshold(df: DataFrame, p: str, y: str) -> DataFrame:
    """The threshold of greatest F1; of equals the nearest to one half."""
    return thresholds(df, p, y).orderBy(F.desc("f1"), F.abs(F.col("score") - 0.5), "score").limit(1)


def average_precision(df: DataFrame, p: str, y: str) -> DataFrame:
    t = by_score(df, p, y)
    return t.agg((F.sum(F.col("pos") * F.col("tp") / F.col("k")) / F.max("positives")).alias("average_precision"))


def roc_auc(df: DataFrame, p: str, y: str) -> DataFrame:
    """Exact area under the ROC curve; ties count half."""
    t = by_score(df, p, y).withColumn("neg", F.col("n") - F.col("pos"))
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / 2)) / (F.max("positives") * (F.max("rows") - F.max("positives")))
    return t.agg(area.alias("auc"))


def group_recall(members: DataFrame, scores: DataFrame, key: str, group: str, least: float) -> DataFrame:
    """By group: members, found (score above ``least``), missed, and not scored at all."""
    rows = members.join(scores.select(key, "score"), key, "left")
    out = rows.groupBy(group).agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("score") > least).alias("found"), F.count_if(F.col("score") <= least).alias("missed"), F.count_if(F.col("score").isNull()).alias("unscored"))
    return out.withColumn("recall", F.col("found") / F.col("members"))


def adjusted_rand(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings from their contingency counts."""
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2
    cells = pairs.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    s = cells.agg(F.sum(two("n")).alias("s"), F.sum("n").alias("t"))
    sa = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(two("n")).alias("sa"))
    sb = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(two("n")).alias("sb"))
    chance = F.col("sa") * F.col("sb") / (F.col("t") * (F.col("t") - 1) / 2)
    return s.crossJoin(sa).crossJoin(sb).select(((F.col("s") - chance) / ((F.col("sa") + F.col("sb")) / 2 - chance)).alias("ari"))  # single rows


def gini(df: DataFrame, value: str) -> DataFrame:
    """Gini coefficient; ranks over distinct values, so that equal values cost one row."""
    steps = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = steps.withColumn("ranks", F.col("n") * before + F.col("n") * (F.col("n") + 1) / 2)
    total, n = F.sum(F.col(value) * F.col("n")), F.sum("n")
    return ranked.agg((2 * F.sum(F.col(value) * F.col("ranks")) / (n * total) - (n + 1) / n).alias("gini"))


def leaks(labels: DataFrame, splits: DataFrame, key: str) -> DataFrame:
    """Keys with more than one active label, or in more than one split."""
    twice = labels.where("is_active").groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key, F.lit("labels").alias("problem"))
    many = splits.groupBy(key).agg(F.countDistinct("split").alias("n")).where("n > 1").select(key, F.lit("splits").alias("problem"))
    return twice.unionByName(many)


def consensus(votes: DataFrame, key: str, value: str) -> DataFrame:
    """Of three or more votes the median toward zero, of two the smaller, of one at most +1 if positive."""
    v = votes.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.percentile(value, F.lit(0.5)).alias("mid"), F.min(value).alias("low"))
    one = F.when(F.col("low") != 0, F.least(F.abs("low"), F.lit(1))).otherwise(0)
    middle = F.when(F.col("mid") >= 0, F.floor("mid")).otherwise(F.ceil("mid"))
    return v.select(key, "n", F.when(F.col("n") >= 3, middle).when(F.col("n") == 2, F.col("low")).otherwise(one).cast("long").alias("consensus"))
