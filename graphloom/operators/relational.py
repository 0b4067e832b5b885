"""Relational operators over plain tables: latest rows, upserts, pagination, rollups, set differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group in a total order; the limit is pushed below the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return top_per_group(df, keys, order, 1, "_r").drop("_r")


def share_of(value: str, keys: list[str]) -> Column:
    """A row's part of its group's total."""
    return F.col(value) / F.sum(value).over(Window.partitionBy(*keys))


def optional(df: DataFrame, columns: list[str]) -> list[str]:
    """Those of the columns that a table has."""
    return [c for c in columns if c in df.columns]


def upsert(target: DataFrame, rows: DataFrame, keys: list[str], fill: bool = False) -> DataFrame:
    """``rows`` over ``target`` by key, last write first. With ``fill`` nulls of a new row keep what was there."""
    columns = target.columns
    new = F.col("s._new").isNotNull()
    both = target.alias("t").join(rows.withColumn("_new", F.lit(1)).alias("s"), keys, "full_outer")
    pick = lambda c: F.col(c) if c in keys else (F.coalesce(F.col(f"s.{c}"), F.col(f"t.{c}")) if fill else F.when(new, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}"))).alias(c)
    return both.select(*[pick(c) for c in columns])


def insert_ignored(target: DataFrame, rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Rows whose key the target lacks; of several with one key the first. First write wins."""
    return latest(rows.join(target.select(*keys).distinct(), keys, "left_anti"), keys, order)


def replaced(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The target with all rows of the keys in ``rows`` replaced by them."""
    return target.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def purged(target: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return target.join(keys.select(*on).distinct(), on, "left_anti")


def merged_accounts(edges: DataFrame, canonical: DataFrame, ends: tuple[str, str], maxima: list[str]) -> DataFrame:
    """Edges moved from duplicate ids to their canonical one (``old, new``); edges that meet keep each field's maximum."""
    for end in ends:
        moved = canonical.select(F.col("old").alias(end), F.col("new").alias("_new"))
        edges = edges.join(moved, end, "left").withColumn(end, F.coalesce("_new", end)).drop("_new")
    return edges.where(F.col(ends[0]) != F.col(ends[1])).groupBy(*ends).agg(*[F.max(c).alias(c) for c in maxima])


def rotated(log: DataFrame, at: str, keep: float = 0.7) -> DataFrame:
    """The newest share of a log, by a distributed cut at the quantile of its time."""
    n = log.count()
    k = int(n * keep)
    return log.orderBy(F.desc(at)).limit(k)


def page_after(df: DataFrame, cursor: dict | None, order: list[tuple[str, bool]], size: int) -> DataFrame:
    """A page of ``size + 1`` rows after a cursor on a total order of (column, descending); the extra row tells whether there is more."""
    if cursor:
        later, same = F.lit(False), F.lit(True)
        for c, down in order:
            x = F.lit(cursor[c])
            later = later | (same & ((F.col(c) < x) if down else (F.col(c) > x)))
            same = same & (F.col(c) == x)
        df = df.where(later)
    return df.orderBy(*[F.desc(c) if down else F.asc(c) for c, down in order]).limit(size + 1)


def round_robin(df: DataFrame, group: str, order: list, k: int, group_order: list) -> DataFrame:
    """One row of each group a round, best first."""
    return df.withColumn("round", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("round") <= k).orderBy("round", *group_order).limit(k)


def differs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one of two tables holds more often: with ``side``, nothing for equal tables."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Audit of a set against another: hits, missing, extra, coverage and precision in percent (null for an empty side)."""
    both = a.select(key).distinct().withColumn("_a", F.lit(1)).join(b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full_outer")
    c = both.agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("hits"), F.count_if(F.col("_b").isNull()).alias("missing"), F.count_if(F.col("_a").isNull()).alias("extra"))
    percent = lambda x, y: F.when(x + y > 0, F.round(100.0 * x / (x + y), 2))
    return c.withColumns({"coverage_pct": percent(F.col("hits"), F.col("missing")), "precision_pct": percent(F.col("hits"), F.col("extra"))})


def quality_counters(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """How many rows meet each check, in one pass."""
    return df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(name) for name, c in checks.items()])


def tokens(text: Column, least: int = 3) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(rf"[a-z]{{{least},}}"), F.lit(0))


def superseded(labels: DataFrame, keys: list[str], order: list) -> DataFrame:
    """A label log with ``is_active``: the last write of each key."""
    return labels.withColumn("is_active", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1)
