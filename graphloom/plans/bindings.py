"""Roles that the provided tables play, for Spark and for the oracle.

follows      customer -> supplier pairs with what they traded
transitions  user -> next user of the same event type on the same day
typed        transitions counted by type and pair
trade        supplier nation -> customer nation, weighted by line items
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))


def follows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).groupBy(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(F.count(F.lit(1)).alias("n"))


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = Window.partitionBy("event_type", F.date_trunc("day", "ts")).orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("type"), F.col("user_id").alias("src"), F.lead("user_id").over(day).alias("dst"), "ts")
    return rows.where("dst IS NOT NULL AND dst <> src")


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transitions(spark, sf_dir).groupBy("type", "src", "dst").agg(F.count(F.lit(1)).alias("n"))


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).select("l_suppkey", "o_custkey").join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("src")), "l_suppkey")
    rows = rows.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("dst")), "o_custkey")
    return rows.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("region"))


VIEWS = {
    "follows": ((), "SELECT o_custkey AS src, l_suppkey AS dst, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2"),
    "transitions": ((), "SELECT * FROM (SELECT event_type AS type, user_id AS src, lead(user_id) OVER (PARTITION BY event_type, date_trunc('day', ts) ORDER BY ts, event_id) AS dst, ts FROM events) WHERE dst IS NOT NULL AND dst <> src"),
    "typed": (("transitions",), "SELECT type, src, dst, count(*) AS n FROM transitions GROUP BY 1, 2, 3"),
    "purchases": (("typed",), "SELECT src, dst, n FROM typed WHERE type = 'purchase'"),
    "trade": ((), "SELECT s_nationkey AS src, c_nationkey AS dst, CAST(count(*) AS DOUBLE) AS w FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"),
    "nations": ((), "SELECT n_nationkey AS id, n_regionkey AS region FROM nation"),
}


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed(spark, sf_dir).where("type = 'purchase'").select("src", "dst", "n")


def oracle(body: str, *names: str, more: dict[str, str] | None = None) -> str:
    """``body`` with the views it needs as common table expressions."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name not in done:
            needs, text = VIEWS[name]
            for x in needs:
                add(x)
            done[name] = text

    for name in names:
        add(name)
    done |= more or {}
    head = ",\n".join(f"{k} AS MATERIALIZED ({v})" for k, v in done.items())
    return f"WITH {head}\n{body}" if head else body
