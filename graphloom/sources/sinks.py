"""Writing tables, snapshots with manifests, logs and exports."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import insert_ignored, upsert


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in any store that Spark reaches."""
    fs, at = _fs(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def snapshot(tables: dict[str, DataFrame], path: str, **about) -> dict:
    """Tables as Parquet under a run's own folder, then a manifest, then the pointer to the run: readers see a whole run or the one before."""
    run = uuid.uuid4().hex
    spark = next(iter(tables.values())).sparkSession
    counts = {}
    for name, df in tables.items():
        df.write.parquet(f"{path}/{run}/{name}", compression="snappy")
        counts[name] = spark.read.parquet(f"{path}/{run}/{name}").count()
    manifest = {"run": run, "rows": counts, **about}
    write_text(spark, f"{path}/{run}/manifest.json", json.dumps(manifest))
    write_text(spark, f"{path}/_active", run)
    return manifest


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, also one whose name Spark's listings leave out."""
    fs, at = _fs(spark, path)
    stream = fs.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def active(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the run that the pointer names."""
    run = read_text(spark, f"{path}/_active").strip()
    return spark.read.parquet(f"{path}/{run}/{name}")


def merge_into(df: DataFrame, path: str, keys: list[str], first_wins: bool = False) -> None:
    """Upsert (or insert what is new) into a Parquet table, which is written anew beside and then swapped in; the old one goes last."""
    spark = df.sparkSession
    fs, at = _fs(spark, path)
    if fs.exists(at):
        old = spark.read.parquet(path)
        df = old.unionByName(insert_ignored(old, df, keys, keys), allowMissingColumns=True) if first_wins else upsert(old, df, keys)
    fresh = f"{path}.{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    jp = spark._jvm.org.apache.hadoop.fs.Path
    old_at = jp(f"{fresh}.old")
    if fs.exists(at) and not fs.rename(at, old_at):
        raise OSError(f"{path} can't be moved")
    if not fs.rename(jp(fresh), at):
        raise OSError(f"{fresh} can't be moved to {path}")
    fs.delete(old_at, True)


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Only the partitions that ``df`` holds are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    """Rows as lines of JSON, appended."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("append").text(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def branch_capture(tables: dict[str, DataFrame]) -> DataFrame:
    """Tables as rows (kind, data) of JSON, sorted keys being the columns' order."""
    parts = [df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*sorted(df.columns))).alias("data")) for kind, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def branch_restore(captured: DataFrame, kind: str, schema) -> DataFrame:
    return captured.where(F.col("kind") == kind).select(F.from_json("data", schema).alias("d")).select("d.*")


def is_dirty(captured: DataFrame, now: DataFrame) -> bool:
    return not (captured.exceptAll(now).isEmpty() and now.exceptAll(captured).isEmpty())
