"""What the corpus operators share: scratch tables, distributed prefix sums, folds."""

from __future__ import annotations

import atexit
import math
import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word, for every operator of this package: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Tables and folders that are ours, by path.
_written: dict[str, tuple[SparkSession, DataFrame | None]] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``; a folder of our own only where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", found)
        _written[found] = (spark, None)
    return found.rstrip("/")


#: Shuffles of an action go when it has ended, and not when the driver happens to collect its garbage.
_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared scratch folder: lineage ends there, so a lost executor costs no recomputation, and the shuffles that made it go."""
    spark = prepared(df.sparkSession)
    path = f"{scratch_dir(spark)}/graphloom-{name}-{uuid.uuid4().hex}"
    _written[path] = (spark, None)
    before = spark.conf.get(_SHUFFLES_GO, None)
    spark.conf.set(_SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_SHUFFLES_GO)
        else:
            spark.conf.set(_SHUFFLES_GO, before)
    out = spark.read.schema(df.schema).parquet(path)
    _written[path] = (spark, out)
    return out


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def spent(*tables: DataFrame) -> None:
    """Removes tables of ``written`` that nothing reads any more: whatever was made of them is written itself."""
    for path, (spark, table_) in list(_written.items()):
        if any(table_ is t for t in tables):
            _remove(spark, path)
            del _written[path]


def _clean() -> None:
    for path, (spark, _) in _written.items():
        try:
            _remove(spark, path)
        except Exception:  # the session may be gone; the cluster's own retention then applies
            pass


atexit.register(_clean)


#: For Python workers, which serve one stage after another: memory of large arrays goes back when they are freed.
_WORKERS = {"MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": str(1 << 20), "MALLOC_TRIM_THRESHOLD_": str(1 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system"}
_ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepared(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package also where the driver found it by its own sys.path, and bounds their memory.

    Arrow batches are bounded by bytes, since a text can be as long as a thousand others;
    a smaller bound that the session has stays."""
    top = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if top not in os.environ.get("PYTHONPATH", "").split(os.pathsep) and top not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH", ""), top) if x)
    for name, value in _WORKERS.items():
        if name not in os.environ:
            env.setdefault(name, value)
    if int(re.sub(r"\D", "", spark.conf.get(_ARROW_BYTES)) or 0) > 8 << 20:
        spark.conf.set(_ARROW_BYTES, str(8 << 20))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepared(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def buckets_for(rows: int, least: int = 16) -> int:
    """How many hash buckets split each group: their number and their size both grow with the root of the rows."""
    return max(least, 1 << math.ceil(math.log2(max(2.0, math.sqrt(rows) / 16))))


def exclusive_prefix(df: DataFrame, group: str, bucket: str, order: list[str], value: str, out: str, more: DataFrame | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of a group before this one, in the order (bucket, *order).

    Two levels, so that no group lies in one task: sums of buckets (combined before the
    shuffle) give each bucket its offset, and rows are only ordered within their bucket.
    ``group`` and ``bucket`` hold no nulls. ``more``: columns by group to be added on the way,
    joined to buckets and not to rows. ``df`` is evaluated twice; pass a written table or
    something cheap."""
    sums = df.groupBy(group, bucket).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(group, bucket, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_gl_off"))
    if more is not None:
        offsets = offsets.join(more, group)
    within = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(offsets, [group, bucket]).withColumn(out, F.col("_gl_off") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("_gl_off")


def n_words(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; null for a null id."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % folds).cast("int")
