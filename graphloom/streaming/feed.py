"""Feed events as a stream: validation, keys, deduplication, rollups, relay, sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import event_key, trimmed

EVENT = T.StructType([T.StructField(n, t) for n, t in (("accountId", T.StringType()), ("username", T.StringType()), ("tweetId", T.StringType()), ("tweetText", T.StringType()), ("surface", T.StringType()), ("position", T.IntegerType()), ("seenAt", T.StringType()), ("eventId", T.StringType()))])
ENVELOPE = T.StructType([T.StructField("eventType", T.StringType()), T.StructField("source", T.StringType()), T.StructField("workspaceId", T.StringType()), T.StructField("ego", T.StringType()), T.StructField("capturedAt", T.StringType()), T.StructField("participant", T.StringType()), T.StructField("payload", EVENT)])


def normalised(events: DataFrame, workspace: str = "default", ego: str = "ego") -> DataFrame:
    """Raw events with trimmed fields, a UTC time, their key, and why they are refused (null if not)."""
    at = F.try_to_timestamp(F.regexp_replace("seenAt", "Z$", "+00:00"))
    rows = events.select(trimmed(F.col("accountId")).alias("account_id"), trimmed(F.col("username")).alias("username"), trimmed(F.col("tweetId")).alias("tweet_id"), trimmed(F.col("tweetText")).alias("text"), F.coalesce(trimmed(F.col("surface")), F.lit("unknown")).alias("surface"), F.col("position"), F.coalesce(at, F.current_timestamp()).alias("seen_at"), "seenAt", trimmed(F.col("eventId")).alias("event_id"))
    own = F.when(F.col("event_id").isNotNull(), event_key(F.lit(workspace), F.lit(ego), F.col("event_id"))).otherwise(event_key(F.lit(workspace), F.lit(ego), F.col("account_id"), F.col("tweet_id"), F.col("seenAt"), F.col("surface"), F.col("position"), F.substring("text", 1, 160)))
    refused = F.when(F.col("account_id").isNull(), "no account").when(F.col("seenAt").isNotNull() & at.isNull(), "bad time")
    return rows.withColumns({"event_key": own, "refused": refused, "workspace": F.lit(workspace), "ego": F.lit(ego)}).drop("seenAt", "event_id")


def rollup(events: DataFrame) -> DataFrame:
    """Per (workspace, ego, account, tweet): first, last, count, and the text and surface that came last."""
    order = F.struct("seen_at", "event_key")
    return events.groupBy("workspace", "ego", "account_id", "tweet_id").agg(
        F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"), F.count(F.lit(1)).alias("seen_count"), F.max_by("text", F.when(F.col("text").isNotNull(), order)).alias("text"), F.max_by("surface", order).alias("surface")
    )


def ingest(batch: DataFrame, store: str) -> dict[str, int]:
    """One batch into the event table at ``store``: counts of total, inserted, duplicates and failed, and ten refused samples at most."""
    spark = batch.sparkSession
    rows = batch.persist()
    try:
        valid = rows.where("refused IS NULL")
        first = valid.withColumn("_r", F.row_number().over(Window.partitionBy("event_key").orderBy("seen_at"))).where("_r = 1").drop("_r", "refused")
        try:
            seen = spark.read.parquet(f"{store}/events").select("event_key")
            first = first.join(seen, "event_key", "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        total, failed = rows.count(), rows.where("refused IS NOT NULL").count()
        before = _count(spark, f"{store}/events")
        first.write.mode("append").parquet(f"{store}/events")
        inserted = _count(spark, f"{store}/events") - before
        samples = [r["refused"] for r in rows.where("refused IS NOT NULL").select("refused").limit(10).collect()]
        return {"total": total, "inserted": inserted, "duplicates": total - failed - inserted, "failed": failed, "errors": samples}
    finally:
        rows.unpersist()


def _count(spark, path: str) -> int:
    try:
        return spark.read.parquet(path).count()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return 0
        raise


def tail(spark, folder: str, per_trigger: int = 100) -> DataFrame:
    """Envelopes appended as lines of JSON under ``folder``: a stream with its own offsets; a damaged line has a null payload."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", per_trigger).load(folder)
    return lines.where(F.trim("value") != "").select(F.from_json("value", ENVELOPE).alias("e"), F.length("value").alias("bytes")).select("e.*", "bytes")


def relayed(envelopes: DataFrame, refused_role: str = "participant") -> DataFrame:
    """Envelopes to pass on: not those of participants; the role defaults to spectator."""
    return envelopes.where(F.coalesce(F.lower("participant"), F.lit("spectator")) != refused_role)


def deduplicated(events: DataFrame, horizon: str | None = None) -> DataFrame:
    """Without repeated keys: for ever, or within a watermark that bounds the state."""
    if horizon:
        return events.withWatermark("seen_at", horizon).dropDuplicatesWithinWatermark(["event_key"])
    return events.dropDuplicates(["event_key"])


def windowed(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("seen_at", late).groupBy(F.window("seen_at", window), "surface").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("account_id").alias("accounts"))


def sessions(events: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("seen_at", late).groupBy(F.session_window("seen_at", gap), "account_id").agg(F.count(F.lit(1)).alias("n"))


def run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """All that is there now, batch by batch; the offsets move only after ``each`` succeeds, so ``each`` sees every row at least once."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def envelope(events: DataFrame, kind: str, source: str, workspace: str, ego: str) -> DataFrame:
    """Events as lines of JSON for an append-only log."""
    return events.select(F.to_json(F.struct(F.lit(kind).alias("eventType"), F.lit(source).alias("source"), F.lit(workspace).alias("workspaceId"), F.lit(ego).alias("ego"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("capturedAt"), F.struct(*events.columns).alias("payload"))).alias("value"))
