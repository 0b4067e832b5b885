"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

A source's documents are ordered by size class and then by a hash, each expects the same
number of copies (its source's target over its source's size), and a prefix sum of those
expectations plus one offset per source decides: a document is emitted once for every
integer its part of the sum crosses. Ordering by size class first keeps the words taken
near the target, since every class is sampled at the same rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets_for, exclusive_prefix, n_words, table, written

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
SEED = 20_240_601


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``_key, source_size`` (a row per source) plus ``target``.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` times
    all sizes. A target stops at ``cap`` times its source's size and the rest is shared
    again by weight. That fixed point is a common level: target = min(cap * size, level *
    weight), where level is the greatest of (total - caps of the sources that fill up
    first) / (weights of the others). One row per source is all the windows see."""
    by_name = Window.orderBy(F.col("_key.s").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    rows = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    rows = rows.withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    fills = [(F.col("_cap") / F.col("_w")).asc(), F.col("_key.s").asc_nulls_last()]
    full = Window.orderBy(*fills).rowsBetween(Window.unboundedPreceding, -1)
    open_ = Window.orderBy(*fills).rowsBetween(0, Window.unboundedFollowing)
    all_ = Window.partitionBy()
    total = F.sum("source_size").over(all_) * F.lit(float(share))
    rows = rows.withColumn("_level", (total - F.coalesce(F.sum("_cap").over(full), F.lit(0.0))) / F.sum("_w").over(open_))
    rows = rows.withColumn("_level", F.max("_level").over(all_))
    return rows.select("_key", "source_size", F.least("_cap", F.col("_level") * F.col("_w")).alias("target"))


def _hash(seed: int, text: Column) -> Column:
    """48 bits of an md5, which SQL engines agree on."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), text)), 1, 12), 16, 10).cast("long")


def _drawn(docs: DataFrame, id_col: str, source_col: str, size_col: str, weights, share: float, cap: float, seed: int) -> DataFrame:
    """``docs`` with _gl_source_size, _gl_target and _gl_copies."""
    n = buckets_for(docs.count())
    hashed = _hash(seed, F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    binary = F.bin(F.col(size_col))
    quarter = F.conv(F.rpad(F.substring(binary, 2, 2), 2, "0"), 2, 10).cast("long")  # size classes: four for each doubling
    level = F.when(F.col(size_col) > 0, 4 * F.length(binary) + quarter).otherwise(F.lit(0))
    rows = docs.withColumns({"_gl_key": F.struct(F.col(source_col).alias("s")), "_gl_bucket": level * n + F.pmod(hashed, F.lit(n)), "_gl_hash": hashed, "_gl_one": F.lit(1).cast("long")})
    by_source = rows.groupBy("_gl_key", "_gl_bucket").agg(F.sum(size_col).alias("_size")).groupBy("_gl_key").agg(F.sum("_size").alias("source_size"))
    targets = source_targets(by_source.withColumnRenamed("_gl_key", "_key"), weights, share, cap).withColumnsRenamed({"_key": "_gl_key", "source_size": "_gl_source_size", "target": "_gl_target"})
    ranked = exclusive_prefix(rows, "_gl_key", "_gl_bucket", ["_gl_hash", id_col, size_col], "_gl_one", "_gl_rank", more=targets)
    rate = F.when(F.col("_gl_source_size") > 0, F.col("_gl_target") / F.col("_gl_source_size")).otherwise(F.lit(0.0))
    offset = (F.pmod(_hash(seed, F.coalesce(F.col("_gl_key.s").cast("string"), F.lit(""))), F.lit(1 << 20)) + 0.5) / float(1 << 20)
    rank, rate_, offset_ = F.col("_gl_rank"), F.col("_gl_rate"), F.col("_gl_offset")
    crossed = F.floor((rank + 1) * rate_ + offset_) - F.floor(rank * rate_ + offset_)
    out = ranked.withColumns({"_gl_rate": rate, "_gl_offset": offset}).withColumn("_gl_copies", crossed.cast("long"))
    return out.drop("_gl_key", "_gl_bucket", "_gl_hash", "_gl_one", "_gl_rank", "_gl_rate", "_gl_offset")


def copies(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size", weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """``docs`` with ``source_size``, ``target`` and ``copies`` (how often the mix emits the row).

    Rows are counted one by one, so repeated rows and repeated ids are sampled like any
    others; a null source is a source; rows of size 0 are emitted at their source's rate
    and take no words. An empty table gives an empty table. Columns of these three names in
    the input are replaced. The result depends on the rows' ids, sizes and sources alone,
    not on how they are partitioned."""
    names = ("source_size", "target", "copies")
    drawn = _drawn(docs.drop(*names), id_col, source_col, size_col, weights, share, cap, seed)
    return drawn.withColumnsRenamed({f"_gl_{n}": n for n in names})


def mixed(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is emitted, with the columns it came with, whatever their names."""
    sized = docs.withColumn("_gl_size", n_words(F.col(text_col)))
    drawn = _drawn(sized, id_col, source_col, "_gl_size", weights, share, cap, seed).where("_gl_copies > 0")
    return drawn.withColumn("_gl_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_gl_copies"))).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    drawn = copies(written(docs, "mix"))
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


#: For tables of up to 65,536 rows, where every class has 16 buckets.
ORACLE = f"""
WITH d AS MATERIALIZED (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)]::DOUBLE AS w FROM d GROUP BY 1),
c AS (SELECT *, source_size * 2.0::DOUBLE AS cap FROM s),
v AS (SELECT *, ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
t AS (SELECT source, source_size, least(cap, (SELECT max(level) FROM v) * w) AS target,
    (CAST('0x' || substr(md5('{SEED}:' || coalesce(source, '')), 1, 12) AS BIGINT) % 1048576 + 0.5::DOUBLE) / 1048576 AS u FROM v),
h AS (SELECT *, CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS hash, rpad(substr(bin(size), 2, 2), 2, '0') AS q FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY (CASE WHEN size > 0 THEN 4 * length(bin(size)) + CASE q WHEN '00' THEN 0 WHEN '01' THEN 1 WHEN '10' THEN 2 ELSE 3 END ELSE 0 END) * 16 + hash % 16, hash, doc_id NULLS FIRST, size) - 1 AS rank FROM h),
x AS (SELECT r.doc_id, r.size, t.source_size, t.target, t.u, r.rank, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
y AS (SELECT *, CAST(floor((rank + 1) * rate + u) - floor(rank * rate + u) AS BIGINT) AS copies FROM x)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM y
"""
