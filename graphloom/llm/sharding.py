"""Resharding by minimum-cost flow: the fewest bytes move from old shards into new capacities.

The flow is solved over shards, a handful of nodes; documents only meet its answer. Each old
shard lists its documents from large to small, a distributed prefix sum of bytes gives each
its place there, and the transfers cut that list: what stays comes first, so the cuts fall
among small documents and the new shards fill to within about one of those.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, exclusive_prefix, table, written

OLD_SHARDS = 12
NEW_SHARDS = 16
SEED = 7


def transfers(old_sizes: list[int], capacities: list[int], cost=None) -> list[list[int]]:
    """Bytes from each old shard to each new one that fill the capacities at the least cost.

    ``cost(i, j)`` per byte; by default 0 where a shard keeps its number and 1 elsewhere, so
    the cost is the bytes moved. Successive shortest paths with potentials; the capacities
    must hold the sizes. Sizes: one integer per shard, so this runs on the driver."""
    n, m = len(old_sizes), len(capacities)
    if sum(capacities) < sum(old_sizes):
        raise ValueError("the new shards cannot hold the old ones")
    cost = cost or (lambda i, j: 0 if i == j else 1)
    source, sink = n + m, n + m + 1
    edges: list[list[int]] = []  # to, room, cost; the odd ones run backwards
    at: list[list[int]] = [[] for _ in range(n + m + 2)]

    def edge(a: int, b: int, room: int, price: int) -> None:
        at[a].append(len(edges))
        edges.append([b, room, price])
        at[b].append(len(edges))
        edges.append([a, 0, -price])

    for i, size in enumerate(old_sizes):
        edge(source, i, size, 0)
        for j in range(m):
            edge(i, n + j, size, cost(i, j))
    for j, room in enumerate(capacities):
        edge(n + j, sink, room, 0)
    potential, left = [0] * (n + m + 2), sum(old_sizes)
    while left:
        far, via = [float("inf")] * (n + m + 2), [-1] * (n + m + 2)
        far[source], heap = 0, [(0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for e in at[a]:
                b, room, price = edges[e]
                step = d + price + potential[a] - potential[b]
                if room > 0 and step < far[b]:
                    far[b], via[b] = step, e
                    heapq.heappush(heap, (step, b))
        potential = [p + (f if f < float("inf") else 0) for p, f in zip(potential, far, strict=True)]
        push, b = left, sink
        while b != source:
            push, b = min(push, edges[via[b]][1]), edges[via[b] ^ 1][0]
        b = sink
        while b != source:
            edges[via[b]][1] -= push
            edges[via[b] ^ 1][1] += push
            b = edges[via[b] ^ 1][0]
        left -= push
    flow = [[0] * m for _ in range(n)]
    for i in range(n):
        for e in at[i]:
            if e % 2 == 0:
                flow[i][edges[e][0] - n] += edges[e ^ 1][1]
    return flow


def even(total: int, shards: int) -> list[int]:
    """Capacities that share ``total`` and differ by one at most."""
    return [total // shards + (j < total % shards) for j in range(shards)]


def reshard(docs: DataFrame, old_col: str, size_col: str, id_col: str = "doc_id", capacities: list[int] | None = None, shards: int = NEW_SHARDS, cost=None, seed: int = SEED, tie_cols: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``shard``, the new shard of each row. Sizes are positive, old shards run from 0.

    Equal rows may part; a row goes where the middle of its bytes falls. Rows are told apart by
    id, size and ``tie_cols``; those that are equal in all of them may swap places. Null ids are
    spread by the rest. ``docs`` is read three times; pass a written table. An empty table stays
    empty."""
    docs = docs.drop("shard")
    old = {r[0]: r[1] for r in docs.groupBy(old_col).agg(F.sum(size_col)).collect()}  # a row per shard
    if not old:
        return docs.withColumn("shard", F.lit(None).cast("int"))
    sizes = [old.get(i, 0) for i in range(max(old) + 1)]
    flow = transfers(sizes, capacities or even(sum(sizes), shards), cost)
    cuts, goes = [], []
    for i, row in enumerate(flow):
        order = sorted((j for j, x in enumerate(row) if x), key=lambda j: (j != i, j))
        ends = [sum(row[j] for j in order[: k + 1]) for k in range(len(order))]
        cuts.append(F.array(*[F.lit(2 * x).cast("long") for x in ends[:-1]]) if len(ends) > 1 else F.array().cast("array<bigint>"))
        goes.append(F.array(*[F.lit(j).cast("int") for j in order or [0]]))
    n = buckets_for(docs.count())
    hashed = F.xxhash64(F.lit(seed), F.col(id_col), F.col(size_col), *[F.col(c) for c in tie_cols])
    rows = docs.withColumns({"_gl_hash": hashed, "_gl_bucket": -F.floor(4 * F.log2(F.col(size_col).cast("double"))) * n + F.pmod(hashed, F.lit(n))})
    placed = exclusive_prefix(rows, old_col, "_gl_bucket", ["_gl_hash", id_col, *tie_cols], size_col, "_gl_before")
    pick = F.col(old_col).cast("int") + 1
    middle = 2 * F.col("_gl_before") + F.col(size_col)
    passed = F.size(F.filter(F.element_at(F.array(*cuts), pick), lambda cut: cut <= middle))
    return placed.withColumn("shard", F.element_at(F.element_at(F.array(*goes), pick), passed + 1)).drop("_gl_hash", "_gl_bucket", "_gl_before")


def slots(docs: DataFrame, shard_col: str = "shard", id_col: str = "doc_id", seed: int = SEED, tie_cols: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``slot``: the place in its shard, from 0 without gaps, ordered by hashes of id and ``tie_cols``. ``docs`` is read twice."""
    n = buckets_for(docs.count())
    hashed = F.xxhash64(F.lit(seed + 1), F.col(id_col), *[F.col(c) for c in tie_cols])
    rows = docs.drop("slot").withColumns({"_gl_hash": hashed, "_gl_bucket": F.pmod(hashed, F.lit(n)), "_gl_one": F.lit(1).cast("long")})
    return exclusive_prefix(rows, shard_col, "_gl_bucket", ["_gl_hash", id_col, *tie_cols], "_gl_one", "slot").drop("_gl_hash", "_gl_bucket", "_gl_one")


def rewrite(docs: DataFrame, old_col: str, out_dir: str, shards: int = NEW_SHARDS, **options) -> list[int]:
    """Writes anew, in ``out_dir/shard=N``, the shards whose rows change and returns their numbers.

    The files of the other shards stay untouched; the folders of shards that are no more go.
    ``docs`` holds whole rows with ``text`` and ``old_col``, and may be read from ``out_dir``
    itself: what is written is first a table in the scratch folder, from which it is brought
    over without ``old_col``, so a failure leaves the rows there. Null ids, repeated rows and
    clashing names are as in ``reshard``."""
    spark = docs.sparkSession
    sized = docs.withColumn("_gl_size", F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 1)
    placed = reshard(sized, old_col, "_gl_size", shards=shards, **options).drop("_gl_size")
    placed = written(placed, "resharded")
    moved = placed.where(F.col(old_col) != F.col("shard")).groupBy(old_col, "shard").count().collect()  # at most old x new rows
    changed = sorted({r[0] for r in moved if r[0] < shards} | {r[1] for r in moved})
    rows = placed.where(F.col("shard").isin(changed)).repartition("shard", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(8)))
    rows.drop(old_col).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(out_dir)
    path = spark._jvm.org.apache.hadoop.fs.Path(out_dir)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    full = {r[0] for r in placed.select("shard").distinct().collect()}  # a row per shard
    for status in files.listStatus(path):
        name = status.getPath().getName()
        if name.startswith("shard=") and int(name[6:]) not in full:
            files.delete(status.getPath(), True)
    return changed


def query(spark, sf_dir: str) -> DataFrame:
    """All documents of a layout of 12 shards by id, brought into 16 of near equal bytes.

    Law ``bytes``. A null text has no bytes and the crc of none; a null id is hashed like
    any other value; repeated rows take a slot each."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.pmod(F.xxhash64(F.lit(SEED + 2), F.col("doc_id"), F.when(F.col("doc_id").isNull(), F.crc32(text.cast("binary")))), F.lit(OLD_SHARDS)).cast("int").alias("old_shard"))
    placed = slots(written(reshard(written(docs, "shard-old"), "old_shard", "size", tie_cols=("text_crc32",)), "shard-new"), tie_cols=("size", "text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")
