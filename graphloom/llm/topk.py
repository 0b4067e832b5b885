"""Exact top-k inner-product search by term-at-a-time accumulation.

Terms are vector components. Queries and candidates are dealt into blocks of bounded size;
within a pair of blocks each non-zero component of a query scatters its weighted postings
(that component of every candidate) into the query's dense score array, a partition
selection keeps k per block, and the blocks' winners are merged.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

CANDIDATE_BLOCK = 2048
QUERY_BLOCK = 2048


def _accumulate(queries: np.ndarray, cands: np.ndarray) -> np.ndarray:
    """Scores of all queries against all candidates, a term at a time."""
    bound = int(np.abs(queries).max(initial=0)) * int(np.abs(cands).max(initial=0)) * queries.shape[1]
    kind = np.int32 if bound < 2**31 else np.int64
    postings = np.ascontiguousarray(cands.T.astype(kind))
    queries = queries.astype(kind)
    scores = np.zeros((len(queries), len(cands)), kind)
    for q, row in enumerate(queries):
        scores_q = scores[q]
        for term in np.flatnonzero(row):
            scores_q += row[term] * postings[term]
    return scores


def _matrix(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _best(k: int):
    def best(cands: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"_query": [], "query_id": [], "vec_id": [], "score": []}
        if len(cands) and len(queries):
            cands = cands.sort_values("vec_id", kind="stable")
            ids = cands["vec_id"].to_numpy()
            width = max(cands["_v"].map(len).max(), queries["_v"].map(len).max())
            matrix = _matrix(cands["_v"].tolist(), width)
            for at in range(0, len(queries), 256):
                part = queries.iloc[at : at + 256]
                scores = _accumulate(_matrix(part["_v"].tolist(), width), matrix).astype(np.int64)
                for key, q, row in zip(part["_query"].to_numpy(), part["vec_id"].to_numpy(), scores, strict=True):
                    own = ids == q
                    n = len(ids) - int(own.sum())
                    if not n:
                        continue
                    if n < len(ids):
                        row = np.where(own, np.iinfo(np.int64).min, row)
                    if n > k:  # the k-th score by partition, then all that reach it, by score and id
                        floor = np.partition(row, len(row) - k)[len(row) - k]
                        keep = np.flatnonzero((row >= floor) & ~own)
                    else:
                        keep = np.flatnonzero(~own)
                    keep = keep[np.lexsort((ids[keep], -row[keep]))][:k]
                    out["_query"] += [key] * len(keep)
                    out["query_id"] += [q] * len(keep)
                    out["vec_id"] += ids[keep].tolist()
                    out["score"] += row[keep].tolist()
        return pd.DataFrame({n: np.asarray(x, np.int64) for n, x in out.items()})

    return best


def top_k(vectors: DataFrame, queries: DataFrame, k: int, candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """For each query its k best candidates: query_id, rank, vec_id, score.

    Both tables hold ``vec_id`` and ``_v``, an array of integers; shorter arrays count as padded
    with zeros. A query's own id is no candidate of its, whatever row holds it; equal rows of the
    queries are one query, and different vectors under one id are one query each, told apart by
    their ranks only. Equal scores go to the smaller id; a repeated candidate row is a candidate
    each time. No rows give no rows. Components so large that a score could pass 64 bits raise a
    ValueError."""
    # a table, so that a query's constant id is not folded into the cogroup, which then loses columns
    queries = written(queries.select("vec_id", "_v").distinct(), "queries")
    limits = [df.agg(F.max(F.array_max(F.transform("_v", lambda c: F.abs(c)))), F.max(F.size("_v"))).first() for df in (vectors, queries)]
    (big, wide), (most, width) = ((int(r[0] or 0), int(r[1] or 0)) for r in limits)
    if big * most * max(wide, width) >= 1 << 62:
        raise ValueError("components too large: a score could pass 64 bits")
    queries = queries.withColumn("_query", F.xxhash64("vec_id", "_v"))
    n, m = vectors.count(), queries.count()
    nc, nq = max(1, math.ceil(n / candidate_block)), max(1, math.ceil(m / query_block))
    block = lambda blocks, of: F.pmod(F.xxhash64(F.lit(11), of), F.lit(blocks))
    all_ = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    cands = vectors.select("vec_id", "_v", block(nc, F.monotonically_increasing_id()).alias("_c"), all_(nq).alias("_q"))  # rows of one id part as well
    asked = queries.select("_query", "vec_id", "_v", all_(nc).alias("_c"), block(nq, F.col("_query")).alias("_q"))
    found = cands.groupBy("_c", "_q").cogroup(asked.groupBy("_c", "_q")).applyInPandas(_best(k), "_query long, query_id long, vec_id long, score long")
    order = Window.partitionBy("_query").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(embeddings: DataFrame, scale: float = 256.0) -> DataFrame:
    """``vec_id, _v``: floor(scale * component). Rows take no part whose id or vector is null or whose vector holds a null or non-finite component."""
    x = F.col("embedding")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return embeddings.where(F.col("vec_id").isNotNull() & x.isNotNull() & F.coalesce(whole, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double"))).alias("_v"))


def query(spark, sf_dir: str) -> DataFrame:
    """The 5 best for every vector whose id is divisible by 50, against all vectors."""
    vectors = written(quantised(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")), "vectors")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT a.vec_id AS query_id, b.vec_id,
                  CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score, a.q
           FROM (SELECT DISTINCT vec_id, q FROM v WHERE vec_id % 50 = 0) a JOIN v b ON a.vec_id <> b.vec_id),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id, q ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5
"""
