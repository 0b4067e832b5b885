"""Linear algebra and clustering on long tables: TF-IDF, factors, Laplacians, embeddings, centroids.

Rows stay distributed; only matrices over classes, components or clusters, whose size a
parameter bounds, come to the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Greatest order of a matrix that the driver takes.
DRIVER_ORDER = 4096


def tfidf(counts: DataFrame, smooth: bool = True) -> DataFrame:
    """(row, col, w) from (row, col, n): (1 + ln n) (ln((1 + rows) / (1 + df)) + 1), rows of unit length."""
    rows = counts.select("row").distinct().count()
    df = counts.groupBy("col").agg(F.count(F.lit(1)).alias("df"))
    raw = counts.join(df, "col").withColumn("w", (1 + F.ln("n")) * (F.ln((1 + F.lit(rows)) / (1 + F.col("df"))) + 1))
    return raw.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("row")))).select("row", "col", "w")


def blocks(parts: dict[str, tuple[DataFrame, float]]) -> DataFrame:
    """Several (row, col, w) side by side: columns prefixed, weights scaled."""
    out = None
    for name, (df, weight) in parts.items():
        part = df.select("row", F.concat(F.lit(name + ":"), F.col("col").cast("string")).alias("col"), (F.col("w") * F.lit(float(weight))).alias("w"))
        out = part if out is None else out.unionByName(part)
    return out


def nmf(matrix: DataFrame, k: int, rounds: int = 20, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Non-negative factors of (row, col, w) by multiplicative updates: (row, f array) and (col, f array).

    Each half round is one join and one aggregation; only the k x k Gram matrix is collected."""
    eps = 1e-9
    matrix = cut(matrix)
    start = lambda c, salt: matrix.select(c).distinct().select(c, F.array(*[0.1 + F.pmod(F.xxhash64(F.col(c), F.lit(i + salt)), F.lit(1000)) / 1000 for i in range(k)]).alias("f"))
    w, h = cut(start("row", seed)), cut(start("col", seed + 1000))

    def gram(side: DataFrame) -> np.ndarray:
        terms = [F.sum(F.col("f")[i] * F.col("f")[j]).alias(f"{i}_{j}") for i in range(k) for j in range(k)]
        return np.array(list(side.agg(*terms).first()), float).reshape(k, k)

    def update(side: DataFrame, key: str, other: DataFrame, via: str) -> DataFrame:
        g = gram(other)
        up = matrix.join(other.withColumnRenamed("f", "o"), via).groupBy(key).agg(*[F.sum(F.col("w") * F.col("o")[i]).alias(f"u{i}") for i in range(k)])
        both = side.join(up, key)
        new = [F.col("f")[i] * F.col(f"u{i}") / (sum((F.col("f")[j] * float(g[j, i]) for j in range(k)), F.lit(eps))) for i in range(k)]
        return cut(both.select(key, F.array(*new).alias("f")))

    for _ in range(rounds):
        w = update(w, "row", h, "col")
        h = update(h, "col", w, "row")
    return w, h


def row_shares(factors: DataFrame, key: str = "row") -> DataFrame:
    """(key, component, w), each row made to sum to 1."""
    long = factors.select(key, F.posexplode("f").alias("component", "w"))
    total = F.sum("w").over(Window.partitionBy(key))
    return long.withColumn("w", F.when(total > 0, F.col("w") / total).otherwise(0.0))


def laplacian(edges: DataFrame) -> DataFrame:
    """(src, dst, v) of I - D^-1/2 ((A + A^T) / 2) D^-1/2; degree 0 counts as 1."""
    sym = edges.select("src", "dst", (F.col("w") / 2).alias("w")).unionAll(edges.select("dst", "src", F.col("w") / 2)).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    d = sym.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("d"))
    scaled = sym.join(d.withColumnsRenamed({"id": "src", "d": "ds"}), "src").join(d.withColumnsRenamed({"id": "dst", "d": "dd"}), "dst").select("src", "dst", (-F.col("w") / F.sqrt(F.col("ds") * F.col("dd"))).alias("v"))
    ones = d.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("v"))
    return scaled.unionByName(ones).groupBy("src", "dst").agg(F.sum("v").alias("v"))


def spectral(edges: DataFrame, k: int, rounds: int = 40, seed: int = 3) -> DataFrame:
    """(id, f array): the k eigenvectors of the normalised Laplacian after the first, rows of unit length, by block power rounds on 2 I - L.

    A round is one join; the Gram matrix of k + 1 columns is orthonormalised on the driver."""
    m = k + 1
    l = cut(laplacian(edges))
    x = l.select(F.col("src").alias("id")).distinct().select("id", F.array(*[F.pmod(F.xxhash64("id", F.lit(seed + i)), F.lit(2001)) / 1000 - 1 for i in range(m)]).alias("f"))

    def orthonormal(x: DataFrame) -> DataFrame:
        g = np.array(list(x.agg(*[F.sum(F.col("f")[i] * F.col("f")[j]) for i in range(m) for j in range(m)]).first()), float).reshape(m, m)
        r = np.linalg.inv(np.linalg.cholesky(g + 1e-12 * np.eye(m)))
        return x.select("id", F.array(*[sum((F.col("f")[j] * float(r[i, j]) for j in range(m)), F.lit(0.0)) for i in range(m)]).alias("f"))

    x = cut(orthonormal(cut(x)))
    for _ in range(rounds):
        lx = l.join(x.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(*[F.sum(F.col("v") * F.col("f")[i]).alias(f"y{i}") for i in range(m)])
        x = cut(x.join(lx, "id").select("id", F.array(*[2 * F.col("f")[i] - F.col(f"y{i}") for i in range(m)]).alias("f")))
        x = cut(orthonormal(x))
    part = F.slice("f", 2, k)
    norm = F.sqrt(F.aggregate(part, F.lit(0.0), lambda a, v: a + v * v))
    return x.select("id", F.when(norm > 0, F.transform(part, lambda v: v / norm)).otherwise(part).alias("f"))


def ward(points: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Ward linkage (n - 1 rows of left, right, distance, size) of centroids, at most ``DRIVER_ORDER``."""
    n = len(points)
    if n > DRIVER_ORDER:
        raise ValueError(f"{n} points are more than the driver takes; cluster to centroids first")
    size = np.ones(n) if weights is None else weights.astype(float)
    d = ((points[:, None, :] - points[None, :, :]) ** 2).sum(-1) * (size[:, None] * size[None, :]) / (size[:, None] + size[None, :])
    np.fill_diagonal(d, np.inf)
    label, alive, out = np.arange(n), np.ones(n, bool), []
    for step in range(n - 1):
        i, j = divmod(int(d.argmin()), n)
        i, j = min(i, j), max(i, j)
        out.append((min(label[i], label[j]), max(label[i], label[j]), np.sqrt(2 * d[i, j]), size[i] + size[j]))
        rest = alive.copy()
        rest[[i, j]] = False
        t = size[rest]
        d[i, rest] = d[rest, i] = ((size[i] + t) * d[i, rest] + (size[j] + t) * d[j, rest] - t * d[i, j]) / (size[i] + size[j] + t)
        size[i] += size[j]
        alive[j] = False
        d[j, :] = d[:, j] = np.inf
        label[i] = n + step
    return np.array(out, float).reshape(-1, 4)


def cut_tree(linkage: np.ndarray, clusters: int) -> np.ndarray:
    """Labels 0.. of the leaves when the tree is cut into so many clusters."""
    n = len(linkage) + 1
    parent = np.arange(2 * n - 1)
    for step in range(max(0, n - clusters)):
        parent[[int(linkage[step, 0]), int(linkage[step, 1])]] = n + step
    root = np.arange(2 * n - 1)
    for i in range(2 * n - 2, -1, -1):
        root[i] = i if parent[i] == i else root[parent[i]]
    return np.unique(root[:n], return_inverse=True)[1]


def kmeans(vectors: DataFrame, k: int, column: str = "f", seed: int = 1, rounds: int = 20) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) and the centroids, on rows of unit length."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    norm = F.sqrt(F.aggregate(column, F.lit(0.0), lambda a, v: a + v.cast("double") * v))
    unit = vectors.withColumn("_u", F.when(norm > 0, F.transform(column, lambda v: v / norm)).otherwise(F.transform(column, lambda v: v.cast("double"))))
    data = unit.withColumn("_v", array_to_vector("_u"))
    model = KMeans(k=k, seed=seed, maxIter=rounds, featuresCol="_v", predictionCol="cluster").fit(data)
    centers = np.array(model.clusterCenters())
    center = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centers])
    gap = F.aggregate(F.zip_with(vector_to_array("_v"), F.element_at(center, F.col("cluster") + 1), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return model.transform(data).select("id", "cluster", F.sqrt(gap).alias("distance")), centers


def soft_memberships(distances: DataFrame, heat: float = 1.0) -> DataFrame:
    """(id, cluster, p): softmax of -distance / heat."""
    low = F.min("distance").over(Window.partitionBy("id"))
    e = distances.withColumn("e", F.exp(-(F.col("distance") - low) / F.lit(heat)))
    return e.select("id", "cluster", (F.col("e") / F.sum("e").over(Window.partitionBy("id"))).alias("p"))


def principal_plane(centroids: np.ndarray) -> np.ndarray:
    """Centroids on their first two principal axes."""
    if len(centroids) > DRIVER_ORDER:
        raise ValueError("more centroids than the driver takes")
    x = centroids - centroids.mean(axis=0)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    flip = np.sign(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])])
    out = (u * flip * s)[:, :2]
    return out if out.shape[1] == 2 else np.column_stack([out, np.zeros(len(out))])


def procrustes(points: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Points turned, scaled and moved onto matching ones."""
    a, b = points - points.mean(0), target - target.mean(0)
    u, s, vt = np.linalg.svd(a.T @ b)
    scale = s.sum() / max((a * a).sum(), 1e-12)
    return scale * a @ (u @ vt) + target.mean(0)


def diversified(scores: np.ndarray, vectors: np.ndarray, k: int, weight: float = 0.7) -> list[int]:
    """Maximal marginal relevance over a bounded candidate list: best of weight * score - (1 - weight) * nearest chosen."""
    if len(scores) > DRIVER_ORDER:
        raise ValueError("more candidates than the driver takes")
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    chosen: list[int] = []
    near = np.zeros(len(scores))
    for _ in range(min(k, len(scores))):
        value = weight * scores - (1 - weight) * near
        value[chosen] = -np.inf
        best = int(value.argmax())
        chosen.append(best)
        near = np.maximum(near, unit @ unit[best])
    return chosen


def aligned_factors(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, float]]:
    """Greedy matching of the rows of two factor matrices by cosine."""
    ua = a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)
    ub = b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-12)
    s, out = ua @ ub.T, []
    for _ in range(min(s.shape)):
        i, j = divmod(int(s.argmax()), s.shape[1])
        out.append((i, j, float(s[i, j])))
        s[i, :], s[:, j] = -np.inf, -np.inf
    return out


def discriminating(counts: DataFrame, clusters: DataFrame, top: int = 10, least: float = 0.15) -> DataFrame:
    """Per cluster its ``top`` targets by mean count within over mean count elsewhere + 0.01: (cluster, target, score, rank).

    ``counts``: (id, target, n), ``clusters``: (id, cluster). A target whose mean within is below
    ``least`` times the cluster's share of all members scores 0. Ties go to the smaller target."""
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("s"))
    everyone = clusters.agg(F.count(F.lit(1)).alias("everyone"))
    held = counts.join(clusters, "id").groupBy("cluster", "target").agg(F.sum("n").alias("n"))
    total = held.groupBy("target").agg(F.sum("n").alias("total"))
    rows = held.join(total, "target").join(sizes.crossJoin(F.broadcast(everyone)), "cluster")  # one row
    inside = F.col("n") / F.col("s")
    outside = (F.col("total") - F.col("n")) / F.greatest(F.col("everyone") - F.col("s"), F.lit(1))
    score = F.when(inside < F.lit(least) * F.col("s") / F.col("everyone"), 0.0).otherwise(inside / (outside + 0.01))
    order = Window.partitionBy("cluster").orderBy(F.desc("score"), "target")
    return rows.select("cluster", "target", score.alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
