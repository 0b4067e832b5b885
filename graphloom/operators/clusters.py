"""Cluster views: edges between clusters, representatives, local metrics, structure scores, dendrogram walks."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cluster_edges(edges: DataFrame, memberships: DataFrame, fusion: float = 0.0, communities: DataFrame | None = None) -> DataFrame:
    """(a, b, w, n) between clusters, a < b: soft weights S^T A S and the raw count; an edge within a community counts 1 + fusion, across max(0, 1 - fusion)."""
    e = edges
    if communities is not None and fusion:
        c = communities
        e = e.join(c.withColumnsRenamed({"id": "src", "community": "_cs"}), "src", "left").join(c.withColumnsRenamed({"id": "dst", "community": "_cd"}), "dst", "left")
        e = e.withColumn("w", F.col("w") * F.when(F.col("_cs") == F.col("_cd"), 1 + fusion).otherwise(max(0.0, 1 - fusion)))
    m = memberships
    both = e.select("src", "dst", "w").join(m.withColumnsRenamed({"id": "src", "cluster": "cs", "p": "ps"}), "src").join(m.withColumnsRenamed({"id": "dst", "cluster": "cd", "p": "pd"}), "dst").where("cs <> cd")
    return both.groupBy(F.least("cs", "cd").alias("a"), F.greatest("cs", "cd").alias("b")).agg(F.sum(F.col("w") * F.col("ps") * F.col("pd")).alias("w"), F.count(F.lit(1)).alias("n"))


def connectivity(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """(a, b, n, strength) of hard clusters: edges over the root of the product of sizes."""
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    both = edges.join(clusters.withColumnsRenamed({"id": "src", "cluster": "cs"}), "src").join(clusters.withColumnsRenamed({"id": "dst", "cluster": "cd"}), "dst").where("cs <> cd")
    n = both.groupBy(F.least("cs", "cd").alias("a"), F.greatest("cs", "cd").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    out = n.join(sizes.withColumnsRenamed({"cluster": "a", "size": "sa"}), "a").join(sizes.withColumnsRenamed({"cluster": "b", "size": "sb"}), "b")
    return out.select("a", "b", "n", (F.col("n") / F.sqrt(F.col("sa") * F.col("sb"))).alias("strength"))


def representatives(clusters: DataFrame, fame: DataFrame, k: int = 3) -> DataFrame:
    """The k best-followed members of each cluster."""
    rows = clusters.join(fame.select("id", "fame"), "id", "left").withColumn("fame", F.coalesce("fame", F.lit(0)))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("fame"), "id"))).where(F.col("rank") <= k)


def visible(clusters: DataFrame, least: int = 4) -> DataFrame:
    """Clusters of enough members as such, others member by member: (id, shown)."""
    n = F.count(F.lit(1)).over(Window.partitionBy("cluster"))
    return clusters.select("id", F.when(n >= least, F.concat(F.lit("cluster:"), F.col("cluster").cast("string"))).otherwise(F.concat(F.lit("node:"), F.col("id").cast("string"))).alias("shown"))


def local_metrics(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """Per cluster: members, inner edges, density, mutual share, mean and deviation of inner out-degrees."""
    inner = edges.join(clusters.withColumnsRenamed({"id": "src", "cluster": "cluster"}), "src").join(clusters.withColumnsRenamed({"id": "dst", "cluster": "cd"}), "dst").where("cluster = cd AND src <> dst").select("cluster", "src", "dst").distinct()
    back = inner.select("cluster", F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("m"))
    out = inner.join(back, ["cluster", "src", "dst"], "left").groupBy("cluster", "src").agg(F.count(F.lit(1)).alias("d"), F.count("m").alias("m"))
    rows = clusters.withColumnRenamed("id", "src").join(out, ["cluster", "src"], "left").withColumns({"d": F.coalesce("d", F.lit(0)), "m": F.coalesce("m", F.lit(0))})
    got = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), F.sum("d").alias("n_edges"), F.sum("m").alias("mutual"), F.avg("d").alias("mean_degree"), F.stddev_pop("d").alias("std_degree"))
    return got.select(
        "cluster", "members", "n_edges", F.when(F.col("members") > 1, F.col("n_edges") / (F.col("members") * (F.col("members") - 1))).otherwise(0.0).alias("density"), F.when(F.col("n_edges") > 0, F.col("mutual") / F.col("n_edges")).otherwise(0.0).alias("mutual_ratio"), "mean_degree", "std_degree"
    )


def strategy(metrics: DataFrame, tag_entropy: Column, n_tags: Column, bridge_ratio: Column, has_children: Column) -> DataFrame:
    """How to open a cluster of ``local_metrics``; the first rule that holds. The thresholds are fixed values."""
    n = F.col("members")
    varied = F.when(F.col("mean_degree") > 0, F.col("std_degree") / F.col("mean_degree")).otherwise(0.0) > 1.5
    rule = (
        F.when(n <= 5, "individuals")
        .when((tag_entropy > 1.5) & (n_tags >= 2), "tag_split")
        .when((bridge_ratio > 0.2) & (n > 10), "bridge_extraction")
        .when(varied & (n > 15), "core_periphery")
        .when((F.col("density") > 0.1) & (F.col("mutual_ratio") > 0.3) & (n < 50), "mutual_components")
        .when(F.col("n_edges") > F.floor(n / 2), "louvain")
        .when(has_children, "hierarchical")
        .when(n <= 20, "individuals")
        .otherwise("sample_individuals")
    )
    return metrics.withColumn("strategy", rule)


def structure_score(sizes: DataFrame, separation: Column, coherence: Column, small: int = 4) -> DataFrame:
    """Per split: the mean of size evenness (1: all alike), 1 - share of the largest, 1 - share of small parts, edge separation, tag coherence; 0.2 for one part."""
    s = sizes.groupBy("split").agg(F.count(F.lit(1)).alias("k"), F.sum("size").alias("t"), F.max("size").alias("top"), F.sum(F.when(F.col("size") < small, 1).otherwise(0)).alias("tiny"), F.sum(F.col("size") * F.log2("size")).alias("sl"))
    h = (F.log2("t") - F.col("sl") / F.col("t")) / F.log2("k")
    score = (h + (1 - F.col("top") / F.col("t")) + (1 - F.col("tiny") / F.col("k")) + separation + coherence) / 5
    return s.select("split", "k", F.when(F.col("k") <= 1, 0.2).otherwise(score).alias("score"))


class Dendrogram:
    """Walks over a merge table (parent, left, right) of bounded size, on the driver."""

    def __init__(self, merges: list[tuple[int, int, int]]):
        self.children = {p: (a, b) for p, a, b in merges}
        self.parent = {c: p for p, kids in self.children.items() for c in kids}

    def leaves(self, node: int) -> list[int]:
        todo, out = [node], []
        while todo:
            x = todo.pop()
            if x in self.children:
                todo += reversed(self.children[x])
            else:
                out.append(x)
        return out

    def size(self, node: int) -> int:
        return len(self.leaves(node))

    def sibling(self, node: int) -> int | None:
        p = self.parent.get(node)
        return None if p is None else next(c for c in self.children[p] if c != node)

    def is_descendant(self, node: int, of: int) -> bool:
        while node != of and node in self.parent:
            node = self.parent[node]
        return node == of

    def expanded(self, shown: list[int], node: int, depth: float = 0.5) -> list[int]:
        """``shown`` with a node opened to max(3, size^(0.4 + 0.3 depth)) parts, the largest first."""
        target = max(3, int(self.size(node) ** (0.4 + 0.3 * depth)))
        parts = [node]
        while len(parts) < target and any(p in self.children for p in parts):
            big = max((p for p in parts if p in self.children), key=lambda p: (self.size(p), -p))
            i = parts.index(big)
            parts[i : i + 1] = self.children[big]
        return [x for s in shown for x in (parts if s == node else [s])]

    def collapsed(self, shown: list[int], node: int) -> list[int]:
        """``shown`` with a node's siblings' subtree folded into its parent."""
        p = self.parent.get(node)
        if p is None:
            return shown
        kept = [s for s in shown if not self.is_descendant(s, p)]
        return [*kept, p]

    def revealed(self, shown: list[int], leaf: int, budget: int) -> list[int]:
        """``shown`` with a leaf's clusters opened until it is shown or the budget is used."""
        while len(shown) < budget:
            holder = next((s for s in shown if s != leaf and self.is_descendant(leaf, s)), None)
            if holder is None:
                break
            i = shown.index(holder)
            shown = [*shown[:i], *self.children[holder], *shown[i + 1 :]]
        return shown


def bridge_paths(neighbours: dict[int, set[int]], scores: dict[int, float], shown: set[int], seeds: set[int], most_hops: int = 8, most_total: int = 50) -> set[int]:
    """Nodes to add so that shown nodes hang together with the seeds: cheapest paths, a hop costing 1 + 0.75 (1 - score). Bounded to what a client shows."""
    import heapq

    added: set[int] = set()
    joined = set(seeds)
    for target in sorted(shown - seeds, key=lambda x: -scores.get(x, 0)):
        best, heap, back = defaultdict(lambda: float("inf")), [(0.0, 0, target)], {}
        while heap and len(added) < most_total:
            cost, hops, x = heapq.heappop(heap)
            if x in joined:
                while x != target:
                    if x not in shown and x not in seeds:
                        added.add(x)
                    joined.add(x)
                    x = back[x]
                joined.add(target)
                break
            if hops >= most_hops:
                continue
            for y in neighbours.get(x, ()):
                price = cost + 1 + 0.75 * (1 - scores.get(y, 0.0))
                if price < best[y]:
                    best[y], back[y] = price, x
                    heapq.heappush(heap, (price, hops + 1, y))
    return added
