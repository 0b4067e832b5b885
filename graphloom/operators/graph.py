"""Graph operators on edge tables (src, dst, w): building, walks, distances, components, centrality."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Searches from many sources: sources times edges a task, tasks at most (each gets the edges), and edges of searches that a task holds at once.
WORK = 20_000_000
MOST_PARTS = 128
HELD = 2_000_000


# -- building ---------------------------------------------------------------------------


def follow_edges(following: DataFrame, followers: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct (src, dst) of both tables whose ends are known nodes. ``following``: (src, dst); ``followers``: (dst, src)."""
    edges = following.select("src", "dst").union(followers.select("src", "dst")).distinct()
    known = nodes.select("id")
    return edges.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")


def mutual(edges: DataFrame) -> DataFrame:
    """Edges whose reverse is there too."""
    return edges.select("src", "dst").intersect(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def mutual_follows(following: DataFrame, followers: DataFrame) -> DataFrame:
    """x, y where a follower table says x follows y and a following table says y follows x; both directions."""
    both = followers.select("src", "dst").intersect(following.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.union(both.select("dst", "src")).distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """One row (a, b), a < b, for each connected pair."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()


def pruned(edges: DataFrame, least_in: int) -> DataFrame:
    """Edges between nodes of at least so many followers; once, not to a fixed point."""
    kept = edges.groupBy("dst").count().where(F.col("count") >= least_in).select(F.col("dst").alias("id"))
    return edges.join(kept.withColumnRenamed("id", "src"), "src", "left_semi").join(kept.withColumnRenamed("id", "dst"), "dst", "left_semi")


def remapped(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Placeholder ids replaced by known ones (``placeholder, id``)."""
    for end in ("src", "dst"):
        edges = edges.join(ids.select(F.col("placeholder").alias(end), F.col("id").alias("_id")), end, "left").withColumn(end, F.coalesce("_id", end)).drop("_id")
    return edges.select("src", "dst").distinct()


def combined(typed: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Typed edges (src, dst, type, w) as one weighted edge a pair; types without a positive weight drop out."""
    used = {k: v for k, v in weights.items() if v > 0}
    by_type = F.create_map(*[F.lit(x) for pair in used.items() for x in pair])
    return typed.where(F.col("type").isin(list(used))).groupBy("src", "dst").agg(F.sum(F.element_at(by_type, F.col("type")) * F.col("w")).alias("w"))


def degrees(edges: DataFrame) -> DataFrame:
    """id, out_degree, in_degree in one aggregation."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def reciprocity(edges: DataFrame) -> DataFrame:
    """Per source: the share of those it points at that point back."""
    back = mutual(edges).withColumn("m", F.lit(1))
    return edges.select("src", "dst").distinct().join(back, ["src", "dst"], "left").groupBy("src").agg(F.count(F.lit(1)).alias("n_out"), F.count("m").alias("n_mutual"), (F.count("m") / F.count(F.lit(1))).alias("reciprocity"))


def cofollowed(follows: DataFrame, least: float = 0.1) -> DataFrame:
    """(a, b, shared, jaccard), a < b, of targets with common followers. Pairs meet on a follower's list, so its cost is the sum of squared list lengths: prune long lists first."""
    follows = follows.select("src", "dst").distinct()
    sizes = follows.groupBy("dst").agg(F.count(F.lit(1)).alias("n"))
    left, right = follows.withColumnRenamed("dst", "a"), follows.withColumnRenamed("dst", "b")
    shared = left.join(right, "src").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    both = shared.join(sizes.withColumnsRenamed({"dst": "a", "n": "na"}), "a").join(sizes.withColumnsRenamed({"dst": "b", "n": "nb"}), "b")
    return both.withColumn("jaccard", F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).where(F.col("jaccard") >= least).select("a", "b", "shared", "jaccard")


def inverse_probability(edges: DataFrame, expected: DataFrame, nodes: DataFrame, floor: float = 0.05, least: float = 0.05, add_reverse: bool = True) -> DataFrame:
    """Edges weighted by how completely their ends were observed.

    completeness = clip(observed / expected, floor, 1), 1 where nothing is expected; w = 1 /
    clip(c_u c_v / mean c, least, 1); a mutual edge counts in reverse too."""
    seen = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("seen"))
    c = nodes.select("id").join(seen, "id", "left").join(expected.select("id", "expected"), "id", "left")
    c = c.select("id", F.when(F.coalesce("expected", F.lit(0)) > 0, F.least(F.lit(1.0), F.greatest(F.lit(floor), F.coalesce("seen", F.lit(0)) / F.col("expected")))).otherwise(1.0).alias("c"))
    mean = c.agg(F.avg("c").alias("mean_c"))
    out = edges.join(c.withColumnsRenamed({"id": "src", "c": "cu"}), "src").join(c.withColumnsRenamed({"id": "dst", "c": "cv"}), "dst").crossJoin(F.broadcast(mean))  # one row
    out = out.withColumn("w", 1 / F.least(F.lit(1.0), F.greatest(F.lit(least), F.col("cu") * F.col("cv") / F.col("mean_c"))))
    if add_reverse and "mutual" in edges.columns:
        out = out.select("src", "dst", "w").unionAll(out.where("mutual").select("dst", "src", "w")).groupBy("src", "dst").agg(F.max("w").alias("w"))
    return out.select("src", "dst", "w")


def blended(a: DataFrame, b: DataFrame, alpha: float) -> DataFrame:
    """(1 - alpha) a + alpha b on weighted edges."""
    if alpha <= 0:
        return a
    if alpha >= 1:
        return b
    return a.withColumn("w", F.col("w") * (1 - alpha)).unionByName(b.withColumn("w", F.col("w") * alpha)).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def reweighted(edges: DataFrame, relevance: DataFrame, floor: float = 0.0) -> DataFrame:
    """w * sqrt(r_src r_dst); ``relevance``: (id, r)."""
    r = relevance.select("id", F.greatest("r", F.lit(floor)).alias("r"))
    out = edges.join(r.withColumnsRenamed({"id": "src", "r": "rs"}), "src").join(r.withColumnsRenamed({"id": "dst", "r": "rd"}), "dst")
    return out.select("src", "dst", (F.col("w") * F.sqrt(F.col("rs") * F.col("rd"))).alias("w"))


def core_and_halo(edges: DataFrame, relevance: DataFrame, least: float) -> DataFrame:
    """id, is_core: nodes of enough relevance and their neighbours."""
    core = relevance.where(F.col("r") >= least).select("id")
    near = both_ways(edges).join(core.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
    return core.withColumn("c", F.lit(1)).unionByName(near.withColumn("c", F.lit(0))).groupBy("id").agg((F.max("c") == 1).alias("is_core"))


# -- walks ------------------------------------------------------------------------------


def pagerank(edges: DataFrame, nodes: DataFrame, personal: DataFrame | None = None, damping: float = 0.85, rounds: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """PageRank (id, x) with restarts at ``personal`` (id, p; uniform if none); nodes without an out-edge give their mass to the restarts.

    Stops when the L1 change is below nodes * tolerance, and raises a RuntimeError if ``rounds``
    don't reach that; ``tolerance`` None runs all rounds."""
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(None).cast("double").alias("x"))
    if personal is None:
        start = nodes.select("id", F.lit(1.0 / n).alias("p"))
    else:
        total = personal.agg(F.sum("p")).first()[0]
        start = nodes.select("id").join(personal.select("id", (F.col("p") / total).alias("p")), "id", "left").select("id", F.coalesce("p", F.lit(0.0)).alias("p"))
    out = edges.groupBy("src").agg(F.sum("w").alias("total"))
    steps = cut(edges.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("share")))
    start = cut(start.join(out.select(F.col("src").alias("id"), F.lit(False).alias("dangling")), "id", "left").select("id", "p", F.coalesce("dangling", F.lit(True)).alias("dangling")))
    x = start.select("id", F.col("p").alias("x"))
    for _ in range(rounds):
        loose = x.join(start, "id").where("dangling").agg(F.coalesce(F.sum("x"), F.lit(0.0))).first()[0]
        flow = x.join(steps, x["id"] == steps["src"]).groupBy("dst").agg(F.sum(F.col("x") * F.col("share")).alias("f"))
        new = start.join(flow, start["id"] == flow["dst"], "left").select("id", (damping * (F.coalesce("f", F.lit(0.0)) + loose * F.col("p")) + (1 - damping) * F.col("p")).alias("x"))
        new = cut(new)
        change = None if tolerance is None else new.join(x.withColumnRenamed("x", "y"), "id").agg(F.sum(F.abs(F.col("x") - F.col("y")))).first()[0]
        x = new
        if change is not None and change < n * tolerance:
            return x
    if tolerance is not None:
        raise RuntimeError(f"no convergence in {rounds} rounds")
    return x


def seeded_walks(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, teleport: float = 0.15, rounds: int = 200, tolerance: float | None = 1e-6) -> DataFrame:
    """Walks against the edges (from the followed to the follower) for all classes at once: (class, id, x).

    ``seeds``: (class, id, w), made to sum to 1 a class. One join and one aggregation a round
    serve every class. Mass at nodes that nobody points at leaks."""
    totals = seeds.groupBy("class").agg(F.sum("w").alias("t")).where("t > 0")
    start = cut(seeds.join(totals, "class").select("class", "id", (F.col("w") / F.col("t")).alias("p")))
    incoming = edges.groupBy("dst").agg(F.sum("w").alias("total"))
    steps = cut(edges.join(incoming, "dst").select(F.col("dst").alias("id"), F.col("src").alias("to"), (F.col("w") / F.col("total")).alias("share")))
    x = start.select("class", "id", F.col("p").alias("x"))
    for _ in range(rounds):
        moved = x.join(steps, "id").select("class", F.col("to").alias("id"), ((1 - teleport) * F.col("x") * F.col("share")).alias("x"))
        new = cut(moved.unionByName(start.select("class", "id", (teleport * F.col("p")).alias("x"))).groupBy("class", "id").agg(F.sum("x").alias("x")))
        if tolerance is not None:
            both = new.join(x.withColumnRenamed("x", "y"), ["class", "id"], "full_outer")
            worst = both.groupBy("class").agg(F.sum(F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0)))).alias("d")).agg(F.max("d")).first()[0]
            x = new
            if worst is None or worst < tolerance:
                break
        x = new
    return x


def lift(walks: DataFrame, everywhere: DataFrame) -> DataFrame:
    """(class, id, lift): a class's visits over everyone's."""
    return walks.join(everywhere.select("id", F.col("x").alias("g")), "id").select("class", "id", (F.col("x") / F.greatest("g", F.lit(1e-12))).alias("lift"))


def boundary(memberships: DataFrame, concentration: DataFrame | None = None) -> DataFrame:
    """Seeds (class, id, w) from (class, id, w) with class balance and a none class.

    Greatest weight of a pair; times the inverse root of the class's total over the largest
    such factor; rows above 1 brought to 1; times the seed's concentration; none is the rest."""
    one = memberships.groupBy("class", "id").agg(F.max("w").alias("w"))
    balance = one.groupBy("class").agg((1 / F.sqrt(F.sum("w"))).alias("f"))
    balance = balance.withColumn("f", F.col("f") / F.max("f").over(Window.partitionBy()))
    rows = one.join(balance, "class").withColumn("w", F.col("w") * F.col("f"))
    rows = rows.withColumn("w", F.col("w") / F.greatest(F.sum("w").over(Window.partitionBy("id")), F.lit(1.0)))
    if concentration is not None:
        rows = rows.join(concentration.select("id", "concentration"), "id", "left").withColumn("w", F.col("w") * F.coalesce("concentration", F.lit(1.0)))
    none = rows.groupBy("id").agg(F.greatest(F.lit(0.0), 1 - F.sum("w")).alias("w")).select(F.lit("none").alias("class"), "id", "w")
    return rows.select("class", "id", "w").unionByName(none)


def classified(lifts: DataFrame, seeds: DataFrame, degree: DataFrame, least_degree: int = 2, least: float = 0.15) -> DataFrame:
    """Row-normalised memberships with the seeds' own restored: (id, class, p, abstain); nodes of low degree are none."""
    p = lifts.withColumn("p", F.col("lift") / F.sum("lift").over(Window.partitionBy("id")))
    own = seeds.select("id").distinct().withColumn("seed", F.lit(True))
    given = seeds.select("id", "class", F.col("w").alias("own"))
    rows = p.join(own, "id", "left").join(given, ["id", "class"], "left").join(degree.select("id", "degree"), "id", "left")
    low = (F.coalesce("degree", F.lit(0)) < least_degree) & F.col("seed").isNull()
    value = F.when(F.col("seed"), F.coalesce("own", F.lit(0.0))).when(low, (F.col("class") == "none").cast("double")).otherwise(F.col("p"))
    rows = rows.withColumn("p", value)
    best = F.max(F.when(F.col("class") != "none", F.col("p"))).over(Window.partitionBy("id"))
    return rows.withColumn("abstain", F.coalesce(best < least, F.lit(True))).select("id", "class", "p", "abstain")


def seed_neighbours(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, class, n): how many neighbours of a node are seeds of a class."""
    return both_ways(edges).join(seeds.select(F.col("id").alias("dst"), "class").distinct(), "dst").groupBy(F.col("src").alias("id"), "class").agg(F.count(F.lit(1)).alias("n"))


def bootstrap_summary(runs: DataFrame) -> DataFrame:
    """Over runs (run, id, class, x): mean, population deviation, central 95 %, stability."""
    out = runs.groupBy("id", "class").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.percentile("x", F.lit(0.025)).alias("low"), F.percentile("x", F.lit(0.975)).alias("high"))
    return out.withColumn("stability", F.when(F.col("mean") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("std") / F.col("mean")))).otherwise(0.0))


def held_out(seeds: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """Seeds to hide, a share of each class (one at least, half at most), by a hash of id and seed."""
    rows = seeds.withColumn("_h", F.xxhash64(F.col("id"), F.lit(seed)))
    order = Window.partitionBy("class").orderBy("_h", "id")
    n = F.count(F.lit(1)).over(Window.partitionBy("class"))
    quota = F.least(F.greatest(F.lit(1), F.floor(n * F.lit(share))), F.floor(n / 2))
    return rows.withColumns({"_r": F.row_number().over(order), "_q": quota}).where("_r <= _q").drop("_h", "_r", "_q")


def harmonic(edges: DataFrame, anchors: DataFrame, nodes: DataFrame, prior: float = 0.5, pull: float = 1e-3, rounds: int = 200, tolerance: float | None = 1e-9) -> DataFrame:
    """Positive membership (id, p) between anchors (id, y in {0, 1}): (L_uu + pull I) p = W_ul y + pull prior, by Jacobi rounds on max(A, A^T).

    The pull makes the rows dominant, so the rounds converge; ``p`` is clipped to [0, 1]."""
    both = edges.where("src <> dst").select("src", "dst", "w").unionAll(edges.where("src <> dst").select("dst", "src", "w")).groupBy("src", "dst").agg(F.max("w").alias("w"))
    both = cut(both)
    degree = both.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("d"))
    fixed = cut(nodes.select("id").join(anchors.select("id", "y"), "id", "left").join(degree, "id", "left").select("id", "y", F.coalesce("d", F.lit(0.0)).alias("d")))
    x = fixed.select("id", F.coalesce(F.col("y").cast("double"), F.lit(float(prior))).alias("p"))
    for _ in range(rounds):
        pulled = both.join(x.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("w") * F.col("p")).alias("s"))
        new = cut(fixed.join(pulled, "id", "left").select("id", F.coalesce(F.col("y").cast("double"), (F.coalesce("s", F.lit(0.0)) + pull * prior) / (F.col("d") + pull)).alias("p")))
        change = None if tolerance is None else new.join(x.withColumnRenamed("p", "q"), "id").agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0]
        x = new
        if change is not None and change < tolerance:
            break
    return x.select("id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "p")).alias("p"))


# -- distances and components -----------------------------------------------------------


def distances(edges: DataFrame, sources: DataFrame, most: int | None = None, directed: bool = False) -> DataFrame:
    """Hops (source, id, distance) from each source, level by level, up to ``most`` or as far as they reach."""
    steps = cut(edges.select("src", "dst").distinct() if directed else both_ways(edges))
    seen = sources.select(F.col("id").alias("source"), "id", F.lit(0).alias("distance"))
    front = seen
    for hop in itertools.count(1) if most is None else range(1, most + 1):
        new = front.join(steps, front["id"] == steps["src"]).select("source", F.col("dst").alias("id")).distinct()
        front = cut(new.join(seen, ["source", "id"], "left_anti").withColumn("distance", F.lit(hop)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int = 2, per_node: int = 100) -> DataFrame:
    """Nodes (id, hop) within ``depth``, following at most ``per_node`` neighbours of a node and direction, those of the least ids."""
    out = edges.select("src", "dst", F.lit("o").alias("way")).unionAll(edges.select("dst", "src", F.lit("i")))
    capped = out.distinct().withColumn("_r", F.row_number().over(Window.partitionBy("src", "way").orderBy("dst"))).where(F.col("_r") <= per_node).select("src", "dst")
    seen = seeds.select("id", F.lit(0).alias("hop"))
    front = seen
    for hop in range(1, depth + 1):
        new = front.join(capped, front["id"] == capped["src"]).select(F.col("dst").alias("id")).distinct()
        front = new.join(seen, "id", "left_anti").withColumn("hop", F.lit(hop))
        seen = cut(seen.unionByName(front))
        front = seen.where(F.col("hop") == hop)
    return seen


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component): the least id reachable, by least neighbours and pointer jumps until nothing moves."""
    pairs = cut(both_ways(edges))
    label = cut(nodes.select("id", F.col("id").alias("component")))
    while True:
        near = pairs.join(label, pairs["dst"] == label["id"]).groupBy(F.col("src").alias("id")).agg(F.min("component").alias("m"))
        hooked = label.join(near, "id", "left").select("id", F.least("component", F.coalesce("m", "component")).alias("component"))
        jump = hooked.select(F.col("id").alias("component"), F.col("component").alias("to"))
        new = cut(hooked.join(jump, "component", "left").select("id", F.least("component", F.coalesce("to", "component")).alias("component")))
        moved = new.join(label.withColumnRenamed("component", "old"), "id").where("component <> old").isEmpty()
        label = new
        if moved:
            return label


# -- centrality and communities ---------------------------------------------------------


def _from_sources(edges: DataFrame, sources: DataFrame, kernel, columns: str) -> DataFrame:
    """``kernel(ids, first, to, sources)`` over blocks of the sources, each beside all edges: ids in order, and by places in it where each node's heads start in ``to``.

    Time is sources times edges, so that bounds a graph long before the memory that its edges take in a task does."""
    steps = cut(edges.where("src <> dst").select("src", "dst").distinct())
    asked = cut(sources.select("id").where("id IS NOT NULL").distinct())
    parts = max(1, min(MOST_PARTS, math.ceil(asked.count() * max(1, steps.count()) / WORK)))
    copies = steps.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    rows = copies.unionByName(asked.select(F.col("id").alias("src"), F.lit(None).cast(steps.schema["dst"].dataType).alias("dst"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("_part")))

    def of(part: pd.DataFrame) -> pd.DataFrame:
        asks = part["dst"].isna().to_numpy()
        src, dst, own = part["src"].to_numpy()[~asks], part["dst"].to_numpy()[~asks].astype(part["src"].dtype), part["src"].to_numpy()[asks]
        ids = np.unique(np.concatenate([src, dst, own]))
        src, dst, own = (np.searchsorted(ids, x) for x in (src, dst, own))
        order = np.lexsort((dst, src))
        return kernel(ids, np.searchsorted(src[order], np.arange(len(ids) + 1)), dst[order], own)

    return rows.repartition(parts, "_part").groupBy("_part").applyInPandas(of, columns)


def _search():
    """Breadth-first search from several sources at once, nodes of the i-th one numbered from i * n on."""

    def levels(first: np.ndarray, to: np.ndarray, sources: np.ndarray):
        """(tails, heads, distinct heads) of the edges into each next level."""
        n = len(first) - 1
        front = np.arange(len(sources)) * n + sources
        known = np.zeros(len(sources) * n, bool)
        known[front] = True
        while len(front):
            node = front % n
            degree = first[node + 1] - first[node]
            tails = np.repeat(front, degree)
            heads = to[np.arange(len(tails)) + np.repeat(first[node] - (degree.cumsum() - degree), degree)] + np.repeat(front - node, degree)
            new = ~known[heads]
            tails, heads = tails[new], heads[new]
            if 8 * len(heads) < len(known):
                front = np.unique(heads)
            else:
                mark = np.zeros(len(known), bool)
                mark[heads] = True
                front = np.flatnonzero(mark)
            known[front] = True
            if len(front):
                yield tails, heads, front

    def added(to: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
        if 8 * len(at) < len(to):
            at, place = np.unique(at, return_inverse=True)
            to[at] += np.bincount(place, values, len(at))
        else:
            to += np.bincount(at, values, len(to))

    return levels, added


def betweenness(edges: DataFrame, nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """Brandes over ``sources`` (all nodes for exact values), level by level: (id, betweenness), directed, not scaled."""
    levels, added = _search()
    held = HELD

    def kernel(ids: np.ndarray, first: np.ndarray, to: np.ndarray, sources: np.ndarray) -> pd.DataFrame:
        n, out = len(ids), np.zeros(len(ids))
        step = max(1, held // (n + len(to) + 1))
        for lo in range(0, len(sources), step):
            own = sources[lo : lo + step]
            start = np.arange(len(own)) * n + own
            paths, delta, passed = np.zeros(len(own) * n), np.zeros(len(own) * n), []
            paths[start] = 1
            for tails, heads, _ in levels(first, to, own):
                added(paths, heads, paths[tails])
                passed.append((tails, heads))
            while passed:
                tails, heads = passed.pop()
                added(delta, tails, paths[tails] / paths[heads] * (1 + delta[heads]))
            delta[start] = 0
            out += delta.reshape(len(own), n).sum(axis=0)
        return pd.DataFrame({"id": ids[out > 0], "b": out[out > 0]})

    kind = nodes.schema["id"].dataType.simpleString()
    got = _from_sources(edges, sources, kernel, f"id {kind}, b double").groupBy("id").agg(F.sum("b").alias("b"))
    return nodes.select("id").join(got, "id", "left").select("id", F.coalesce("b", F.lit(0.0)).alias("betweenness"))


def reach(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """From each source along edges of either direction, as far as they reach: (id, r, t), nodes reached besides it and the sum of their distances."""
    levels, _ = _search()
    held = HELD

    def kernel(ids: np.ndarray, first: np.ndarray, to: np.ndarray, sources: np.ndarray) -> pd.DataFrame:
        n = len(ids)
        r, t = np.zeros(len(sources), np.int64), np.zeros(len(sources), np.int64)
        step = max(1, held // (n + len(to) + 1))
        for lo in range(0, len(sources), step):
            own = sources[lo : lo + step]
            for hop, (_, _, front) in enumerate(levels(first, to, own), 1):
                here = np.bincount(front // n, minlength=len(own))
                r[lo : lo + step] += here
                t[lo : lo + step] += hop * here
        return pd.DataFrame({"id": ids[sources], "r": r, "t": t})

    return _from_sources(both_ways(edges), sources, kernel, f"id {sources.schema['id'].dataType.simpleString()}, r long, t long")


def closeness(reached: DataFrame, n: int) -> DataFrame:
    """From (id, r, t) of ``reach``: reachable / (n - 1) * reachable / total distance, of nodes that reach any."""
    return reached.where("r > 0").select("id", (F.col("r") / F.lit(max(1, n - 1)) * F.col("r") / F.col("t")).alias("closeness"))


def eigenvector(edges: DataFrame, nodes: DataFrame, rounds: int = 50) -> DataFrame:
    """Power rounds of (A^T + I) x, of unit length: (id, x)."""
    x = nodes.select("id", F.lit(1.0).alias("x"))
    for _ in range(rounds):
        got = x.join(edges, x["id"] == edges["src"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("x") * F.col("w")).alias("y"))
        new = x.join(got, "id", "left").select("id", (F.col("x") + F.coalesce("y", F.lit(0.0))).alias("x"))
        norm = new.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
        x = cut(new.crossJoin(F.broadcast(norm)).select("id", (F.col("x") / F.col("n")).alias("x")))  # one row
    return x


def modularity(edges: DataFrame, communities: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Modularity (one row) of (id, community) on undirected weighted edges (a, b, w)."""
    total = edges.agg(F.sum("w").alias("m"))
    degree = edges.select(F.col("a").alias("id"), "w").unionAll(edges.select("b", "w")).groupBy("id").agg(F.sum("w").alias("k"))
    by = degree.join(communities, "id").groupBy("community").agg(F.sum("k").alias("k"))
    c = communities
    inner = edges.join(c.withColumnsRenamed({"id": "a", "community": "ca"}), "a").join(c.withColumnsRenamed({"id": "b", "community": "cb"}), "b").where("ca = cb").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("inner"))
    squares = by.agg(F.sum(F.col("k") * F.col("k")).alias("sq"))
    return inner.crossJoin(total).crossJoin(squares).select((F.col("inner") / F.col("m") - resolution * F.col("sq") / (4 * F.col("m") * F.col("m"))).alias("modularity"))  # single rows


def louvain(edges: DataFrame, rounds: int = 12, resolution: float = 1.0) -> DataFrame:
    """Communities (id, community) of undirected weighted edges (a, b, w): synchronous local moving, only towards smaller labels on odd rounds and larger ones on even, so that two nodes never swap."""
    pairs = cut(edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").unionAll(edges.select("b", "a", "w")))
    degree = cut(pairs.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")))
    m2 = degree.agg(F.sum("k")).first()[0] or 1.0
    label = cut(degree.select("id", F.col("id").alias("community")))
    for i in range(rounds):
        mass = label.join(degree, "id").groupBy("community").agg(F.sum("k").alias("mass"))
        own = label.join(degree, "id").select("id", F.col("community").alias("home"), "k")
        near = pairs.join(label.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"), "community").agg(F.sum("w").alias("to"))
        gain = near.join(mass, "community").join(own, "id").withColumn("gain", F.col("to") - resolution * F.col("k") * (F.col("mass") - F.when(F.col("community") == F.col("home"), F.col("k")).otherwise(0.0)) / m2)
        stay = F.max(F.when(F.col("community") == F.col("home"), F.col("gain"))).over(Window.partitionBy("id"))
        alone = F.coalesce(stay, F.lit(0.0))
        side = (F.col("community") < F.col("home")) if i % 2 == 0 else (F.col("community") > F.col("home"))
        better = gain.withColumn("stay", alone).where(side & (F.col("gain") > F.col("stay") + 1e-9))
        move = better.groupBy("id").agg(F.max_by("community", F.struct("gain", -F.col("community"))).alias("to"))
        new = cut(label.join(move, "id", "left").select("id", F.coalesce("to", "community").alias("community")))
        still = new.join(label.withColumnRenamed("community", "old"), "id").where("community <> old").isEmpty()
        label = new
        if still and i:
            break
    return label


# -- scores of candidates ---------------------------------------------------------------


def neighbour_overlap(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Per node: how many of those that the seeds follow follow it, raw and as a share."""
    followed = edges.join(seeds.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("via")).distinct()
    total = followed.agg(F.count(F.lit(1)).alias("t"))
    hit = edges.join(followed, edges["src"] == followed["via"]).groupBy(F.col("dst").alias("id")).agg(F.countDistinct("via").alias("raw"))
    return hit.crossJoin(F.broadcast(total)).select("id", "raw", F.least(F.lit(1.0), F.col("raw") / F.col("t")).alias("overlap"))  # one row


def percentile_score(scores: DataFrame, value: str = "x") -> DataFrame:
    """Scores over their 95th percentile (the element at int(0.95 n) in order), capped at 1, and the share of smaller ones."""
    n = scores.count()
    ordered = scores.select(value).orderBy(value).offset(min(int(n * 0.95), max(0, n - 1))).limit(1)
    p95 = ordered.select(F.col(value).alias("p95"))
    below = Window.orderBy(value)
    return scores.crossJoin(F.broadcast(p95)).withColumn("score", F.when(F.col("p95") > 0, F.least(F.lit(1.0), F.col(value) / F.col("p95"))).otherwise(0.0)).withColumn("percentile", (F.rank().over(below) - 1) / F.lit(n)).drop("p95")


def min_max(value: str) -> Column:
    """Scaled to [0, 1] over all rows; 0.5 where all are equal."""
    low, high = F.min(value).over(Window.partitionBy()), F.max(value).over(Window.partitionBy())
    return F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(0.5)


def affinity_edges(memberships: DataFrame, k: int = 20) -> DataFrame:
    """Cosine neighbours of sparse memberships (id, class, w), top k each, symmetrised by the greater: (src, dst, w).

    Nodes meet through the classes they share, never all with all."""
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    unit = memberships.where("w > 0").withColumn("u", F.col("w") / norm).select("id", "class", "u")
    dots = unit.withColumnsRenamed({"id": "src", "u": "us"}).join(unit.withColumnsRenamed({"id": "dst", "u": "ud"}), "class").where("src <> dst").groupBy("src", "dst").agg(F.sum(F.col("us") * F.col("ud")).alias("w"))
    top = dots.withColumn("_r", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("w"), "dst"))).where(F.col("_r") <= k)
    return top.select("src", "dst", "w").unionAll(top.select("dst", "src", "w")).groupBy("src", "dst").agg(F.max("w").alias("w"))


def calibrated(relevance: DataFrame, edges: DataFrame, holdout: DataFrame, thresholds: list[float]) -> DataFrame:
    """For each threshold: nodes in core and halo, holdout recall, compactness, their harmonic mean. A node's own threshold of entry (its or a neighbour's greatest relevance) decides, so one pass serves all."""
    near = both_ways(edges).join(relevance.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"), "r")
    entry = relevance.unionByName(near).groupBy("id").agg(F.max("r").alias("r")).join(holdout.select("id", F.lit(1).alias("h")), "id", "left")
    grid = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("tau")
    rows = entry.select("r", "h", grid).groupBy("tau").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("r") >= F.col("tau")).alias("kept"), F.count("h").alias("held"), F.count_if((F.col("r") >= F.col("tau")) & F.col("h").isNotNull()).alias("found"))
    rows = rows.withColumns({"recall": F.when(F.col("held") > 0, F.col("found") / F.col("held")).otherwise(0.0), "compactness": 1 - F.col("kept") / F.col("n")})
    both = F.col("recall") + F.col("compactness")
    return rows.withColumn("balance", F.when(both > 0, 2 * F.col("recall") * F.col("compactness") / both).otherwise(0.0)).select("tau", "kept", "recall", "compactness", "balance")
