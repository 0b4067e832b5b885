"""Plans of graph operators: walks, harmonic labels, distances, components, centrality, scores of candidates.

Oracles of iterative plans are the rounds written out as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import graph as G
from .bindings import nations, oracle, purchases, table, trade, typed
from .registry import query

ROUNDS = 6
WEIGHTS = {"signup": 1.0, "click": 0.5, "view": 0.3, "purchase": 0.6, "error": 0.0}


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nations(spark, sf_dir).where("id < 12").select(F.concat(F.lit("r"), F.col("region").cast("string")).alias("class"), "id", F.lit(1.0).alias("w"))


_SEEDS = "SELECT 'r' || CAST(region AS VARCHAR) AS class, id, 1.0::DOUBLE AS w FROM nations WHERE id < 12"


def _walk_views(rounds: int) -> dict[str, str]:
    views = {
        "seeds": _SEEDS,
        "start": "SELECT class, id, w / sum(w) OVER (PARTITION BY class) AS p FROM seeds",
        "steps": "SELECT dst AS id, src AS nxt, w / sum(w) OVER (PARTITION BY dst) AS share FROM trade",
        "x0": "SELECT class, id, p AS x FROM start",
    }
    for i in range(rounds):
        views[f"x{i + 1}"] = f"SELECT class, id, sum(x) AS x FROM (SELECT class, nxt AS id, 0.85 * x * share AS x FROM x{i} JOIN steps USING (id) UNION ALL SELECT class, id, 0.15 * p FROM start) GROUP BY 1, 2"
    return views


def _rank_views(rounds: int) -> dict[str, str]:
    views = {"share": "SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS s FROM trade", "g0": "SELECT id, 1.0 / 25 AS x FROM nations"}
    for i in range(rounds):
        views[f"g{i + 1}"] = f"SELECT n.id, 0.85 * coalesce(f.f, 0) + 0.15 / 25 AS x FROM nations n LEFT JOIN (SELECT dst AS id, sum(x * s) AS f FROM g{i} JOIN share ON src = id GROUP BY 1) f USING (id)"
    return views


@query(oracle(f"SELECT id, round(x, 8) AS x FROM g{ROUNDS}", "trade", "nations", more=_rank_views(ROUNDS)))
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.pagerank(trade(spark, sf_dir), nations(spark, sf_dir), rounds=ROUNDS, tolerance=None).select("id", F.round("x", 8).alias("x"))


@query(oracle(f"SELECT class, id, round(x, 8) AS x FROM x{ROUNDS}", "trade", "nations", more=_walk_views(ROUNDS)))
def seeded_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.seeded_walks(trade(spark, sf_dir), nations(spark, sf_dir), _seeds(spark, sf_dir), rounds=ROUNDS, tolerance=None).select("class", "id", F.round("x", 8).alias("x"))


@query(oracle(f"SELECT class, x.id, round(x.x / greatest(g.x, 1e-12), 6) AS lift FROM x{ROUNDS} x JOIN g{ROUNDS} g USING (id)", "trade", "nations", more=_walk_views(ROUNDS) | _rank_views(ROUNDS)))
def lift_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks of each class over the walk of all."""
    edges, n = trade(spark, sf_dir), nations(spark, sf_dir)
    walks = G.seeded_walks(edges, n, _seeds(spark, sf_dir), rounds=ROUNDS, tolerance=None)
    return G.lift(walks, G.pagerank(edges, n, rounds=ROUNDS, tolerance=None)).select("class", "id", F.round("lift", 6).alias("lift"))


_MEMBERS = "SELECT c_mktsegment AS class, c_nationkey AS id, sum(c_acctbal) / 100000 AS w FROM customer WHERE c_acctbal > 0 AND c_nationkey < 15 GROUP BY 1, 2"
_BOUNDARY = {
    "m": _MEMBERS,
    "b": "SELECT class, 1 / sqrt(sum(w)) AS f FROM m GROUP BY 1",
    "r1": "SELECT m.class, id, w * f / (SELECT max(f) FROM b) AS w FROM m JOIN b USING (class)",
    "r2": "SELECT class, id, w / greatest(sum(w) OVER (PARTITION BY id), 1.0) AS w FROM r1",
    "bound": "SELECT class, id, w FROM r2 UNION ALL SELECT 'none', id, greatest(0.0, 1 - sum(w)) FROM r2 GROUP BY id",
}


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").where("c_acctbal > 0 AND c_nationkey < 15")
    return rows.groupBy(F.col("c_mktsegment").alias("class"), F.col("c_nationkey").alias("id")).agg((F.sum("c_acctbal") / 100000).alias("w"))


def _with_degree(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """``rows`` with ``deg``, the nation's partners that sell to it."""
    degree = trade(spark, sf_dir).groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("deg"))
    return rows.join(degree, "id", "left").withColumn("deg", F.coalesce("deg", F.lit(0)))


@query(oracle("SELECT class, id, round(w, 6) AS w FROM bound", more=_BOUNDARY))
def seed_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.boundary(_members(spark, sf_dir)).select("class", "id", F.round("w", 6).alias("w"))


@query(
    oracle(
        """SELECT id, round(top, 6) AS top, CASE WHEN id < 3 THEN 'exemplar' WHEN none >= 0.95 THEN 'unknown' WHEN top >= 0.30 AND entropy < 0.70 THEN 'specialist' WHEN several >= 2 AND none < 0.40 THEN 'bridge' WHEN top >= 0.08 THEN 'frontier' ELSE 'unknown' END AS band
 FROM (SELECT id, max(w) FILTER (class <> 'none') AS top, max(w) FILTER (class = 'none') AS none, count(*) FILTER (class <> 'none' AND w >= 0.15) AS several, -sum(CASE WHEN class <> 'none' AND w > 1e-10 THEN w * ln(w) ELSE 0 END) / ln(5) AS entropy FROM bound GROUP BY 1)""",
        more=_BOUNDARY,
    )
)
def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of five classes; the first three nations are labelled, those of hardly any class abstain."""
    rows = G.boundary(_members(spark, sf_dir))
    real = F.col("class") != "none"
    got = rows.groupBy("id").agg(F.max(F.when(~real, F.col("w"))).alias("none"), F.collect_list(F.when(real, F.col("w"))).alias("ws"))
    band = S.band(F.col("ws"), F.col("none"), 5, F.col("id") < 3, F.col("none") >= 0.95)
    return got.select("id", F.round(F.array_max("ws"), 6).alias("top"), band.alias("band"))


@query(oracle("SELECT src, dst, round(sum(n * CAST(CASE type WHEN 'signup' THEN 1.0 WHEN 'click' THEN 0.5 WHEN 'view' THEN 0.3 WHEN 'purchase' THEN 0.6 END AS DOUBLE)), 6) AS w FROM typed WHERE type <> 'error' GROUP BY 1, 2", "typed"))
def typed_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.combined(typed(spark, sf_dir).withColumnRenamed("n", "w"), WEIGHTS).select("src", "dst", F.round("w", 6).alias("w"))


@query(oracle("SELECT src, dst, type, least(n / CASE type WHEN 'click' THEN 5.0 WHEN 'view' THEN 50.0 WHEN 'purchase' THEN 10.0 ELSE 1.0 END, 1.0)::DOUBLE AS w FROM typed WHERE type <> 'error'", "typed"))
def typed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each type up to its cap."""
    cap = F.when(F.col("type") == "click", 5.0).when(F.col("type") == "view", 50.0).when(F.col("type") == "purchase", 10.0).otherwise(1.0)
    return typed(spark, sf_dir).where("type <> 'error'").select("src", "dst", "type", F.least(F.col("n") / cap, F.lit(1.0)).alias("w"))


@query(
    oracle(
        "SELECT src AS id, region AS class, count(*) AS n FROM (SELECT src, dst FROM trade WHERE src <> dst UNION SELECT dst, src FROM trade WHERE src <> dst) JOIN nations s ON dst = s.id WHERE s.id < 12 GROUP BY 1, 2",
        "trade",
        "nations",
    )
)
def seed_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.seed_neighbours(trade(spark, sf_dir), nations(spark, sf_dir).where("id < 12").select("id", F.col("region").alias("class")))


_HARMONIC = {
    "h": "SELECT src, dst, max(w) AS w FROM (SELECT src, dst, w FROM trade WHERE src <> dst UNION ALL SELECT dst, src, w FROM trade WHERE src <> dst) GROUP BY 1, 2",
    "d": "SELECT src AS id, sum(w) AS d FROM h GROUP BY 1",
    "a": "SELECT id, CASE WHEN id < 4 THEN 1.0 WHEN id >= 21 THEN 0.0 END AS y FROM nations",
    "p0": "SELECT id, coalesce(y, 0.5) AS p FROM a",
}
for _i in range(ROUNDS):
    _HARMONIC[f"p{_i + 1}"] = f"SELECT a.id, coalesce(y, (coalesce(s, 0) + 0.0005) / (coalesce(d, 0) + 0.001)) AS p FROM a LEFT JOIN d USING (id) LEFT JOIN (SELECT src AS id, sum(w * p) AS s FROM h JOIN p{_i} ON id = dst GROUP BY 1) q USING (id)"


@query(oracle(f"SELECT id, round(least(1.0, greatest(0.0, p)), 6) AS p FROM p{ROUNDS}", "trade", "nations", more=_HARMONIC))
def harmonic_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nations(spark, sf_dir)
    anchors = n.where("id < 4 OR id >= 21").select("id", (F.col("id") < 4).cast("double").alias("y"))
    return G.harmonic(trade(spark, sf_dir), anchors, n, rounds=ROUNDS, tolerance=None).select("id", F.round("p", 6).alias("p"))


_EDGES = {
    "edges": "SELECT src, dst, n FROM purchases",
    "bothways": "SELECT src, dst FROM edges UNION SELECT dst, src FROM edges",
    "users": "SELECT DISTINCT user_id AS id FROM events",
}


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id")).distinct()


def _bfs(most: int) -> dict[str, str]:
    views = {"b0": "SELECT id AS source, id, 0 AS distance FROM users WHERE id % 40 = 1"}
    for i in range(1, most + 1):
        views[f"b{i}"] = f"SELECT * FROM b{i - 1} UNION ALL SELECT DISTINCT source, dst, {i} FROM b{i - 1} JOIN bothways ON id = src WHERE distance = {i - 1} AND NOT EXISTS (SELECT 1 FROM b{i - 1} x WHERE x.source = b{i - 1}.source AND x.id = dst)"
    return views


@query(oracle("SELECT source, id, CAST(distance AS INTEGER) AS distance FROM b3", "purchases", more=_EDGES | _bfs(3)))
def hop_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.distances(purchases(spark, sf_dir), _users(spark, sf_dir).where("id % 40 = 1"), 3)


@query(
    oracle(
        """SELECT id, min(hop) AS hop FROM (SELECT id, 0 AS hop FROM users WHERE id % 40 = 1
 UNION ALL SELECT c.dst, 1 FROM users JOIN c ON c.src = id WHERE id % 40 = 1
 UNION ALL SELECT e.dst, 2 FROM users JOIN c ON c.src = id JOIN c e ON e.src = c.dst WHERE id % 40 = 1) GROUP BY 1""",
        "purchases",
        more=_EDGES | {"c": "SELECT DISTINCT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src, way ORDER BY dst) AS r FROM (SELECT src, dst, 'o' AS way FROM edges UNION SELECT dst, src, 'i' FROM edges)) WHERE r <= 5"},
    )
)
def khop_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hops, five neighbours a node and direction."""
    return G.neighbourhood(purchases(spark, sf_dir), _users(spark, sf_dir).where("id % 40 = 1"), 2, 5)


@query(
    oracle(
        """SELECT id, component FROM (WITH RECURSIVE r(id, component) AS (SELECT id, id FROM users UNION SELECT e.dst, r.component FROM r JOIN e ON r.id = e.src)
 SELECT id, min(component) AS component FROM r GROUP BY 1)""",
        "purchases",
        more={"users": _EDGES["users"], "e": "SELECT a.src, a.dst FROM purchases a JOIN purchases b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst"},
    )
)
def mutual_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = G.mutual(purchases(spark, sf_dir))
    return G.components(edges, _users(spark, sf_dir))


@query(
    oracle(
        """SELECT src, dst, round(1 / least(1.0, greatest(0.05, x.c * y.c / (SELECT avg(c) FROM k))), 6) AS w FROM edges JOIN k x ON x.id = src JOIN k y ON y.id = dst""",
        "purchases",
        more=_EDGES | {"k": "SELECT users.id, CASE WHEN users.id % 6 > 0 THEN least(1.0, greatest(0.05, coalesce(s.n, 0) / (users.id % 6 * 2))) ELSE 1.0 END AS c FROM users LEFT JOIN (SELECT src AS id, count(*) AS n FROM edges GROUP BY 1) s USING (id)"},
    )
)
def observation_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = _users(spark, sf_dir)
    expected = users.select("id", (F.col("id") % 6 * 2).alias("expected"))
    return G.inverse_probability(purchases(spark, sf_dir).select("src", "dst"), expected, users, add_reverse=False).select("src", "dst", F.round("w", 6).alias("w"))


@query(oracle("SELECT id, max(c) = 1 AS is_core FROM (SELECT id, 1 AS c FROM users WHERE id % 10 / 10.0 >= 0.85 UNION ALL SELECT src, 0 FROM bothways JOIN users ON dst = id WHERE id % 10 / 10.0 >= 0.85) GROUP BY 1", "purchases", more=_EDGES))
def core_halo(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _users(spark, sf_dir).select("id", (F.col("id") % 10 / 10).alias("r"))
    return G.core_and_halo(purchases(spark, sf_dir), r, 0.85)


@query(oracle("SELECT src, dst, round(n * sqrt(greatest(src % 10 / 10.0, 0.01) * greatest(dst % 10 / 10.0, 0.01)), 6) AS w FROM edges", "purchases", more=_EDGES))
def reweighted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _users(spark, sf_dir).select("id", (F.col("id") % 10 / 10).alias("r"))
    return G.reweighted(purchases(spark, sf_dir).withColumnRenamed("n", "w"), r, 0.01).select("src", "dst", F.round("w", 6).alias("w"))


@query(
    oracle(
        """SELECT tau, sum(CASE WHEN r >= tau THEN 1 ELSE 0 END)::BIGINT AS kept, round(sum(CASE WHEN r >= tau AND id % 7 = 0 THEN 1 ELSE 0 END) / sum(CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END), 6) AS recall,
 round(1 - sum(CASE WHEN r >= tau THEN 1 ELSE 0 END) / count(*), 6) AS compactness FROM entry, (SELECT unnest([0.25, 0.5, 0.75, 0.95])::DOUBLE AS tau) GROUP BY 1""",
        "purchases",
        more=_EDGES | {"entry": "SELECT id, max(r) AS r FROM (SELECT id, id % 10 / 10.0 AS r FROM users UNION ALL SELECT src, dst % 10 / 10.0 FROM bothways) GROUP BY 1"},
    )
)
def threshold_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = _users(spark, sf_dir)
    got = G.calibrated(users.select("id", (F.col("id") % 10 / 10).alias("r")), purchases(spark, sf_dir), users.where("id % 7 = 0"), [0.25, 0.5, 0.75, 0.95])
    return got.select("tau", "kept", F.round("recall", 6).alias("recall"), F.round("compactness", 6).alias("compactness"))


@query(
    oracle(
        "SELECT dst AS id, count(DISTINCT src) AS raw, round(least(1.0, count(DISTINCT src) / (SELECT count(*) FROM v)), 6) AS overlap FROM edges JOIN v ON src = via GROUP BY 1",
        "purchases",
        more=_EDGES | {"v": "SELECT DISTINCT dst AS via FROM edges WHERE src % 40 = 1"},
    )
)
def neighbour_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.neighbour_overlap(purchases(spark, sf_dir), _users(spark, sf_dir).where("id % 40 = 1")).select("id", "raw", F.round("overlap", 6).alias("overlap"))


@query(
    oracle(
        """SELECT id, round(0.4 * coalesce(o, 0) + 0.3 * least(1.0, d.n / 20.0) + 0.3 * CASE WHEN distance BETWEEN 1 AND 3 THEN 1 - (distance - 1) * 0.45 ELSE 0 END, 4) AS score
FROM (SELECT dst AS id, count(*) AS n FROM edges GROUP BY 1) d LEFT JOIN (SELECT dst AS id, least(1.0, count(DISTINCT src) / (SELECT count(*) FROM v)) AS o FROM edges JOIN v ON src = via GROUP BY 1) USING (id)
LEFT JOIN (SELECT id, min(distance) AS distance FROM b3 GROUP BY 1) USING (id) WHERE id % 40 <> 1 ORDER BY score DESC, id LIMIT 30""",
        "purchases",
        more=_EDGES | {"v": "SELECT DISTINCT dst AS via FROM edges WHERE src % 40 = 1"} | _bfs(3),
    )
)
def discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates near the seeds by overlap, followers and path, best first."""
    edges, seeds = purchases(spark, sf_dir), _users(spark, sf_dir).where("id % 40 = 1")
    far = G.distances(edges, seeds, 3).groupBy("id").agg(F.min("distance").alias("distance"))
    known = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    rows = known.join(G.neighbour_overlap(edges, seeds), "id", "left").join(far, "id", "left").where("id % 40 <> 1")
    path = F.when(F.col("distance") >= 1, S.path_score(F.col("distance"))).otherwise(0.0)
    score = 0.4 * F.coalesce("overlap", F.lit(0.0)) + 0.3 * F.least(F.lit(1.0), F.col("n") / 20) + 0.3 * path
    return rows.select("id", F.round(score, 4).alias("score")).orderBy(F.desc("score"), "id").limit(30)


@query()
def betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From all sources; a test holds it against a plain count of shortest paths."""
    users = _users(spark, sf_dir)
    return G.betweenness(purchases(spark, sf_dir), users, users)


_LEVELS = 9
_REACH = {"r0": "SELECT id AS source, id, 0 AS distance FROM users"} | {f"r{i}": f"SELECT * FROM r{i - 1} UNION ALL SELECT DISTINCT source, dst, {i} FROM r{i - 1} JOIN bothways ON id = src WHERE distance = {i - 1} AND NOT EXISTS (SELECT 1 FROM r{i - 1} x WHERE x.source = r{i - 1}.source AND x.id = dst)" for i in range(1, _LEVELS)}


@query(
    oracle(
        f"SELECT source AS id, round(count(*) / ((SELECT count(*) FROM users) - 1) * count(*) / sum(distance), 6) AS closeness FROM r{_LEVELS - 1} WHERE distance > 0 GROUP BY 1",
        "purchases",
        more=_EDGES | _REACH,
    )
)
def closeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all nodes, as far as paths reach; the SQL counts levels up to the diameter that the tables have."""
    users = _users(spark, sf_dir)
    return G.closeness(G.reach(purchases(spark, sf_dir), users), users.count()).select("id", F.round("closeness", 6).alias("closeness"))


_EIGEN = {"e0": "SELECT id, 1.0::DOUBLE AS x FROM nations"}
for _i in range(4):
    _EIGEN[f"y{_i}"] = f"SELECT e.id, e.x + coalesce(s, 0) AS x FROM e{_i} e LEFT JOIN (SELECT dst AS id, sum(x * w) AS s FROM e{_i} JOIN trade ON src = id GROUP BY 1) USING (id)"
    _EIGEN[f"e{_i + 1}"] = f"SELECT id, x / (SELECT sqrt(sum(x * x)) FROM y{_i}) AS x FROM y{_i}"


@query(oracle("SELECT id, round(x, 6) AS x FROM e4", "trade", "nations", more=_EIGEN))
def eigenvector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.eigenvector(trade(spark, sf_dir), nations(spark, sf_dir), 4).select("id", F.round("x", 6).alias("x"))


@query()
def louvain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities by local moving; a test compares modularity, since labels are not unique."""
    edges = purchases(spark, sf_dir).groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("n").cast("double").alias("w"))
    return G.louvain(edges)


@query(
    oracle(
        """SELECT round((SELECT sum(w) FROM u WHERE a % 5 = b % 5) / sum(w) - (SELECT sum(k * k) FROM (SELECT id % 5 AS c, sum(w) AS k FROM (SELECT a AS id, w FROM u UNION ALL SELECT b, w FROM u) GROUP BY 1)) / (4 * sum(w) * sum(w)), 8) AS modularity FROM u""",
        "purchases",
        more=_EDGES | {"u": "SELECT least(src, dst) AS a, greatest(src, dst) AS b, CAST(sum(n) AS DOUBLE) AS w FROM edges GROUP BY 1, 2"},
    )
)
def modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = purchases(spark, sf_dir).groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("n").cast("double").alias("w"))
    return G.modularity(edges, _users(spark, sf_dir).select("id", (F.col("id") % 5).alias("community"))).select(F.round("modularity", 8).alias("modularity"))


@query(
    oracle(
        """SELECT src, dst, round(max(w), 6) AS w FROM (SELECT src, dst, w FROM t UNION ALL SELECT dst, src, w FROM t) GROUP BY 1, 2""",
        more={
            "m": "SELECT c_nationkey AS id, c_mktsegment AS class, count(*)::DOUBLE AS w FROM customer GROUP BY 1, 2",
            "u": "SELECT id, class, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS u FROM m",
            "c": "SELECT x.id AS src, y.id AS dst, round(sum(x.u * y.u), 9) AS w FROM u x JOIN u y USING (class) WHERE x.id <> y.id GROUP BY 1, 2",
            "t": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS r FROM c) WHERE r <= 5",
        },
    )
)
def semantic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine neighbours of membership vectors, symmetrised."""
    m = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("id"), F.col("c_mktsegment").alias("class")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    return G.affinity_edges(m, 5).select("src", "dst", F.round("w", 6).alias("w"))


@query(oracle("SELECT src, dst, round(sum(w), 6) AS w FROM (SELECT src, dst, 0.7::DOUBLE * n AS w FROM typed WHERE type = 'view' UNION ALL SELECT src, dst, 0.3::DOUBLE * n FROM typed WHERE type = 'click') GROUP BY 1, 2", "typed"))
def blended_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = typed(spark, sf_dir)
    part = lambda name: t.where(F.col("type") == name).select("src", "dst", F.col("n").cast("double").alias("w"))
    return G.blended(part("view"), part("click"), 0.3).select("src", "dst", F.round("w", 6).alias("w"))


@query(
    oracle(
        """SELECT id, class, round(avg(x) + 1e-9, 3) AS mean, round(stddev_pop(x) + 1e-9, 3) AS std, round(quantile_cont(x, 0.025) + 1e-9, 3) AS low, round(quantile_cont(x, 0.975) + 1e-9, 3) AS high FROM
 (SELECT user_id AS id, event_type AS class, day(ts) % 6 AS run, avg(value) AS x FROM events GROUP BY 1, 2, 3) GROUP BY 1, 2"""
    )
)
def bootstrap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id"), F.col("event_type").alias("class"), (F.dayofmonth("ts") % 6).alias("run")).agg(F.avg("value").alias("x"))
    r = lambda c: F.round(F.col(c) + 1e-9, 3).alias(c)
    return G.bootstrap_summary(runs).select("id", "class", r("mean"), r("std"), r("low"), r("high"))


@query(
    oracle(
        """SELECT id, round((1 - none) * (1 - entropy) * top * least(1.0, ln(1 + deg) / ln(1 + (SELECT median(deg) FROM n))), 6) AS relevance FROM n""",
        "trade",
        more=_BOUNDARY | {"n": "SELECT id, max(w) FILTER (class = 'none') AS none, max(w) FILTER (class <> 'none') AS top, -sum(CASE WHEN w > 0 THEN w * ln(w) ELSE 0 END) / ln(6) AS entropy, max(coalesce(k, 0)) AS deg FROM bound LEFT JOIN (SELECT dst AS id, count(*) AS k FROM trade GROUP BY 1) USING (id) GROUP BY 1"},
    )
)
def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = G.boundary(_members(spark, sf_dir))
    real = F.col("class") != "none"
    got = rows.groupBy("id").agg(F.max(F.when(real, F.col("w"))).alias("top"), F.max(F.when(~real, F.col("w"))).alias("none"), F.collect_list("w").alias("ws"))
    got = _with_degree(spark, sf_dir, got)
    middle = got.agg(F.percentile("deg", F.lit(0.5)).alias("median"))
    value = S.relevance(F.col("none"), S.entropy(F.col("ws"), normalise=False, by=F.lit(6)), F.col("top"), F.col("deg"), F.col("median"))
    return got.crossJoin(F.broadcast(middle)).select("id", F.round(value, 6).alias("relevance"))  # one row


@query(
    oracle(
        "SELECT id, round(entropy * sqrt(greatest(deg, 1)) * (1 - none), 6) AS info_value FROM n ORDER BY info_value DESC, id LIMIT 10",
        "trade",
        more=_BOUNDARY | {"n": "SELECT id, max(w) FILTER (class = 'none') AS none, -sum(CASE WHEN w > 0 THEN w * ln(w) ELSE 0 END) / ln(6) AS entropy, max(coalesce(k, 0)) AS deg FROM bound LEFT JOIN (SELECT dst AS id, count(*) AS k FROM trade GROUP BY 1) USING (id) GROUP BY 1"},
    )
)
def frontier_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where one more label tells most; the uncertainty is the entropy of the memberships."""
    rows = G.boundary(_members(spark, sf_dir))
    got = rows.groupBy("id").agg(F.max(F.when(F.col("class") == "none", F.col("w"))).alias("none"), F.collect_list("w").alias("ws"))
    got = _with_degree(spark, sf_dir, got)
    value = S.info_value(S.entropy(F.col("ws"), normalise=False, by=F.lit(6)), F.col("deg"), F.col("none"))
    return got.select("id", F.round(value, 6).alias("info_value")).orderBy(F.desc("info_value"), "id").limit(10)


@query(
    oracle(
        "SELECT id, round(0.4 * (a - (SELECT min(a) FROM s)) / ((SELECT max(a) FROM s) - (SELECT min(a) FROM s)) + 0.6 * (b - (SELECT min(b) FROM s)) / ((SELECT max(b) FROM s) - (SELECT min(b) FROM s)), 6) AS composite FROM s",
        "purchases",
        more={"s": "SELECT dst AS id, count(*) AS a, sum(n) / greatest(count(*), 1) AS b FROM purchases GROUP BY 1"},
    )
)
def composite_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Min-max scaled parts, weighted."""
    s = purchases(spark, sf_dir).groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("a"), (F.sum("n") / F.count(F.lit(1))).alias("b"))
    return s.select("id", F.round(0.4 * G.min_max("a") + 0.6 * G.min_max("b"), 6).alias("composite"))


@query()
def held_out_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stratified holdout by hash: a fifth of each class."""
    seeds = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("class"))
    return G.held_out(seeds, 0.2).select("id", "class")
