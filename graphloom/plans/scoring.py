"""Plans of scalar scores, evaluation, curation, learning and cluster views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import clusters as C
from ..operators import evaluation as E
from ..operators import learning as L
from ..operators import relational as R
from ..streaming import feed
from .bindings import nations, oracle, table, trade, typed
from .registry import query


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a score from their length, in steps of a hundredth."""
    p = F.least(F.lit(1.0), F.round(F.col("n_chars") / 4000, 2))
    return table(spark, sf_dir, "documents").select("doc_id", "source", p.alias("p")).join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id")


_SCORED = {"s": "SELECT doc_id, source, least(1.0, round(n_chars / 4000, 2)) AS p, quality AS y FROM documents JOIN labels USING (doc_id)"}
_STEPS = _SCORED | {
    "g": "SELECT p, sum(y) AS pos, count(*) AS n FROM s GROUP BY 1",
    "t": "SELECT p, pos, n, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS k, (SELECT sum(y) FROM s) AS np, (SELECT count(*) FROM s) AS nr FROM g",
}


@query(oracle("SELECT round(avg((p - y) * (p - y)), 8) AS brier, count(*) AS n FROM s", more=_SCORED))
def brier_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.brier(_scored(spark, sf_dir), "p", "y").select(F.round("brier", 8).alias("brier"), "n")


@query(oracle("SELECT round(sum(n * abs(c - a)) / sum(n), 8) AS ece FROM (SELECT least(floor(p * 10), 9) AS b, count(*) AS n, avg(p) AS c, avg(y) AS a FROM s GROUP BY 1)", more=_SCORED))
def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.calibration_error(_scored(spark, sf_dir), "p", "y").select(F.round("ece", 8).alias("ece"))


@query(oracle("SELECT p AS score, round(tp / k, 6) AS precision, round(tp / np, 6) AS recall, round(2 * tp / (k + np), 6) AS f1 FROM t", more=_STEPS))
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lambda c: F.round(c, 6).alias(c)
    return E.thresholds(_scored(spark, sf_dir), "p", "y").select("score", r("precision"), r("recall"), r("f1"))


@query(oracle("SELECT p AS score, round(2 * tp / (k + np), 6) AS f1 FROM t ORDER BY 2 * tp / (k + np) DESC, abs(p - 0.5), p LIMIT 1", more=_STEPS))
def tuned_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.best_threshold(_scored(spark, sf_dir), "p", "y").select("score", F.round("f1", 6).alias("f1"))


@query(oracle("SELECT round(sum(pos * tp / k) / max(np), 6) AS average_precision FROM t", more=_STEPS))
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.average_precision(_scored(spark, sf_dir), "p", "y").select(F.round("average_precision", 6).alias("average_precision"))


@query(oracle("SELECT round(sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END) / count(*), 6) AS auc FROM s a JOIN s b ON a.y = 1 AND b.y = 0", more=_SCORED))
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.roc_auc(_scored(spark, sf_dir), "p", "y").select(F.round("auc", 6).alias("auc"))


@query(oracle("SELECT d.source, count(*) AS members, count(*) FILTER (s.p > 0.3) AS found, count(*) FILTER (s.p <= 0.3) AS missed, count(*) FILTER (s.p IS NULL) AS unscored, round(count(*) FILTER (s.p > 0.3) / count(*), 6) AS recall FROM documents d LEFT JOIN s USING (doc_id) GROUP BY 1", more=_SCORED))
def holdout_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "documents").select("doc_id", "source")
    return E.group_recall(members, _scored(spark, sf_dir).withColumnRenamed("p", "score"), "doc_id", "source", 0.3).withColumn("recall", F.round("recall", 6))


@query(
    """WITH c AS (SELECT p_brand AS a, p_type AS b, count(*) AS n FROM part GROUP BY 1, 2), s AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS t FROM c),
 x AS (SELECT sum(n * (n - 1) / 2) AS sa FROM (SELECT sum(n) AS n FROM c GROUP BY a)), y AS (SELECT sum(n * (n - 1) / 2) AS sb FROM (SELECT sum(n) AS n FROM c GROUP BY b))
SELECT round((s - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)), 8) AS ari FROM s, x, y"""
)
def adjusted_rand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.adjusted_rand(table(spark, sf_dir, "part"), "p_brand", "p_type").select(F.round("ari", 8).alias("ari"))


@query("SELECT round(2 * sum(r * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*), 6) AS gini FROM (SELECT o_totalprice AS x, row_number() OVER (ORDER BY o_totalprice) AS r FROM orders)")
def gini_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.gini(table(spark, sf_dir, "orders"), "o_totalprice").select(F.round("gini", 6).alias("gini"))


@query(
    """SELECT source, round(-sum(n / t * log2(n / t)), 6) AS bits, round(-sum(n / t * ln(n / t)) / ln(4), 6) AS normalised, round(max(n / t), 6) AS concentration
FROM (SELECT source, lang, count(*) AS n, sum(count(*)) OVER (PARTITION BY source) AS t FROM documents GROUP BY 1, 2) GROUP BY 1"""
)
def entropies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of an account's tags in bits and by the number of classes."""
    n = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).cast("double").alias("n"))
    got = n.groupBy("source").agg(F.collect_list("n").alias("w"), (F.max("n") / F.sum("n")).alias("top"))
    return got.select("source", F.round(S.entropy(F.col("w"), 2.0), 6).alias("bits"), F.round(S.entropy(F.col("w"), by=F.lit(4)), 6).alias("normalised"), F.round("top", 6).alias("concentration"))


@query("SELECT doc_id, CASE WHEN h < 70 THEN 'train' WHEN h < 85 THEN 'dev' ELSE 'test' END AS split FROM (SELECT doc_id, CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 AS h FROM documents)")
def split_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", S.split_of(F.col("doc_id")).alias("split"))


@query(
    """SELECT post, n, CAST(CASE WHEN n >= 3 THEN trunc(m) WHEN n = 2 THEN l WHEN l <> 0 THEN 1 ELSE 0 END AS BIGINT) AS consensus FROM
 (SELECT l_orderkey AS post, count(*) AS n, median(v) AS m, min(v) AS l FROM (SELECT l_orderkey, CAST(l_quantity AS INTEGER) % 7 - 3 AS v FROM lineitem) GROUP BY 1)"""
)
def label_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("post"), (F.col("l_quantity").cast("int") % 7 - 3).alias("v"))
    return E.consensus(votes, "post", "v")


@query("SELECT user_id, round(sum(exp(-ln(2) * date_diff('day', CAST(ts AS DATE), DATE '2024-02-01') / 14.0)), 6) AS weight FROM events GROUP BY 1")
def decayed_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that halve every fortnight."""
    age = F.datediff(F.lit("2024-02-01").cast("date"), F.col("ts"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.sum(S.decay(age, 14)), 6).alias("weight"))


@query("SELECT doc_id, round(0.5 * (abs(q - 0.8) + abs(1 - q - 0.2)), 6) AS tv, round(CASE WHEN q IN (0, 1) THEN 0 ELSE -(q * log2(q) + (1 - q) * log2(1 - q)) END, 6) AS uncertainty FROM (SELECT doc_id, (n_chars % 11) / 10.0::DOUBLE AS q FROM documents)")
def disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total variation between two predictions, and the first one's binary entropy."""
    q = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 11 / 10).alias("q"))
    return q.select("doc_id", F.round(S.total_variation(F.array("q", 1 - F.col("q")), F.array(F.lit(0.8), F.lit(0.2))), 6).alias("tv"), F.round(S.binary_entropy(F.col("q")), 6).alias("uncertainty"))


@query("SELECT p_partkey, CASE WHEN p_size > 40 THEN '1.5K' WHEN p_size > 20 THEN '2M' ELSE '1,234' END AS shown, CAST(CASE WHEN p_size > 40 THEN 1500 WHEN p_size > 20 THEN 2000000 ELSE 1234 END AS BIGINT) AS n, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def parsed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.when(F.col("p_size") > 40, "1.5K").when(F.col("p_size") > 20, "2M").otherwise("1,234")
    return table(spark, sf_dir, "part").select("p_partkey", shown.alias("shown"), S.compact_count(shown).alias("n"), S.slug(F.col("p_name")).alias("slug"))


@query("SELECT c_custkey, round(least(1.0, sqrt(n / 50.0)), 6) AS discount FROM (SELECT c_custkey, c_acctbal, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2) WHERE c_acctbal < 5000 UNION ALL SELECT c_custkey, 1.0 FROM customer WHERE c_acctbal >= 5000")
def enrichment_discounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    rows = table(spark, sf_dir, "customer").join(n, "c_custkey", "left")
    return rows.select("c_custkey", F.round(S.enrichment_discount(F.coalesce("n", F.lit(0)), F.col("c_acctbal") >= 5000), 6).alias("discount"))


@query("SELECT key, label, n_ver, is_active FROM (SELECT user_id AS key, event_type AS label, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1 AS is_active, CAST(event_id AS BIGINT) AS n_ver FROM events)")
def superseded_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label log in which only the last write of a key is active."""
    rows = R.superseded(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])
    return rows.select(F.col("user_id").alias("key"), F.col("event_type").alias("label"), F.col("event_id").alias("n_ver"), "is_active")


@query("SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, CASE WHEN avg(value) > 55 THEN 'high' WHEN avg(value) > 45 THEN 'middle' ELSE 'low' END AS separation FROM events GROUP BY 1")
def signal_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = F.avg("value")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(mean, 4).alias("mean"), F.when(mean > 55, "high").when(mean > 45, "middle").otherwise("low").alias("separation"))


@query(
    """WITH k AS (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events), d AS (SELECT DISTINCT ON (user_id, event_type, k) user_id, event_type, k, ts, event_id, value FROM k ORDER BY user_id, event_type, k, ts, event_id)
SELECT user_id, event_type, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen, count(*) AS seen_count, arg_max(k, event_id) AS last_k FROM d GROUP BY 1, 2"""
)
def dedup_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events once a key, then first, last, count and the latest payload."""
    rows = table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k int")["k"])
    first = rows.groupBy("user_id", "event_type", "k").agg(F.min(F.struct("ts", "event_id")).alias("f")).select("user_id", "event_type", "k", "f.ts", "f.event_id")
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return first.groupBy("user_id", "event_type").agg(day(F.min("ts")).alias("first_seen"), day(F.max("ts")).alias("last_seen"), F.count(F.lit(1)).alias("seen_count"), F.max_by("k", "event_id").alias("last_k"))


@query(
    """SELECT user_id, count(*) AS sessions, CAST(max(n) AS BIGINT) AS longest FROM (SELECT user_id, s, count(*) AS n FROM
 (SELECT user_id, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT user_id, ts, event_id, CASE WHEN date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) < 3600000000 THEN 0 ELSE 1 END AS g FROM events)) GROUP BY 1, 2) GROUP BY 1"""
)
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that end after an hour without an event."""
    s = table(spark, sf_dir, "events").groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "1 hour")).agg(F.count(F.lit(1)).alias("n"))
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


@query("SELECT event_id, sha1('ws|ego|' || CAST(user_id AS VARCHAR) || '|' || event_type || '|' || CAST(event_id AS VARCHAR)) AS event_key FROM events")
def event_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", S.event_key(F.lit("ws"), F.lit("ego"), F.col("user_id"), F.col("event_type"), F.col("event_id")).alias("event_key"))


@query("SELECT conv_id, turn, role FROM conversations WHERE role <> 'user'")
def relay_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("participant", F.col("role"))
    return feed.relayed(rows, "user").select("conv_id", "turn", "role")


_TFIDF = {
    "n": "SELECT doc_id AS row, term AS col, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS term FROM documents) GROUP BY 1, 2",
    "df": "SELECT col, count(*) AS df FROM n GROUP BY 1",
    "w": "SELECT row, col, (1 + ln(n)) * (ln((1 + (SELECT count(DISTINCT row) FROM n)) / (1 + df)) + 1) AS w FROM n JOIN df USING (col)",
}


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row"), F.explode(R.tokens(F.col("text"))).alias("col"))
    return words.groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"))


@query(oracle("SELECT row AS doc_id, col AS term, round(w / sqrt(sum(w * w) OVER (PARTITION BY row)), 6) AS weight FROM w", more=_TFIDF))
def tfidf_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.tfidf(_counts(spark, sf_dir)).select(F.col("row").alias("doc_id"), F.col("col").alias("term"), F.round("w", 6).alias("weight"))


@query(oracle("SELECT * FROM (SELECT doc_id, term, weight, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS rank FROM (SELECT row AS doc_id, col AS term, round(w / sqrt(sum(w * w) OVER (PARTITION BY row)), 6) AS weight FROM w)) WHERE rank <= 3", more=_TFIDF))
def top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tfidf_terms(spark, sf_dir)
    return R.top_per_group(t, ["doc_id"], [F.desc("weight"), "term"], 3)


@query(
    oracle(
        "SELECT src, dst, round(sum(v), 6) AS v FROM (SELECT s.src, s.dst, -w / sqrt(x.d * y.d) AS v FROM s JOIN d x ON x.id = src JOIN d y ON y.id = dst UNION ALL SELECT id, id, 1.0 FROM d) GROUP BY 1, 2",
        "trade",
        more={"s": "SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, w / 2 AS w FROM trade UNION ALL SELECT dst, src, w / 2 FROM trade) GROUP BY 1, 2", "d": "SELECT src AS id, sum(w) AS d FROM s GROUP BY 1"},
    )
)
def normalised_laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.laplacian(trade(spark, sf_dir)).select("src", "dst", F.round("v", 6).alias("v"))


@query()
def spectral_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three coordinates a nation; a test holds them against a dense eigensolver."""
    return L.spectral(trade(spark, sf_dir), 3, rounds=15)


@query()
def topic_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of four non-negative factors of supplier nations' trade."""
    m = trade(spark, sf_dir).select(F.col("src").alias("row"), F.col("dst").alias("col"), "w")
    w, _ = L.nmf(m, 4, rounds=6)
    return L.row_shares(w)


@query()
def multiscale_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the embeddings at two scales with sizes and mean distance."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("f"))
    out = None
    for k in (4, 16):
        got, _ = L.kmeans(v, k)
        part = got.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("distance").alias("mean_distance")).withColumn("k", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id")).distinct().withColumn("cluster", F.col("id") % 7)


_CLUSTERS = {"c": "SELECT DISTINCT user_id AS id, user_id % 7 AS cluster FROM events", "e": "SELECT src, dst, n FROM typed WHERE type = 'signup'"}


@query(oracle("SELECT least(x.cluster, y.cluster) AS a, greatest(x.cluster, y.cluster) AS b, CAST(sum(n) AS DOUBLE) AS w, count(*) AS n FROM e JOIN c x ON src = x.id JOIN c y ON dst = y.id WHERE x.cluster <> y.cluster GROUP BY 1, 2", "typed", more=_CLUSTERS))
def cluster_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = typed(spark, sf_dir).where("type = 'signup'").select("src", "dst", F.col("n").alias("w"))
    return C.cluster_edges(e, _clusters(spark, sf_dir).withColumn("p", F.lit(1.0)))


@query(
    oracle(
        "SELECT a, b, count(*) AS n, round(count(*) / sqrt(max(x.s) * max(y.s)), 6) AS strength FROM (SELECT least(x.cluster, y.cluster) AS a, greatest(x.cluster, y.cluster) AS b FROM e JOIN c x ON src = x.id JOIN c y ON dst = y.id WHERE x.cluster <> y.cluster) JOIN z x ON x.cluster = a JOIN z y ON y.cluster = b GROUP BY 1, 2",
        "typed",
        more=_CLUSTERS | {"z": "SELECT cluster, count(*) AS s FROM c GROUP BY 1"},
    )
)
def connectivity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = typed(spark, sf_dir).where("type = 'signup'").select("src", "dst")
    return C.connectivity(e, _clusters(spark, sf_dir)).withColumn("strength", F.round("strength", 6))


@query(
    oracle(
        """SELECT cluster, count(*) AS members, CAST(sum(d) AS BIGINT) AS n_edges, CASE WHEN count(*) > 1 THEN round(sum(d) / (count(*) * (count(*) - 1)), 6) ELSE 0 END AS density, CASE WHEN sum(d) > 0 THEN round(sum(m) / sum(d), 6) ELSE 0 END AS mutual_ratio, round(avg(d), 6) AS mean_degree, round(stddev_pop(d), 6) AS std_degree
FROM (SELECT c.cluster, c.id, count(i.dst) AS d, count(b.src) AS m FROM c LEFT JOIN i ON i.src = c.id LEFT JOIN i b ON b.src = i.dst AND b.dst = i.src GROUP BY 1, 2) GROUP BY 1""",
        "typed",
        more=_CLUSTERS | {"i": "SELECT DISTINCT src, dst FROM e JOIN c x ON src = x.id JOIN c y ON dst = y.id WHERE x.cluster = y.cluster"},
    )
)
def local_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = C.local_metrics(typed(spark, sf_dir).where("type = 'signup'"), _clusters(spark, sf_dir))
    return got.select("cluster", "members", "n_edges", *[F.round(c, 6).alias(c) for c in ("density", "mutual_ratio", "mean_degree", "std_degree")])


@query(oracle("SELECT cluster, id, rank FROM (SELECT cluster, c.id, row_number() OVER (PARTITION BY cluster ORDER BY coalesce(f, 0) DESC, c.id) AS rank FROM c LEFT JOIN (SELECT dst AS id, count(*) AS f FROM e GROUP BY 1) x ON x.id = c.id) WHERE rank <= 3", "typed", more=_CLUSTERS))
def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    fame = typed(spark, sf_dir).where("type = 'signup'").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("fame"))
    return C.representatives(_clusters(spark, sf_dir), fame).select("cluster", "id", "rank")


@query(
    """SELECT split, k, round(((log2(t) - sl / t) / log2(k) + 1 - top / t + 1 - tiny / k + 0.5 + 0.5) / 5, 6) AS score FROM
 (SELECT split, count(*) AS k, sum(n) AS t, max(n) AS top, sum(CASE WHEN n < 4 THEN 1 ELSE 0 END) AS tiny, sum(n * log2(n)) AS sl FROM (SELECT p_size % 5 AS split, p_brand, count(*) AS n FROM part GROUP BY 1, 2) GROUP BY 1)"""
)
def structure_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "part").groupBy((F.col("p_size") % 5).alias("split"), "p_brand").agg(F.count(F.lit(1)).alias("size"))
    return C.structure_score(sizes, F.lit(0.5), F.lit(0.5)).withColumn("score", F.round("score", 6))


@query(
    oracle(
        "SELECT id, cluster, round(exp(-(d - m)) / sum(exp(-(d - m))) OVER (PARTITION BY id), 6) AS p FROM (SELECT id, cluster, d, min(d) OVER (PARTITION BY id) AS m FROM k)",
        "nations",
        more={"k": "SELECT id, region AS cluster0, unnest([0, 1, 2]) AS cluster, abs(id - 8 * unnest([0, 1, 2])) / 8.0::DOUBLE AS d FROM nations"},
    )
)
def soft_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nations(spark, sf_dir).select("id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("cluster")).withColumn("distance", F.abs(F.col("id") - 8 * F.col("cluster")) / 8)
    return L.soft_memberships(rows).withColumn("p", F.round("p", 6))


_SPLIT = {
    "z": "SELECT cluster, count(*) AS s, (SELECT count(*) FROM c) - count(*) AS others FROM c GROUP BY 1",
    "k": "SELECT cluster, dst, sum(n) AS n FROM e JOIN c ON src = c.id GROUP BY 1, 2",
    "t": "SELECT k.*, s, others, sum(n) OVER (PARTITION BY dst) - n AS elsewhere FROM k JOIN z USING (cluster)",
}


@query(
    oracle(
        """SELECT cluster, dst, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, dst) AS rank FROM
 (SELECT cluster, dst, CASE WHEN n / s < 0.15 * s / (s + others) THEN 0 ELSE (n / s) / (elsewhere / greatest(others, 1) + 0.01) END AS score FROM t)) WHERE rank <= 10""",
        "typed",
        more=_CLUSTERS | _SPLIT,
    )
)
def discriminating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that tell a cluster from the others."""
    counts = typed(spark, sf_dir).where("type = 'signup'").select(F.col("src").alias("id"), F.col("dst").alias("target"), "n")
    got = L.discriminating(counts, _clusters(spark, sf_dir), 10)
    return got.select("cluster", F.col("target").alias("dst"), F.round("score", 6).alias("score"), "rank")


@query(
    oracle(
        """SELECT cluster, members, CASE WHEN members <= 5 THEN 'individuals' WHEN h > 1.5 AND tags >= 2 THEN 'tag_split' WHEN bridges > 0.2 AND members > 10 THEN 'bridge_extraction' WHEN mean > 0 AND std / mean > 1.5 AND members > 15 THEN 'core_periphery'
 WHEN density > 0.1 AND mutual > 0.3 AND members < 50 THEN 'mutual_components' WHEN edges > members // 2 THEN 'louvain' WHEN members % 2 = 0 THEN 'hierarchical' WHEN members <= 20 THEN 'individuals' ELSE 'sample_individuals' END AS strategy
FROM (SELECT cluster, count(*) AS members, sum(d) AS edges, CASE WHEN count(*) > 1 THEN sum(d) / (count(*) * (count(*) - 1)) ELSE 0 END AS density, CASE WHEN sum(d) > 0 THEN sum(m) / sum(d) ELSE 0 END AS mutual, avg(d) AS mean, stddev_pop(d) AS std
 FROM (SELECT c.cluster, c.id, count(i.dst) AS d, count(b.src) AS m FROM c LEFT JOIN i ON i.src = c.id LEFT JOIN i b ON b.src = i.dst AND b.dst = i.src GROUP BY 1, 2) GROUP BY 1)
JOIN (SELECT cluster, -sum(p * log2(p)) AS h, count(*) AS tags FROM (SELECT cluster, n / sum(n) OVER (PARTITION BY cluster) AS p FROM g) GROUP BY 1) USING (cluster)
JOIN (SELECT cluster, avg(CASE WHEN kinds >= 2 AND h / log2(kinds) > 0.7 THEN 1.0 ELSE 0.0 END) AS bridges FROM (SELECT cluster, id, count(*) AS kinds, -sum(p * log2(p)) AS h FROM (SELECT cluster, id, n / sum(n) OVER (PARTITION BY id) AS p FROM u) GROUP BY 1, 2) GROUP BY 1) USING (cluster)""",
        "typed",
        more=_CLUSTERS
        | {
            "i": "SELECT DISTINCT src, dst FROM e JOIN c x ON src = x.id JOIN c y ON dst = y.id WHERE x.cluster = y.cluster",
            "u": "SELECT user_id % 7 AS cluster, user_id AS id, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3",
            "g": "SELECT cluster, event_type, count(*) AS n FROM u WHERE event_type = 'error' OR n > 14 GROUP BY 1, 2",
        },
    )
)
def expansion_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How to open each cluster of users: tags are errors and what a user does often, memberships the shares of event types."""
    clusters = _clusters(spark, sf_dir)
    used = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id"), "event_type").agg(F.count(F.lit(1)).alias("n")).join(clusters, "id")
    tags = used.where("event_type = 'error' OR n > 14").groupBy("cluster", "event_type").agg(F.count(F.lit(1)).alias("n"))
    bits = lambda c: S.entropy(F.collect_list(c), base=2.0)
    tagged = tags.groupBy("cluster").agg(bits("n").alias("tag_entropy"), F.count(F.lit(1)).alias("n_tags"))
    shares = used.groupBy("cluster", "id").agg(bits("n").alias("h"), F.count(F.lit(1)).alias("kinds"))
    bridge = F.when((F.col("kinds") >= 2) & (F.col("h") / F.log2("kinds") > 0.7), 1.0).otherwise(0.0)
    rows = C.local_metrics(typed(spark, sf_dir).where("type = 'signup'"), clusters).join(tagged, "cluster").join(shares.groupBy("cluster").agg(F.avg(bridge).alias("bridge_ratio")), "cluster")
    return C.strategy(rows, F.col("tag_entropy"), F.col("n_tags"), F.col("bridge_ratio"), F.col("members") % 2 == 0).select("cluster", "members", "strategy")


@query("SELECT 'labels' AS problem, doc_id FROM labels GROUP BY doc_id HAVING count(*) > 1 UNION ALL SELECT 'splits', doc_id FROM documents GROUP BY doc_id HAVING count(DISTINCT doc_id % 3) > 1")
def leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("is_active"))
    splits = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 3).alias("split"))
    return E.leaks(labels, splits, "doc_id").select("problem", "doc_id")


@query("SELECT c_custkey, coalesce(n, 0) AS n, coalesce(last, '1970-01-01') AS last FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, strftime(max(o_orderdate), '%Y-%m-%d') AS last FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def upserted_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newly counted rows over empty ones, by key."""
    target = table(spark, sf_dir, "customer").select("c_custkey", F.lit(0).cast("long").alias("n"), F.lit("1970-01-01").alias("last"))
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last"))
    return R.upsert(target, rows, ["c_custkey"])


@query("SELECT n_name, CAST(sum(n) AS BIGINT) AS n FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1 UNION ALL SELECT c_nationkey, count(*) FROM customer GROUP BY 1) JOIN nation ON n_nationkey = k GROUP BY ROLLUP (n_name)")
def rollup_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    b = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(b).join(table(spark, sf_dir, "nation"), F.col("k") == F.col("n_nationkey")).rollup("n_name").agg(F.sum("n").alias("n"))


@query(
    """SELECT event_id, value IS NOT NULL AND value BETWEEN 0 AND 100 AS in_range, value = 0 OR value = 100 AS edge_case, isnan(value) AS is_nan FROM events"""
)
def signal_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", (v.isNotNull() & v.between(0, 100)).alias("in_range"), ((v == 0) | (v == 100)).alias("edge_case"), F.isnan(v).alias("is_nan"))


@query(
    """SELECT a.user_id AS account, strftime(min(a.ts), '%Y-%m-%d') AS since, count(*) AS candidates FROM (SELECT * FROM events WHERE event_type = 'signup') a
WHERE a.user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND user_id IS NOT NULL AND value > 99) GROUP BY 1"""
)
def unlabelled_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that no label excludes; an anti join is safe for nulls."""
    e = table(spark, sf_dir, "events")
    done = e.where("event_type = 'error' AND value > 99").select("user_id")
    return e.where("event_type = 'signup'").join(done, "user_id", "left_anti").groupBy(F.col("user_id").alias("account")).agg(F.date_format(F.min("ts"), "yyyy-MM-dd").alias("since"), F.count(F.lit(1)).alias("candidates"))


@query(
    """WITH w AS (SELECT c_nationkey AS acc, c_mktsegment AS com, count(*)::DOUBLE AS w FROM customer GROUP BY 1, 2)
SELECT acc, com, round(w, 6) AS w FROM (SELECT *, row_number() OVER (PARTITION BY acc ORDER BY w DESC, com) AS r FROM w) WHERE r = 1"""
)
def primary_community(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each account's community of greatest weight, the first by name among equals."""
    w = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("acc"), F.col("c_mktsegment").alias("com")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    return R.latest(w, ["acc"], [F.desc("w"), "com"])


@query(
    """SELECT id, round(0.25 * least(1, n / 20.0) + 0.30 * q + 0.20 * top + 0.15 * least(1, deg / 10.0) + 0.10, 6) AS score FROM
 (SELECT source AS id, count(*) AS n, avg(CASE WHEN l.doc_id IS NULL THEN 0.0 ELSE 1.0 END) AS q, max(c) / sum(1.0) AS top, count(DISTINCT lang) AS deg FROM (SELECT *, count(*) OVER (PARTITION BY source, lang) AS c FROM documents) d LEFT JOIN labels l USING (doc_id) GROUP BY 1)"""
)
def account_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five factors: richness, labels, concentration, network, agreement."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(table(spark, sf_dir, "labels").select("doc_id", F.lit(1.0).alias("l")), "doc_id", "left")
    per = d.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("c"), F.sum(F.coalesce("l", F.lit(0.0))).alias("l"))
    got = per.groupBy(F.col("source").alias("id")).agg(F.sum("c").alias("n"), F.sum("l").alias("l"), F.max("c").alias("top"), F.count(F.lit(1)).alias("deg"))
    score = S.confidence(F.least(F.lit(1.0), F.col("n") / 20), F.col("l") / F.col("n"), F.col("top") / F.col("n"), F.least(F.lit(1.0), F.col("deg") / 10), F.lit(1.0))
    return got.select("id", F.round(score, 6).alias("score"))
