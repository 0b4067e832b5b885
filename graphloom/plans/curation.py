"""Plans of curation and exploration: queues, candidates, selections, audits, context, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import evaluation as E
from ..operators import relational as R
from ..streaming import feed
from .bindings import follows, oracle, purchases, table, typed
from .registry import query


@query("SELECT o_orderkey, round(o_totalprice + 2 * (o_custkey % 100), 2) AS engagement FROM orders ORDER BY engagement DESC, o_orderkey LIMIT 25")
def engaged_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts by likes and twice the reposts."""
    e = F.round(F.col("o_totalprice") + 2 * (F.col("o_custkey") % 100), 2).alias("engagement")
    return table(spark, sf_dir, "orders").select("o_orderkey", e).orderBy(F.desc("engagement"), "o_orderkey").limit(25)


@query(oracle("SELECT p.dst AS id, count(DISTINCT p.src) AS known, string_agg(DISTINCT CAST(p.src AS VARCHAR), ',' ORDER BY CAST(p.src AS VARCHAR)) AS who FROM purchases p JOIN purchases e ON e.src = 1 AND e.dst = p.src WHERE p.dst <> 1 GROUP BY 1 ORDER BY known DESC, id LIMIT 20", "purchases"))
def followers_you_know(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by how many accounts that the ego follows follow them."""
    e = purchases(spark, sf_dir)
    mine = e.where("src = 1").select(F.col("dst").alias("src"))
    who = F.array_join(F.array_sort(F.collect_set(F.col("src").cast("string"))), ",").alias("who")
    return e.join(mine, "src").where("dst <> 1").groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("known"), who).orderBy(F.desc("known"), "id").limit(20)


@query(
    """SELECT doc_id, source, lang FROM (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source ORDER BY (lang = 'en') DESC, n_chars DESC, doc_id) AS r FROM documents d
 WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)) WHERE r = 1"""
)
def cold_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One unlabelled post an account, those in the graph first."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
    return R.latest(rows, ["source"], [F.desc(F.col("lang") == "en"), F.desc("n_chars"), "doc_id"]).select("doc_id", "source", "lang")


_PREDICTIONS = {"p": "SELECT doc_id, (n_chars % 7) / 6.0::DOUBLE AS a, (n_chars % 5) / 4.0::DOUBLE AS b FROM documents"}


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 7 / 6).alias("a"), (F.col("n_chars") % 5 / 4).alias("b"))


@query(
    oracle(
        """SELECT doc_id, round(0.7 * CASE WHEN a IN (0, 1) THEN 0 ELSE -(a * log2(a) + (1 - a) * log2(1 - a)) END + 0.3 * abs(a - b), 6) AS score,
 CASE WHEN l.doc_id IS NOT NULL AND quality = 1 THEN 'resolved' WHEN l.doc_id IS NOT NULL THEN 'skipped' ELSE 'pending' END AS status FROM p LEFT JOIN labels l USING (doc_id)""",
        more=_PREDICTIONS,
    )
)
def uncertainty_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy and disagreement of two models; a status once given stays."""
    rows = _predictions(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    tv = S.total_variation(F.array("a", 1 - F.col("a")), F.array("b", 1 - F.col("b")))
    status = F.when(F.col("quality") == 1, "resolved").when(F.col("quality").isNotNull(), "skipped").otherwise("pending")
    return rows.select("doc_id", F.round(S.queue_score(S.binary_entropy(F.col("a")), tv), 6).alias("score"), status.alias("status"))


@query(oracle("SELECT round(avg(((a - quality) * (a - quality) + (1 - a - (1 - quality)) * (1 - a - (1 - quality))) / 2), 8) AS brier, count(*) AS items FROM p JOIN labels USING (doc_id)", more=_PREDICTIONS))
def evaluation_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over posts of the mean over classes of the squared error."""
    rows = _predictions(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    two = lambda x, name: rows.select("doc_id", F.explode(F.array(F.struct(F.lit("in").alias("class"), x.cast("double").alias(name)), F.struct(F.lit("out").alias("class"), (1 - x).cast("double").alias(name)))).alias("e")).select("doc_id", "e.*")
    return E.multiclass_brier(two(F.col("a"), "p"), two(F.col("quality"), "y"), ["doc_id"]).select(F.round("brier", 8).alias("brier"), "items")


@query(
    oracle(
        """, t AS (SELECT method, x, 2.0 * sum(y) OVER w / (sum(n) OVER w + (SELECT sum(quality) FROM r WHERE train)) AS f1 FROM
   (SELECT method, x, sum(y) AS y, sum(n) AS n FROM (SELECT 'a' AS method, a AS x, quality AS y, 1 AS n FROM r WHERE train UNION ALL SELECT 'b', b, quality, 1 FROM r WHERE train) GROUP BY 1, 2) WINDOW w AS (PARTITION BY method ORDER BY x DESC)),
 best AS (SELECT method, x FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY round(f1, 9) DESC, abs(x - 0.5), x) AS k FROM t) WHERE k = 1)
SELECT method, round(best.x, 6) AS threshold, round(2.0 * sum(CASE WHEN v.x >= best.x THEN y ELSE 0 END) / (sum(CASE WHEN v.x >= best.x THEN 1 ELSE 0 END) + sum(y)), 6) AS f1
FROM best JOIN (SELECT 'a' AS method, a AS x, quality AS y FROM r WHERE NOT train UNION ALL SELECT 'b', b, quality FROM r WHERE NOT train) v USING (method) GROUP BY 1, best.x""".replace(", t AS", "SELECT * FROM (WITH t AS", 1)
        + ")",
        more=_PREDICTIONS | {"r": "SELECT p.*, quality, doc_id % 3 > 0 AS train FROM p JOIN labels USING (doc_id)"},
    )
)
def scoreboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each method's threshold tuned on one split and its F1 on another."""
    rows = _predictions(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id")
    out = None
    for method in ("a", "b"):
        tuned = E.thresholds(rows.where("doc_id % 3 > 0"), method, "y").orderBy(F.desc(F.round("f1", 9)), F.abs(F.col("score") - 0.5), "score").limit(1).select(F.col("score").alias("threshold"))
        test = rows.where("doc_id % 3 = 0").crossJoin(F.broadcast(tuned))  # one row
        hit = F.col(method) >= F.col("threshold")
        part = test.groupBy("threshold").agg((2 * F.sum(F.when(hit, F.col("y")).otherwise(0)) / (F.count_if(hit) + F.sum("y"))).alias("f1")).select(F.lit(method).alias("method"), F.round("threshold", 6).alias("threshold"), F.round("f1", 6).alias("f1"))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT source, n, round((pos + 2 * (SELECT avg(quality) FROM labels)) / (n + 2), 6) AS transfer FROM (SELECT source, count(*) AS n, sum(quality) AS pos FROM documents JOIN labels USING (doc_id) GROUP BY 1)")
def label_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of positive labels in a community, drawn to the prior by two counts."""
    labels = table(spark, sf_dir, "labels")
    prior = labels.agg(F.avg("quality").alias("prior"))
    n = table(spark, sf_dir, "documents").select("doc_id", "source").join(labels, "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("pos"))
    return n.crossJoin(F.broadcast(prior)).select("source", "n", F.round((F.col("pos") + 2 * F.col("prior")) / (F.col("n") + 2), 6).alias("transfer"))  # one row


@query(
    oracle(
        """SELECT id, round(v * CASE WHEN id IN (SELECT dst FROM purchases WHERE src = 1) THEN 3 WHEN id IN (SELECT b.dst FROM purchases a JOIN purchases b ON a.dst = b.src WHERE a.src = 1) THEN 1.5 ELSE 1 END, 4) AS boosted
FROM (SELECT user_id AS id, avg(value) AS v FROM events GROUP BY 1) WHERE id <> 1 ORDER BY boosted DESC, id LIMIT 15""",
        "purchases",
    )
)
def boosted_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts near the ego count three times, those one hop further one and a half times."""
    e = purchases(spark, sf_dir).select("src", "dst")
    near = e.where("src = 1").select(F.col("dst").alias("id"), F.lit(3.0).alias("boost"))
    far = near.select(F.col("id").alias("src")).join(e, "src").select(F.col("dst").alias("id"), F.lit(1.5).alias("boost"))
    boost = near.unionByName(far).groupBy("id").agg(F.max("boost").alias("boost"))
    v = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.avg("value").alias("v"))
    return v.join(boost, "id", "left").where("id <> 1").select("id", F.round(F.col("v") * F.coalesce("boost", F.lit(1.0)), 4).alias("boosted")).orderBy(F.desc("boosted"), "id").limit(15)


@query(
    """SELECT user_id, round(0.35 * e + 0.25 * b + 0.20 * CASE WHEN hi > lo THEN (i - lo) / (hi - lo) ELSE 0.5 END + 0.15 * 1 + 0.05 / (1 + n), 6) AS score FROM
 (SELECT *, min(i) OVER () AS lo, max(i) OVER () AS hi FROM (SELECT user_id, count(*) AS n, ln(1 + count(*)) AS i, avg(value) / 100 AS b, CASE WHEN avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0 END) IN (0, 1) THEN 0 ELSE
   -(avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0 END) * log2(avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0 END)) + (1 - avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0 END)) * log2(1 - avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0 END))) END AS e FROM events GROUP BY 1))"""
)
def acquisition_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.graph import min_max

    p = F.avg((F.col("event_type") == "click").cast("double"))
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.log1p(F.count(F.lit(1))).alias("i"), (F.avg("value") / 100).alias("b"), p.alias("p"))
    return rows.select("user_id", F.round(S.acquisition(S.binary_entropy(F.col("p")), F.col("b"), min_max("i"), F.lit(1.0), 1 / (1 + F.col("n"))), 6).alias("score"))


@query("SELECT c_custkey, CASE WHEN n = 0 THEN 'first run' WHEN c_nationkey = 3 THEN 'small account' WHEN n < 3 THEN 'low capture' WHEN n > 15 THEN 'store mismatch' WHEN n < 10 THEN 'age' ELSE 'fresh' END AS reason FROM (SELECT c_custkey, c_nationkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)")
def refresh_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered rules; the first that holds."""
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    rows = table(spark, sf_dir, "customer").join(n, "c_custkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    reason = S.refresh_reason(F.col("n") == 0, F.col("c_nationkey") == 3, F.when(F.col("n") < 3, 0.1).otherwise(0.9), F.when(F.col("n") > 15, 20).otherwise(10), F.lit(12), F.when(F.col("n") < 10, 200).otherwise(1))
    return rows.select("c_custkey", reason.alias("reason"))


@query("SELECT o_custkey AS list_id, 5 AS claimed, count(*) AS actual, count(*) <> 5 AS differs FROM orders GROUP BY 1 HAVING count(*) <> 5")
def list_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists whose members are not as many as claimed."""
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("list_id")).agg(F.lit(5).alias("claimed"), F.count(F.lit(1)).alias("actual"))
    return n.withColumn("differs", F.col("actual") != F.col("claimed")).where("differs")


@query(
    """SELECT name, id FROM (SELECT lower(name) AS name, id, row_number() OVER (PARTITION BY lower(name) ORDER BY pri, id) AS r FROM
 (SELECT c_name AS name, c_custkey AS id, 1 AS pri FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT upper(c_name), c_custkey + 1000000, 2 FROM customer)) WHERE r = 1"""
)
def resolved_handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by the best source that knows them, whatever their case."""
    c = table(spark, sf_dir, "customer")
    local = c.where("c_custkey % 2 = 0").select(S.handle(F.col("c_name")).alias("name"), F.col("c_custkey").alias("id"), F.lit(1).alias("pri"))
    remote = c.select(S.handle(F.upper("c_name")).alias("name"), (F.col("c_custkey") + 1000000).alias("id"), F.lit(2).alias("pri"))
    return local.unionByName(remote).groupBy("name").agg(F.min_by("id", F.struct("pri", "id")).alias("id"))


@query(
    oracle(
        "SELECT f.dst, c_mktsegment AS community, count(DISTINCT f.src) AS likers FROM follows f JOIN customer ON c_custkey = f.src WHERE f.dst <= 20 GROUP BY 1, 2",
        "follows",
    )
)
def likers_by_community(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("src"), F.col("c_mktsegment").alias("community"))
    return follows(spark, sf_dir).where("dst <= 20").join(c, "src").groupBy("dst", "community").agg(F.countDistinct("src").alias("likers"))


@query(
    """WITH m AS (SELECT d.source, d.lang, count(*) AS n FROM documents d GROUP BY 1, 2), t AS (SELECT source, sum(n) AS t FROM m GROUP BY 1)
SELECT lang, count(*) AS members, round(sum(n / t) / (SELECT count(*) FROM t), 6) AS mean_share, arg_max(source, n / t * 1000000 - CAST(replace(source, 'src', '') AS INTEGER) / 1000.0) AS strongest FROM m JOIN t USING (source) GROUP BY 1"""
)
def topic_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean share of each topic over all accounts (0 where an account lacks it), and the account where it is strongest."""
    n = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    shares = n.withColumn("share", R.share_of("n", ["source"]))
    total = n.select("source").distinct().count()
    key = F.col("share") * 1000000 - F.regexp_replace("source", "src", "").cast("int") / 1000
    return shares.groupBy("lang").agg(F.count(F.lit(1)).alias("members"), F.round(F.sum("share") / total, 6).alias("mean_share"), F.max_by("source", key).alias("strongest"))


@query(
    """SELECT label, count(*) AS n, round(max(c) / count(*), 6) AS purity, round((max(c) - coalesce(max(CASE WHEN k = 2 THEN c END), 0)) / count(*), 6) AS margin, round(avg(CASE WHEN known THEN 1.0 ELSE 0.0 END), 6) AS coverage
FROM (SELECT e.label, d.lang, l.doc_id IS NOT NULL AS known, count(*) OVER (PARTITION BY e.label, d.lang) AS c, dense_rank() OVER (PARTITION BY e.label ORDER BY x.c DESC, d.lang) AS k
 FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id LEFT JOIN labels l ON l.doc_id = d.doc_id JOIN (SELECT label, lang, count(*) AS c FROM embeddings JOIN documents ON doc_id = vec_id GROUP BY 1, 2) x ON x.label = e.label AND x.lang = d.lang) GROUP BY 1"""
)
def cluster_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per cluster: size, purity, the margin of the first class over the second, and how many members are known."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").join(table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("known")), "doc_id", "left")
    cells = rows.groupBy("label", "lang").agg(F.count(F.lit(1)).alias("c"), F.count("known").alias("known"))
    got = cells.groupBy("label").agg(F.sum("c").alias("n"), F.sum("known").alias("known"), F.sort_array(F.collect_list("c"), asc=False).alias("cs"))
    first, second = F.get("cs", F.lit(0)), F.coalesce(F.get("cs", F.lit(1)), F.lit(0))
    return got.select("label", "n", F.round(first / F.col("n"), 6).alias("purity"), F.round((first - second) / F.col("n"), 6).alias("margin"), F.round(F.col("known") / F.col("n"), 6).alias("coverage"))


@query("SELECT doc_id, CASE WHEN abs(a + b + c + d - 1) > 0.001 THEN 'sum' END AS problem FROM (SELECT doc_id, 0.25 AS a, 0.25 AS b, 0.25 AS c, CASE WHEN doc_id % 5 = 0 THEN 0.2 ELSE 0.25 END AS d FROM documents)")
def checked_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    quarter = F.lit(0.25)
    return table(spark, sf_dir, "documents").select("doc_id", S.valid_distribution(F.array(quarter, quarter, quarter, F.when(F.col("doc_id") % 5 == 0, 0.2).otherwise(0.25))).alias("problem"))


@query(
    oracle(
        "SELECT t.src, t.dst, t.n * coalesce(s.k, 0) AS probe, round(t.n / sqrt(d.d), 6) AS scaled FROM (SELECT * FROM typed WHERE type = 'signup') t LEFT JOIN (SELECT src AS id, count(*) AS k FROM purchases WHERE dst % 9 = 0 GROUP BY 1) s ON s.id = t.src JOIN (SELECT src, count(*) AS d FROM typed WHERE type = 'signup' GROUP BY 1) d ON d.src = t.src",
        "typed",
        "purchases",
    )
)
def edge_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of edges: weight times seed neighbours, and weight over the root of the degree."""
    t = typed(spark, sf_dir).where("type = 'signup'").select("src", "dst", "n")
    near = purchases(spark, sf_dir).where("dst % 9 = 0").groupBy("src").agg(F.count(F.lit(1)).alias("k"))
    degree = F.count(F.lit(1)).over(Window.partitionBy("src"))
    return t.withColumn("d", degree).join(near, "src", "left").select("src", "dst", (F.col("n") * F.coalesce("k", F.lit(0))).alias("probe"), F.round(F.col("n") / F.sqrt("d"), 6).alias("scaled"))


@query("SELECT doc_id, round(q.p, 6) AS p, round(greatest(0, q.p - 1.96 * least(0.25, 0.25 * u)), 6) AS low, round(least(1, q.p + 1.96 * least(0.25, 0.25 * u)), 6) AS high FROM (SELECT doc_id, (n_chars % 10) / 10.0::DOUBLE * c + 0.1 * (1 - c) AS p, 0.7 * 0.2 + 0.3 * (1 - c) AS u FROM (SELECT *, (n_chars % 4) / 3.0::DOUBLE AS c FROM documents)) q")
def shrunk_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memberships drawn to the prior where coverage is thin, with an interval."""
    s = S.shrunk(F.col("n_chars") % 10 / 10, F.col("n_chars") % 4 / 3, 0.1, F.lit(0.2))
    return table(spark, sf_dir, "documents").select("doc_id", s.alias("s")).select("doc_id", F.round("s.p", 6).alias("p"), F.round("s.low", 6).alias("low"), F.round("s.high", 6).alias("high"))


@query("SELECT source, substr(sha1(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY CAST(doc_id AS VARCHAR))), 1, 6) AS run_id FROM documents GROUP BY 1")
def run_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short ids of runs from what went into them."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.substring(F.sha1(F.array_join(F.array_sort(F.collect_list(F.col("doc_id").cast("string"))), ",")), 1, 6).alias("run_id"))


@query("SELECT user_id AS account_id, event_type AS surface, count(*) AS seen_count, count(DISTINCT event_id) AS events FROM events GROUP BY 1, 2")
def streamed_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table read as a stream, ingested batch by batch into a store with a checkpoint, then rolled up."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not base:
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="graphloom-")
    place = f"{base.rstrip('/')}/feed-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    raw = stream.select(F.col("user_id").cast("string").alias("accountId"), F.lit(None).cast("string").alias("username"), F.lit(None).cast("string").alias("tweetId"), F.lit(None).cast("string").alias("tweetText"), F.col("event_type").alias("surface"), F.lit(None).cast("int").alias("position"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("seenAt"), F.col("event_id").cast("string").alias("eventId"))
    feed.run(feed.normalised(raw), lambda batch, _: feed.ingest(batch, place), f"{place}-offsets").awaitTermination()
    got = spark.read.parquet(f"{place}/events")
    return got.groupBy(F.col("account_id").cast("long").alias("account_id"), "surface").agg(F.count(F.lit(1)).alias("seen_count"), F.countDistinct("event_key").alias("events"))
