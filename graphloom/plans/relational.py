"""Relational plans: unions of typed edges, joins, aggregates, windows, top-k, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import graph as G
from ..operators import relational as R
from .bindings import follows, items, oracle, purchases, table, transitions, typed
from .registry import query


@query(
    """
WITH e AS (
  SELECT o_custkey AS src, l_suppkey AS dst, 1 AS orders, 0 AS returns, o_orderdate AS seen
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL
  SELECT o_custkey, l_suppkey, 0, 1, l_shipdate
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R')
SELECT src, dst, CAST(sum(orders) AS BIGINT) AS n_orders, CAST(sum(returns) AS BIGINT) AS n_returns,
       strftime(min(seen), '%Y-%m-%d') AS first_seen, strftime(max(seen), '%Y-%m-%d') AS last_seen
FROM e GROUP BY src, dst
"""
)
def engagement_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interactions of customers with suppliers as one weighted edge a pair, in one pass: a conditional aggregate replaces the union."""
    returned = F.col("l_returnflag") == "R"
    rows = items(spark, sf_dir).select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst"), returned.alias("r"), "o_orderdate", "l_shipdate")
    ship = F.when(F.col("r"), F.col("l_shipdate"))
    return rows.groupBy("src", "dst").agg(
        F.count(F.lit(1)).alias("n_orders"), F.count_if("r").alias("n_returns"), F.date_format(F.least(F.min("o_orderdate"), F.min(ship)), "yyyy-MM-dd").alias("first_seen"), F.date_format(F.greatest(F.max("o_orderdate"), F.max(ship)), "yyyy-MM-dd").alias("last_seen")
    )


@query(
    oracle(
        """SELECT src, dst, CAST(sum(CASE WHEN type = 'view' THEN n ELSE 0 END) AS BIGINT) AS like_count,
  CAST(sum(CASE WHEN type = 'click' THEN n ELSE 0 END) AS BIGINT) AS reply_count,
  CAST(sum(CASE WHEN type = 'purchase' THEN n ELSE 0 END) AS BIGINT) AS rt_count,
  max(CASE WHEN type = 'signup' THEN 1 ELSE 0 END) AS follow_flag
FROM typed WHERE type <> 'error' GROUP BY 1, 2""",
        "typed",
    )
)
def typed_engagement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four edge sources merged into one row a pair."""
    n = lambda t: F.sum(F.when(F.col("type") == t, F.col("n")).otherwise(0))
    return typed(spark, sf_dir).where("type <> 'error'").groupBy("src", "dst").agg(n("view").alias("like_count"), n("click").alias("reply_count"), n("purchase").alias("rt_count"), F.max(F.when(F.col("type") == "signup", 1).otherwise(0)).alias("follow_flag"))


@query(oracle("SELECT src, dst, CAST(sum(n) AS BIGINT) AS mentions FROM typed GROUP BY 1, 2 ORDER BY mentions DESC, src, dst LIMIT 50", "typed"))
def mention_pairs_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed(spark, sf_dir).groupBy("src", "dst").agg(F.sum("n").alias("mentions")).orderBy(F.desc("mentions"), "src", "dst").limit(50)


@query(oracle("SELECT a.src, a.dst FROM purchases a JOIN purchases b ON a.src = b.dst AND a.dst = b.src", "purchases"))
def mutual_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.mutual(purchases(spark, sf_dir))


@query(oracle("SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM purchases", "purchases"))
def undirected_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.undirected(purchases(spark, sf_dir))


@query(
    oracle(
        "SELECT a.src, count(*) AS n_out, count(b.src) AS n_mutual, round(count(b.src) / count(*), 6) AS reciprocity FROM purchases a LEFT JOIN purchases b ON a.src = b.dst AND a.dst = b.src GROUP BY 1",
        "purchases",
    )
)
def reciprocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.reciprocity(purchases(spark, sf_dir)).withColumn("reciprocity", F.round("reciprocity", 6))


@query(
    oracle(
        "SELECT r.src, r.dst, count(*) AS replies FROM transitions r WHERE r.type = 'click' AND EXISTS (SELECT 1 FROM typed l WHERE l.type = 'view' AND l.src = r.dst AND l.dst = r.src) GROUP BY 1, 2",
        "typed",
    )
)
def signed_links_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies whose author liked back."""
    liked = typed(spark, sf_dir).where("type = 'view'").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return transitions(spark, sf_dir).where("type = 'click'").join(liked, ["src", "dst"], "left_semi").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("replies"))


@query(
    oracle(
        """SELECT src, dst, n AS replies FROM typed t WHERE type = 'click'
  AND EXISTS (SELECT 1 FROM typed f WHERE f.type = 'signup' AND f.src = t.src AND f.dst = t.dst)
  AND EXISTS (SELECT 1 FROM typed f WHERE f.type = 'signup' AND f.src = t.dst AND f.dst = t.src)""",
        "typed",
    )
)
def signed_links_mutual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies between mutual follows: two semi joins in opposite directions."""
    edges = typed(spark, sf_dir)
    follow = edges.where("type = 'signup'").select("src", "dst")
    both = G.mutual(follow)
    return edges.where("type = 'click'").join(both, ["src", "dst"], "left_semi").select("src", "dst", F.col("n").alias("replies"))


@query(
    oracle(
        """SELECT a, b, shared, round(shared / (x.n + y.n - shared), 6) AS jaccard FROM
  (SELECT p.dst AS a, q.dst AS b, count(*) AS shared FROM f p JOIN f q ON p.src = q.src AND p.dst < q.dst GROUP BY 1, 2)
  JOIN s x ON x.dst = a JOIN s y ON y.dst = b WHERE shared / (x.n + y.n - shared) >= 0.05""",
        "follows",
        more={"f": "SELECT src, dst FROM follows WHERE n >= 3", "s": "SELECT dst, count(*) AS n FROM f GROUP BY 1"},
    )
)
def cofollow_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.cofollowed(follows(spark, sf_dir).where("n >= 3"), 0.05).withColumn("jaccard", F.round("jaccard", 6))


@query(
    oracle(
        """SELECT x.region, round(sum(w) / (max(z.n) * (max(z.n) - 1)), 6) AS within,
  round((SELECT sum(w) FROM trade JOIN nations p ON src = p.id JOIN nations q ON dst = q.id WHERE p.region = x.region AND q.region <> x.region) / (max(z.n) * (25 - max(z.n))), 6) AS between_
FROM trade JOIN nations x ON src = x.id JOIN nations y ON dst = y.id JOIN (SELECT region, count(*) AS n FROM nations GROUP BY 1) z ON z.region = x.region
WHERE x.region = y.region AND src <> dst GROUP BY x.region""",
        "trade",
        "nations",
    )
)
def community_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean weight of pairs within and across communities; pairs without an edge count as 0, so means are sums over pair counts and no pairs are made."""
    from .bindings import nations, trade

    n = nations(spark, sf_dir)
    sizes = n.groupBy("region").agg(F.count(F.lit(1)).alias("n"))
    total = n.count()
    rows = trade(spark, sf_dir).where("src <> dst").join(n.withColumnsRenamed({"id": "src"}), "src").join(n.select(F.col("id").alias("dst"), F.col("region").alias("other")), "dst")
    sums = rows.groupBy("region").agg(F.sum(F.when(F.col("region") == F.col("other"), F.col("w"))).alias("i"), F.sum(F.when(F.col("region") != F.col("other"), F.col("w"))).alias("o")).join(sizes, "region")
    return sums.select("region", F.round(F.col("i") / (F.col("n") * (F.col("n") - 1)), 6).alias("within"), F.round(F.col("o") / (F.col("n") * (F.lit(total) - F.col("n"))), 6).alias("between_"))


_BITS = "SELECT o_custkey AS account, l_orderkey AS post, 'bits:' || p_brand || ':' || CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END || CAST(l_linenumber AS VARCHAR) AS tag FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"


@query(
    oracle(
        """SELECT account, name, CAST(sum(bits) AS BIGINT) AS total_bits, count(DISTINCT post) AS posts,
  round(100.0 * abs(sum(bits)) / nullif(sum(abs(sum(bits))) OVER (PARTITION BY account), 0), 4) AS pct
FROM (SELECT account, post, string_split(tag, ':')[2] AS name, CAST(string_split(tag, ':')[3] AS INTEGER) AS bits FROM tags) GROUP BY 1, 2""",
        more={"tags": _BITS},
    )
)
def bits_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags ``bits:NAME:+N`` parsed and summed by account, with each name's share of the account's absolute bits."""
    rows = items(spark, sf_dir).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    tag = F.concat(F.lit("bits:"), F.col("p_brand"), F.lit(":"), F.when(F.col("l_returnflag") == "R", "-").otherwise("+"), F.col("l_linenumber").cast("string"))
    tags = rows.select(F.col("o_custkey").alias("account"), F.col("l_orderkey").alias("post"), S.bits_tag(tag).alias("t")).where("t IS NOT NULL")
    sums = tags.groupBy("account", F.col("t.name").alias("name")).agg(F.sum("t.bits").alias("total_bits"), F.countDistinct("post").alias("posts"))
    all_ = F.sum(F.abs("total_bits")).over(Window.partitionBy("account"))
    return sums.withColumn("pct", F.when(all_ > 0, F.round(100.0 * F.abs("total_bits") / all_, 4)))


@query(
    """SELECT post, label, CASE label WHEN 'F' THEN 1.5 WHEN 'O' THEN 1.0 ELSE 0.5 END AS weight FROM
 (SELECT l_orderkey AS post, l_linestatus AS label, row_number() OVER (PARTITION BY l_orderkey ORDER BY sum(l_quantity) DESC, l_linestatus) AS r FROM lineitem GROUP BY 1, 2) WHERE r = 1"""
)
def label_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest label of each post (first by name among equals) and its weight."""
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("post"), F.col("l_linestatus").alias("label")).agg(F.sum("l_quantity").alias("q"))
    best = R.latest(sums, ["post"], [F.desc("q"), "label"])
    return best.select("post", "label", F.when(F.col("label") == "F", 1.5).when(F.col("label") == "O", 1.0).otherwise(0.5).alias("weight"))


@query(
    """SELECT source, lang, n, round(n / sum(n) OVER (PARTITION BY source), 6) AS share FROM
 (SELECT source, lang, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS r FROM documents GROUP BY 1, 2) WHERE r <= 3"""
)
def fingerprint_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three commonest tags of each account, as shares of those kept."""
    counts = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    kept = R.top_per_group(counts, ["source"], [F.desc("n"), "lang"], 3).drop("rank")
    return kept.withColumn("share", F.round(R.share_of("n", ["source"]), 6))


@query(
    """WITH m AS (SELECT source, avg(CAST(quality AS DOUBLE)) AS q, avg(CAST(toxic AS DOUBLE)) AS t, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT source, n, round(q / (q + t), 4) AS quality, round(t / (q + t), 4) AS toxic FROM m WHERE q + t > 0"""
)
def fingerprint_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean label probabilities of an account, made to sum to 1."""
    m = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("quality").cast("double")).alias("q"), F.avg(F.col("toxic").cast("double")).alias("t"))
    total = F.col("q") + F.col("t")
    return m.where(total > 0).select("source", "n", F.round(F.col("q") / total, 4).alias("quality"), F.round(F.col("t") / total, 4).alias("toxic"))


@query(
    """SELECT user_id, count(*) AS posts, round(avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END), 6) AS reply_ratio,
 round(avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END), 6) AS repost_ratio,
 round(count(*) * 7.0 / greatest(date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)), 1), 4) AS per_week FROM events GROUP BY 1"""
)
def fingerprint_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda t: F.round(F.avg((F.col("event_type") == t).cast("double")), 6)
    days = F.greatest(F.datediff(F.max("ts"), F.min("ts")), F.lit(1))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("posts"), part("click").alias("reply_ratio"), part("purchase").alias("repost_ratio"), F.round(F.count(F.lit(1)) * 7.0 / days, 4).alias("per_week"))


@query(
    """SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') THEN 'core'
  WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'ring' WHEN c_acctbal > 0 THEN 'known' ELSE 'unseen' END AS ring FROM customer"""
)
def fingerprint_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cascade of existence tests: the first that holds."""
    seen = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.col("o_orderpriority") == "1-URGENT").alias("core"))
    rows = table(spark, sf_dir, "customer").join(seen, "c_custkey", "left")
    return rows.select("c_custkey", F.when(F.col("core"), "core").when(F.col("core").isNotNull(), "ring").when(F.col("c_acctbal") > 0, "known").otherwise("unseen").alias("ring"))


@query(
    """WITH claimed AS (SELECT o_orderkey AS k, o_orderstatus AS source, 4 AS n FROM orders), got AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1)
SELECT source, count(*) AS accounts, CAST(sum(coalesce(got.n, 0)) AS BIGINT) AS captured, round(avg(least(1.0, coalesce(got.n, 0) / claimed.n)), 6) AS mean_coverage,
 sum(CASE WHEN coalesce(got.n, 0) >= claimed.n THEN 1 ELSE 0 END)::BIGINT AS complete FROM claimed LEFT JOIN got USING (k) GROUP BY 1"""
)
def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of what is claimed was captured, by source."""
    got = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    rows = table(spark, sf_dir, "orders").join(got, "o_orderkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.groupBy(F.col("o_orderstatus").alias("source")).agg(F.count(F.lit(1)).alias("accounts"), F.sum("n").alias("captured"), F.round(F.avg(F.least(F.lit(1.0), F.col("n") / 4)), 6).alias("mean_coverage"), F.count_if(F.col("n") >= 4).alias("complete"))


@query("SELECT user_id, count(*) AS impressions, count(DISTINCT event_type) AS surfaces, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM events GROUP BY 1 ORDER BY impressions DESC, user_id LIMIT 30")
def exposure_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("impressions"), F.countDistinct("event_type").alias("surfaces"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_seen")).orderBy(F.desc("impressions"), "user_id").limit(30)


@query(
    """SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS term FROM documents)
WHERE term NOT IN ('the', 'and', 'der', 'die', 'des', 'les', 'que', 'los') GROUP BY 1 HAVING count(*) > 5 ORDER BY n DESC, term LIMIT 100"""
)
def keywords_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commonest tokens without stop words."""
    words = table(spark, sf_dir, "documents").select(F.explode(R.tokens(F.col("text"))).alias("term"))
    return words.where(~F.col("term").isin("the", "and", "der", "die", "des", "les", "que", "los")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).where("n > 5").orderBy(F.desc("n"), "term").limit(100)


@query("SELECT account, post FROM (SELECT o_custkey AS account, o_orderkey AS post, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def latest_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("account"), F.col("o_orderkey").alias("post"), "o_orderdate")
    return rows.groupBy("account").agg(F.max_by("post", F.struct("o_orderdate", "post")).alias("post"))


@query("SELECT p_brand, p_partkey, r AS rank FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 3")
def top3_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_per_group(table(spark, sf_dir, "part"), ["p_brand"], [F.desc("p_retailprice"), "p_partkey"], 3).select("p_brand", "p_partkey", "rank")


@query("SELECT p_partkey, p_brand, r AS round FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) ORDER BY r, p_brand, p_partkey LIMIT 40")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.round_robin(table(spark, sf_dir, "part"), "p_brand", [F.desc("p_retailprice"), "p_partkey"], 40, ["p_brand", "p_partkey"]).select("p_partkey", "p_brand", "round")


@query(
    """WITH t AS (SELECT o_custkey, l_suppkey, sum(l_extendedprice) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
 m AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY v DESC, l_suppkey) AS r FROM t)
SELECT o_custkey, l_suppkey, round(v / (SELECT sum(v) FROM t x WHERE x.o_custkey = m.o_custkey), 6) AS share FROM m WHERE r <= 2"""
)
def share_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = items(spark, sf_dir).groupBy("o_custkey", "l_suppkey").agg(F.sum("l_extendedprice").alias("v"))
    t = t.withColumn("share", F.round(R.share_of("v", ["o_custkey"]), 6))
    return R.top_per_group(t, ["o_custkey"], [F.desc("v"), "l_suppkey"], 2).select("o_custkey", "l_suppkey", "share")


@query(
    """WITH x AS (SELECT c_custkey AS id, c_acctbal + 1000 AS x FROM customer), o AS (SELECT list(x ORDER BY x) AS l FROM x)
SELECT id, round(least(1.0, x / l[least(CAST(floor(len(l) * 0.95) AS BIGINT), len(l) - 1) + 1]), 6) AS score, round((rank() OVER (ORDER BY x) - 1) / len(l), 6) AS percentile FROM x, o"""
)
def percentile_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores over the 95th percentile, and the share of smaller scores."""
    x = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") + 1000).alias("x"))
    return G.percentile_score(x).select("id", F.round("score", 6).alias("score"), F.round("percentile", 6).alias("percentile"))


@query(
    """SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'repost' WHEN event_type = 'click' THEN 'reply'
 WHEN date_diff('millisecond', lag(ts) OVER w, ts) <= 300000 OR date_diff('millisecond', ts, lead(ts) OVER w) <= 300000 THEN 'thread' ELSE 'post' END AS kind
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""
)
def thread_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of posts; posts at most five minutes from a neighbour are a thread."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ms = lambda a, b: F.unix_millis(b.cast("timestamp")) - F.unix_millis(a.cast("timestamp"))
    near = (ms(F.lag("ts").over(w), F.col("ts")) <= 300000) | (ms(F.col("ts"), F.lead("ts").over(w)) <= 300000)
    return table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "purchase", "repost").when(F.col("event_type") == "click", "reply").when(F.coalesce(near, F.lit(False)), "thread").otherwise("post").alias("kind"))


@query(
    """SELECT event_id, round(stddev_pop(value) OVER w, 6) AS spread, round(max(value) OVER w, 6) AS high, round(min(value) OVER w, 6) AS low, count(*) OVER w AS n
FROM events WINDOW w AS (PARTITION BY event_type, date_trunc('day', ts) ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)"""
)
def rolling_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread and range of the last 100 scores of a signal."""
    w = Window.partitionBy("event_type", F.date_trunc("day", "ts")).orderBy("ts", "event_id").rowsBetween(-99, 0)
    r = lambda c: F.round(c.over(w), 6)
    return table(spark, sf_dir, "events").select("event_id", r(F.stddev_pop("value")).alias("spread"), r(F.max("value")).alias("high"), r(F.min("value")).alias("low"), F.count(F.lit(1)).over(w).alias("n"))


@query("SELECT event_id, user_id FROM events WHERE (ts < TIMESTAMP '2024-01-15 00:00:00') OR (ts = TIMESTAMP '2024-01-15 00:00:00' AND event_id < 5000) ORDER BY ts DESC, event_id DESC LIMIT 51")
def cursor_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page after a cursor, with one row more; ties of the time are split by id."""
    import datetime

    cursor = {"ts": datetime.datetime(2024, 1, 15), "event_id": 5000}
    return R.page_after(table(spark, sf_dir, "events"), cursor, [("ts", True), ("event_id", True)], 50).select("event_id", "user_id")


@query("SELECT p_partkey, p_name FROM part ORDER BY p_size DESC, p_partkey LIMIT 20 OFFSET 40")
def offset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").orderBy(F.desc("p_size"), "p_partkey").offset(40).limit(20).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(lower(p_name), 'part') ORDER BY CASE WHEN p_size > 25 THEN NULL ELSE p_size END DESC NULLS LAST, p_partkey LIMIT 25")
def search_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by prefix whatever the case, best known first, unknown last."""
    size = F.when(F.col("p_size") <= 25, F.col("p_size"))
    return table(spark, sf_dir, "part").where(F.lower("p_name").startswith("part")).orderBy(size.desc_nulls_last(), "p_partkey").limit(25).select("p_partkey", "p_name")


@query(
    oracle(
        """, pool AS (SELECT dst, sum(n) AS n, row_number() OVER (ORDER BY sum(n) DESC, dst) AS r FROM follows GROUP BY 1),
 c AS (SELECT c_custkey AS src, pool.dst, pool.n FROM customer, pool WHERE r <= 40 AND NOT EXISTS (SELECT 1 FROM follows f WHERE f.src = c_custkey AND f.dst = pool.dst))
SELECT src, dst, CAST(k AS INTEGER) AS rank FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS k FROM c) WHERE k <= 3""".replace(", pool", "SELECT * FROM (WITH pool", 1)
        + ")",
        "follows",
    )
)
def recommend_not_followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each account the three best of a pool of 40 that it does not follow yet; the pool's size is fixed, so it is broadcast."""
    f = follows(spark, sf_dir)
    pool = f.groupBy("dst").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "dst").limit(40)
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("src")).crossJoin(F.broadcast(pool))
    return R.top_per_group(asked.join(f, ["src", "dst"], "left_anti"), ["src"], [F.desc("n"), "dst"], 3).select("src", "dst", "rank")


@query(
    """SELECT doc_id, CASE WHEN a AND b THEN 'both' WHEN b THEN 'labelled only' ELSE 'listed only' END AS category FROM
 (SELECT coalesce(x.doc_id, y.doc_id) AS doc_id, x.doc_id IS NOT NULL AS a, y.doc_id IS NOT NULL AS b
  FROM (SELECT doc_id FROM documents WHERE lang = 'en') x FULL JOIN (SELECT doc_id FROM labels WHERE quality = 1) y ON x.doc_id = y.doc_id)"""
)
def holdout_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A and B, only B, only A: one full join instead of three set operations."""
    a = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", F.lit(True).alias("a"))
    b = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id", F.lit(True).alias("b"))
    return a.join(b, "doc_id", "full_outer").select("doc_id", F.when(F.col("a") & F.col("b"), "both").when(F.col("b"), "labelled only").otherwise("listed only").alias("category"))


@query("(SELECT doc_id, 'left' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) UNION ALL (SELECT doc_id, 'right' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents))")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.differs(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id"))


@query(
    """SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS hits, count(*) FILTER (b IS NULL) AS missing, count(*) FILTER (a IS NULL) AS extra,
 round(100.0 * count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) / count(*) FILTER (a IS NOT NULL), 2) AS coverage_pct,
 round(100.0 * count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) / count(*) FILTER (b IS NOT NULL), 2) AS precision_pct
FROM (SELECT x.doc_id AS a, y.doc_id AS b FROM documents x FULL JOIN labels y ON x.doc_id = y.doc_id)"""
)
def overlap_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.overlap(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query(
    """SELECT count(*) AS rows, count(*) FILTER (c_acctbal < 0) AS negative, count(*) FILTER (c_name IS NULL) AS unnamed,
 count(*) FILTER (NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS no_edges, count(*) FILTER (c_mktsegment LIKE 'A%') AS by_channel FROM customer"""
)
def quality_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("active", F.lit(1))
    rows = table(spark, sf_dir, "customer").join(active, "c_custkey", "left")
    return R.quality_counters(rows, {"negative": F.col("c_acctbal") < 0, "unnamed": F.col("c_name").isNull(), "no_edges": F.col("active").isNull(), "by_channel": F.col("c_mktsegment").startswith("A")})


@query(
    """SELECT o_orderpriority, CAST(o_orderstatus = 'F' AS INTEGER) AS failed, count(*) AS runs, round(avg(o_totalprice), 2) AS mean_cost, CAST(round(10000 * avg(CASE WHEN o_totalprice > 100000 THEN 1.0 ELSE 0.0 END)) AS BIGINT) AS coverage_e4
FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' GROUP BY 1, 2"""
)
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary of runs of a period by outcome; coverage in ten-thousandths."""
    rows = table(spark, sf_dir, "orders").where("o_orderdate >= TIMESTAMP '2000-01-01'")
    return rows.groupBy("o_orderpriority", (F.col("o_orderstatus") == "F").cast("int").alias("failed")).agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg("o_totalprice"), 2).alias("mean_cost"), F.round(10000 * F.avg((F.col("o_totalprice") > 100000).cast("double"))).cast("long").alias("coverage_e4"))


@query(oracle("SELECT id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT src AS id, 1 AS o, 0 AS i FROM purchases UNION ALL SELECT dst, 0, 1 FROM purchases) GROUP BY 1", "purchases"))
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(purchases(spark, sf_dir))


@query(
    oracle(
        """SELECT p.src, p.dst FROM purchases p JOIN k a ON p.src = a.id JOIN k b ON p.dst = b.id""",
        "purchases",
        more={"k": "SELECT dst AS id FROM purchases GROUP BY 1 HAVING count(*) >= 12"},
    )
)
def pruned_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.pruned(purchases(spark, sf_dir).select("src", "dst"), 12)


@query(
    """SELECT event_type, CAST(percentile_cont(0.5) WITHIN GROUP (ORDER BY value) AS DOUBLE) AS median_last3, user_id FROM
 (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 3 GROUP BY event_type, user_id"""
)
def median_last3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median cost of the last three runs of a key."""
    last = R.top_per_group(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")], 3)
    return last.groupBy("user_id", "event_type").agg(F.percentile("value", F.lit(0.5)).alias("median_last3"))


@query("SELECT p_brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types, count(*) AS n FROM part WHERE p_size <= 10 GROUP BY 1")
def tag_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_size <= 10").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("types"), F.count(F.lit(1)).alias("n"))


@query(
    """SELECT p_type, count(*) FILTER (p_size > 25) AS n_in, count(*) FILTER (p_size <= 25) AS n_not_in FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) GROUP BY 1"""
)
def cluster_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of one cluster's members by polarity."""
    part = table(spark, sf_dir, "part")
    member = part.agg(F.min("p_brand").alias("p_brand"))
    return part.join(F.broadcast(member), "p_brand", "left_semi").groupBy("p_type").agg(F.count_if(F.col("p_size") > 25).alias("n_in"), F.count_if(F.col("p_size") <= 25).alias("n_not_in"))


@query(
    """SELECT source, label, n, round(n / sum(n) OVER (PARTITION BY source), 6) AS share FROM (SELECT d.source, e.label, count(*) AS n FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id GROUP BY 1, 2)"""
)
def cluster_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label"), "doc_id")
    return rows.groupBy("source", "label").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.round(R.share_of("n", ["source"]), 6))


@query(
    """SELECT round(avg(p), 6) AS purity, count(*) AS children FROM (SELECT p_type, max(n) / sum(n) AS p FROM (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY 1, 2) GROUP BY 1)"""
)
def nesting_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over fine clusters of the greatest share that lies in one coarse cluster."""
    n = table(spark, sf_dir, "part").groupBy("p_type", "p_brand").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("p_type").agg((F.max("n") / F.sum("n")).alias("p")).agg(F.round(F.avg("p"), 6).alias("purity"), F.count(F.lit(1)).alias("children"))


@query(
    """WITH RECURSIVE walk AS (SELECT conv_id, turn, turn AS at, 0 AS depth FROM conversations UNION ALL
 SELECT w.conv_id, w.turn, c.turn, depth + 1 FROM walk w JOIN conversations c ON c.conv_id = w.conv_id AND c.turn = w.at - 1 WHERE depth < 5)
SELECT conv_id, turn, CAST(max(depth) AS INTEGER) AS ancestors FROM walk GROUP BY 1, 2"""
)
def reply_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the five turns before each turn are there, one after the other."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    w = Window.partitionBy("conv_id").orderBy("turn")
    chain = turns
    for depth in range(1, 6):
        there = F.lag("turn", depth).over(w) == F.col("turn") - depth
        chain = chain.withColumn(f"_{depth}", F.coalesce(there, F.lit(False)))
    return chain.select("conv_id", "turn", sum((F.col(f"_{d}").cast("int") for d in range(1, 6)), F.lit(0)).alias("ancestors"))


@query(
    """SELECT page_id, len(list_distinct(list_transform(regexp_extract_all(html, 'href="/([^"]*)"', 1), lambda x: lower(x)))) AS n_links,
 list_sort(list_distinct(list_transform(regexp_extract_all(html, 'href="/([^"]*)"', 1), lambda x: lower(x))))[1] AS first_link FROM pages"""
)
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names linked from a page: extracted, lower-cased, distinct, in order."""
    links = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1)), F.lower)))
    return table(spark, sf_dir, "pages").select("page_id", F.size(links).alias("n_links"), F.element_at(links, 1).alias("first_link"))
