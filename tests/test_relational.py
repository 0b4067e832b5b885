import datetime
import json

import pytest
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.operators import clusters as C
from graphloom.operators import evaluation as E
from graphloom.operators import relational as R
from graphloom.sources import archive, sinks
from graphloom.streaming import feed


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()[0]


def test_parsers(spark):
    rows = {"bits:alpha:+3": ("alpha", 3), "BITS: beta :-2": ("beta", -2), "bits:x": None, "other:x:1": None, "bits:x:y": None, None: None}
    df = spark.createDataFrame([(k,) for k in rows], "t string").select("t", S.bits_tag(F.col("t")).alias("b"))
    assert {r.t: (r.b.name, r.b.bits) if r.b else None for r in df.collect()} == rows
    counts = {"90.5K Followers": 90500, "1,234": 1234, "2M": 2000000, "none": None}
    df = spark.createDataFrame([(k,) for k in counts], "t string").select("t", S.compact_count(F.col("t")).alias("n"))
    assert {r.t: r.n for r in df.collect()} == counts
    assert {one(spark, S.handle(F.lit(x))) for x in ("user_a", " @USER_A", "@@user_a")} == {"user_a"}
    assert one(spark, S.slug(F.lit(" Hello,  World! "))) == "hello-world"


def test_scores(spark):
    assert [one(spark, S.decay(F.lit(x), 10.0)) for x in (0, 10, 20)] == pytest.approx([1, 0.5, 0.25])
    assert one(spark, S.entropy(F.array(F.lit(1.0), F.lit(1.0)), 2.0)) == pytest.approx(1)
    assert one(spark, S.entropy(F.array(F.lit(0.0)))) == 0
    assert one(spark, S.total_variation(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0)))) == 1
    assert [one(spark, S.path_score(F.lit(d))) for d in (1, 3, 4)] == pytest.approx([1, 0.1, 0])
    assert one(spark, S.valid_distribution(F.array(F.lit(0.5), F.lit(0.4)))) == "sum"
    assert S.weights_normalised({"a": 2, "b": -1}, {"a": 0.5, "b": 0.5}) == {"a": 1.0, "b": 0.0}
    assert S.weights_normalised({}, {"a": 0.5, "b": 0.5}) == {"a": 0.5, "b": 0.5}


def test_upsert_merge_and_pages(spark):
    t = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k long, v string, w string")
    n = spark.createDataFrame([(2, "B", None), (3, "c", "z")], "k long, v string, w string")
    assert sorted(map(tuple, R.upsert(t, n, ["k"]).collect())) == [(1, "a", "x"), (2, "B", None), (3, "c", "z")]
    assert sorted(map(tuple, R.upsert(t, n, ["k"], fill=True).collect()))[1] == (2, "B", "y")
    assert [r.k for r in R.insert_ignored(t, n, ["k"], ["v"]).collect()] == [3]
    assert sorted(r.k for r in R.replaced(t, n, ["k"]).collect()) == [1, 2, 3]
    assert R.differs(t, t).count() == 0
    e = spark.createDataFrame([("a1", "b", 3), ("a", "b", 5), ("b", "a1", 1)], "src string, dst string, n long")
    ids = spark.createDataFrame([("a1", "a")], "old string, new string")
    assert sorted(map(tuple, R.merged_accounts(e, ids, ("src", "dst"), ["n"]).collect())) == [("a", "b", 5), ("b", "a", 1)]
    page = R.page_after(spark.range(10), {"id": 4}, [("id", False)], 2)
    assert [r.id for r in page.collect()] == [5, 6, 7]


def test_evaluation_by_hand(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.7, 0), (0.1, 0)], "p double, y int")
    assert E.roc_auc(df, "p", "y").first()[0] == pytest.approx((3 + 1.5) / 6)
    assert E.average_precision(df, "p", "y").first()[0] == pytest.approx((1 + 2 / 4) / 2)
    assert E.best_threshold(df, "p", "y").first().f1 == pytest.approx(2 / 3)
    votes = spark.createDataFrame([("a", -3), ("b", 2), ("b", 1), ("c", 1), ("c", 4), ("c", -2)], "k string, v int")
    assert {r.k: r.consensus for r in E.consensus(votes, "k", "v").collect()} == {"a": 1, "b": 1, "c": 1}
    assert E.gini(spark.createDataFrame([(1.0,), (1.0,), (1.0,)], "x double"), "x").first()[0] == pytest.approx(0)


def test_dendrogram():
    d = C.Dendrogram([(5, 0, 1), (6, 2, 3), (7, 5, 6), (8, 7, 4)])
    assert d.leaves(8) == [0, 1, 2, 3, 4] and d.sibling(5) == 6 and d.is_descendant(0, 7)
    assert d.collapsed([5, 6, 4], 5) == [4, 7]
    assert 3 in d.revealed([8], 3, 10)
    assert len(d.expanded([8], 8)) >= 3
    assert C.bridge_paths({1: {2}, 2: {1, 3}, 3: {2}}, {2: 0.5}, {3}, {1}) == {2}


EVENTS = [
    {"accountId": "acct_1", "username": "u", "tweetId": "t1", "tweetText": "deep meditation", "surface": "home", "position": 1, "seenAt": "2025-01-01T00:00:00Z"},
    {"accountId": "acct_1", "username": "u", "tweetId": "t1", "tweetText": "deep meditation", "surface": "home", "position": 1, "seenAt": "2025-01-01T00:00:00Z"},
    {"accountId": "acct_1", "username": "u", "tweetId": "t2", "tweetText": "meaning", "surface": "search", "position": 2, "seenAt": "2025-01-02T00:00:00Z"},
    {"accountId": "acct_2", "username": "v", "tweetId": "t3", "tweetText": " ", "surface": "home", "position": 3, "seenAt": "2025-01-02T01:00:00Z"},
    {"accountId": " ", "username": "w", "tweetId": "t4", "tweetText": "x", "surface": "home", "position": 4, "seenAt": "2025-01-02T01:00:00Z"},
]


def test_ingest_counts_and_rollup(spark, tmp_path):
    raw = spark.createDataFrame([tuple(e.get(f.name) for f in feed.EVENT) for e in EVENTS], feed.EVENT)
    store = f"file://{tmp_path}/store"
    got = feed.ingest(feed.normalised(raw), store)
    assert got == {"total": 5, "inserted": 3, "duplicates": 1, "failed": 1, "errors": ["no account"]}
    assert feed.ingest(feed.normalised(raw), store)["inserted"] == 0
    roll = feed.rollup(spark.read.parquet(f"{store}/events"))
    rows = {(r.account_id, r.tweet_id): (r.seen_count, r.text, r.surface) for r in roll.collect()}
    assert rows == {("acct_1", "t1"): (1, "deep meditation", "home"), ("acct_1", "t2"): (1, "meaning", "search"), ("acct_2", "t3"): (1, None, "home")}


def test_stream_of_logs(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    line = lambda role, event: json.dumps({"eventType": "seen", "workspaceId": "w", "ego": "e", "participant": role, "payload": event})
    (folder / "a.ndjson").write_text("\n".join([line("participant", EVENTS[0]), "", line(None, EVENTS[2]), "{broken", line("spectator", EVENTS[3])]))
    passed = feed.relayed(feed.tail(spark, f"file://{folder}")).where("payload IS NOT NULL")
    store = f"file://{tmp_path}/out"
    counts = []
    each = lambda batch, _: counts.append(feed.ingest(feed.normalised(batch.select("payload.*")), store))
    for _ in range(2):
        feed.run(passed, each, f"{tmp_path}/ck").awaitTermination(120)
    assert [c["inserted"] for c in counts] == [2]
    (folder / "b.ndjson").write_text(line(None, EVENTS[1]))
    feed.run(passed, each, f"{tmp_path}/ck").awaitTermination(120)
    assert spark.read.parquet(f"{store}/events").count() == 3


def test_archives(spark, tmp_path):
    tweet = lambda i, text, likes: {"tweet": {"id_str": i, "full_text": text, "created_at": "Tue Nov 25 03:54:12 +0000 2025", "favorite_count": likes, "retweet_count": "0", "lang": "en"}}
    body = {"account_id": "1", "username": "u", "tweets": [tweet("10", "hello", "3"), tweet("11", "RT @Other: x", "9")], "community-tweet": [tweet("12", "there", "x")], "note-tweet": [{"noteTweet": {"noteTweetId": "13", "createdAt": "2025-11-25T00:00:00Z", "core": {"text": "long"}}}], "like": [{"like": {"tweetId": "5", "fullText": "t"}}], "follower": [{"follower": {"accountId": "2"}}], "following": [{"following": {"accountId": "3"}}], "profile": [{"profile": {"description": {"bio": "b"}}}]}
    (tmp_path / "a.json").write_text(json.dumps(body))
    a = archive.read_archives(spark, f"file://{tmp_path}/a.json")
    got = {r.tweet_id: (r.full_text, r.favorite_count, r.is_note_tweet) for r in archive.tweets(a).collect()}
    assert got == {"10": ("hello", 3, 0), "12": ("there", None, 0), "13": ("long", None, 1)}
    assert archive.tweets(a).where("tweet_id = '10'").first().created_at == datetime.datetime(2025, 11, 25, 3, 54, 12)
    assert [r.rt_of_username for r in archive.reposts(a).collect()] == ["other"]
    assert archive.likes(a).count() == archive.followers(a).count() == archive.following(a).count() == archive.profiles(a).count() == 1
    names = spark.createDataFrame([("x.com/b_c twitter.com/Zed x.com/zed",)], "h string").select(archive.handles_in(F.col("h"))).first()[0]
    assert names == ["zed", "b_c"]


def test_snapshots_and_branches(spark, tmp_path):
    path = f"file://{tmp_path}/snap"
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    assert sinks.snapshot({"nodes": df}, path, note="x")["rows"] == {"nodes": 2}
    assert sinks.active(spark, path, "nodes").count() == 2
    sinks.snapshot({"nodes": df.where("k = 1")}, path)
    assert sinks.active(spark, path, "nodes").count() == 1
    table = f"file://{tmp_path}/table"
    sinks.merge_into(df, table, ["k"])
    sinks.merge_into(spark.createDataFrame([(2, "B"), (3, "c")], "k long, v string"), table, ["k"])
    assert sorted(map(tuple, spark.read.parquet(table).collect())) == [(1, "a"), (2, "B"), (3, "c")]
    kept = sinks.branch_capture({"nodes": df})
    assert not sinks.is_dirty(kept, sinks.branch_capture({"nodes": df}))
    assert sinks.is_dirty(kept, sinks.branch_capture({"nodes": df.where("k = 1")}))
    assert sorted(map(tuple, sinks.branch_restore(kept, "nodes", df.schema).collect())) == [(1, "a"), (2, "b")]
