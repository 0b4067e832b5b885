"""Reading archives, snapshots and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L = T.StringType(), T.LongType()


def _row(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_TWEET = _row(id_str=_S, full_text=_S, created_at=_S, in_reply_to_status_id_str=_S, in_reply_to_screen_name=_S, favorite_count=_S, retweet_count=_S, lang=_S)
_NOTE = _row(noteTweetId=_S, createdAt=_S, core=_row(text=_S))
_LIKE = _row(tweetId=_S, fullText=_S, expandedUrl=_S)
ARCHIVE = T.StructType([
    T.StructField("account_id", _S), T.StructField("username", _S),
    T.StructField("tweets", T.ArrayType(_row(tweet=_TWEET))), T.StructField("community-tweet", T.ArrayType(_row(tweet=_TWEET))),
    T.StructField("note-tweet", T.ArrayType(_row(noteTweet=_NOTE))), T.StructField("like", T.ArrayType(_row(like=_LIKE))),
    T.StructField("follower", T.ArrayType(_row(follower=_row(accountId=_S)))), T.StructField("following", T.ArrayType(_row(following=_row(accountId=_S)))),
    T.StructField("profile", T.ArrayType(_row(profile=_row(description=_row(bio=_S, website=_S, location=_S))))),
])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One account's archive a file, with a fixed schema: nothing is inferred."""
    return spark.read.schema(ARCHIVE).option("multiLine", True).json(path)


def twitter_time(c: Column) -> Column:
    """``Tue Nov 25 03:54:12 +0000 2025`` or ISO 8601 as a timestamp; null for neither."""
    return F.coalesce(F.try_to_timestamp(F.substring(c, 5, 30), F.lit("MMM dd HH:mm:ss Z yyyy")), F.try_to_timestamp(c))


def tweets(archives: DataFrame) -> DataFrame:
    """Posts of both sections and long notes; reposts (RT @) are left out."""
    both = F.concat(F.coalesce("tweets", F.array().cast(ARCHIVE["tweets"].dataType)), F.coalesce(F.col("`community-tweet`"), F.array().cast(ARCHIVE["tweets"].dataType)))
    rows = archives.select("account_id", "username", F.explode(both).alias("x")).select(
        "account_id", "username", F.col("x.tweet.id_str").alias("tweet_id"), F.col("x.tweet.full_text").alias("full_text"), twitter_time(F.col("x.tweet.created_at")).alias("created_at"), F.col("x.tweet.in_reply_to_status_id_str").alias("reply_to_tweet_id"), F.col("x.tweet.in_reply_to_screen_name").alias("reply_to_username"), F.col("x.tweet.favorite_count").try_cast("long").alias("favorite_count"), F.col("x.tweet.retweet_count").try_cast("long").alias("retweet_count"), F.col("x.tweet.lang").alias("lang"), F.lit(0).alias("is_note_tweet")
    )
    notes = archives.select("account_id", "username", F.explode("`note-tweet`").alias("x")).select("account_id", "username", F.col("x.noteTweet.noteTweetId").alias("tweet_id"), F.col("x.noteTweet.core.text").alias("full_text"), twitter_time(F.col("x.noteTweet.createdAt")).alias("created_at"), F.lit(1).alias("is_note_tweet"))
    return rows.where(~F.col("full_text").startswith("RT @")).unionByName(notes, allowMissingColumns=True)


def reposts(archives: DataFrame) -> DataFrame:
    rows = archives.select("account_id", F.explode("tweets").alias("x")).where(F.col("x.tweet.full_text").startswith("RT @"))
    return rows.select("account_id", F.col("x.tweet.id_str").alias("tweet_id"), F.lower(F.regexp_extract("x.tweet.full_text", r"^RT @(\w+)", 1)).alias("rt_of_username"), twitter_time(F.col("x.tweet.created_at")).alias("created_at"))


def likes(archives: DataFrame) -> DataFrame:
    return archives.select(F.col("account_id").alias("liker_account_id"), F.explode("like").alias("x")).select("liker_account_id", F.col("x.like.tweetId").alias("tweet_id"), F.col("x.like.fullText").alias("full_text"), F.col("x.like.expandedUrl").alias("expanded_url"))


def following(archives: DataFrame) -> DataFrame:
    return archives.select("account_id", F.explode("following").alias("x")).select("account_id", F.col("x.following.accountId").alias("following_account_id"))


def followers(archives: DataFrame) -> DataFrame:
    return archives.select("account_id", F.explode("follower").alias("x")).select("account_id", F.col("x.follower.accountId").alias("follower_account_id"))


def profiles(archives: DataFrame) -> DataFrame:
    p = F.element_at("profile", 1)["profile"]["description"]
    return archives.where(F.size("profile") > 0).select("account_id", "username", p["bio"].alias("bio"), p["location"].alias("location"), p["website"].alias("website"))


def sampled_posts(posts: DataFrame, liked: int = 20, last: int = 10) -> DataFrame:
    """Of each account its most liked posts and the last in file order (``position``), once each."""
    top = F.row_number().over(Window.partitionBy("account_id").orderBy(F.desc_nulls_last("favorite_count"), "tweet_id"))
    end = F.row_number().over(Window.partitionBy("account_id").orderBy(F.desc("position")))
    return posts.withColumns({"_t": top, "_e": end}).where((F.col("_t") <= liked) | (F.col("_e") <= last)).drop("_t", "_e").dropDuplicates(["tweet_id"])


def drawn_posts(posts: DataFrame, per_account: int, seed: int) -> DataFrame:
    """A seeded sample of each account's posts that is the same on every run."""
    order = Window.partitionBy("account_id").orderBy(F.xxhash64("tweet_id", F.lit(seed)), "tweet_id")
    return posts.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_account).drop("_r")


def documents_of(posts: DataFrame) -> DataFrame:
    """Each account's posts as one text, in order of time."""
    one = F.transform(F.array_sort(F.collect_list(F.struct("created_at", "tweet_id", "full_text"))), lambda x: x["full_text"])
    return posts.groupBy("account_id").agg(F.array_join(one, " ").alias("text"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="tweet_id string, account_id string, full_text string", multiLine=True, escape='"')


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Lines of JSON with blank ones skipped; a damaged line is kept in ``_corrupt_record``."""
    return spark.read.schema(schema.add("_corrupt_record", _S)).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def is_stale(fetches: DataFrame, key: str, days: int) -> DataFrame:
    """Per key whether its newest fetch is older than the limit."""
    return fetches.groupBy(key).agg((F.max("fetched_at") < F.current_timestamp() - F.make_interval(days=F.lit(days))).alias("stale"))


def handles_in(html: Column) -> Column:
    """User names linked in a page: lower case, distinct, plain ones first."""
    names = F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(r"(?:twitter|x)\.com/([A-Za-z0-9_]{1,15})"), F.lit(1)), F.lower))
    under = lambda x: F.length(x) - F.length(F.regexp_replace(x, "_", ""))
    return F.transform(F.array_sort(F.transform(names, lambda x: F.struct(under(x).alias("u"), x.alias("n")))), lambda x: x["n"])
