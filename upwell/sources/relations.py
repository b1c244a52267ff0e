"""Post relations derived from the test tables, whole tables each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keyword list of the test relations, in order.
KEYWORDS = ["earthquake drill", "earthquake", "地震", "台風", "flood", "outage", "recall", "事件", "license", "token"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One post per event; its text comes from the document of the event's number, modulo their count.

    Where doc_ids have holes, events that fall into one have no post.
    """
    events = read(spark, sf_dir, "events").withColumn("posted_at", F.col("ts").cast("timestamp"))
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    n = docs.agg(F.count("*").alias("n"))
    e = F.col("event_id")
    # only the part of a text that a post shows goes through the join
    lead = docs.select("doc_id", F.substring("text", 1, 200).alias("lead"))
    keyed = events.withColumn("doc_key", F.pmod(e, n.scalar()))
    joined = keyed.join(lead, keyed["doc_key"] == lead["doc_id"])
    words = F.array(*map(F.lit, KEYWORDS))
    word = F.get(words, F.pmod(F.floor(e / 4), F.lit(len(KEYWORDS))).cast("int"))
    text = F.when(e % 4 == 0, F.concat(word, F.lit(" "), F.col("lead"))).otherwise(F.col("lead"))
    return joined.select(
        e.alias("ingest_seq"),
        e.cast("string").alias("post_id"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("author_handle"),
        F.concat(F.lit("https://x.com/user_"), F.col("user_id").cast("string"), F.lit("/status/"), e.cast("string")).alias("url"),
        F.substring(text, 1, 200).alias("text_snippet"),
        "posted_at",
        (F.col("posted_at") + F.make_dt_interval(mins=(e * 37 % 480).cast("int"))).alias("observed_at"),
        (e * 7919 % 6000).alias("likes"),
        (e * 6151 % 500).alias("retweets"),
        (e * 3571 % 400).alias("replies"),
        (e * 2741 % 300).alias("quotes"),
        (e * 4409 % 700).alias("bookmarks"),
        F.when(e % 5 != 0, e * 9973 % 600000).alias("impressions"),
        F.col("user_id"),
    )


def known_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored post ids of the test state."""
    return read(spark, sf_dir, "events").filter("event_id % 7 = 0").select(F.col("event_id").cast("string").alias("post_id"))


def author_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = read(spark, sf_dir, "events").select("user_id").distinct().filter("user_id % 3 = 0")
    at = F.lit("2024-01-16 00:00:00").cast("timestamp") + F.make_dt_interval(mins=F.col("user_id").cast("int"))
    return users.select(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("author_handle"), at.alias("last_notified_at"))


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The sightings of the two search modes, with the order of collection in ``seq``."""
    live = posts(spark, sf_dir).withColumn("seq", F.col("ingest_seq"))
    n = read(spark, sf_dir, "events").agg(F.count("*").alias("n"))
    top = live.filter("ingest_seq % 3 = 0").withColumn("seq", F.col("ingest_seq") + n.scalar())
    return live, top.withColumn("likes", F.col("likes") + 100).withColumn("retweets", F.col("retweets") + 10)


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``post_id, view_count, seq`` as a second source returns them, some twice."""
    ev = read(spark, sf_dir, "events").filter("event_id % 6 <> 0")
    e = F.col("event_id")
    n = read(spark, sf_dir, "events").agg(F.count("*").alias("n"))
    first = ev.select(e.cast("string").alias("post_id"), F.when(e % 5 != 0, e * 9973 % 600000).alias("view_count"), e.alias("seq"))
    again = ev.filter("event_id % 11 = 0").select(e.cast("string").alias("post_id"), F.when(e % 5 != 0, e * 9973 % 600000 + 1).alias("view_count"), (e + n.scalar()).alias("seq"))
    return first.unionByName(again)


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw search cards that render the posts, some malformed."""
    p = posts(spark, sf_dir)
    e = F.col("ingest_seq")
    label = lambda word, c: F.when(e % 4 == 1, F.concat(F.lit(f"{word} "), F.format_number(c, 0))).when(e % 4 == 2, F.concat(F.lit(f"{word} "), (c / 1000).cast("int").cast("string"), F.lit(".5K"))).when(e % 4 == 3, F.lit(f"{word}")).otherwise(F.concat(F.lit(f"{word} "), c.cast("string"), F.lit("件")))
    return p.select(
        "ingest_seq",
        F.when(e % 10 == 9, F.lit("/explore")).when(e % 10 == 8, F.concat(F.lit("https://x.com/user/status/"), F.col("post_id"))).otherwise(F.concat(F.lit("/"), F.col("author_handle"), F.lit("/status/"), F.col("post_id"))).alias("href"),
        F.when(e % 13 != 0, F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).alias("datetime"),
        F.concat(F.lit("/"), F.col("author_handle"), F.when(e % 2 == 0, "/").otherwise("/media")).alias("user_href"),
        F.col("text_snippet").alias("body"),
        label("Reply", F.col("replies")).alias("reply_label"),
        label("Repost", F.col("retweets")).alias("retweet_label"),
        label("Like", F.col("likes")).alias("like_label"),
        "observed_at",
    )


def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw detail texts of the posts."""
    e = F.col("ingest_seq")
    n = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("0"))
    usual = F.concat_ws("\n", F.concat(n("impressions"), F.lit(" Views")), n("replies"), n("retweets"), n("likes"), F.concat(n("bookmarks"), F.lit(",0")), F.lit("Relevant"), F.lit("99"))
    text = (
        F.when(e % 6 == 1, F.concat(F.lit("1.2万 view 5 6 7K Relevant 8"), F.lit("")))
        .when(e % 6 == 2, F.lit("no statistics 1 2 3 4"))
        .when(e % 6 == 3, F.concat_ws(" ", F.lit("3K VIEWS"), n("replies"), n("retweets"), n("likes"), F.lit("1.5K"), F.lit("77")))
        .otherwise(usual)
    )
    return posts(spark, sf_dir).select("ingest_seq", "post_id", "url", text.alias("detail_text"))


def api_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw items of the second source in their nested shape."""
    e = F.col("ingest_seq")
    return posts(spark, sf_dir).select(
        "ingest_seq",
        F.when(e % 9 != 0, F.col("post_id")).alias("id"),
        F.when(e % 4 == 0, F.col("url")).alias("url"),
        F.when(e % 4 < 3, F.concat(F.lit("https://alt.example/"), F.col("post_id"))).alias("twitterUrl"),
        F.when(e % 5 == 0, F.lit("not a date")).otherwise(F.concat(F.lit("Tue "), F.date_format("posted_at", "MMM dd HH:mm:ss"), F.lit(" +0000 "), F.date_format("posted_at", "yyyy"))).alias("createdAt"),
        F.concat(F.col("text_snippet"), F.lit(" tail")).alias("text"),
        F.struct(F.when(e % 8 != 0, F.col("author_handle")).alias("userName")).alias("author"),
        F.when(e % 3 != 0, F.col("likes")).alias("likeCount"),
        F.col("retweets").alias("retweetCount"),
        F.when(e % 7 != 0, F.col("replies")).alias("replyCount"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """720 hourly runs with their numbers of scanned posts."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    hour = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(start)) / F.lit(3_600_000_000))
    per_hour = read(spark, sf_dir, "events").groupBy(hour.cast("long").alias("hr")).agg(F.count("*").alias("n"))
    hours = spark.range(720).withColumnRenamed("id", "hr")
    scanned = F.when(F.floor(F.col("hr") / 5) % 3 == 0, 0).otherwise(1 + F.coalesce("n", F.lit(0)))
    return hours.join(per_hour, "hr", "left").select(
        (F.col("hr") + 1).alias("run_id"), (start + F.make_dt_interval(hours=F.col("hr").cast("int"))).alias("started_at"), scanned.cast("long").alias("posts_scanned")
    )
