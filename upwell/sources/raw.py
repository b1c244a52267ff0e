"""From raw cards, detail pages and API items to posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from upwell.config import THRESHOLDS, Thresholds
from upwell.functions import text
from upwell.schema import API_ITEM, CARD, DETAIL, STATUS


class SourceUnavailable(RuntimeError):
    """A source that cannot be read; ``expired`` tells a session that ended."""

    def __init__(self, message: str, expired: bool = False):
        super().__init__(message)
        self.expired = expired


class SessionExpired(SourceUnavailable):
    """A source whose session has ended."""

    def __init__(self, message: str):
        super().__init__(message, True)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON rows by a fixed schema; malformed rows become nulls, which the parsers drop."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, API_ITEM)


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, CARD)


def read_details(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, DETAIL)


def read_status(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATUS).option("multiLine", True).json(path)


def extract_cards(cards: DataFrame) -> DataFrame:
    """Posts of search cards; cards without link or id are dropped.

    A missing time is the time of collection. Quotes, bookmarks and impressions aren't on cards.
    """
    parsed = cards.filter("href is not null and href <> ''").withColumn("post_id", text.post_id(F.col("href"))).filter("post_id <> ''")
    return parsed.select(
        "post_id",
        text.handle(F.col("user_href")).alias("author_handle"),
        text.absolute_url(F.col("href")).alias("url"),
        text.snippet(F.col("body")).alias("text_snippet"),
        F.coalesce(text.iso_time(F.col("datetime")), F.col("observed_at")).alias("posted_at"),
        text.label_count(F.col("like_label")).alias("likes"),
        text.label_count(F.col("retweet_label")).alias("retweets"),
        text.label_count(F.col("reply_label")).alias("replies"),
        F.lit(0).cast("long").alias("quotes"),
        F.lit(0).cast("long").alias("bookmarks"),
        F.lit(None).cast("long").alias("impressions"),
        "ingest_seq",
        "observed_at",
    )


def parse_details(details: DataFrame) -> DataFrame:
    body = F.col("detail_text")
    return details.withColumn("impressions", text.impressions(body)).withColumn("bookmarks", text.bookmarks(body)).drop("detail_text")


def count_quotes(listing: DataFrame) -> DataFrame:
    """``post_id, quotes``: distinct labels seen in a post's quote listing; nulls don't count."""
    return listing.groupBy("post_id").agg(F.count_distinct("label").alias("quotes"))


def normalize_items(items: DataFrame) -> DataFrame:
    """Posts of API items; items without id are dropped, missing counters are 0."""
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return items.filter("id is not null and id <> ''").select(
        F.col("id").alias("post_id"),
        F.coalesce(F.col("author.userName"), F.lit("")).alias("author_handle"),
        F.coalesce(F.col("url"), F.col("twitterUrl"), F.lit("")).alias("url"),
        text.legacy_time(F.col("createdAt")).alias("posted_at"),
        text.snippet(F.col("text")).alias("text_snippet"),
        number("likeCount").alias("likes"),
        number("retweetCount").alias("retweets"),
        number("replyCount").alias("replies"),
        F.lit(0).cast("long").alias("quotes"),
        F.lit(0).cast("long").alias("bookmarks"),
        *(["ingest_seq"] if "ingest_seq" in items.columns else []),
    )


def source_predicate(cards: DataFrame, t: Thresholds = THRESHOLDS) -> DataFrame:
    """What the search source filters itself; over Parquet it is pushed to the scan."""
    return cards.filter((F.col("lang") == "ja") & (F.col("likes") >= t.source_likes) & (F.col("replies") >= t.source_replies) & ~F.col("is_repost"))
