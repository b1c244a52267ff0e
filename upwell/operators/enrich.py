"""Prefilters and the joins that add what search cards lack."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upwell.config import THRESHOLDS, Thresholds
from upwell.functions import detect
from upwell.operators.keywords import matches


def prefilter(posts: DataFrame, keywords: list[str], t: Thresholds = THRESHOLDS) -> DataFrame:
    """Posts worth a look at their detail page."""
    busy = (detect.count("likes") >= t.detail_likes) | (detect.count("replies") >= t.detail_replies)
    return posts.filter(busy & (detect.elapsed_hours(t) <= t.sustained_max_hours) & matches(F.col("text_snippet"), keywords))


def add_details(posts: DataFrame, details: DataFrame, keywords: list[str], t: Thresholds = THRESHOLDS) -> DataFrame:
    """Counters of detail pages for prefiltered posts; others get none.

    ``details(post_id, quotes, bookmarks, impressions)`` has one row per post.
    """
    wanted = prefilter(posts, keywords, t).select("post_id")
    seen = details.join(wanted, "post_id", "left_semi").select("post_id", "quotes", "bookmarks", "impressions")
    bare = posts.drop("quotes", "bookmarks", "impressions")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return bare.join(seen, "post_id", "left").select(*bare.columns, zero("quotes"), zero("bookmarks"), F.col("impressions").cast("long"))


def last_views(views: DataFrame) -> DataFrame:
    """One count per post: the last row wins, a null count is 0."""
    last = views.groupBy("post_id").agg(F.max_by(F.struct("view_count"), "seq").alias("v"))
    return last.select("post_id", F.coalesce("v.view_count", F.lit(0)).alias("impressions"))


def add_views(posts: DataFrame, views: DataFrame) -> DataFrame:
    """Posts of the second source with their view counts; posts without are dropped."""
    return posts.drop("impressions").join(last_views(views), "post_id")


def popular(posts: DataFrame, t: Thresholds = THRESHOLDS) -> DataFrame:
    return posts.filter(detect.count("likes") >= t.profile_likes)


def handles(posts: DataFrame) -> DataFrame:
    """Distinct non-empty authors, for one look-up each."""
    return posts.filter("author_handle is not null and author_handle <> ''").select("author_handle").distinct()


def of_handles(items: DataFrame, authors: DataFrame) -> DataFrame:
    return items.join(authors, "author_handle", "left_semi")
