"""Enrichment, ranking and top lists, each with a full order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upwell.config import RECENT_LIMIT, THRESHOLDS, TOP_K, WEIGHTS, Thresholds, Weights
from upwell.functions import detect


def filter_explosive(posts: DataFrame, t: Thresholds = THRESHOLDS) -> DataFrame:
    return posts.filter(detect.is_explosive(t))


def enrich(posts: DataFrame, t: Thresholds = THRESHOLDS, w: Weights = WEIGHTS) -> DataFrame:
    """Adds the rounded figures that messages and ranking use."""
    r = detect.round_half_even
    return posts.withColumns(
        {
            "elapsed_hours": r(detect.elapsed_hours(t), 2),
            "buzz_score": r(detect.rank_score(t, w), 1),
            "quote_like_ratio": r(detect.like_ratio("quotes"), 3),
            "bookmark_like_ratio": r(detect.like_ratio("bookmarks"), 3),
            "reply_like_ratio": r(detect.like_ratio("replies"), 3),
            "is_gekiatsu": detect.is_highlight(t),
            "explosive_type": detect.explosive_type(t),
        }
    )


def rank_candidates(posts: DataFrame, t: Thresholds = THRESHOLDS, w: Weights = WEIGHTS) -> DataFrame:
    """Enriched posts by falling rounded score; ties keep the order of collection."""
    return enrich(posts, t, w).orderBy(F.desc("buzz_score"), F.asc("ingest_seq"))


def top_by_progress(posts: DataFrame, k: int = TOP_K, t: Thresholds = THRESHOLDS) -> DataFrame:
    return posts.withColumn("progress", detect.progress(t)).orderBy(F.desc("progress"), F.asc("ingest_seq")).limit(k)


def top_by_likes(posts: DataFrame, k: int = TOP_K) -> DataFrame:
    return posts.orderBy(F.desc("likes"), F.asc("ingest_seq")).limit(k)


def recent(stored: DataFrame, n: int = RECENT_LIMIT) -> DataFrame:
    """The stored posts that were detected last."""
    return stored.orderBy(F.desc("detected_at"), F.asc("post_id")).limit(n)
