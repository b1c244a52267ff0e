"""Deduplication and the stored state: known posts, cool-downs, versions, run log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from upwell.config import THRESHOLDS, Thresholds
from upwell.functions.detect import in_cooldown
from upwell.schema import MUTABLE


def union_modes(live: DataFrame, top: DataFrame) -> DataFrame:
    """All sightings of the two search modes."""
    return live.unionByName(top)


def dedupe(sightings: DataFrame, key: str = "post_id", order: str = "seq") -> DataFrame:
    """One row per key: values of the last sighting, ``first_seq`` of the first."""
    rest = [c for c in sightings.columns if c != key]
    last = sightings.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("v"), F.min(order).alias("first_seq"))
    return last.select(key, "v.*", "first_seq")


def drop_known(posts: DataFrame, known: DataFrame) -> DataFrame:
    return posts.join(known.select("post_id"), "post_id", "left_anti")


def drop_cooling(posts: DataFrame, authors: DataFrame, t: Thresholds = THRESHOLDS) -> DataFrame:
    """Posts whose author wasn't notified within the cool-down.

    State is read once for all posts, so two posts of one author pass together.
    ``authors`` has one row per author; Spark broadcasts it only below its size threshold.
    """
    last = authors.select("author_handle", F.col("last_notified_at").alias("_last"))
    joined = posts.join(last, "author_handle", "left")
    return joined.filter(~in_cooldown(F.col("_last"), F.col("observed_at"), t.author_cooldown_hours)).select(*posts.columns)


def last_posts(rows: DataFrame) -> DataFrame:
    """One row for each stored post: counters and genre of its last write by ``seq``, nulls

    included, everything else of its first.
    """
    fixed = [c for c in rows.columns if c not in (*MUTABLE, "post_id", "seq")]
    agg = rows.groupBy("post_id").agg(
        F.min_by(F.struct(*fixed), "seq").alias("first"), F.max_by(F.struct(*MUTABLE), "seq").alias("last"), F.min("seq").alias("seq")
    )
    return agg.select("post_id", "first.*", "last.*", "seq").select(*rows.columns)


def upsert(base: DataFrame, delta: DataFrame) -> DataFrame:
    """The next state of stored posts, by the rules of ``last_posts``; writing again changes nothing."""
    return last_posts(base.unionByName(delta.select(*base.columns)))


def succeeded(sent: DataFrame) -> DataFrame:
    """``post_id`` of posts that a channel took, from ``sent(post_id, first_ok, second_ok)``; once each."""
    return sent.filter(F.coalesce("first_ok", F.lit(False)) | F.coalesce("second_ok", F.lit(False))).select("post_id").distinct()


def apply_notices(stored: DataFrame, notices: DataFrame) -> DataFrame:
    """Sets flag and time of posts with a notice (``post_id, notified_at``, one a post); other ids don't matter."""
    at = notices.select("post_id", F.col("notified_at").alias("_at"), F.lit(True).alias("_ok"))
    done = stored.join(at, "post_id", "left").withColumn("notified", F.coalesce("_ok", "notified", F.lit(False)))
    return done.withColumn("notified_at", F.when(F.col("_ok"), F.col("_at")).otherwise(F.col("notified_at"))).select(*stored.columns)


def mark_notified(stored: DataFrame, sent: DataFrame, at: Column | None = None) -> DataFrame:
    """Sets flag and time of posts that a channel delivered; a post counts if either succeeded."""
    when = F.lit(None).cast("timestamp") if at is None else at
    return apply_notices(stored, succeeded(sent).withColumn("notified_at", when))


def latest_meta(log: DataFrame) -> DataFrame:
    """The last value of each key of an append-only log."""
    last = log.groupBy("key").agg(F.max_by(F.struct("value"), "seq").alias("v"))
    return last.select("key", "v.value")


def number_runs(log: DataFrame, new: DataFrame) -> DataFrame:
    """The new runs, numbered on from the log's last id by their start.

    A batch of runs is small (one per cycle), so numbering it in one window is bounded.
    """
    top = log.agg(F.coalesce(F.max("run_id"), F.lit(0)).alias("m"))
    number = F.row_number().over(Window.orderBy("started_at", "finished_at"))
    return new.withColumn("run_id", (top.scalar() + number).cast("long")).select(*log.columns)


def append_runs(log: DataFrame, new: DataFrame) -> DataFrame:
    """``log`` and the new runs."""
    return log.unionByName(number_runs(log, new))


def run_counts(flagged: DataFrame) -> DataFrame:
    """Figures of a cycle in one row and one pass, from the booleans of ``flag_posts`` and ``notified``."""
    n = lambda c, name: F.count_if(c).alias(name)
    return flagged.agg(
        F.count("*").alias("posts_scanned"), n("whitelisted", "whitelisted"), n("candidate", "candidates"), n("fresh", "posts_flagged"), n("notified", "notified_count")
    )


def init_state(spark: SparkSession, root: str) -> None:
    """Creates the empty state tables that are missing, as ``Store`` reads them."""
    from upwell.sources.store import Store

    Store(spark, root).create()
