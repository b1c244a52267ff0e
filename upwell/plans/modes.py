"""Other ways to run: a trial of the channels, and sources that are checked first."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from upwell.config import TRIAL_FAILED, TRIAL_OK, TRIAL_TITLE
from upwell.operators import alerts, notify
from upwell.plans.cycle import Sender, dry_run
from upwell.sources.raw import SourceUnavailable

#: A made-up post that shows every part of a message (fixed values).
TRIAL_POST = {
    "post_id": "0", "author_handle": "test_account", "url": "https://x.com/example/status/000000000", "genre": "テスト", "likes": 12345, "quotes": 100, "bookmarks": 300,
    "elapsed_hours": 0.5, "is_gekiatsu": True, "quote_like_ratio": 0.15, "bookmark_like_ratio": 0.25,
}


def trial_outbox(spark: SparkSession) -> DataFrame:
    """The outbox row of the made-up post."""
    kinds = {str: "string", int: "long", float: "double", bool: "boolean"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in TRIAL_POST.items())
    row = spark.createDataFrame([tuple(TRIAL_POST.values())], schema)
    return notify.outbox(row.withColumn("explosive_type", F.lit(None).cast("string")).withColumn("matched_keyword", F.lit(None).cast("string")))


def trial(spark: SparkSession, sender: Sender = dry_run) -> DataFrame:
    """Sends the made-up post; ``channel, ok`` tells which channels took it."""
    got = sender(trial_outbox(spark))
    return got.select(F.explode(F.array(F.struct(F.lit("first").alias("channel"), F.coalesce("first_ok", F.lit(False)).alias("ok")), F.struct(F.lit("second").alias("channel"), F.coalesce("second_ok", F.lit(False)).alias("ok")))).alias("r")).select("r.*")


def trial_summary(spark: SparkSession, results: Mapping[str, bool]) -> DataFrame:
    """The outbox row that tells which channels took the made-up post."""
    lines = [TRIAL_TITLE, *((TRIAL_OK if ok else TRIAL_FAILED) + channel for channel, ok in results.items())]
    return notify.outbox(alerts.system_posts(spark, [{"post_id": "system:trial", "author_handle": "\n".join(lines), "url": ""}]))


def run_trial(spark: SparkSession, sender: Sender = dry_run, posts: DataFrame | None = None) -> DataFrame:
    """The whole course of a trial: sends the made-up post, or the given ones, then which channels took any.

    Returns the outbox rows of both messages.
    """
    keyed = lambda out: out.withColumn("send_key", F.concat(F.lit("trial:"), F.monotonically_increasing_id().cast("string"), F.lit(":"), "post_id"))
    sent = trial_outbox(spark) if posts is None else notify.outbox(posts)
    took = sender(keyed(sent)).agg(*(F.coalesce(F.max(f"{c}_ok"), F.lit(False)).alias(c) for c in ("first", "second"))).first()
    summary = trial_summary(spark, took.asDict())
    sender(keyed(summary)).count()
    return sent.unionByName(summary)


def require_input(spark: SparkSession, path: str, expired: bool = False) -> str:
    """``path`` if it exists, else ``SourceUnavailable``."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        raise SourceUnavailable(f"no input at {path}", expired)
    return path
