"""Status report, its text, and the commands that ask for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from upwell.config import (
    EMPTY_LIST_LINE, ERROR_LINE, HEADLINES, ITEMS, LAST_RUN, LIKES_TITLE, LIKES_WORD, MARKS_WORD, MINUTES_AGO, NOTIFIED, PROGRESS_TITLE, PROGRESS_WORD, QUOTES_WORD,
    SCANNED, STATUS_COMMAND, TOP_K, UNKNOWN_HEADLINE,
)
from upwell.functions import detect
from upwell.functions.text import percent, trimmed
from upwell.schema import STATUS, WEBHOOK


def top_lists(whitelisted: DataFrame, k: int = TOP_K) -> DataFrame:
    """Both top lists in one relation and one pass: ``list, pos`` and the fields of an entry.

    Each task keeps the best ``k`` rows of either list, and only these are brought together.
    """
    base = ["author_handle", "likes", "quotes", "bookmarks", "url", "matched_keyword", "ingest_seq"]
    entry = lambda name, order, progress: F.struct(F.lit(name).alias("list"), order.cast("double").alias("order"), progress.cast("double").alias("progress"))
    both = F.array(entry("likes", F.col("likes"), F.lit(None)), entry("progress", F.col("_progress"), F.col("_progress")))
    rows = whitelisted.withColumn("_progress", detect.progress()).select(*base, F.explode(both).alias("e")).select(*base, "e.*")
    w = Window.partitionBy("list").orderBy(F.desc("order"), F.asc("ingest_seq"))
    return (
        rows.withColumn("pos", F.row_number().over(w).cast("long"))
        .filter(F.col("pos") <= k)
        .select("list", "pos", F.col("author_handle").alias("author"), "likes", "quotes", "bookmarks", percent(F.col("progress")).alias("progress_percent"), "url", "matched_keyword")
    )


def status_report(
    whitelisted: DataFrame, counts: DataFrame, updated_at: Column, status: str = "success", k: int = TOP_K, started_at: Column | None = None, finished_at: Column | None = None
) -> DataFrame:
    """One row: scalars and the two top lists as arrays."""
    entry = F.struct("pos", "author", "likes", "quotes", "bookmarks", "progress_percent", "url", "matched_keyword")
    both = top_lists(whitelisted, k)
    lists = both.agg(
        F.array_sort(F.coalesce(F.collect_list(F.when(F.col("list") == "likes", entry)), F.array())).alias("a"),
        F.array_sort(F.coalesce(F.collect_list(F.when(F.col("list") == "progress", entry)), F.array())).alias("b"),
    )
    likes = F.transform("a", lambda x: F.struct(x["author"].alias("author"), x["likes"].alias("likes"), x["quotes"].alias("quotes"), x["bookmarks"].alias("bookmarks"), x["url"].alias("url"), x["matched_keyword"].alias("matched_keyword")))
    best = F.transform("b", lambda x: F.struct(x["author"].alias("author"), x["likes"].alias("likes"), x["quotes"].alias("quotes"), x["bookmarks"].alias("bookmarks"), x["progress_percent"].alias("progress_percent"), x["url"].alias("url"), x["matched_keyword"].alias("matched_keyword")))
    # one look at the counts for all three
    lists = lists.withColumn("n", counts.select(F.struct("posts_scanned", "posts_flagged", "notified_count")).scalar())
    none = F.lit(None).cast("string")
    return lists.select(
        updated_at.alias("updated_at"),
        F.lit(status).alias("status"),
        (none if started_at is None else started_at).alias("started_at"),
        (none if finished_at is None else finished_at).alias("finished_at"),
        "n.posts_scanned",
        "n.posts_flagged",
        "n.notified_count",
        F.lit(None).cast("string").alias("error_message"),
        likes.alias("top5_by_likes"),
        best.alias("top5_by_progress"),
    )


def failure_report(failures: DataFrame) -> DataFrame:
    """Reports of cycles whose source failed, from ``updated_at, status, started_at, error_message``: nothing scanned, no lists."""
    zero, none = F.lit(0).cast("long"), F.lit(None)
    empty = {f.name: none.cast(f.dataType).alias(f.name) for f in StructType.fromDDL(STATUS) if f.name.startswith("top5")}
    return failures.select(
        "updated_at", "status", "started_at", none.cast("string").alias("finished_at"), zero.alias("posts_scanned"), zero.alias("posts_flagged"), zero.alias("notified_count"), "error_message", *empty.values()
    )


def report_json(report: DataFrame) -> DataFrame:
    return report.select(F.to_json(F.struct(*report.columns), {"pretty": "true"}).alias("value"))


def minutes_since(updated_at: Column, now: Column) -> Column:
    """Whole minutes, halves up."""
    return F.floor((F.unix_micros(now) - F.unix_micros(updated_at)) / F.lit(6e7) + F.lit(0.5)).cast("long")


def status_text(now: Column) -> Column:
    """The answer to a status question, from the columns of a report."""
    s = lambda c: c.cast("string")
    head = F.lit(UNKNOWN_HEADLINE)
    for status, line in HEADLINES.items():
        head = F.when(F.col("status") == status, line).otherwise(head)
    note = lambda p: F.when(F.coalesce(p["matched_keyword"], F.lit("")) != "", F.concat(F.lit(" ["), p["matched_keyword"], F.lit("]"))).otherwise("")
    figures = lambda p: F.concat(F.lit(LIKES_WORD), s(p["likes"]), F.lit(QUOTES_WORD), s(p["quotes"]), F.lit(MARKS_WORD), s(p["bookmarks"]))
    who = lambda p: F.concat(F.lit("・@"), p["author"], F.lit(" "))

    def section(column: str, title: str, line) -> Column:
        some = F.when(F.size(column) > 0, F.transform(column, line)).otherwise(F.array(F.lit(EMPTY_LIST_LINE)))
        return F.when(F.col(column).isNotNull(), F.concat(F.array(F.lit(""), F.lit(title)), some)).otherwise(F.expr("cast(array() as array<string>)"))

    updated = F.try_to_timestamp(F.col("updated_at").cast("string"))
    first = F.array(head, F.concat(F.lit(LAST_RUN), s(minutes_since(updated, now)), F.lit(MINUTES_AGO)))
    counts = F.array(F.concat(F.lit(SCANNED), s(F.col("posts_scanned")), F.lit(ITEMS)), F.concat(F.lit(NOTIFIED), s(F.col("notified_count")), F.lit(ITEMS)))
    none = F.expr("cast(array() as array<string>)")
    body = F.when(
        F.col("status") == "success",
        F.concat(
            counts,
            section("top5_by_likes", LIKES_TITLE, lambda p: F.concat(who(p), figures(p), note(p))),
            section("top5_by_progress", PROGRESS_TITLE, lambda p: F.concat(who(p), F.lit(PROGRESS_WORD), s(p["progress_percent"]), F.lit("% ("), figures(p), F.lit(")"), note(p))),
        ),
    ).otherwise(none)
    error = F.when(F.coalesce("error_message", F.lit("")) != "", F.array(F.lit(""), F.concat(F.lit(ERROR_LINE), F.col("error_message")))).otherwise(none)
    return F.array_join(F.concat(first, body, error), "\n")


def status_requests(bodies: DataFrame) -> DataFrame:
    """``reply_token`` of each text event that is the status command; other events are ignored.

    ``bodies(value)`` holds webhook bodies; one that isn't JSON has no events.
    """
    events = bodies.select(F.explode(F.from_json("value", WEBHOOK)["events"]).alias("e"))
    asked = (F.col("e.type") == "message") & (F.col("e.message.type") == "text") & (trimmed(F.col("e.message.text")) == STATUS_COMMAND)
    return events.filter(asked).select(F.col("e.replyToken").alias("reply_token"))
