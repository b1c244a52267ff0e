"""Message texts and payloads for the outbox; nothing here sends anything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upwell.config import (
    DEFAULT_GENRE, HOT_HEADER, KEYWORD_LINE, LEAD_HOURS, LEAD_MARKS, LEAD_POST, LEAD_QUOTES, MESSAGE_KINDS, PUSH_KINDS, URL_TITLE, USUAL_HEADER, PushConfig,
)
from upwell.functions.text import percent, thousands


def _said(c: str, missing: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(missing))


def _n(c: str) -> Column:
    return thousands(F.coalesce(F.col(c), F.lit(0)))


def _keyword_line() -> Column:
    shown = F.col("matched_keyword").isNotNull() & (F.col("matched_keyword") != "")
    return F.when(shown, F.concat(F.lit(KEYWORD_LINE), F.col("matched_keyword"))).otherwise("")


def _header(instant: str, sustained: str) -> Column:
    kind = F.when(F.col("explosive_type") == "instant", instant).otherwise(sustained)
    start = F.when(F.coalesce("is_gekiatsu", F.lit(False)), HOT_HEADER).otherwise(USUAL_HEADER)
    return F.concat(start, F.lit(" ["), kind, F.lit("/"), _said("genre", DEFAULT_GENRE), F.lit("]"))


def _lead() -> Column:
    return F.concat(_said("author_handle", ""), F.lit(LEAD_POST), _said("elapsed_hours", "?"), F.lit(LEAD_HOURS), _n("likes"), F.lit(LEAD_QUOTES), _n("quotes"))


def message_text() -> Column:
    """The message of the first channel."""
    share = lambda c: F.concat(F.lit("("), percent(F.coalesce(c, F.lit(0.0))).cast("string"), F.lit("%)"))
    hot = F.coalesce("is_gekiatsu", F.lit(False))
    quotes = F.when(hot, share("quote_like_ratio")).otherwise("")
    marks = F.when(hot, share("bookmark_like_ratio")).otherwise("")
    detail = F.concat(_lead(), quotes, F.lit(LEAD_MARKS), _n("bookmarks"), marks)
    return F.concat(_header(*MESSAGE_KINDS), F.lit("\n"), detail, F.lit("\n"), _said("url", ""), _keyword_line())


def priority(at_school: Column, config: PushConfig) -> Column:
    """Lower at school; unknown presence counts as away."""
    return F.when(F.coalesce(at_school, F.lit(False)), config.value("school_priority")).otherwise(config.value("priority"))


def push_payload(at_school: Column, config: PushConfig = PushConfig()) -> dict[str, Column]:  # noqa: B008
    """Fields of the second channel; those that don't apply are null."""
    level = priority(at_school, config)
    has_url = F.coalesce(F.col("url") != "", F.lit(False))
    return {
        "title": _header(*PUSH_KINDS),
        "message": F.concat(_lead(), F.lit(LEAD_MARKS), _n("bookmarks"), _keyword_line()),
        "sound": F.lit(config.value("sound")),
        "priority": level,
        "link": F.when(has_url, F.col("url")),
        "url_title": F.when(has_url, F.lit(URL_TITLE)),
        "retry": F.when(level == "2", F.lit(config.value("retry"))),
        "expire": F.when(level == "2", F.lit(config.value("expire"))),
    }


def latest_presence(log: DataFrame) -> DataFrame:
    """One row, ``at_school``: the last record's value, false without records."""
    return log.agg(F.coalesce(F.max_by("at_school", "updated_at"), F.lit(False)).alias("at_school"))


def route(posts: DataFrame, presence: DataFrame, config: PushConfig = PushConfig()) -> DataFrame:  # noqa: B008
    """Adds ``priority`` by the latest presence record."""
    return posts.withColumn("priority", priority(latest_presence(presence).scalar(), config))


def outbox(posts: DataFrame, presence: DataFrame | None = None, config: PushConfig = PushConfig()) -> DataFrame:  # noqa: B008
    """``post_id, text`` for the first channel and the payload fields of the second."""
    at = latest_presence(presence).scalar() if presence is not None else F.lit(False)
    fields = push_payload(at, config)
    return posts.select("post_id", "author_handle", message_text().alias("text"), *(c.alias(n) for n, c in fields.items()))


def first_accepted(status: Column) -> Column:
    """Whether the first channel took a post: HTTP 200."""
    return F.coalesce(status == 200, F.lit(False))


def second_accepted(status: Column, body: Column) -> Column:
    """Whether the second channel took a post: HTTP 200 and status 1 in its body."""
    return F.coalesce((status == 200) & (F.get_json_object(body, "$.status") == "1"), F.lit(False))


def accepted(first_status: Column, second_status: Column, second_body: Column) -> Column:
    """Whether a post went out on either channel."""
    return first_accepted(first_status) | second_accepted(second_status, second_body)
