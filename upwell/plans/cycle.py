"""One cycle: from sightings to outbox, state versions and report."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from upwell.config import THRESHOLDS, UNFILTERED_MARK, Thresholds
from upwell.functions.detect import in_cooldown, is_explosive
from upwell.operators import alerts, classify, notify, rank, report, state
from upwell.operators.keywords import first_keyword, whitelist
from upwell.schema import META, SENT
from upwell.sources.raw import SessionExpired, SourceUnavailable
from upwell.sources.store import MERGES, Store

#: Takes the outbox and returns ``post_id, first_ok, second_ok``. Spark may run a failed task
#: again, so a sender should use ``send_key`` to recognise what it has sent.
Sender = Callable[[DataFrame], DataFrame]


def dry_run(outbox: DataFrame) -> DataFrame:
    """A sender that delivers nothing and reports success."""
    return outbox.select("post_id", F.lit(True).alias("first_ok"), F.lit(False).alias("second_ok"))


def select_posts(posts: DataFrame, keywords: list[str], known: DataFrame, authors: DataFrame, t: Thresholds = THRESHOLDS) -> DataFrame:
    """Whitelist, rules, known posts, cool-down, then the figures; one lazy plan without order."""
    kept = rank.filter_explosive(whitelist(posts, keywords), t)
    return rank.enrich(state.drop_cooling(state.drop_known(kept, known), authors, t), t)


def judge_posts(posts: DataFrame, keywords: list[str], t: Thresholds = THRESHOLDS) -> DataFrame:
    """All posts with ``matched_keyword`` and, as booleans, ``whitelisted`` and ``candidate``."""
    word = first_keyword(F.col("text_snippet"), keywords) if keywords else F.lit(UNFILTERED_MARK)
    judged = posts.withColumn("matched_keyword", word).withColumn("whitelisted", F.col("matched_keyword").isNotNull())
    return judged.withColumn("candidate", F.col("whitelisted") & F.coalesce(is_explosive(t), F.lit(False)))


def mark_fresh(judged: DataFrame, known: DataFrame, authors: DataFrame, t: Thresholds = THRESHOLDS) -> DataFrame:
    """Adds ``fresh``: candidates that aren't stored and whose author isn't in cool-down, by one row for each author."""
    ids = known.select("post_id").distinct().withColumn("_known", F.lit(True))
    last = authors.select("author_handle", F.col("last_notified_at").alias("_last"))
    joined = judged.join(ids, "post_id", "left").join(last, "author_handle", "left")
    fresh = F.col("candidate") & F.col("_known").isNull() & ~in_cooldown(F.col("_last"), F.col("observed_at"), t.author_cooldown_hours)
    return joined.withColumn("fresh", fresh).select(*judged.columns, "fresh")


def flag_posts(posts: DataFrame, keywords: list[str], known: DataFrame, authors: DataFrame, t: Thresholds = THRESHOLDS) -> DataFrame:
    """All posts with ``matched_keyword`` and what ``select_posts`` decides as booleans: ``whitelisted``, ``candidate``, ``fresh``."""
    return mark_fresh(judge_posts(posts, keywords, t), known, authors, t)


def deliver(store: Store, name: str, out: DataFrame, cycle: int, sender: Sender) -> DataFrame:
    """Hands the rows of ``out`` to the sender once, whatever is repeated, and gives its answers.

    The outbox is kept before anything is sent, and the sender runs in one job that keeps its
    answers. A cycle that is repeated after that reads them. One that ended while sending
    counts its posts as not delivered, rather than send any of them twice, unless the sender
    is ``idempotent``: then the channel knows what it has, and all are sent again.
    """
    answers = f"{name}_sent"
    if store.has(answers, cycle):
        return store.at(answers, cycle)
    held = store.step(name, out.withColumn("send_key", F.concat(F.lit(f"{name}:{cycle}:"), "post_id")), cycle)
    if store.claim(name, cycle) or getattr(sender, "idempotent", False):
        sent = sender(held)
    else:
        sent = held.select("post_id", F.lit(False).alias("first_ok"), F.lit(False).alias("second_ok"))
    fields = [F.col(f.name).cast(f.dataType) for f in store.spark.createDataFrame([], SENT).schema]
    return store.step(answers, sent.select(*fields), cycle)


def _raise_alerts(store: Store, changed: dict[str, str], posts: list[dict], cycle: int, sender: Sender) -> None:
    """Sends system posts, and writes what they changed in ``meta``."""
    if posts:
        deliver(store, "alerts", notify.outbox(alerts.system_posts(store.spark, posts)), cycle, sender)
    store.write("meta", store.spark.createDataFrame([(k, v, cycle) for k, v in changed.items()], META), cycle)


def _meta(store: Store, cycle: int) -> dict[str, str]:
    rows = store.read("meta", cycle).filter(F.col("key").isin(alerts.STREAK, alerts.ZERO_AT, alerts.SESSION_AT))
    return {r["key"]: r["value"] for r in rows.collect()}


def _log_run(store: Store, cycle: int, started: F.Column, finished: F.Column, scanned: int, flagged: int, status: str, error: str | None) -> None:
    line = store.spark.createDataFrame([(0, scanned, flagged, status, error)], "run_id long, posts_scanned long, posts_flagged long, status string, error_message string")
    line = line.withColumn("started_at", started).withColumn("finished_at", finished)
    store.write("runs", state.number_runs(store.read("runs", cycle), line), cycle)


def _write_report(store: Store, lines: str) -> None:
    store.write_text("status", store.spark.createDataFrame([(lines,)], "value string"))


def run_cycle(
    spark: SparkSession,
    sightings: DataFrame,
    root: str,
    keywords: list[str],
    now: str,
    cycle: int,
    sender: Sender = dry_run,
    classifier: classify.Classifier | classify.Batched = classify.offline,
    presence: DataFrame | None = None,
    t: Thresholds = THRESHOLDS,
    clock: Callable[[], float] | None = None,
) -> dict[str, int]:
    """Runs cycle number ``cycle`` at time ``now`` (UTC, unless it has an offset) and commits its state.

    State is read once, before anything is decided, and only where a candidate may be in it.
    What was chosen and sent is kept on the way, all state appears at the end, so a cycle that
    ended early shows none of it; repeated, it sends nothing again. A failed delivery isn't
    tried again; posts in cool-down aren't stored and can come back. A number that is committed
    does nothing but write its report. Sightings without a post_id are left out. Runs that find
    nothing raise an alert, see ``alerts``. ``clock`` gives seconds (``time.monotonic``)
    to tell how long the run took; without it, as in a replay, it ends when it starts.
    """
    began = clock() if clock else 0.0
    store = Store(spark, root)
    done = store.result(cycle)
    if done is not None and "report" in done:
        _write_report(store, done["report"])
        return done["counts"]
    time = alerts.utc(now)
    at = F.lit(time.replace(tzinfo=timezone.utc))
    posts = state.dedupe(sightings.filter("post_id is not null")).withColumn("ingest_seq", F.col("first_seq")).withColumn("observed_at", at)
    judged = judge_posts(posts, keywords, t).persist()
    try:
        hot = judged.filter("candidate")
        known = store.lookup("posts", hot.select("post_id"), cycle)
        authors = MERGES["authors"](store.lookup("authors", hot.select("author_handle"), cycle))
        flagged = mark_fresh(judged, known, authors, t)
        # kept once, so that a classifier sees each post once
        new = flagged.filter("fresh").select(*posts.columns, "matched_keyword")
        fresh = store.step("chosen", classify.classify(rank.enrich(new, t), classifier), cycle)
        delta = fresh.select(
            "post_id", "author_handle", "url", "posted_at", "text_snippet", "likes", "retweets", "replies", "quotes", "bookmarks", "genre", at.alias("detected_at"),
            F.lit(False).alias("notified"), F.lit(None).cast("timestamp").alias("notified_at"), (F.lit(cycle) * F.lit(1 << 40) + F.col("ingest_seq")).cast("long").alias("seq"),
        )
        store.write("posts", delta, cycle)
        delivered = state.succeeded(deliver(store, "outbox", notify.outbox(fresh, presence), cycle, sender))
        notices = store.write("notices", delivered.withColumn("notified_at", at), cycle)
        reached = fresh.join(delivered, "post_id", "left_semi").select("author_handle").filter("author_handle is not null").distinct()
        store.write("authors", reached.withColumn("last_notified_at", at), cycle)
        counted = flagged.join(notices.select("post_id", F.lit(True).alias("notified")), "post_id", "left")
        n = state.run_counts(counted).first().asDict()
        _raise_alerts(store, *alerts.zero_post_step(_meta(store, cycle), n["posts_scanned"], time, t), cycle, sender)
        ended = time + timedelta(seconds=clock() - began if clock else 0)
        _log_run(store, cycle, at, F.lit(ended.replace(tzinfo=timezone.utc)), n["posts_scanned"], n["posts_flagged"], "success", None)
        counts = spark.createDataFrame([tuple(n.values())], ", ".join(f"{k} long" for k in n))
        said = now if ended == time else ended.isoformat(sep=" ")
        made = report.report_json(report.status_report(judged.filter("whitelisted"), counts, F.lit(said), started_at=F.lit(now), finished_at=F.lit(said)))
        return _finish(store, cycle, {"counts": n, "report": made.first()["value"]})["counts"]
    finally:
        judged.unpersist()


def _finish(store: Store, cycle: int, result: dict) -> dict:
    """Commits a cycle and writes its report; of two runs of one number, both give what the first one left."""
    if not store.commit(cycle, result):
        result = store.result(cycle)
    _write_report(store, result["report"])
    return result


def log_failure(spark: SparkSession, root: str, now: str, cycle: int, error: Exception, sender: Sender = dry_run, t: Thresholds = THRESHOLDS) -> str:
    """Logs and reports a cycle whose source failed, raises the alert about an ended session; returns its status."""
    status = "session_expired" if getattr(error, "expired", False) or SessionExpired.__name__ in str(error) else "error"
    store, time = Store(spark, root), alerts.utc(now)
    done = store.result(cycle)
    if done is not None and "report" in done:
        _write_report(store, done["report"])
        return done.get("status", "success")
    at, said = F.lit(time.replace(tzinfo=timezone.utc)), error_line(error)
    _log_run(store, cycle, at, at, 0, 0, status, said)
    changed, posts = alerts.session_step(_meta(store, cycle), time, t) if status == "session_expired" else ({}, [])
    _raise_alerts(store, changed, posts, cycle, sender)
    failure = spark.createDataFrame([(now, status, now, said)], "updated_at string, status string, started_at string, error_message string")
    made = report.report_json(report.failure_report(failure))
    return _finish(store, cycle, {"counts": {}, "status": status, "report": made.first()["value"]})["status"]


def error_line(error: Exception) -> str:
    """What an error says; of one that crossed from a Python worker, the line that names it there."""
    said = str(error)
    named = [line.strip() for line in said.splitlines() if SourceUnavailable.__name__ in line or SessionExpired.__name__ in line]
    return re.sub(r"^[\w.]*(SourceUnavailable|SessionExpired): ", "", named[-1]) if named else said


def run_polled(spark: SparkSession, poll: Callable[[], DataFrame], root: str, keywords: list[str], now: str, cycle: int, sender: Sender = dry_run, t: Thresholds = THRESHOLDS, **options) -> dict[str, int] | str:
    """A cycle over what ``poll`` gives; if the source fails, now or while it is read, ``log_failure`` instead."""
    sightings = None
    try:
        try:
            sightings = poll().persist()
            sightings.count()
        except Exception as error:  # noqa: BLE001 - whatever a source raises is logged and reported
            return log_failure(spark, root, now, cycle, error, sender, t)
        return run_cycle(spark, sightings, root, keywords, now, cycle, sender, t=t, **options)
    finally:
        if sightings is not None:
            sightings.unpersist()
