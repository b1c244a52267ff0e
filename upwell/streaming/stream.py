"""The same cycle over a stream, and alerts with kept state."""

from __future__ import annotations

import re
import time
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from upwell.config import THRESHOLDS, Thresholds
from upwell.plans.cycle import log_failure, run_cycle
from upwell.schema import STORED_POST
from upwell.sources.store import Store


def start_cycles(spark: SparkSession, stream: DataFrame, root: str, keywords: list[str], checkpoint: str, every: str | None = "1 hour", **options) -> StreamingQuery:
    """A cycle for each micro-batch, at the batch's latest ``observed_at``.

    ``every`` None takes what there is and ends, a replay whose runs take no time. State is
    read once per batch, as in batch mode; a batch that is run again commits nothing and
    sends nothing again. A batch without posts is a run that found nothing. A batch whose source
    fails is logged and reported, and the stream goes on with the next. Rows without a post_id
    only tell the time of a poll (see ``with_polls``); without any row it is the clock's.
    """
    if every is not None:
        options.setdefault("clock", time.monotonic)

    said = lambda at: at.replace(tzinfo=None).isoformat(sep=" ")

    def cycle(batch: DataFrame, number: int) -> None:
        rows, now = batch.persist(), datetime.now(timezone.utc)
        try:
            try:
                last = rows.selectExpr("unix_micros(max(observed_at)) t").first()["t"]
            except Exception as error:  # noqa: BLE001 - whatever a source raises is logged and reported
                if re.search("cancel|interrupt", str(error), re.IGNORECASE):
                    raise  # the query is being stopped; it will run this batch again
                kept = {k: v for k, v in options.items() if k in ("sender", "t")}
                log_failure(spark, root, said(now), number + 1, error, **kept)
                return
            at = now if last is None else datetime.fromtimestamp(0, timezone.utc) + timedelta(microseconds=last)
            run_cycle(spark, rows, root, keywords, said(at), number + 1, **options)
        finally:
            rows.unpersist()

    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return stream.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def with_polls(stream: DataFrame, seconds: int = 60) -> DataFrame:
    """A stream of sightings with a row every so many seconds that has nothing but a time.

    A trigger without new sightings would run no batch; with these rows it does, so a poll that
    finds nothing counts as a run.
    """
    ticks = stream.sparkSession.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("advanceMillisPerBatch", seconds * 1000).load()
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema if f.name != "observed_at"]
    return stream.unionByName(ticks.select(F.current_timestamp().alias("observed_at"), *empty).select(*stream.columns))


def first_sightings(stream: DataFrame, t: Thresholds = THRESHOLDS) -> DataFrame:
    """The first sighting of each post, with state kept no longer than the rules can use it.

    Not a substitute for the last-wins ``dedupe`` within a batch, which keeps later values.
    """
    return stream.withWatermark("posted_at", f"{int(t.sustained_max_hours)} hours").dropDuplicatesWithinWatermark(["post_id"])


def late_details(cards: DataFrame, details: DataFrame, within: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Cards with the counters of their detail pages, which are read some time after the cards.

    ``cards`` are posts; ``details(post_id, seen_at, quotes, bookmarks, impressions)`` has one row for
    each page that was read. A detail belongs to its post's card if it was seen no earlier and
    at most ``within`` later. Over streams both sides may be out of order by ``late``, and a card
    without a detail comes out, with counters of 0, once none can follow; what is kept is
    bounded by the two times. Over tables the same rows come out at once.
    """
    c = cards.drop("quotes", "bookmarks", "impressions").withWatermark("observed_at", late)
    d = details.select(F.col("post_id").alias("_id"), "seen_at", "quotes", "bookmarks", "impressions").withWatermark("seen_at", late)
    near = (F.col("post_id") == F.col("_id")) & (F.col("seen_at") >= F.col("observed_at")) & (F.col("seen_at") <= F.col("observed_at") + F.expr(f"interval {within}"))
    zero = lambda n: F.coalesce(n, F.lit(0)).cast("long").alias(n)
    return c.join(d, near, "leftOuter").select(*c.columns, zero("quotes"), zero("bookmarks"), F.col("impressions").cast("long"))


class _StrictCooldown(StatefulProcessor):
    """Lets a post of an author out if the last one that was let out is old enough."""

    def __init__(self, hours: float):
        self.gap = int(hours * 3_600_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        posts = pd.concat(list(rows)).sort_values(["observed_at", "ingest_seq"])
        before = self.last.get()[0] if self.last.exists() else None
        last, kept = before, []
        for at in posts["observed_at"].astype("int64") // (1_000_000 if posts["observed_at"].dtype == "datetime64[ns]" else 1000):
            free = last is None or at - last >= self.gap
            last = at if free else last
            kept.append(free)
        if last != before:
            if before is not None:
                self.handle.deleteTimer(before + self.gap)
            self.last.update((int(last),))
            self.handle.registerTimer(int(last) + self.gap)
        yield posts[kept]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        self.last.clear()  # nothing that may still come is in cool-down
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def strict_cooldown(posts: DataFrame, t: Thresholds = THRESHOLDS, late: str = "0 seconds") -> DataFrame:
    """Of a stream of posts those whose author had none let out within the cool-down.

    Unlike ``drop_cooling``, which looks at the state before a batch, two posts of an author
    in one batch give one. ``posts`` has ``author_handle, observed_at, ingest_seq``; posts of an author
    count in their order within a batch, and may be out of order by ``late`` from batch to
    batch. The time of an author's last post is kept until its cool-down is over.
    """
    spark = posts.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    keyed = posts.withWatermark("observed_at", late).groupBy("author_handle")
    return keyed.transformWithStateInPandas(_StrictCooldown(t.author_cooldown_hours), posts.schema, "Append", "EventTime")


def start_upserts(spark: SparkSession, stream: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Keeps the stored posts up to date with a stream of rows of their schema.

    A batch is committed as a cycle; ``Store.read`` merges them by the rules of ``upsert``.
    """

    def merge(batch: DataFrame, number: int) -> None:
        store = Store(spark, root)
        store.write("posts", batch.select(*StructType.fromDDL(STORED_POST).names), number + 1)
        store.commit(number + 1)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def zero_post_alerts(runs: DataFrame, t: Thresholds = THRESHOLDS) -> DataFrame:
    """``job, run_id, at, streak`` of alerts about missing posts, from a stream of runs.

    ``runs(job, run_id, started_at, posts_scanned)``; a job's runs must arrive in order from
    batch to batch. Streak and last alert are kept for each job.
    """

    def reduce(key: tuple, batches: Iterable[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        streak, last = kept.get if kept.exists else (0, None)
        gap = int(t.alert_cooldown_hours * 3_600_000_000)
        out = []
        rows = pd.concat(list(batches)).dropna(subset=["posts_scanned"]).sort_values("run_id")
        for r in rows.itertuples():
            streak = 0 if r.posts_scanned > 0 else streak + 1
            micros = r.started_at.value // 1000
            if streak >= t.zero_streak and (last is None or micros - last >= gap):
                last = micros
                out.append((key[0], r.run_id, r.started_at, streak))
        kept.update((streak, last))
        yield pd.DataFrame(out, columns=["job", "run_id", "at", "streak"])

    return runs.groupBy("job").applyInPandasWithState(
        reduce, "job string, run_id long, at timestamp, streak long", "streak long, last long", "append", GroupStateTimeout.NoTimeout
    )
