"""Alerts about the job itself: runs without posts, and ended sessions.

Two forms: columns over a whole run log, and one step of a running cycle, which keeps its
streak and the time of the last alert in ``meta``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from upwell.config import SESSION_TEXT, SESSION_URL, SITE, SYSTEM_GENRE, SYSTEM_HOURS, THRESHOLDS, ZERO_POSTS_TEXT, Thresholds

#: Keys of ``meta`` (fixed values).
STREAK, ZERO_AT, SESSION_AT = "zero_posts_streak", "zero_posts_alert_at", "session_expired_alert_at"


#: Bits of a run number that count within a block, and levels of blocks: numbers below 2**36.
BLOCK_BITS, LEVELS = 12, 3


def _carried(rows: DataFrame, by: list[str], at: str, levels: int) -> DataFrame:
    """Adds ``_c``: the sum of ``_n`` over the rows before, in order of ``at``, back to the last one with ``_reset``, its own included.

    Rows are summed within blocks of neighbouring numbers; what goes from block to block is
    found in the same way over one row a block. No group is larger than a block.
    """
    rows = rows.withColumn("_block", F.shiftright(at, BLOCK_BITS))
    if not levels:
        return rows.withColumn("_c", F.lit(0).cast("long")).drop("_block")
    block = Window.partitionBy(*by, "_block").orderBy(at)
    upto = (Window.unboundedPreceding, Window.currentRow)
    island = Window.partitionBy(*by, "_block", "_island").orderBy(at).rowsBetween(*upto)
    marked = rows.withColumn("_island", F.sum("_reset").over(block.rowsBetween(*upto))).withColumn("_s", F.sum("_n").over(island))
    marked = marked.withColumn("_before", F.lag("_s", 1, 0).over(block))
    ends = marked.groupBy(*by, "_block").agg(F.max_by("_s", at).alias("_n"), F.max("_reset").alias("_reset"))
    into = _carried(ends.withColumnRenamed("_block", "_at"), by, "_at", levels - 1).select(*by, F.col("_at").alias("_block"), F.col("_c").alias("_in"))
    open_ = F.col("_island") == F.col("_reset")  # nothing before it in its block resets
    joined = marked.join(into, [*by, "_block"]).withColumn("_c", F.col("_before") + F.when(open_, F.col("_in")).otherwise(0))
    return joined.select(*rows.drop("_block").columns, "_c")


def zero_streaks(runs: DataFrame, job: str | None = None) -> DataFrame:
    """Adds ``streak``: how many runs in a row, this one included, scanned nothing.

    Runs whose ``posts_scanned`` is null, or whose ``status`` (if there is such a column) is
    another than success, failed before the count: they change nothing and have no streak.
    ``run_id`` is a number that a job has once; ``job`` names the column of the job if there are many.
    """
    done = F.col("posts_scanned").isNotNull()
    if "status" in runs.columns:
        done &= F.coalesce(F.col("status") == "success", F.lit(True))
    busy = done & (F.col("posts_scanned") > 0)
    marked = runs.withColumn("_n", F.when(done & (F.col("posts_scanned") == 0), 1).otherwise(0).cast("long")).withColumn("_reset", busy.cast("long"))
    carried = _carried(marked, [job] if job else [], "run_id", LEVELS)
    streak = F.when(busy, 0).when(done, F.col("_c") + F.col("_n"))
    return carried.withColumn("streak", streak.cast("long")).select(*runs.columns, "streak")


def spaced(times: Iterable[pd.Timestamp], hours: float, last: pd.Timestamp | None = None) -> list[bool]:
    """For times in order, which ones alert: no alert less than ``hours`` after the one before."""
    out, gap = [], pd.Timedelta(hours=hours)
    for t in times:
        fire = last is None or t - last >= gap
        last = t if fire else last
        out.append(fire)
    return out


#: A block of due alerts is as long as so many cool-downs.
BLOCK_GAPS = 1000


def _follow(times: np.ndarray, gap: int) -> np.ndarray:
    """For sorted times the position of the next one that may alert after each; their number if there is none."""
    return np.searchsorted(times, times + gap)


def alerts(due: DataFrame, hours: float, key: str = "kind") -> DataFrame:
    """Of the due alerts of each ``kind``, in order of ``at``, those that the cool-down lets out.

    Time is cut into blocks. An alert before a block holds back those of its first ``hours``
    at most, so a block has few ways to begin; the last alert that each of them leads to is
    found block by block, then one row for each such way says how blocks follow one another.
    Only these rows of a kind meet in one task, a thousandth of the cool-downs that passed.
    """
    gap = int(hours * 3_600_000_000)
    kind, columns = due.schema[key], due.columns
    rows = due.withColumn("_t", F.unix_micros("at")).withColumn("_block", F.floor(F.col("_t") / F.lit(gap * BLOCK_GAPS)).cast("long"))
    named = lambda fields: StructType([kind, *StructType.fromDDL(fields).fields])

    def ways(group: pd.DataFrame) -> pd.DataFrame:
        times = np.unique(group["_t"].to_numpy())
        after, last = _follow(times, gap), times.copy()
        for i in range(len(times) - 1, -1, -1):
            if after[i] < len(times):
                last[i] = last[after[i]]
        block = int(group["_block"].iloc[0])
        n = min(len(times), int(np.searchsorted(times, block * gap * BLOCK_GAPS + gap)) + 1)
        return pd.DataFrame({key: group[key].iloc[0], "_block": block, "first": times[:n], "last": last[:n]})

    def chain(group: pd.DataFrame) -> pd.DataFrame:
        out, since = [], -(1 << 62)
        for block, part in group.sort_values(["_block", "first"]).groupby("_block", sort=True):
            out.append((group[key].iloc[0], block, since))
            begun = part[part["first"] >= since]
            if len(begun):
                since = int(begun["last"].iloc[0]) + gap
        return pd.DataFrame(out, columns=[key, "_block", "since"])

    def fire(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_t", "run_id"], ignore_index=True)
        times = group["_t"].to_numpy()
        after, at, kept = _follow(times, gap), int(np.searchsorted(times, group["since"].iloc[0])), []
        while at < len(times):
            kept.append(at)
            at = int(after[at])
        return group.loc[kept, columns]

    begins = rows.groupBy(key, "_block").applyInPandas(ways, named("_block long, first long, last long"))
    entered = begins.groupBy(key).applyInPandas(chain, named("_block long, since long"))
    return rows.join(entered, [key, "_block"]).groupBy(key, "_block").applyInPandas(fire, due.schema)


def zero_post_alerts(runs: DataFrame, t: Thresholds = THRESHOLDS) -> DataFrame:
    """Runs that raise the alert about missing posts: ``kind, run_id, at, streak``."""
    due = zero_streaks(runs).filter(F.col("streak") >= t.zero_streak)
    due = due.select(F.lit("zero_posts").alias("kind"), "run_id", F.col("started_at").alias("at"), "streak")
    return alerts(due, t.alert_cooldown_hours)


def session_alerts(runs: DataFrame, t: Thresholds = THRESHOLDS) -> DataFrame:
    """Runs that raise the alert about an ended session."""
    due = runs.filter("status = 'session_expired'").select(F.lit("session_expired").alias("kind"), "run_id", F.col("started_at").alias("at"), F.lit(None).cast("long").alias("streak"))
    return alerts(due, t.alert_cooldown_hours)


def utc(time: str | datetime) -> datetime:
    """A time as UTC without an offset; one without an offset is taken for UTC."""
    at = datetime.fromisoformat(time) if isinstance(time, str) else time
    return at if at.tzinfo is None else at.astimezone(timezone.utc).replace(tzinfo=None)


def _cooled(last: str | None, now: datetime, hours: float) -> bool:
    return not last or utc(now) - utc(last) >= timedelta(hours=hours)


def zero_post_step(meta: Mapping[str, str], scanned: int, now: datetime, t: Thresholds = THRESHOLDS) -> tuple[dict[str, str], list[dict]]:
    """What a finished run changes in ``meta``, and the system posts that it raises."""
    if scanned > 0:
        return {STREAK: "0"}, []
    streak = int(meta.get(STREAK) or 0) + 1
    changed = {STREAK: str(streak)}
    if streak < t.zero_streak or not _cooled(meta.get(ZERO_AT), now, t.alert_cooldown_hours):
        return changed, []
    return changed | {ZERO_AT: now.isoformat()}, [{"post_id": "system:zero_posts", "author_handle": ZERO_POSTS_TEXT.format(streak=streak), "url": SITE}]


def session_step(meta: Mapping[str, str], now: datetime, t: Thresholds = THRESHOLDS) -> tuple[dict[str, str], list[dict]]:
    """The same of a run whose session had ended."""
    if not _cooled(meta.get(SESSION_AT), now, t.alert_cooldown_hours):
        return {}, []
    return {SESSION_AT: now.isoformat()}, [{"post_id": "system:session_expired", "author_handle": SESSION_TEXT, "url": SESSION_URL}]


def system_posts(spark: SparkSession, posts: list[dict]) -> DataFrame:
    """System posts in the shape that messages are made of."""
    zero = F.lit(0).cast("long")
    rows = spark.createDataFrame([(p["post_id"], p["author_handle"], p["url"]) for p in posts], "post_id string, author_handle string, url string")
    return rows.select(
        "*", F.lit(SYSTEM_GENRE).alias("genre"), F.lit(SYSTEM_HOURS).alias("elapsed_hours"), zero.alias("likes"), zero.alias("quotes"), zero.alias("bookmarks"), F.lit(False).alias("is_gekiatsu"),
        *(F.lit(None).cast("double").alias(c) for c in ("quote_like_ratio", "bookmark_like_ratio")), *(F.lit(None).cast("string").alias(c) for c in ("explosive_type", "matched_keyword")),
    )
