"""Detection rules, score and progress as columns over a post relation.

Missing counters count as 0. Every division has a positive divisor, so no expression
depends on the order in which conditions are evaluated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from upwell.config import THRESHOLDS, WEIGHTS, Thresholds, Weights


def count(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast("double")


def round_half_even(x: Column, digits: int) -> Column:
    unit = F.lit(float(10**digits))
    return F.rint(x * unit) / unit


def elapsed_hours(t: Thresholds = THRESHOLDS) -> Column:
    """Age in hours, at least 0.01, so a post from the future counts as new."""
    posted = F.coalesce("posted_at", "observed_at")
    return F.greatest((F.unix_micros("observed_at") - F.unix_micros(posted)) / F.lit(3.6e9), F.lit(t.least_elapsed_hours))


def velocity(name: str, t: Thresholds = THRESHOLDS) -> Column:
    return count(name) / F.greatest(elapsed_hours(t), F.lit(t.velocity_floor_hours))


def like_ratio(name: str) -> Column:
    return count(name) / F.greatest(count("likes"), F.lit(1.0))


def required_velocity(t: Thresholds = THRESHOLDS) -> Column:
    return F.lit(t.base_velocity) / (F.lit(1.0) + F.lit(t.velocity_decay) * elapsed_hours(t))


def is_instant(t: Thresholds = THRESHOLDS) -> Column:
    return (
        (elapsed_hours(t) <= t.instant_max_hours)
        & (count("likes") >= t.instant_likes)
        & (count("retweets") >= t.instant_retweets)
        & (count("replies") >= t.instant_replies)
    )


def sustained_age(t: Thresholds = THRESHOLDS) -> Column:
    least = max(t.sustained_min_hours, t.velocity_min_age_hours)
    return elapsed_hours(t).between(least, t.sustained_max_hours)


def is_sustained(t: Thresholds = THRESHOLDS) -> Column:
    return (
        sustained_age(t)
        & (velocity("likes", t) >= required_velocity(t))
        & (count("impressions") >= t.sustained_impressions)
        & (like_ratio("replies") >= t.sustained_reply_ratio)
        & ((count("bookmarks") >= t.sustained_bookmarks) | (count("quotes") >= t.sustained_quotes))
    )


def is_explosive(t: Thresholds = THRESHOLDS) -> Column:
    return is_instant(t) | is_sustained(t)


def explosive_type(t: Thresholds = THRESHOLDS) -> Column:
    return F.when(is_instant(t), "instant").when(is_sustained(t), "sustained")


def is_highlight(t: Thresholds = THRESHOLDS) -> Column:
    return (
        (like_ratio("quotes") >= t.highlight_quote_ratio)
        & (like_ratio("bookmarks") >= t.highlight_bookmark_ratio)
        & (like_ratio("replies") >= t.highlight_reply_ratio)
    )


def rank_score(t: Thresholds = THRESHOLDS, w: Weights = WEIGHTS) -> Column:
    """Weighted velocities, and a logarithm of the impressions where there are any."""
    score = F.lit(0.0)
    for name in ("likes", "retweets", "replies", "quotes", "bookmarks"):
        score = score + F.lit(getattr(w, name)) * velocity(name, t)
    seen = F.when(count("impressions") > 0, F.lit(w.impressions) * F.log1p(count("impressions") / F.lit(w.impressions_unit)))
    return score + F.coalesce(seen, F.lit(0.0))


def raw_progress(t: Thresholds = THRESHOLDS) -> Column:
    """The weakest condition's share, of the better of the two rules."""
    share = lambda name, goal: count(name) / F.lit(float(goal))
    instant = F.when(
        elapsed_hours(t) <= t.instant_max_hours,
        F.least(share("likes", t.instant_likes), share("retweets", t.instant_retweets), share("replies", t.instant_replies)),
    ).otherwise(0.0)
    sustained = F.when(
        sustained_age(t),
        F.least(
            velocity("likes", t) / required_velocity(t),
            share("impressions", t.sustained_impressions),
            like_ratio("replies") / F.lit(t.sustained_reply_ratio),
            F.greatest(share("bookmarks", t.sustained_bookmarks), share("quotes", t.sustained_quotes)),
        ),
    ).otherwise(0.0)
    return F.greatest(instant, sustained)


def progress(t: Thresholds = THRESHOLDS) -> Column:
    return round_half_even(raw_progress(t), 3)


def in_cooldown(last: Column, now: Column, hours: float) -> Column:
    """Whether less than ``hours`` passed since ``last``; exactly that long is over, null never was."""
    return F.coalesce(F.unix_micros(now) - F.unix_micros(last) < F.lit(int(hours * 3_600_000_000)), F.lit(False))
