"""Boundary rows of the rules, with figures worked out by hand."""

from __future__ import annotations

import math
from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from upwell.functions import detect
from upwell.operators import rank
from upwell.schema import POST

NOW = datetime(2024, 3, 1, 12, tzinfo=timezone.utc)


def make(spark, rows):
    """Posts from ``(hours, likes, retweets, replies, quotes, bookmarks, impressions)``."""
    data = [(str(i), "a", "", "", NOW - timedelta(microseconds=round(h * 3.6e9)), L, rt, r, q, b, imp, i, NOW) for i, (h, L, rt, r, q, b, imp) in enumerate(rows)]
    return spark.createDataFrame(data, POST)


def values(df, column):
    return [r["v"] for r in df.select("ingest_seq", column.alias("v")).orderBy("ingest_seq").collect()]


def test_instant_boundaries(spark):
    rows = [(2.0, 1800, 150, 70), (2.0001, 1800, 150, 70), (2.0, 1799, 150, 70), (2.0, 1800, 149, 70), (2.0, 1800, 150, 69), (-5.0, 1800, 150, 70)]
    df = make(spark, [(*r, 0, 0, None) for r in rows])
    assert values(df, detect.is_instant()) == [True, False, False, False, False, True]
    assert values(df, detect.elapsed_hours())[-1] == 0.01


def test_sustained_boundaries(spark):
    rows = [
        (1.0, 375, 0, 17, 0, 20, 200000), (1.0, 374, 0, 17, 0, 20, 200000), (1.0, 375, 0, 16, 0, 20, 200000), (1.0, 375, 0, 17, 10, 0, 200000), (1.0, 375, 0, 17, 9, 19, 200000),
        (1.0, 375, 0, 17, 0, 20, 199999), (1.0, 375, 0, 17, 0, 20, None), (1.0, 375, 0, 17, 0, 20, 0), (0.9999, 999, 0, 99, 0, 20, 200000), (6.0001, 9999, 0, 999, 0, 20, 200000),
        (3.0, 843, 0, 38, 0, 20, 200000), (3.0, 844, 0, 38, 0, 20, 200000), (3.0, 844, 0, 37, 0, 20, 200000), (6.0, 1227, 0, 90, 0, 20, 200000), (6.0, 1228, 0, 90, 0, 20, 200000),
    ]
    want = [True, False, False, True, False, False, False, False, False, False, False, True, False, False, True]
    assert values(make(spark, rows), detect.is_sustained()) == want


def test_type_and_highlight(spark):
    df = make(spark, [(2.0, 1800, 150, 81, 10, 20, 300000), (3.0, 844, 0, 38, 0, 20, 200000), (9.0, 1, 1, 1, 1, 1, None), (1, 100, 0, 7, 6, 12, None), (1, 100, 0, 7, 5, 12, None), (1, 0, 0, 1, 1, 1, None)])
    assert values(df, detect.explosive_type())[:3] == ["instant", "sustained", None]
    assert values(df, detect.is_highlight())[3:] == [True, False, True]


def test_score_and_progress(spark):
    rows = [(0.5, 2000, 200, 100, 50, 100, None), (3.0, 2000, 100, 120, 5, 30, 250000), (0.1, 2000, 200, 100, 0, 0, None)]
    got = values(make(spark, rows), detect.rank_score())
    assert all(math.isclose(a, b, rel_tol=1e-12) for a, b in zip(got, [11480.0, 1823.5538114736987, 22320.0], strict=True))
    rows = [(1.5, 1799, 150, 70, 0, 0, None), (3.0, 2000, 0, 120, 0, 20, 199950), (3.0, 2000, 0, 120, 10, 0, 200000), (0.5, 900, 150, 70, 0, 0, None), (7.0, 9999, 999, 999, 99, 99, 999999)]
    assert values(make(spark, rows), detect.progress()) == [0.999, 1.0, 1.0, 0.5, 0.0]
    assert values(make(spark, rows), detect.is_explosive()) == [False, False, True, False, False]


def test_missing_counters_count_as_zero(spark):
    df = make(spark, [(1.0, None, None, None, None, None, None)])
    assert values(df, detect.is_explosive()) == [False] and values(df, detect.rank_score()) == [0.0] and values(df, detect.progress()) == [0.0]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.floats(0, 8), *[st.integers(0, 4000)] * 5, st.one_of(st.none(), st.integers(0, 400000))), min_size=20, max_size=60))
def test_explosive_means_progress_of_one(spark, rows):
    df = make(spark, rows)
    for hot, p, a, b in df.select(detect.is_explosive(), detect.raw_progress(), detect.rank_score(), detect.rank_score()).collect():
        assert not hot or p >= 1 - 1e-9
    more = make(spark, [(h, L + 1, *rest) for h, L, *rest in rows])
    assert all(x >= y for x, y in zip(values(more, detect.rank_score()), values(df, detect.rank_score()), strict=True))


def test_ranking_keeps_input_order_on_ties(spark):
    df = make(spark, [(1.0, 10, 0, 0, 0, 0, None), (1.0, 20, 0, 0, 0, 0, None), (1.0, 10, 0, 0, 0, 0, None), (1.0, 20, 0, 0, 0, 0, None)])
    assert [r["ingest_seq"] for r in rank.rank_candidates(df).collect()] == [1, 3, 0, 2]
    assert [r["ingest_seq"] for r in rank.top_by_likes(df, 3).collect()] == [1, 3, 0]
    assert [r["ingest_seq"] for r in rank.top_by_progress(df, 2).collect()] == [0, 1]  # none makes progress


@pytest.mark.parametrize(("micros", "cool"), [(0, False), (-1, True), (-3 * 7_200_000_000, True)])
def test_cooldown_boundary(spark, micros, cool):
    from pyspark.sql import functions as F

    last = NOW - timedelta(hours=2) - timedelta(microseconds=micros)
    df = spark.createDataFrame([(last, NOW), (None, NOW)], "last timestamp, now timestamp")
    assert [r[0] for r in df.select(detect.in_cooldown(F.col("last"), F.col("now"), 2.0)).collect()] == [cool, False]
