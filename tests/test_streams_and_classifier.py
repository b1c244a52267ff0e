"""Late details, the strict cool-down, the batched classifier and the one-pass top lists."""

from __future__ import annotations

import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from upwell.operators import classify, rank, report
from upwell.plans import cycle
from upwell.sources import relations as rel
from upwell.streaming import stream

T0 = datetime(2024, 3, 1, 12, tzinfo=timezone.utc)
CARD = "post_id string, observed_at timestamp, likes long"
DETAIL = "post_id string, seen_at timestamp, quotes long, bookmarks long, impressions long"


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def fed(spark, tmp_path, steps, make, schemas):
    """Rows that a stream gives out over batches of its inputs, one file for each input and step."""
    got = []
    for k, inputs in enumerate(steps):
        for name, rows in inputs.items():
            spark.createDataFrame(rows, schemas[name]).coalesce(1).write.parquet(f"{tmp_path}/{name}/{k}")
        read = lambda name: spark.readStream.schema(schemas[name]).parquet(f"{tmp_path}/{name}/*")
        q = make(read).writeStream.foreachBatch(lambda df, _: got.extend(map(tuple, df.collect()))).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
    return got


def test_late_details_equal_the_batch_join(spark, tmp_path):
    cards = [(str(i), at(10 * i), i) for i in range(12)]
    # late, out of order, before its card, too late, without a card, twice
    details = [("0", at(59), 1, 2, 3), ("2", at(21), 4, 5, None), ("1", at(12), 6, 7, 8), ("3", at(29), 9, 9, 9), ("4", at(101), 9, 9, 9), ("99", at(30), 1, 1, 1), ("5", at(60), 1, 0, 0), ("5", at(61), 2, 0, 0), (None, at(61), 2, 0, 0)]
    end = [("end", at(10_000), 0)], [("end", at(10_000), 0, 0, 0)]
    steps = [{"cards": cards[6:], "details": details[4:]}, {"cards": cards[:6], "details": details[:4]}, {"cards": end[0], "details": end[1]}, {"cards": [], "details": []}]
    schemas = {"cards": CARD, "details": DETAIL}
    got = fed(spark, tmp_path, steps, lambda read: stream.late_details(read("cards"), read("details"), "1 hour", "3 hours"), schemas)
    whole = stream.late_details(spark.createDataFrame(cards, CARD), spark.createDataFrame(details, DETAIL), "1 hour", "3 hours")
    want = sorted(map(tuple, whole.collect()))
    assert sorted(r for r in got if r[0] != "end") == want and len(want) == 13
    by_id = {r[0]: r[3:] for r in want}
    assert by_id["0"] == (1, 2, 3) and by_id["2"] == (4, 5, None) and by_id["3"] == by_id["4"] == by_id["11"] == (0, 0, None)


POST = "ingest_seq long, post_id string, author_handle string, observed_at timestamp"


def test_strict_cooldown(spark, tmp_path):
    row = lambda i, author, minutes: (i, str(i), author, at(minutes))
    first = [row(1, "a", 5), row(0, "a", 0), row(2, "a", 119), row(3, "b", 1), row(4, "c", 0), row(5, "c", 0), row(6, None, 0), row(7, None, 3)]
    second = [row(8, "a", 120), row(9, "a", 121), row(10, "b", 120), row(11, "b", 121)]
    steps = [{"in": first}, {"in": second}, {"in": [row(12, "z", 5000)]}, {"in": []}]
    got = fed(spark, tmp_path, steps, lambda read: stream.strict_cooldown(read("in")), {"in": POST})
    assert sorted(r[0] for r in got) == [0, 3, 4, 6, 8, 11, 12]
    kept = spark.read.format("statestore").option("stateVarName", "last").load(f"{tmp_path}/cp")
    assert kept.count() == 1  # of all authors only the last one may still be in cool-down


class Service:
    """A topic service that notes the texts it was asked about; one kind of text makes it fail, one takes long."""

    def __init__(self, path):
        self.path = path

    def __call__(self, texts):
        with open(self.path, "a", encoding="utf-8") as f:
            f.writelines(f"{t}\n" for t in texts)
        if "bad" in texts:
            raise RuntimeError("no answer")
        if "slow" in texts:
            time.sleep(20)
        return ['{"genre": "政治", "reason": "r"}' if t == "vote" else "{odd" if t == "odd" else '{"genre": "none"}' for t in texts]


def test_each_text_is_asked_about_once(spark, tmp_path):
    asked = tmp_path / "asked"
    batched = classify.Batched(lambda p=str(asked): Service(p), str(tmp_path / "answers"), size=1, seconds=3)
    texts = ["vote", "vote", "x", "odd", None, "", " 　", "bad", "slow", "vote" * 200, "vote" * 300]
    posts = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "i int, text_snippet string, genre string")
    for k in range(2):
        got = {r["i"]: (r["genre"], r["reason"]) for r in classify.classify_batch(posts, batched).collect()}
        assert got[0] == got[1] == ("政治", "r") and got[2] == ("その他", None)
        assert got[3] == got[7] == got[8] == ("その他", "分類失敗") and got[4] == got[5] == got[6] == ("その他", "本文なし")
        lines = sorted(t for t in asked.read_text().split("\n") if t)
        long = ("vote" * 200)[:500]
        # only what had no reply is asked about again
        assert lines == sorted(["vote", "x", "odd", long] + ["bad", "slow"] * (k + 1))
    assert classify.classify(posts, batched).columns == ["i", "text_snippet", "genre"]


def test_cycle_with_a_service(spark, tmp_path):
    seen = "post_id string, author_handle string, url string, text_snippet string, posted_at timestamp, likes long, retweets long, replies long, quotes long, bookmarks long, impressions long, seq long, observed_at timestamp"
    rows = [(str(i), f"a{i}", "u", "vote", T0 - timedelta(hours=1), 2000, 200, 100, 10, 20, None, i, T0) for i in range(3)]
    path = str(tmp_path / "asked")
    batched = classify.Batched(lambda: Service(path), str(tmp_path / "answers"))
    cycle.run_cycle(spark, spark.createDataFrame(rows, seen), str(tmp_path / "s"), ["vote"], "2024-03-01 12:00:00", 1, classifier=batched)
    from upwell.sources.store import Store

    assert {r["genre"] for r in Store(spark, str(tmp_path / "s")).read("posts").collect()} == {"政治"}
    with open(path, encoding="utf-8") as f:
        assert f.read().split() == ["vote"]


def test_top_lists_take_one_pass(spark):
    posts = rel.posts(spark, "/root/testdata/sf0.001").withColumn("matched_keyword", F.lit("k"))
    lists = report.top_lists(posts)
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert plan.count("events.parquet") == 1 and plan.count("WindowGroupLimit") == 2 and "TakeOrdered" not in plan
    got = lists.orderBy("list", "pos").collect()
    likes = [r["url"] for r in rank.top_by_likes(posts).collect()]
    best = [r["url"] for r in rank.top_by_progress(posts).collect()]
    assert [r["url"] for r in got] == likes + best and [r["pos"] for r in got] == [1, 2, 3, 4, 5] * 2


@pytest.mark.parametrize("seconds", [0.2])
def test_replies_have_a_time_limit(seconds):
    began = time.monotonic()
    assert classify.replies(lambda texts: time.sleep(5), ["a", "b"], seconds) == [None, None]
    assert time.monotonic() - began < 3
    assert classify.replies(lambda texts: ["x"], ["a", "b"], seconds) == [None, None]  # not one for each
    assert classify.replies(lambda texts: texts, ["a", "b"], 5) == ["a", "b"]
