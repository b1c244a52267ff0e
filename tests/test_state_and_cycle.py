from __future__ import annotations

import json
import time
from datetime import datetime, timedelta, timezone
from itertools import count

import pytest
from pyspark.sql import functions as F

from upwell.config import Thresholds
from upwell.operators import alerts, classify, notify, report, state
from upwell.plans import cycle
from upwell.schema import AUTHOR_STATE, META, RUN, STORED_POST
from upwell.sources.raw import SourceUnavailable
from upwell.sources.store import StaleCycle, StateExpired, Store
from upwell.streaming import stream

T0 = datetime(2024, 3, 1, 12, tzinfo=timezone.utc)
SEEN = "post_id string, author_handle string, url string, text_snippet string, posted_at timestamp, likes long, retweets long, replies long, quotes long, bookmarks long, impressions long, seq long, observed_at timestamp"


def sighting(i, author="a", likes=2000, text="flood here", seq=None, at=T0):
    return (str(i), author, f"https://x.com/{author}/status/{i}", text, at - timedelta(hours=1), likes, 200, 100, 10, 20, None, i if seq is None else seq, at)


def test_dedupe_keeps_first_place_and_last_values(spark):
    df = spark.createDataFrame([("A", 1, 0), ("B", 2, 1), ("A", None, 2)], "post_id string, likes long, seq long")
    for n in (1, 5):
        got = {r["post_id"]: (r["likes"], r["first_seq"]) for r in state.dedupe(df.repartition(n)).collect()}
        assert got == {"A": (None, 0), "B": (2, 1)}


def stored(post_id, author, likes, genre, seq):
    return (post_id, author, "u", T0, "t", likes, 1, 1, 1, 1, genre, T0, False, None, seq)


def test_upsert_changes_counters_and_genre_only(spark):
    base = spark.createDataFrame([stored("1", "a", 5, "x", 1), stored("2", "b", 5, "x", 2)], STORED_POST)
    delta = spark.createDataFrame([stored("1", "zz", None, "y", 3), stored("3", "c", 7, "z", 4)], STORED_POST)
    once = state.upsert(base, delta)
    got = {r["post_id"]: (r["author_handle"], r["likes"], r["genre"]) for r in once.collect()}
    assert got == {"1": ("a", None, "y"), "2": ("b", 5, "x"), "3": ("c", 7, "z")}
    assert sorted(state.upsert(base, delta.unionByName(delta)).collect()) == sorted(once.collect())


def test_mark_notified_and_meta(spark):
    base = spark.createDataFrame([stored("1", "a", 5, "x", 1), stored("2", "b", 5, "x", 2), stored("3", "b", 5, "x", 2)], STORED_POST)
    sent = spark.createDataFrame([("1", True, False), ("2", False, False), ("3", None, True), ("9", True, True)], "post_id string, first_ok boolean, second_ok boolean")
    assert {r["post_id"]: r["notified"] for r in state.mark_notified(base, sent).collect()} == {"1": True, "2": False, "3": True}
    at = {r["post_id"]: r["notified_at"] for r in state.mark_notified(base, sent, F.lit(T0)).collect()}
    assert at["1"] == at["3"] == T0.replace(tzinfo=None) and at["2"] is None
    log = spark.createDataFrame([("k", "1", 1), ("k", None, 3), ("j", "x", 2)], META)
    assert {r["key"]: r["value"] for r in state.latest_meta(log).collect()} == {"k": None, "j": "x"}


def test_two_posts_of_an_author_pass_together(spark):
    posts = spark.createDataFrame([sighting(1), sighting(2), sighting(3, "b")], SEEN)
    authors = spark.createDataFrame([("b", T0 - timedelta(hours=1))], AUTHOR_STATE)
    assert sorted(r["post_id"] for r in state.drop_cooling(posts, authors).collect()) == ["1", "2"]


def runs(spark, counts, gap=1):
    rows = [(i + 1, T0 + timedelta(hours=i * gap), None, c, 0, "success" if c is not None else "error", None) for i, c in enumerate(counts)]
    return spark.createDataFrame(rows, RUN)


def test_streaks_and_alert_cooldown(spark):
    got = [r["streak"] for r in alerts.zero_streaks(runs(spark, [0, 0, None, 0, 0, 5, 0])).orderBy("run_id").collect()]
    assert got == [1, 2, None, 3, 4, 0, 1]
    assert [r["run_id"] for r in alerts.zero_post_alerts(runs(spark, [0] * 30)).orderBy("run_id").collect()] == [3, 27]
    expired = runs(spark, [0] * 30).withColumn("status", F.lit("session_expired"))
    assert [r["run_id"] for r in alerts.session_alerts(expired).orderBy("run_id").collect()] == [1, 25]


def test_streaks_over_blocks_and_jobs(spark, monkeypatch):
    """Streaks go from block to block on all levels, whatever numbers are missing."""
    import random

    monkeypatch.setattr(alerts, "BLOCK_BITS", 3)
    rng, rows, want = random.Random(3), [], {}
    for job in ("a", "b", "c"):
        streak = 0
        for i in sorted(rng.sample(range(250), 180)):
            scanned = rng.choices([0, 7, None], [30, 1 if job != "c" else 0, 2])[0]
            streak = streak if scanned is None else 0 if scanned else streak + 1
            rows.append((job, i, scanned))
            want[job, i] = None if scanned is None else streak
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "job string, run_id long, posts_scanned long")
    got = alerts.zero_streaks(df, "job")
    assert {(r["job"], r["run_id"]): r["streak"] for r in got.collect()} == want and max(v or 0 for v in want.values()) > 60
    one = alerts.zero_streaks(df.filter("job = 'b'").drop("job"))
    assert {r["run_id"]: r["streak"] for r in one.collect()} == {i: s for (j, i), s in want.items() if j == "b"}
    assert "SinglePartition" not in one._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("gaps", [1, 2, 5, 1000])
def test_alert_cooldown_over_blocks(spark, monkeypatch, gaps):
    """Alerts of a kind are those of the plain rule, however time is cut."""
    import random

    import pandas as pd

    monkeypatch.setattr(alerts, "BLOCK_GAPS", gaps)
    rng, rows = random.Random(gaps), []
    for kind, pause in (("often", 1), ("rare", 30), ("mixed", 9)):
        at = T0 - timedelta(days=400)
        for i in range(250):
            at += timedelta(hours=rng.choice([0, 1, 1, 2, pause, 24, 0.5]))
            rows.append((kind, i, at, None))
    rng.shuffle(rows)
    due = spark.createDataFrame(rows, "kind string, run_id long, at timestamp, streak long")
    want = set()
    for kind in ("often", "rare", "mixed"):
        mine = sorted((r[2], r[1]) for r in rows if r[0] == kind)
        want |= {(kind, i) for (_, i), fire in zip(mine, alerts.spaced([pd.Timestamp(t) for t, _ in mine], 24), strict=True) if fire}
    got = alerts.alerts(due, 24)
    assert got.columns == due.columns and {(r["kind"], r["run_id"]) for r in got.collect()} == want and len(want) > 30


def test_streamed_alerts_equal_batch(spark, tmp_path):
    counts = [0 if (i // 5) % 3 == 0 else 1 for i in range(120)]
    log = runs(spark, counts).select(F.lit("j").alias("job"), "run_id", "started_at", "posts_scanned")
    want = [(r["run_id"], r["streak"]) for r in alerts.zero_post_alerts(runs(spark, counts)).orderBy("run_id").collect()]
    got = []
    src = str(tmp_path / "in")
    for k in range(3):
        log.filter(F.col("run_id").between(40 * k + 1, 40 * k + 40)).coalesce(1).write.mode("append").parquet(src)
        out = stream.zero_post_alerts(spark.readStream.schema(log.schema).parquet(src))
        q = out.writeStream.foreachBatch(lambda df, _: got.extend((r["run_id"], r["streak"]) for r in df.collect())).outputMode("append")
        q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(got) == want and len(want) > 1


def test_genre_validation(spark):
    rows = [("t", '{"genre":"政治","reason":"r"}'), ("t", '{"genre":"?","reason":"r"}'), ("t", "{bad"), ("t", None), (" 　", '{"genre":"政治"}'), (None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, r string")
    got = [tuple(r["c"]) for r in df.select("i", classify.finalize(F.col("t"), F.col("r")).alias("c")).orderBy("i").collect()]
    assert got == [("政治", "r"), ("その他", "r"), ("その他", "分類失敗"), ("その他", "分類失敗"), ("その他", "本文なし"), ("その他", "本文なし")]


def test_send_results(spark):
    df = spark.createDataFrame([(200, None, None), (500, 200, '{"status":1}'), (500, 200, '{"status":0}'), (500, 429, '{"status":1}'), (None, None, None)], "a int, b int, c string")
    assert [r[0] for r in df.select(notify.accepted(F.col("a"), F.col("b"), F.col("c"))).collect()] == [True, True, False, False, False]


def test_status_text_minutes(spark):
    one = spark.range(1).select(report.minutes_since(F.lit("2024-01-01T00:00:00Z").cast("timestamp"), F.lit("2024-01-01T00:00:30Z").cast("timestamp")).alias("m"))
    assert one.first()["m"] == 1


def test_webhook(spark):
    body = json.dumps({"events": [{"type": "message", "replyToken": "t", "message": {"type": "text", "text": " 動作確認\n"}}, {"type": "message", "replyToken": "u", "message": {"type": "text", "text": "動作確認？"}}, {"type": "follow", "replyToken": "v"}]})
    df = spark.createDataFrame([(body,), ("{",), ("{}",)], "value string")
    assert [r["reply_token"] for r in report.status_requests(df).collect()] == ["t"]


def test_cycles(spark, tmp_path):
    root = str(tmp_path / "state")
    state.init_state(spark, str(tmp_path / "empty"))
    made = Store(spark, str(tmp_path / "empty"))
    assert made.manifests() == [0] and made.read("posts").count() == 0 and made.read("meta").count() == 0
    at = T0.strftime("%Y-%m-%d %H:%M:%S")
    first = spark.createDataFrame([sighting(1), sighting(1, likes=2500, seq=9), sighting(2, "b", text="nothing"), sighting(3, "c", likes=10)], SEEN)
    n = cycle.run_cycle(spark, first, root, ["flood"], at, 1)
    assert n == {"posts_scanned": 3, "whitelisted": 2, "candidates": 1, "posts_flagged": 1, "notified_count": 1}
    assert cycle.run_cycle(spark, first, root, ["flood"], at, 1) == n  # again, the same versions
    kept = Store(spark, root).read("posts").collect()
    assert [(r["post_id"], r["likes"], r["notified"], r["genre"]) for r in kept] == [("1", 2500, True, "事件・事故")]
    # known post, author in cool-down, and a delivery that fails
    later = T0 + timedelta(hours=1)
    second = spark.createDataFrame([sighting(1, at=later), sighting(4, "a", at=later), sighting(5, "d", at=later)], SEEN)
    fail = lambda out: out.select("post_id", F.lit(False).alias("first_ok"), F.lit(False).alias("second_ok"))
    n = cycle.run_cycle(spark, second, root, ["flood"], later.strftime("%Y-%m-%d %H:%M:%S"), 2, sender=fail)
    assert (n["candidates"], n["posts_flagged"], n["notified_count"]) == (3, 1, 0)
    store = Store(spark, root)
    assert {r["post_id"]: r["notified"] for r in store.read("posts").collect()} == {"1": True, "5": False}
    assert [r["author_handle"] for r in store.read("authors").collect()] == ["a"]
    status = json.loads("\n".join(r["value"] for r in spark.read.text(f"{root}/status").collect()))
    assert status["posts_flagged"] == 1 and len(status["top5_by_likes"]) == 3
    assert cycle.log_failure(spark, root, at, 3, SourceUnavailable("gone", expired=True)) == "session_expired"  # reported in its turn
    assert [(r["run_id"], r["status"]) for r in store.read("runs").orderBy("run_id").collect()] == [(1, "success"), (2, "success"), (3, "session_expired")]


class Counting:
    """A sender that keeps what it was handed, in a file that its tasks append to."""

    def __init__(self, path, fails=False):
        self.path, self.fails = path, fails

    def __call__(self, out):
        path, fails = self.path, self.fails

        def send(batches):
            for rows in batches:
                with open(path, "a", encoding="utf-8") as f:
                    f.writelines(f"{i}\n" for i in rows["post_id"])
                if fails:
                    raise RuntimeError("the channel broke")
                yield rows[["post_id"]].assign(first_ok=True, second_ok=None)

        return out.select("post_id").mapInPandas(send, "post_id string, first_ok boolean, second_ok boolean")

    def handed(self):
        with open(self.path, encoding="utf-8") as f:
            return sorted(f.read().split())


def cached(spark):
    return spark.sparkContext._jsc.getPersistentRDDs().size()


def test_each_post_is_sent_once(spark, tmp_path):
    root, sender = str(tmp_path / "state"), Counting(str(tmp_path / "sent"))
    batch = spark.createDataFrame([sighting(i, f"a{i}") for i in range(5)], SEEN)
    at, before = T0.strftime("%Y-%m-%d %H:%M:%S"), cached(spark)
    n = cycle.run_cycle(spark, batch, root, ["flood"], at, 1, sender=sender)
    assert n["posts_flagged"] == n["notified_count"] == 5 and sender.handed() == list("01234")
    assert cached(spark) == before
    cycle.run_cycle(spark, batch, root, ["flood"], at, 1, sender=sender)
    cycle.run_cycle(spark, batch, root, ["flood"], at, 2, sender=sender)
    assert sender.handed() == list("01234")
    posts = Store(spark, root).read("posts").collect()
    assert len(posts) == 5 and all(r["notified"] and r["notified_at"] == T0.replace(tzinfo=None) for r in posts)


@pytest.mark.parametrize("broken", ["outbox", "outbox_sent", "notices", "authors", "runs", "meta"])
def test_each_post_is_sent_once_after_a_failure(spark, tmp_path, monkeypatch, broken):
    root, sender = str(tmp_path / "state"), Counting(str(tmp_path / "sent"))
    batch = spark.createDataFrame([sighting(i, f"a{i}") for i in range(5)], SEEN)
    at, write = T0.strftime("%Y-%m-%d %H:%M:%S"), Store.write

    def failing(self, table, df, version):
        if table == broken and broken != "outbox_sent":
            raise OSError("the folder is away")
        return write(self, table, df, version)

    with monkeypatch.context() as m, pytest.raises(Exception):  # noqa: B017
        m.setattr(Store, "write", failing)
        # where the answers are lost, what was sent is unknown and not sent again
        cycle.run_cycle(spark, batch, root, ["flood"], at, 1, sender=Counting(sender.path, fails=True) if broken == "outbox_sent" else sender)
    n = cycle.run_cycle(spark, batch, root, ["flood"], at, 1, sender=sender)
    assert len(set(sender.handed())) == len(sender.handed()) and n["posts_flagged"] == 5
    assert (n["notified_count"], len(sender.handed())) == (5, 5) or broken == "outbox_sent"
    assert {r["post_id"]: r["notified"] for r in Store(spark, root).read("posts").collect()} == dict.fromkeys("01234", broken != "outbox_sent")


def test_reports_alerts_and_run_length(spark, tmp_path):
    root, sender = str(tmp_path / "state"), Counting(str(tmp_path / "sent"))
    store, none, ticks = Store(spark, root), spark.createDataFrame([], SEEN), count(0, 30)
    t = Thresholds(alert_cooldown_hours=4)
    for k in range(1, 9):
        at = (T0 + timedelta(hours=k)).replace(tzinfo=None).isoformat(sep=" ")
        cycle.run_cycle(spark, none, root, ["flood"], at, k, sender=sender, clock=lambda: next(ticks), t=t)
    # the third run without posts, and the first one four hours later
    assert sender.handed() == ["system:zero_posts"] * 2 and store.steps("alerts") == [3, 7]
    assert store.at("alerts", 3).first()["text"].startswith("🔥 急上昇検知 [📈持続/システム通知]\n⚠️ 3回連続で投稿を0件しか")
    assert {r["key"]: r["value"] for r in store.read("meta").collect()}["zero_posts_streak"] == "8"
    run = store.read("runs").orderBy("run_id").first()
    assert run["finished_at"] - run["started_at"] == timedelta(seconds=30)
    status = lambda: json.loads("\n".join(r["value"] for r in spark.read.text(f"{root}/status").collect()))
    assert status()["started_at"] < status()["finished_at"] and status()["top5_by_likes"] == []
    for k in (9, 10):
        at = (T0 + timedelta(hours=k)).replace(tzinfo=None).isoformat(sep=" ")
        assert cycle.log_failure(spark, root, at, k, SourceUnavailable("gone", expired=True), sender=sender) == "session_expired"
    assert store.steps("alerts") == [3, 7, 9] and sender.handed()[0] == "system:session_expired"
    assert status() == {"updated_at": at, "status": "session_expired", "started_at": at, "posts_scanned": 0, "posts_flagged": 0, "notified_count": 0, "error_message": "gone"}
    assert cycle.log_failure(spark, root, at, 11, ValueError("odd"), sender=sender) == "error" and status()["status"] == "error"
    assert [r["run_id"] for r in store.read("runs").orderBy("run_id").collect()] == list(range(1, 12))
    assert [r["streak"] for r in alerts.zero_streaks(store.read("runs")).orderBy("run_id").collect()] == [*range(1, 9), None, None, None]


def test_levels_replace_runs(spark, tmp_path):
    store = Store(spark, str(tmp_path), fanout=3)
    for v in range(1, 11):
        store.write("posts", spark.createDataFrame([stored("1", f"a{v}", v, "x", v), stored(str(v + 1), "b", 0, "y", v)], STORED_POST), v)
        assert store.commit(v)
        got = {r["post_id"]: (r["author_handle"], r["likes"]) for r in store.read("posts").collect()}
        assert got == {"1": ("a1", v), **{str(k + 1): ("b", 0) for k in range(1, v + 1)}}
    assert sorted((r["level"], r["rows"]) for r in store.snapshot()["tables"]["posts"]) == [(0, 2), (2, 10)]


def size_of(folder):
    return sum(f.stat().st_size for f in folder.rglob("*.parquet"))


def test_bytes_written_follow_what_is_added(spark, tmp_path):
    """Forty cycles of equal size: a row is written once for each level it has come to."""
    store, written = Store(spark, str(tmp_path), fanout=4, keep=1000), []
    for v in range(1, 41):
        rows = spark.range(500).selectExpr(f"cast({v} * 1000 + id as string) post_id", f"timestamp_micros({v}) notified_at")
        store.write("notices", rows.coalesce(1), v)
        before = size_of(tmp_path)
        assert store.commit(v)
        written.append(sum(r["rows"] for r in store.snapshot()["tables"]["notices"] if f"r{v:09d}-" in r["path"]))
        assert size_of(tmp_path) >= before
    assert store.read("notices").count() == 20_000
    # levels of 4, 16: no cycle but those that fill one writes more than it adds, and all write 500 * (1 + levels)
    assert written.count(500) == 30 and written.count(2000) == 8 and written.count(8000) == 2


def test_cycle_shows_all_or_nothing(spark, tmp_path, monkeypatch):
    """A run that ends after any of its writes leaves the state of the cycle before."""
    at = lambda k: (T0 + timedelta(hours=3 * k)).replace(tzinfo=None).isoformat(sep=" ")
    batch = lambda k: spark.createDataFrame([sighting(f"{k}{i}", f"a{k}{i}", seq=i, at=T0 + timedelta(hours=3 * k)) for i in range(3)], SEEN)
    root, sender = str(tmp_path / "s"), Counting(str(tmp_path / "sent"))
    cycle.run_cycle(spark, batch(0), root, ["flood"], at(0), 1, sender=sender)
    tables = ["posts", "notices", "authors", "runs", "meta"]
    shown = lambda: {t: sorted(map(str, Store(spark, root).read(t).collect())) for t in tables}
    first, write, create = shown(), Store.write, Store._create
    for stop in ["chosen", *tables, "manifest"]:
        with monkeypatch.context() as m, pytest.raises(OSError):
            m.setattr(Store, "write", lambda self, t, df, v, stop=stop: (write(self, t, df, v), kill(t == stop))[0])
            m.setattr(Store, "_create", lambda self, name, content, stop=stop: (kill(stop == "manifest" and "_manifests" in name), create(self, name, content))[1])
            cycle.run_cycle(spark, batch(1), root, ["flood"], at(1), 2, sender=sender)
        assert shown() == first
    n = cycle.run_cycle(spark, batch(1), root, ["flood"], at(1), 2, sender=sender)
    assert n["posts_flagged"] == n["notified_count"] == 3 and len(shown()["posts"]) == 6
    assert sender.handed() == ["00", "01", "02", "10", "11", "12"]


def kill(now):
    if now:
        raise OSError("the machine is gone")


def test_one_of_two_writers_wins(spark, tmp_path):
    one, two = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    for k, store in enumerate((one, two)):
        store.write("posts", spark.createDataFrame([stored(str(k), "a", 1, "x", 1)], STORED_POST), 1)
        store.write("runs", spark.createDataFrame([(k, T0, T0, 0, 0, "success", None)], RUN), 1)
    assert one.commit(1, {"by": 1}) and not two.commit(1, {"by": 2})
    assert [r["post_id"] for r in two.read("posts").collect()] == ["0"] == [str(r["run_id"]) for r in two.read("runs").collect()]
    assert two.result(1) == {"by": 1} and len(two._names("posts")) == 1  # what the other wrote is gone
    assert one._create("_manifests/000000002.json", {}) and not two._create("_manifests/000000002.json", {})
    late = Store(spark, str(tmp_path))
    late.write("posts", spark.createDataFrame([stored("9", "a", 1, "x", 1)], STORED_POST), 0)
    with pytest.raises(StaleCycle):
        late.commit(0)


def test_old_state_is_right_or_raises(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("upwell.sources.store.BLOOM_ROWS", 1)
    store = Store(spark, str(tmp_path), fanout=2, keep=4)
    for v in range(1, 11):
        store.write("posts", spark.createDataFrame([stored(str(v), "a", v, "x", v)], STORED_POST), v)
        store.step("outbox", spark.range(v), v)
        store.commit(v)
    assert store.manifests() == [7, 8, 9, 10] == store.steps("outbox")
    for v in range(8, 12):
        assert sorted(int(r["post_id"]) for r in store.read("posts", v).collect()) == list(range(1, v))
    for v in range(1, 8):
        with pytest.raises(StateExpired):
            store.read("posts", v)
    assert len(store._names("outbox")) == 4 and store.at("outbox", 9).count() == 9
    held = {p for v in store.manifests() for r in store._manifest(v)["tables"]["posts"] for p in [r["path"].partition("/")[2]]}
    assert set(store._names("posts")) == held == set(store._names("bloom/posts"))
    assert Store(spark, str(tmp_path / "new")).read("posts", 3).count() == 0


def test_point_reads_open_few_files(spark, tmp_path):
    store = Store(spark, str(tmp_path), bucket_rows=100)
    for v in (1, 2, 3):
        rows = spark.range(2000).select(F.lit(None).cast("string").alias("x"), (F.col("id") * 3 + v).cast("string").alias("post_id"), F.current_timestamp().alias("notified_at")).drop("x")
        store.write("notices", rows, v)
        store.commit(v)
    runs_ = store.snapshot()["tables"]["notices"]
    assert [r["buckets"] for r in runs_] == [32, 32, 32] and all(len(r["files"]) == 32 for r in runs_)
    wanted = spark.createDataFrame([("4",), ("4",), ("3001",), ("no such id",), (None,)], "k string")
    got = store.lookup("notices", wanted)
    assert {r["post_id"] for r in got.join(wanted, got["post_id"] == wanted["k"]).collect()} == {"4", "3001"}
    assert 2 <= len(got.inputFiles()) <= 5 < len(store.rows("notices").inputFiles()) == 96
    every = store.rows("notices").select("post_id")
    for some in (every.filter("post_id % 7 = 0"), every, every.limit(0)):
        n = some.count()
        assert store.lookup("notices", some).join(some, "post_id", "left_semi").count() == n
    assert store.lookup("notices", wanted, before=1).count() == 0


def test_clock_with_and_without_offset(spark, tmp_path):
    """Times mean the same moment with and without an offset, also in a state that holds both."""
    root, none = str(tmp_path), spark.createDataFrame([], SEEN)
    forms = ["2024-03-01 00:00:00", "2024-03-01T10:00:00+09:00", "2024-03-01 02:00:00+00:00", "2024-03-01T03:00:00", "2024-03-02T11:00:00+09:00"]
    for k, now in enumerate(forms, 1):
        assert cycle.run_cycle(spark, none, root, ["flood"], now, k)["posts_scanned"] == 0
    store = Store(spark, root)
    assert [r["started_at"].hour for r in store.read("runs").orderBy("run_id").collect()] == [0, 1, 2, 3, 2]
    assert store.steps("alerts") == [3, 5]  # the third run without posts, and the first a day later
    for k, now in enumerate(["2024-03-03T00:00:00+00:00", "2024-03-03 10:00:00"], 6):
        assert cycle.log_failure(spark, root, now, k, SourceUnavailable("gone", expired=True)) == "session_expired"
    assert store.steps("alerts") == [3, 5, 6]


def test_rows_without_an_id_are_left_out(spark, tmp_path):
    rows = [sighting(1), (None, *sighting(2, "b")[1:]), (None, *sighting(3, "c")[1:])]
    for k in (1, 2):
        n = cycle.run_cycle(spark, spark.createDataFrame(rows, SEEN), str(tmp_path), ["flood"], str(T0 + timedelta(hours=3 * k - 3)), k)
        assert (n["posts_scanned"], n["posts_flagged"], n["notified_count"]) == ((1, 1, 1) if k == 1 else (1, 0, 0))
    assert [(r["post_id"], r["notified"]) for r in Store(spark, str(tmp_path)).read("posts").collect()] == [("1", True)]


def test_posts_in_cooldown_come_back(spark, tmp_path):
    root = str(tmp_path)
    run = lambda k, hours, *posts: cycle.run_cycle(spark, spark.createDataFrame([sighting(i, "a", at=T0 + timedelta(hours=hours)) for i in posts], SEEN), root, ["flood"], str(T0 + timedelta(hours=hours)), k)["posts_flagged"]
    assert run(1, 0, 1) == 1
    assert run(2, 1, 1, 2) == 0  # known, and in cool-down
    assert run(3, 2, 1, 2) == 1  # two hours later it is taken
    assert sorted(r["post_id"] for r in Store(spark, root).read("posts").collect()) == ["1", "2"]


def test_polled_source_that_fails(spark, tmp_path):
    root = str(tmp_path)
    status = lambda: json.loads("\n".join(r["value"] for r in spark.read.text(f"{root}/status").collect()))

    def gone():
        raise SourceUnavailable("no answer")

    lazily = spark.createDataFrame([sighting(1)], SEEN).withColumn("likes", F.raise_error(F.lit("SessionExpired: log in again")).cast("long"))
    assert cycle.run_polled(spark, gone, root, ["flood"], "2024-03-01 00:00:00", 1) == "error" and status()["error_message"] == "no answer"
    assert cycle.run_polled(spark, lambda: lazily, root, ["flood"], "2024-03-01 01:00:00", 2) == "session_expired" and status()["status"] == "session_expired"
    n = cycle.run_polled(spark, lambda: spark.createDataFrame([sighting(1)], SEEN), root, ["flood"], str(T0), 3)
    assert n["posts_flagged"] == 1 and status()["status"] == "success"
    assert cycle.run_polled(spark, gone, root, ["flood"], str(T0), 3) == "success"  # committed: nothing changes
    assert [r["status"] for r in Store(spark, root).read("runs").orderBy("run_id").collect()] == ["error", "session_expired", "success"]


def test_polls_without_posts_count_as_runs(spark, tmp_path):
    """A timed stream: polls that find nothing run cycles too."""
    schema = spark.createDataFrame([], SEEN).schema
    spark.createDataFrame([sighting(1, at=datetime.now(timezone.utc))], SEEN).coalesce(1).write.parquet(str(tmp_path / "in"))
    polled = stream.with_polls(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.start_cycles(spark, polled, str(tmp_path / "s"), ["flood"], str(tmp_path / "cp"), every="1 second")
    store = Store(spark, str(tmp_path / "s"))
    try:
        deadline = time.monotonic() + 120
        while len(store.manifests()) < 3 and time.monotonic() < deadline and q.exception() is None:
            time.sleep(1)
    finally:
        q.stop()
    runs_ = store.read("runs").orderBy("run_id").collect()
    assert len(runs_) >= 3 and sorted((r["posts_scanned"] for r in runs_), reverse=True)[:2] == [1, 0]
    assert {r["status"] for r in runs_} == {"success"}


@pytest.mark.parametrize("every", [None])
def test_stream_equals_batch(spark, tmp_path, every):
    src, schema = str(tmp_path / "in"), spark.createDataFrame([], SEEN).schema
    batches = [[sighting(1), sighting(2, "b")], [sighting(1, at=T0 + timedelta(hours=3), likes=9999), sighting(3, "a", at=T0 + timedelta(hours=3))]]
    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows, SEEN)
        df.coalesce(1).write.mode("append").parquet(src)
        q = stream.start_cycles(spark, spark.readStream.schema(schema).parquet(src), str(tmp_path / "s"), ["flood"], str(tmp_path / "cp"), every)
        q.awaitTermination()
        cycle.run_cycle(spark, df, str(tmp_path / "b"), ["flood"], str(max(r[-1] for r in rows).replace(tzinfo=None)), k + 1)
    for name in ("posts", "authors", "runs"):
        a, b = (sorted(map(str, Store(spark, str(tmp_path / x)).read(name).collect())) for x in "sb")
        assert a == b and a
