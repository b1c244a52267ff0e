"""The search source, cards from HTML and the push sink."""

from __future__ import annotations

import json
import threading
from datetime import datetime, timezone
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from upwell.plans import cycle
from upwell.sources import html_cards, push, search
from upwell.sources.raw import SourceUnavailable
from upwell.sources.store import Store
from upwell.streaming import stream

POLL = 1709290800
RESULT = f"query string, mode string, {search.RESULT}"


def result(i, mode="live", query="flood", likes=1000, replies=30, lang="ja", repost=False, at=POLL):
    return (query, mode, str(i), "a", f"https://x.com/a/status/{i}", "flood here", lang, repost, datetime.fromtimestamp(at - i, timezone.utc), likes, 1, replies, 0, 0, None)


def put(spark, root, poll, rows):
    spark.createDataFrame(rows, RESULT).coalesce(2).write.parquet(f"{root}/poll={poll}")


def load(spark, root, **options):
    return search.read(spark, str(root), **options)


def test_query_operators_and_cap(spark, tmp_path):
    q = search.QUERY
    rows = [result(1, "top", q, 900), result(2, "top", q, 500), result(3, "top", q, 499), result(4, "top", q, 700, replies=19), result(5, "top", q, 800, lang="en"), result(6, "top", q, 999, repost=True)]
    put(spark, tmp_path, POLL, [*rows, result(7, "live", q), result(8, "live", q, 600), result(9, "live", "other")])
    got = load(spark, tmp_path).orderBy("seq").collect()
    assert [(r["mode"], r["post_id"], r["seq"]) for r in got] == [("live", "7", 0), ("live", "8", 1), ("top", "1", 1 << 24), ("top", "2", (1 << 24) + 1)]
    assert {r["observed_at"] for r in got} == {datetime.fromtimestamp(POLL)}
    assert [r["post_id"] for r in load(spark, tmp_path, cap=1).orderBy("seq").collect()] == ["7", "1"]
    words = load(spark, tmp_path, queries="other\nno such\nfrom:a flood", modes="live").collect()
    assert [r["post_id"] for r in words] == []  # a query's results are those kept under it
    put(spark, tmp_path, POLL + 1, [result(1, query="from:a flood min_retweets:1"), result(2, query="from:b"), result(3, query="from:a flood min_retweets:1", likes=5)])
    assert sorted(r["post_id"] for r in load(spark, tmp_path, queries="from:a flood min_retweets:1\nfrom:b").collect()) == ["1", "3"]


def test_filters_are_pushed_down(spark, tmp_path):
    for k in range(3):
        put(spark, tmp_path, POLL + k, [result(10 * k + i, m, likes=100 * i) for i in range(8) for m in ("live", "top")])
    every = load(spark, tmp_path, queries="flood")
    some = every.filter((F.col("likes") >= 300) & (F.col("mode") == "top") & (F.col("poll") > POLL) & (F.col("likes") % 200 == 0) & F.col("post_id").isin("14", "16", "3"))
    plan = some._jdf.queryExecution().executedPlan().toString()
    kept = plan[plan.index("Filter") : plan.index("BatchScan")] if "Filter" in plan else ""
    assert "% 200" in kept and ">= 300" not in kept and "mode" not in kept  # the source has taken the others
    assert sorted(r["post_id"] for r in some.collect()) == ["14", "16"]
    assert some.rdd.getNumPartitions() == 2 and every.rdd.getNumPartitions() == 6
    assert every.count() == 48 and some.count() == 2 and load(spark, tmp_path, queries="flood").filter("mode = 'live'").unionByName(some).count() == 26
    capped = load(spark, tmp_path, queries="flood", cap=2).filter("likes < 700")
    assert sorted((r["mode"], r["likes"]) for r in capped.collect()) == [("live", 0)] * 3 + [("live", 100)] * 3 + [("top", 600)] * 3


def read_parts(root, **options):
    """The rows of each partition and its batches, as the workers read them."""
    reader = search.SearchReader(StructType.fromDDL(search.SIGHTING), {"path": str(root), **{k: str(v) for k, v in options.items()}})
    return [(p.mode, list(reader.read(p))) for p in reader.partitions()]


def arrow(rows):
    names = [f.split()[0] for f in RESULT.split(", ")]
    kinds = {"posted_at": pa.timestamp("us", "UTC"), "is_repost": pa.bool_()} | {n: pa.int64() for n in ("likes", "retweets", "replies", "quotes", "bookmarks", "impressions")}
    return pa.table({n: pa.array([r[k] for r in rows], kinds.get(n, pa.string())) for k, n in enumerate(names)})


@pytest.mark.parametrize("held", [1, 7, 1000])
@pytest.mark.parametrize("cap", [None, 0, 1, 7, 8, 30, 1000])
def test_places_in_passes(spark, tmp_path, monkeypatch, held, cap):
    """Ties, copies, nulls and files without a column; however little is held, results and their places are those of one sort."""
    monkeypatch.setattr(search, "HELD", held)
    monkeypatch.setattr(search, "BATCH", 4)
    rows = [result(i * 31 % 17, ("live", "top", "top")[i % 3], likes=None if i % 11 == 4 else i * 7 % 5) for i in range(90)]
    rows = [(*r[:2], None if i % 13 == 5 else r[2], *r[3:8], None if i % 8 == 3 else r[8], *r[9:]) for i, r in enumerate(rows)]
    (tmp_path / f"poll={POLL}").mkdir()
    for k in range(3):
        table = arrow(rows[30 * k : 30 * k + 30])
        table = table.drop_columns(["quotes"]) if k == 1 else table.select(table.column_names[::-1]) if k == 2 else table
        pq.write_table(table, tmp_path / f"poll={POLL}" / f"{k}.parquet", row_group_size=9)
    names = [f.split()[0] for f in RESULT.split(", ")]
    for order, (mode, batches) in enumerate(read_parts(tmp_path, queries="flood", **({} if cap is None else {"cap": cap}))):
        by = names.index("posted_at" if mode == "live" else "likes")
        desc = lambda v: (v is None, -(v.timestamp() if isinstance(v, datetime) else v or 0))
        want = sorted((r for r in rows if r[1] == mode), key=lambda r: (desc(r[by]), r[2] is None, r[2] or ""))[:cap]
        got = sorted((row for b in batches for row in b.to_pylist()), key=lambda row: row["seq"])
        assert [row["seq"] for row in got] == [order * search.RESULTS + k for k in range(len(want))]
        assert [(row["post_id"], row["likes"], row["posted_at"]) for row in got] == [(r[2], r[9], r[8]) for r in want]
        assert all(len(b) <= 4 for b in batches)


@pytest.mark.parametrize("cap", [None, 50])
def test_a_large_poll_is_not_held(spark, tmp_path, monkeypatch, cap):
    monkeypatch.setattr(search, "HELD", 20_000, raising=False)
    n, per = 240_000, 30_000
    (tmp_path / f"poll={POLL}").mkdir()
    for k in range(n // per):
        few = arrow([result(i, likes=i % 999) for i in range(k * per, k * per + per)])
        few = few.set_column(few.column_names.index("text_snippet"), "text_snippet", pa.array([f"{i} flood ".ljust(300, "x") for i in range(per)]))
        pq.write_table(few, tmp_path / f"poll={POLL}" / f"{k}.parquet")
    whole = n * 300
    del few
    pool, usual = pa.proxy_memory_pool(pa.default_memory_pool()), pa.default_memory_pool()
    pa.set_memory_pool(pool)
    try:
        reader = search.SearchReader(StructType.fromDDL(search.SIGHTING), {"path": str(tmp_path), "queries": "flood", "modes": "live"} | ({} if cap is None else {"cap": str(cap)}))
        seen = [b["seq"].to_pylist() for b in reader.read(reader.partitions()[0])]
    finally:
        pa.set_memory_pool(usual)
    assert sorted(x for b in seen for x in b) == list(range(cap or n))
    assert pool.max_memory() < whole / 4


def test_session_and_missing_polls(spark, tmp_path):
    put(spark, tmp_path / "p", POLL, [result(1)])
    session = tmp_path / "session.json"
    with pytest.raises(Exception, match="SourceUnavailable: no session"):
        load(spark, tmp_path / "p", queries="flood", session=str(session)).collect()
    session.write_text(json.dumps({"expires": POLL + 1}))
    assert load(spark, tmp_path / "p", queries="flood", session=str(session)).count() == 1
    session.write_text(json.dumps({"expires": POLL}))
    poll = lambda: load(spark, tmp_path / "p", queries="flood", session=str(session))
    assert cycle.run_polled(spark, poll, str(tmp_path / "s"), ["flood"], "2024-03-01 12:00:00", 1) == "session_expired"
    assert Store(spark, str(tmp_path / "s")).read("runs").first()["error_message"] == f"the session ended at {POLL}"
    with pytest.raises(Exception, match="no polls"):
        load(spark, tmp_path / "none").collect()
    assert SourceUnavailable("x").expired is False


def test_stream_continues_at_its_offset(spark, tmp_path):
    taken = []
    name = search.register(spark)
    polled = spark.readStream.format(name).options(path=str(tmp_path / "p"), queries="flood").load()
    for k in range(4):
        put(spark, tmp_path / "p", POLL + 60 * k, [result(k)] if k != 2 else [])
        if k != 1:  # the second poll is found together with the third
            q = polled.writeStream.foreachBatch(lambda df, n: taken.append((n, sorted((r["poll"] - POLL, r["post_id"] or "") for r in df.collect()))))
            q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert taken == [(0, [(0, ""), (0, "0")]), (1, [(60, ""), (60, "1"), (120, "")]), (2, [(180, ""), (180, "3")])]


def test_polls_of_a_stream_as_cycles(spark, tmp_path):
    polled = spark.readStream.format(search.register(spark)).options(path=str(tmp_path / "p"), queries="flood").load()
    for k in range(2):
        put(spark, tmp_path / "p", POLL + 3600 * k, [result(1, likes=3000)] if not k else [])
        stream.start_cycles(spark, polled, str(tmp_path / "s"), ["flood"], str(tmp_path / "cp"), None).awaitTermination()
    runs = Store(spark, str(tmp_path / "s")).read("runs").orderBy("run_id").collect()
    assert [(r["posts_scanned"], r["started_at"]) for r in runs] == [(1, datetime.fromtimestamp(POLL)), (0, datetime.fromtimestamp(POLL + 3600))]


CARD = (
    '<article><a role="link" href="/u{0}/"><img></a><a href="/u{0}/status/{0}"><time datetime="2024-01-01T00:00:00.000Z">1h</time></a><div data-testid="tweetText">a &amp; b<br>c</div>'
    '<button data-testid="reply" aria-label="12 replies">x</button><button data-testid="retweet"></button><button data-testid="like"><b>1.2</b>K</button>{1}</article>'
)


def test_cards_of_html(spark):
    quoted = CARD.format(2, "")
    pages = {
        0: None, 1: "", 2: "no cards", 3: "<html>" + CARD.format(1, "") * 3, 4: CARD.format(1, quoted), 5: "<article><time datetime=d><p>open <article>no time",
        6: "</div></article><time><a href='/x'>" + CARD.format(7, "</span></i>")[:-10] + "<!-- <article> --><script>'<article><time>'</script>", 7: "<article><h1>news</h1></article><time>",
        8: "<ARTICLE><A HREF='/u/status/9' href=other><TIME></A></ARTICLE>", 9: "<article><time><" , 10: "&lt;article><time>",
    }
    df = spark.createDataFrame([(k, h, "u") for k, h in pages.items()], "page_id long, html string, href string").repartition(3)
    out = html_cards.parse_cards(df)
    assert out.columns == ["page_id", "position", *html_cards.CARD_COLUMNS]
    got = {}
    for r in sorted(out.collect()):
        got.setdefault(r["page_id"], []).append(tuple(r)[2:])
    one = lambda n: (f"/u{n}/status/{n}", "2024-01-01T00:00:00.000Z", f"/u{n}/", "a & b\nc", "12 replies", "", "1.2K")
    assert got[3] == [one(1)] * 3 and got[4] == [one(1), one(2)] and got[6] == [one(7)]
    assert got[5] == [(None, "d", None, None, None, None, None)] == got[9][:0] + [(None, "d", None, None, None, None, None)]
    assert got[8] == [("/u/status/9", None, None, None, None, None, None)] and sorted(got) in ([3, 4, 5, 6, 8], [3, 4, 5, 6, 8, 9])


def test_long_and_broken_pages(spark):
    whole = "<p>" * 200_000 + CARD.format(5, "") + "x" * 9_000_000
    broken = "<div><article><time><i data-testid=tweetText>text<a role=link href=/u>" * 20_000
    df = spark.createDataFrame([(1, whole), (2, broken)], "page_id long, html string")
    got = html_cards.parse_cards(df).groupBy("page_id").agg(F.count("*"), F.max(F.length("body")), F.min("user_href")).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 7, "/u5/"), (2, 20_000, html_cards.TEXT_CHARS, "/u")]


class Channel(BaseHTTPRequestHandler):
    """Two channels that know a message by its key; the first message of each fails once on its way back."""

    seen, posts, lost = {}, [], set()

    def do_POST(self):  # noqa: N802
        key, body = self.headers["Idempotency-Key"], self.rfile.read(int(self.headers["Content-Length"]))
        if key not in self.seen:
            self.seen[key] = body
            self.posts.append((self.path, key, body, self.headers.get("Authorization")))
        if key in self.lost:
            self.lost.discard(key)
            self.connection.close()  # taken, but the answer is lost
            return
        status, said = (200, {}) if self.path == "/first" else (200, {"status": 0 if b"message=c" in body else 1})
        if self.path == "/first" and b'"bad"' in body:
            status = 400
        answer = json.dumps(said).encode()
        self.send_response(status)
        self.send_header("Content-Length", str(len(answer)))
        self.end_headers()
        self.wfile.write(answer)

    def log_message(self, *args):
        pass


@pytest.fixture
def channel():
    Channel.seen, Channel.posts, Channel.lost = {}, [], set()
    server = ThreadingHTTPServer(("127.0.0.1", 0), Channel)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def box(spark, *rows):
    names = ["text", "title", "message", "sound", "priority", "link", "url_title", "retry", "expire"]
    return spark.createDataFrame([(i, f"k:{i}", text, "t", m, "siren", "2", None, None, "60", "3600") for i, text, m in rows], f"post_id string, send_key string, {', '.join(f'{n} string' for n in names)}")


def test_push_and_answers(spark, tmp_path, channel):
    send = push.HttpSender(str(tmp_path), {"first_url": f"{channel}/first", "first_to": "me", "first_token": "T", "second_url": f"{channel}/second", "second_token": "x", "second_user": "u"})
    rows = box(spark, ("1", "hello", "a"), ("2", "bad", "b"), ("3", "bad", "c"), ("4", "é 日本", "c"))
    assert {r["post_id"]: (r["first_ok"], r["second_ok"]) for r in send(rows).collect()} == {"1": (True, True), "2": (False, True), "3": (False, False), "4": (True, False)}
    assert len(Channel.posts) == 8
    first = {k: (json.loads(b), a) for p, k, b, a in Channel.posts if p == "/first"}
    assert first["k:4:first"] == ({"to": "me", "messages": [{"type": "text", "text": "é 日本"}]}, "Bearer T")
    second = {k: parse_qs(b.decode()) for p, k, b, _ in Channel.posts if p == "/second"}
    assert second["k:1:second"] == {"token": ["x"], "user": ["u"], "title": ["t"], "message": ["a"], "sound": ["siren"], "priority": ["2"], "retry": ["60"], "expire": ["3600"]}
    none = push.HttpSender(str(tmp_path), {"first_url": "http://127.0.0.1:1/nobody"})
    assert [(r["first_ok"], r["second_ok"]) for r in none(box(spark, ("1", "x", "y"))).collect()] == [(False, False)]


class Breaking(push.PushWriter):
    """A writer whose first attempt ends after its posts went out."""

    def write(self, iterator):
        from pyspark import TaskContext

        answers = super().write(iterator)
        if TaskContext.get().attemptNumber() == 0 and answers.rows:
            raise RuntimeError("the executor is lost")
        return answers


class BreakingSink(push.PushSink):
    def writer(self, schema, overwrite):
        return Breaking(dict(self.options))


def test_repeated_sends_go_out_once(spark, tmp_path, channel, monkeypatch):
    """A run that ended while sending is repeated; the channels know the messages by their keys."""
    t0 = datetime(2024, 3, 1, 12, tzinfo=timezone.utc)
    seen = "post_id string, author_handle string, url string, text_snippet string, posted_at timestamp, likes long, retweets long, replies long, quotes long, bookmarks long, impressions long, seq long, observed_at timestamp"
    at = datetime(2024, 3, 1, 11, tzinfo=timezone.utc)
    batch = spark.createDataFrame([(str(i), f"a{i}", "u", "flood", at, 2000, 200, 100, 10, 20, None, i, t0) for i in range(4)], seen)
    send = push.HttpSender(str(tmp_path / "answers"), {"first_url": f"{channel}/first"})
    run = lambda: cycle.run_cycle(spark, batch, str(tmp_path / "s"), ["flood"], "2024-03-01 12:00:00", 1, sender=send)
    with monkeypatch.context() as m, pytest.raises(Exception):  # noqa: B017
        m.setattr(push, "PushSink", BreakingSink)
        run()
    assert len(Channel.posts) == 4 and not (tmp_path / "s" / "_manifests").exists()
    Channel.lost.update(list(Channel.seen)[:1])
    n = run()
    assert len(Channel.posts) == 4 and n["posts_flagged"] == 4 and n["notified_count"] in (3, 4)
    assert run() == n and len(Channel.posts) == 4
    assert sum(r["notified"] for r in Store(spark, str(tmp_path / "s")).read("posts").collect()) == n["notified_count"]
