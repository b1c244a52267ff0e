from __future__ import annotations

import json

from pyspark.sql import functions as F

from upwell.functions import text
from upwell.operators import keywords as kw
from upwell.schema import API_ITEM
from upwell.sources import raw
from upwell.sources.keywords import load_keywords


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r["v"] for r in df.select("i", f(F.col("s")).alias("v")).orderBy("i").collect()]


def test_parse_count(spark):
    cases = {
        "": 0, "3,500": 3500, "1.2万": 12000, "5K": 5000, "5k": 5000, "1M": 1_000_000, "1.2.3": 0, ".": 0, ",": 0, "2.3億": 229_999_999, "4.1M": 4_099_999, "0.57万": 5699,
        "　12　": 12, "１２": 12, "1_000": 0, "abc": 0, "1d": 0, "K": 0, "-5": -5, "1e3": 1000, "9" * 40: 0,
    }
    assert column(spark, list(cases), text.parse_count) == list(cases.values())
    assert column(spark, [None], text.parse_count) == [0]


def test_labels_ids_urls(spark):
    assert column(spark, ["返信 12件", "likes 1.5K x 3", "none", None], text.label_count) == [12, 1500, 0, 0]
    assert column(spark, ["/a/status/12?x", "/a/statuses", None], text.post_id) == ["12", "", ""]
    assert column(spark, ["/user/", "//u/media", "", None], text.handle) == ["user", "u", "", ""]
    assert column(spark, ["/a", "https://b"], text.absolute_url) == ["https://x.com/a", "https://b"]


def test_times(spark):
    stamps = column(spark, ["2024-01-16T00:00:00Z", "2024-01-16T09:00:00.5+09:00", "2024-01-16T00:00:00", "x"], lambda c: F.unix_micros(text.iso_time(c)))
    base = 1_705_363_200_000_000
    assert stamps == [base, base + 500_000, base, None]
    assert column(spark, ["Tue Jan 16 00:00:00 +0000 2024", "soon", None], lambda c: F.unix_micros(text.legacy_time(c))) == [base, None, None]


def test_details(spark):
    pages = ["1.2万 Views\n5\n6\n7\n1.5K\nRelevant\n9", "12 views 1 2 3 Relevant 4", "no numbers", None, "3 View 1 2 3 4 5"]
    assert column(spark, pages, text.impressions) == [12000, 12, 0, 0, 3]
    assert column(spark, pages, text.bookmarks) == [1500, 0, 0, 0, 4]


def test_cards(spark):
    rows = [("/u/status/1", "2024-01-16T00:00:00Z", "/u", "b" * 300, "Reply 3", None, "like 1.2K"), ("/explore", "x", "/u", "b", "", "", ""), (None, None, None, None, None, None, None), ("/u/status/2", None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "href string, datetime string, user_href string, body string, reply_label string, retweet_label string, like_label string")
    df = df.withColumn("ingest_seq", F.lit(0).cast("long")).withColumn("observed_at", F.lit("2024-02-01").cast("timestamp"))
    got = {r["post_id"]: r for r in raw.extract_cards(df).collect()}
    assert set(got) == {"1", "2"}
    assert (got["1"]["likes"], got["1"]["replies"], got["1"]["retweets"], len(got["1"]["text_snippet"])) == (1200, 3, 0, 200)
    assert got["2"]["posted_at"] == got["2"]["observed_at"] and got["2"]["author_handle"] == ""


def test_items_from_json(spark, tmp_path):
    items = [{"id": "1", "author": {"userName": "a"}, "twitterUrl": "t", "createdAt": "Tue Jan 16 00:00:00 +0000 2024", "text": "x", "likeCount": 5}, {"text": "no id"}, {"id": "2"}]
    (tmp_path / "items.json").write_text("\n".join(map(json.dumps, items)) + "\n{broken\n", encoding="utf-8")
    got = {r["post_id"]: r for r in raw.normalize_items(raw.read_items(spark, str(tmp_path / "items.json"))).collect()}
    assert set(got) == {"1", "2"} and got["1"]["url"] == "t" and got["1"]["likes"] == 5 and got["2"]["author_handle"] == "" and got["2"]["likes"] == 0
    assert API_ITEM.startswith("id string")


def test_keyword_file(spark, tmp_path):
    path = tmp_path / "words.txt"
    path.write_text("# c\n b、a ,b\n\n　c　\n#d\na\n", encoding="utf-8")
    assert load_keywords(spark, str(path)) == ["b", "a", "c"]
    assert load_keywords(spark, str(tmp_path / "none.txt")) == []


def test_keyword_order_and_empty_list(spark):
    df = spark.createDataFrame([(0, "xx earthquake drill"), (1, "drill then earthquake"), (2, "Earthquake"), (3, ""), (4, None), (5, "flood earthquake")], "ingest_seq long, text_snippet string")
    words = ["earthquake drill", "earthquake", "flood"]
    want = {0: "earthquake drill", 1: "earthquake", 5: "earthquake"}
    assert {r["ingest_seq"]: r["matched_keyword"] for r in kw.whitelist(df, words).collect()} == want
    listed = spark.createDataFrame(list(enumerate(words)), "pos long, keyword string")
    assert {r["ingest_seq"]: r["matched_keyword"] for r in kw.keyword_join(df, listed).collect()} == want
    unfiltered = kw.keyword_join(df, listed.limit(0))
    assert unfiltered.columns == kw.whitelist(df, []).columns and sorted(map(repr, unfiltered.collect())) == sorted(map(repr, kw.whitelist(df, []).collect()))
    assert {r["matched_keyword"] for r in kw.whitelist(df, []).collect()} == {"(フィルタ無効・全件通過)"} and kw.whitelist(df, []).count() == 6
    assert [r[0] for r in df.orderBy("ingest_seq").select(kw.matches(F.col("text_snippet"), words)).collect()] == [True, True, False, False, False, True]


def test_keyword_join_against_the_array_form(spark, monkeypatch):
    import random

    rng = random.Random(4)
    bits = ["a", "ab", "b", "地", "震", "é", " ", "xyz", "x"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(150)] + [None, ""]
    # repeated ids and texts, and rows that are equal altogether
    df = spark.createDataFrame([(i % 60, t, i) for i, t in enumerate(texts * 2)] + [(1, "ab", 7)] * 2, "ingest_seq long, text_snippet string, anchor long")
    words = ["地震x", "xyzab", "ab地", "é", "bb", "zx", "abab"]
    listed = spark.createDataFrame([*enumerate(words), (90, ""), (91, "é")], "pos long, keyword string")
    want = sorted(map(repr, kw.whitelist(df, words).collect()))
    for room in (kw.BROADCAST_BYTES, 0):
        monkeypatch.setattr(kw, "BROADCAST_BYTES", room)
        assert sorted(map(repr, kw.keyword_join(df, listed).collect())) == want and want


def test_counters_of_other_scripts(spark):
    cases = {"\xa012\xa0": 12, "\u20031.5K": 1500, "١٢": 12, "１２": 12, "𝟏𝟐万": 120_000, "12 K": 12_000, "1２": 12, "x１": 0, "²": 0}
    assert column(spark, list(cases), text.parse_count) == list(cases.values())
    assert column(spark, ["返信 １２件", "٣٤ likes"], text.label_count) == [12, 34]
    assert column(spark, ["/a/status/１２"], text.post_id) == ["１２"]
    pages = ["１.２万\xa0Views\n5\n6\n7\n８\nRelevant\n9", "5 Views 1 2 3 4 Views 5 6 7 8"]
    assert column(spark, pages, text.impressions) == [12000, 5] and column(spark, pages, text.bookmarks) == [8, 4]


def test_predicate_is_pushed_down(spark, tmp_path):
    spark.createDataFrame([("ja", 600, 30, False), ("en", 600, 30, False), ("ja", 499, 30, False), ("ja", 500, 20, True)], "lang string, likes long, replies long, is_repost boolean").write.parquet(str(tmp_path / "p"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")  # else the plan is cut short
    df = raw.source_predicate(spark.read.parquet(str(tmp_path / "p")))
    assert df.count() == 1
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(likes,500)" in plan and "EqualTo(lang,ja)" in plan
