"""The registered queries over posts, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from upwell import catalog_sql
from upwell.config import PushConfig, Thresholds
from upwell.functions import detect, text
from upwell.operators import alerts, classify, enrich, notify, rank, report, state
from upwell.operators import keywords as kw
from upwell.plans import modes
from upwell.plans.cycle import flag_posts, select_posts
from upwell.schema import STATUS, STORED_POST
from upwell.sources import keywords as kw_source
from upwell.sources import html_cards, raw, search
from upwell.sources import relations as rel
from upwell.sources.store import Store, shared_dir
from upwell.streaming.stream import first_sightings, late_details, start_cycles, start_upserts, strict_cooldown

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def seconds(c: str) -> F.Column:
    return F.unix_seconds(c).alias(f"{c}_s")


@query
def q_elapsed_velocity(spark, d):
    p = rel.posts(spark, d)
    return p.select("ingest_seq", detect.elapsed_hours().alias("hours"), *(detect.velocity(c).alias(f"v_{c}") for c in ("likes", "retweets", "replies", "quotes", "bookmarks")))


@query
def q_ratios(spark, d):
    return rel.posts(spark, d).select("ingest_seq", *(detect.like_ratio(c).alias(f"r_{c}") for c in ("quotes", "bookmarks", "replies")))


@query
def q_is_instant(spark, d):
    return rel.posts(spark, d).select("ingest_seq", detect.is_instant().alias("is_instant"))


@query
def q_is_sustained(spark, d):
    return rel.posts(spark, d).select("ingest_seq", detect.is_sustained().alias("is_sustained"))


@query
def q_explosive_type(spark, d):
    return rel.posts(spark, d).select("ingest_seq", detect.explosive_type().alias("explosive_type"))


@query
def q_highlight(spark, d):
    return rel.posts(spark, d).select("ingest_seq", detect.is_highlight().alias("is_gekiatsu"))


@query
def q_rank_score(spark, d):
    # six digits: the logarithm's last bits differ between libraries
    return rel.posts(spark, d).select("ingest_seq", detect.round_half_even(detect.rank_score(), 6).alias("score"))


@query
def q_progress(spark, d):
    return rel.posts(spark, d).select("ingest_seq", detect.progress().alias("progress"))


@query
def q_filter_explosive(spark, d):
    return rank.filter_explosive(rel.posts(spark, d)).select("ingest_seq", "post_id", "author_handle", "likes")


@query
def q_rank_candidates(spark, d):
    ranked = rank.rank_candidates(rank.filter_explosive(rel.posts(spark, d)))
    return ranked.select("ingest_seq", "post_id", "elapsed_hours", "buzz_score", "quote_like_ratio", "bookmark_like_ratio", "reply_like_ratio", "is_gekiatsu", "explosive_type")


@query
def q_top_progress(spark, d):
    return rank.top_by_progress(rel.posts(spark, d)).select("ingest_seq", "post_id", "progress")


@query
def q_top_likes(spark, d):
    return rank.top_by_likes(kw.whitelist(rel.posts(spark, d), rel.KEYWORDS)).select("ingest_seq", "post_id", "likes", "matched_keyword")


@query
def q_parse_count(spark, d):
    """Localized renderings of the counters, parsed back."""
    p = rel.posts(spark, d)
    e, n = F.col("ingest_seq"), F.col("likes")
    shapes = [n.cast("string"), F.format_number(n, 0), F.concat(F.lit(" "), (n / 8).cast("string"), F.lit("K ")), F.concat((n / 16).cast("string"), F.lit("万")), F.concat((n / 4).cast("string"), F.lit("m")), F.lit(""), F.lit("1.2.3"), F.lit(",."), F.concat(F.lit("　"), n.cast("string"), F.lit("　")), F.lit("2.3億"), F.lit("4.1M"), F.lit("0.57万")]
    rendered = F.get(F.array(*shapes), F.pmod(e, F.lit(len(shapes))).cast("int"))
    return p.select("ingest_seq", rendered.alias("raw")).select("ingest_seq", text.parse_count(F.col("raw")).alias("n"))


@query
def q_label_count(spark, d):
    return rel.cards(spark, d).select("ingest_seq", *(text.label_count(F.col(f"{c}_label")).alias(f"n_{c}") for c in ("reply", "retweet", "like")))


@query
def q_extract_id(spark, d):
    c = rel.cards(spark, d)
    return c.select("ingest_seq", text.post_id(F.col("href")).alias("post_id"), text.handle(F.col("user_href")).alias("handle"), text.absolute_url(F.col("href")).alias("link"))


@query
def q_card_extract(spark, d):
    c = raw.extract_cards(rel.cards(spark, d))
    return c.select("ingest_seq", "post_id", "author_handle", "url", "text_snippet", seconds("posted_at"), "likes", "retweets", "replies")


@query
def q_detail_parse(spark, d):
    return raw.parse_details(rel.details(spark, d)).select("ingest_seq", "impressions", "bookmarks")


@query
def q_parse_ts(spark, d):
    c = rel.cards(spark, d).select("ingest_seq", F.unix_seconds(text.iso_time(F.col("datetime"))).alias("iso_s"))
    i = rel.api_items(spark, d).select("ingest_seq", F.unix_seconds(text.legacy_time(F.col("createdAt"))).alias("legacy_s"))
    return c.join(i, "ingest_seq")


@query
def q_normalize_items(spark, d):
    n = raw.normalize_items(rel.api_items(spark, d))
    return n.select("ingest_seq", "post_id", "author_handle", "url", seconds("posted_at"), "text_snippet", "likes", "retweets", "replies")


KEYWORD_FILE = "# list\nearthquake drill, earthquake\n\n 地震、台風 ,flood\noutage\n#recall\nrecall,,earthquake\n　事件　\nlicense、token"


@query
def q_keyword_load(spark, d):
    """A keyword file's text, with how many posts hold each keyword."""
    words = kw_source.parse_keywords(spark.createDataFrame([(KEYWORD_FILE,)], "value string"))
    hits = rel.posts(spark, d).select(F.explode(F.filter(kw_source.keyword_array(rel.KEYWORDS), lambda k: F.contains("text_snippet", k))).alias("keyword"))
    n = hits.groupBy("keyword").agg(F.count("*").alias("n_posts"))
    return words.join(n, "keyword", "left").select("pos", "keyword", F.coalesce("n_posts", F.lit(0)).alias("n_posts"))


@query
def q_keyword_match(spark, d):
    return rel.posts(spark, d).select("ingest_seq", kw.matches(F.col("text_snippet"), rel.KEYWORDS).alias("matched"))


@query
def q_first_keyword(spark, d):
    return rel.posts(spark, d).select("ingest_seq", kw.first_keyword(F.col("text_snippet"), rel.KEYWORDS).alias("matched_keyword"))


@query
def q_keyword_join(spark, d):
    listed = spark.createDataFrame(list(enumerate(rel.KEYWORDS)), "pos long, keyword string")
    return kw.keyword_join(rel.posts(spark, d), listed).select("ingest_seq", "matched_keyword")


@query
def q_whitelist(spark, d):
    return kw.whitelist(rel.posts(spark, d), rel.KEYWORDS).select("ingest_seq", "post_id", "matched_keyword")


@query
def q_source_predicate(spark, d):
    e = F.col("ingest_seq")
    posts = rel.posts(spark, d).withColumn("lang", F.when(e % 4 == 3, "en").otherwise("ja")).withColumn("is_repost", e % 5 == 1)
    return raw.source_predicate(posts).select("ingest_seq", "likes", "replies")


@query
def q_union_modes(spark, d):
    return state.union_modes(*rel.snapshots(spark, d)).select("post_id", "seq", "likes", "retweets")


@query
def q_dedupe_posts(spark, d):
    s = state.union_modes(*rel.snapshots(spark, d))
    return state.dedupe(s).select("post_id", "first_seq", "likes", "retweets", "replies", "impressions")


@query
def q_quote_count(spark, d):
    """A quote listing with repeats and nulls, counted for every post."""
    e = F.col("ingest_seq")
    posts = rel.posts(spark, d).select("ingest_seq", "post_id")
    seen = posts.filter(e % 3 != 0).select("post_id", F.explode(F.sequence(F.lit(0).cast("long"), e % 6)).alias("k"), "ingest_seq")
    listing = seen.select("post_id", F.when((F.col("k") + e) % 5 != 0, F.concat(F.lit("q"), (F.col("k") % 4).cast("string"))).alias("label"))
    counted = posts.join(raw.count_quotes(listing), "post_id", "left")
    return counted.select("ingest_seq", F.coalesce("quotes", F.lit(0)).alias("quotes"))


@query
def q_prefilter(spark, d):
    return enrich.prefilter(rel.posts(spark, d), rel.KEYWORDS).select("ingest_seq", "post_id")


@query
def q_detail_enrich(spark, d):
    p = rel.posts(spark, d)
    got = raw.parse_details(rel.details(spark, d)).withColumn("quotes", F.col("ingest_seq") % 50)
    out = enrich.add_details(p, got.select("post_id", "quotes", "bookmarks", "impressions"), rel.KEYWORDS)
    return out.select("ingest_seq", "quotes", "bookmarks", "impressions")


@query
def q_alt_enrich(spark, d):
    return enrich.add_views(rel.posts(spark, d), rel.views(spark, d)).select("ingest_seq", "post_id", "impressions")


@query
def q_handles(spark, d):
    many = rel.posts(spark, d).withColumn("likes", F.col("likes") * 10)
    return enrich.handles(enrich.popular(many)).orderBy("author_handle")


@query
def q_semi_handles(spark, d):
    p = rel.posts(spark, d)
    wanted = enrich.handles(enrich.popular(p.withColumn("likes", F.col("likes") * 10), Thresholds(profile_likes=59_000)))
    return enrich.of_handles(p, wanted).select("ingest_seq", "author_handle")


@query
def q_anti_known(spark, d):
    return state.drop_known(rel.posts(spark, d), rel.known_ids(spark, d)).select("ingest_seq", "post_id")


@query
def q_cooldown(spark, d):
    return state.drop_cooling(rel.posts(spark, d), rel.author_state(spark, d)).select("ingest_seq", "author_handle")


def _stored(p: DataFrame, seq: F.Column) -> DataFrame:
    genre = F.when(F.col("ingest_seq") % 9 != 0, classify.finalize(F.col("text_snippet"), classify.offline(F.col("text_snippet")))["genre"])
    return p.select(
        "post_id", "author_handle", "url", "posted_at", "text_snippet", "likes", "retweets", "replies", "quotes", "bookmarks", genre.alias("genre"),
        F.col("observed_at").alias("detected_at"), (F.col("ingest_seq") % 2 == 0).alias("notified"), F.when(F.col("ingest_seq") % 2 == 0, F.col("observed_at")).alias("notified_at"), seq.alias("seq"),
    )


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Stored posts, and a later write of part of them with some new ones."""
    p = rel.posts(spark, d)
    e = F.col("ingest_seq")
    base = _stored(p.filter(e % 4 != 0), e)
    later = p.filter(e % 3 == 0).withColumn("likes", F.when(e % 6 != 0, F.col("likes") + 7)).withColumn("author_handle", F.lit("renamed"))
    return base, _stored(later, e + 10_000_000_000).withColumn("genre", F.lit("経済"))


@query
def q_upsert(spark, d):
    out = state.upsert(*_versions(spark, d))
    return out.select("post_id", "author_handle", "likes", "retweets", "replies", "quotes", "bookmarks", "genre", seconds("detected_at"), "notified", "seq")


@query
def q_mark_notified(spark, d):
    base, _ = _versions(spark, d)
    e = F.col("seq")
    sent = base.select("post_id", notify.accepted(F.when(e % 5 == 0, 200).otherwise(500), F.when(e % 7 < 3, 200).otherwise(429), F.concat(F.lit('{"status":'), (e % 2).cast("string"), F.lit("}"))).alias("first_ok"), F.lit(None).cast("boolean").alias("second_ok"))
    return state.mark_notified(base, sent, F.lit("2024-02-01").cast("timestamp")).select("post_id", "notified", seconds("notified_at"))


@query
def q_recent_flagged(spark, d):
    base, _ = _versions(spark, d)
    return rank.recent(base).select("post_id", seconds("detected_at"))


@query
def q_meta_latest(spark, d):
    """Key-value writes, one for each post, as the author table."""
    e = F.col("ingest_seq")
    log = rel.posts(spark, d).select(F.concat(F.lit("author_last_notified:"), F.col("author_handle")).alias("key"), F.when(e % 11 != 0, e.cast("string")).alias("value"), e.alias("seq"))
    return state.latest_meta(log)


@query
def q_run_log(spark, d):
    e = rel.runs(spark, d).select(F.col("run_id"), "started_at", (F.col("started_at") + F.make_dt_interval(mins=F.lit(2))).alias("finished_at"), "posts_scanned", (F.col("posts_scanned") % 5).alias("posts_flagged"), F.lit("success").alias("status"), F.lit(None).cast("string").alias("error_message"))
    log, new = e.filter("run_id <= 700"), e.filter("run_id > 700").drop("run_id")
    return state.append_runs(log, new).select("run_id", seconds("started_at"), seconds("finished_at"), "posts_scanned", "posts_flagged", "status")


def _flagged(spark: SparkSession, d: str) -> DataFrame:
    flagged = flag_posts(rel.posts(spark, d), rel.KEYWORDS, rel.known_ids(spark, d), rel.author_state(spark, d))
    return flagged.withColumn("notified", F.col("fresh") & (F.col("ingest_seq") % 2 == 0))


@query
def q_run_counts(spark, d):
    return state.run_counts(_flagged(spark, d))


@query
def q_genre_finalize(spark, d):
    e = F.col("ingest_seq")
    p = rel.posts(spark, d).withColumn("text_snippet", F.when(e % 17 == 0, " 　").otherwise(F.col("text_snippet")))
    reply = F.when(e % 5 == 0, '{"genre": "政治", "reason": "r"}').when(e % 5 == 1, '{"genre": "other", "reason": "x"}').when(e % 5 == 2, '{"genre": ').when(e % 5 == 3, '{"genre": "経済"}')
    return p.select("ingest_seq", classify.finalize(F.col("text_snippet"), reply).alias("c")).select("ingest_seq", "c.genre", "c.reason")


def _messages(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("ingest_seq")
    hot = rank.enrich(rank.filter_explosive(rel.posts(spark, d)))
    with_word = hot.withColumn("matched_keyword", kw.first_keyword(F.col("text_snippet"), rel.KEYWORDS))
    return with_word.withColumn("genre", F.when(e % 3 != 0, "経済")).withColumn("url", F.when(e % 5 != 0, F.col("url")))


@query
def q_message_text(spark, d):
    return _messages(spark, d).select("ingest_seq", notify.message_text().alias("text"))


@query
def q_push_payload(spark, d):
    fields = notify.push_payload(F.col("ingest_seq") % 2 == 0, PushConfig(sound="bell"))
    return _messages(spark, d).select("ingest_seq", *(c.alias(n) for n, c in fields.items()))


@query
def q_priority_route(spark, d):
    e = F.col("ingest_seq")
    p = rel.posts(spark, d)
    presence = p.filter(e % 10 == 0).select((e % 20 == 0).alias("at_school"), F.struct("observed_at", "ingest_seq").alias("updated_at"))
    return notify.route(p, presence).select("ingest_seq", "priority")


@query
def q_status_report(spark, d):
    return report.top_lists(kw.whitelist(rel.posts(spark, d), rel.KEYWORDS))


def _report(spark: SparkSession, d: str) -> DataFrame:
    white = kw.whitelist(rel.posts(spark, d), rel.KEYWORDS)
    return report.status_report(white, state.run_counts(_flagged(spark, d)), F.lit("2024-02-01T00:00:00Z"))


@query
def q_status_text(spark, d):
    """The report's text, and those of other states."""
    full = report.report_json(_report(spark, d))
    other = spark.createDataFrame(
        [
            ('{"updated_at": "2024-02-01T00:10:29Z", "status": "session_expired", "error_message": "login"}',),
            ('{"updated_at": "2024-02-01T00:10:30Z", "status": "error", "error_message": "boom"}',),
            ('{"updated_at": "2024-02-01T00:00:31Z", "status": "odd"}',),
            ('{"updated_at": "2024-02-01T00:00:29Z", "status": "success", "posts_scanned": 3, "notified_count": 0, "top5_by_likes": []}',),
        ],
        "value string",
    )
    parsed = full.unionByName(other).select(F.from_json("value", STATUS).alias("r")).select("r.*")
    return parsed.select("status", "updated_at", report.status_text(F.lit("2024-02-01T00:11:00Z").cast("timestamp")).alias("text"))


@query
def q_webhook(spark, d):
    """One webhook body for each post; some ask for the status, some twice."""
    e = F.col("ingest_seq")
    text_of = F.when(e % 3 == 0, " 動作確認 ").when(e % 3 == 1, "動作確認").otherwise("hello")
    event = lambda kind, inner, text, tag: F.struct(F.lit(kind).alias("type"), F.concat(F.lit(tag), e.cast("string")).alias("replyToken"), F.struct(F.lit(inner).alias("type"), text.alias("text")).alias("message"))
    events = F.array(event("message", "text", text_of, "a"), event("message", "sticker", F.lit("動作確認"), "b"), event("follow", "text", F.lit("動作確認"), "c"), event("message", "text", F.lit("動作確認。"), "d"))
    body = F.when(e % 7 == 0, "{bad").when(e % 7 == 1, "{}").otherwise(F.to_json(F.struct(events.alias("events"))))
    return report.status_requests(rel.posts(spark, d).select(body.alias("value")))


@query
def q_streaks(spark, d):
    return alerts.zero_streaks(rel.runs(spark, d)).select("run_id", "posts_scanned", "streak")


@query
def q_alerts(spark, d):
    return alerts.zero_post_alerts(rel.runs(spark, d)).select("run_id", seconds("at"), "streak")


@query
def q_pipeline(spark, d):
    out = select_posts(rel.posts(spark, d), rel.KEYWORDS, rel.known_ids(spark, d), rel.author_state(spark, d))
    return out.select("ingest_seq", "post_id", "author_handle", "matched_keyword", "elapsed_hours", "buzz_score", "is_gekiatsu", "explosive_type").orderBy(F.desc("buzz_score"), "ingest_seq")


@query
def q_stream_parity(spark, d):
    """Both sightings of every post through a file stream of upserts."""
    root = _scratch_root(spark, "stream")
    for k, part in enumerate(_versions(spark, d)):
        part.select(*Store(spark, root).rows("posts").columns).coalesce(4).write.mode("append").parquet(f"{root}/in/{k}")
        stream = spark.readStream.schema(STORED_POST).parquet(f"{root}/in/*")
        start_upserts(spark, stream, f"{root}/state", f"{root}/checkpoint").awaitTermination()
    out = Store(spark, f"{root}/state").read("posts")
    return out.select("post_id", "author_handle", "likes", "retweets", "replies", "quotes", "bookmarks", "genre", seconds("detected_at"), "notified", "seq")


@query
def q_session_alerts(spark, d):
    runs = rel.runs(spark, d).withColumn("status", F.when(F.col("posts_scanned") == 0, "session_expired").otherwise("success"))
    return alerts.session_alerts(runs).select("run_id", seconds("at"))


@query
def q_failed_report(spark, d):
    """The reports of runs whose source failed, as JSON."""
    failed = rel.runs(spark, d).filter("posts_scanned = 0")
    at = F.date_format("started_at", "yyyy-MM-dd HH:mm:ss")
    kind = F.when(F.col("run_id") % 2 == 0, "session_expired").otherwise("error")
    return report.report_json(report.failure_report(failed.select(at.alias("updated_at"), kind.alias("status"), at.alias("started_at"), F.concat(F.lit("run "), F.col("run_id")).alias("error_message"))))


@query
def q_trial_outbox(spark, d):
    """What a trial over all hot posts sends, through a first channel that takes some of them."""
    take = lambda out: out.select("post_id", (F.length("post_id") % 2 == 0).alias("first_ok"), F.lit(None).cast("boolean").alias("second_ok"))
    return modes.run_trial(spark, take, _messages(spark, d)).select("post_id", "author_handle", "text", "title", "sound", "priority")


@query
def q_quote_query(spark, d):
    return rel.posts(spark, d).select("ingest_seq", text.quote_query(F.col("text_snippet")).alias("quoted"))


def _scratch_root(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/upwell-{name}-{uuid.uuid4().hex}"


@query
def q_first_sightings(spark, d):
    """Both sightings of every post through a stream that keeps the first of each."""
    root = _scratch_root(spark, "first")
    state.union_modes(*rel.snapshots(spark, d)).select("post_id", "posted_at").write.parquet(f"{root}/in")
    stream = first_sightings(spark.readStream.schema("post_id string, posted_at timestamp").parquet(f"{root}/in"))
    stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("post_id string, posted_at timestamp").parquet(f"{root}/out").select("post_id", seconds("posted_at"))


#: Times of the two cycles of ``q_cycle_state``.
CYCLES = ("2024-01-16 12:00:00", "2024-01-16 13:00:00")


@query
def q_cycle_state(spark, d):
    """Stored posts after two cycles of a stream, in which deliveries of every third post fail."""
    root = _scratch_root(spark, "cycles")
    seen = rel.posts(spark, d).withColumn("seq", F.col("ingest_seq")).drop("ingest_seq", "user_id")
    send = lambda out: out.select("post_id", (F.col("post_id").cast("long") % 3 != 0).alias("first_ok"), F.lit(None).cast("boolean").alias("second_ok"))
    stream = spark.readStream.schema(seen.schema).parquet(f"{root}/in/*")
    for k, at in enumerate(CYCLES):
        part = seen if k else seen.filter("seq % 2 = 0")
        part.withColumn("observed_at", F.lit(at).cast("timestamp")).write.parquet(f"{root}/in/{k}")
        start_cycles(spark, stream, f"{root}/state", rel.KEYWORDS, f"{root}/checkpoint", None, sender=send).awaitTermination()
    out = Store(spark, f"{root}/state").read("posts")
    return out.select("post_id", "author_handle", "likes", "genre", seconds("detected_at"), "notified", seconds("notified_at"))


@query
def q_late_details(spark, d):
    """Cards and details as two streams in two halves of time; some details come too late for their card."""
    root = _scratch_root(spark, "late")
    e = F.col("ingest_seq")
    cards = rel.posts(spark, d).select("post_id", "ingest_seq", "observed_at", "likes")
    details = rel.posts(spark, d).filter(e % 3 != 0).select("post_id", (F.col("observed_at") + F.make_dt_interval(mins=F.when(e % 7 == 0, 90).otherwise(e % 50).cast("int"))).alias("seen_at"), "quotes", "bookmarks", "impressions")
    half, end = F.lit("2024-01-16").cast("timestamp"), F.lit("2100-01-01").cast("timestamp")
    last = lambda df, at: df.limit(1).withColumn(at, end).withColumn("post_id", F.lit("end"))
    for k in (0, 1, 2):
        for name, df, at in (("cards", cards, "observed_at"), ("details", details, "seen_at")):
            part = last(df, at) if k == 2 else df.filter((F.col(at) < half) if k == 0 else (F.col(at) >= half))
            part.write.parquet(f"{root}/{name}/{k}")
        read = lambda name, df: spark.readStream.schema(df.schema).parquet(f"{root}/{name}/*")
        out = late_details(read("cards", cards), read("details", details))
        out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out").filter("post_id <> 'end'").select("ingest_seq", "post_id", "quotes", "bookmarks", "impressions")


@query
def q_strict_cooldown(spark, d):
    """All hot posts as a stream in two halves of time, one of an author within two hours."""
    root = _scratch_root(spark, "strict")
    hot = rank.filter_explosive(rel.posts(spark, d)).select("ingest_seq", "post_id", "author_handle", "observed_at")
    half = F.lit("2024-01-16").cast("timestamp")
    for k, part in enumerate((hot.filter(F.col("observed_at") < half), hot.filter(F.col("observed_at") >= half))):
        part.write.parquet(f"{root}/in/{k}")
        out = strict_cooldown(spark.readStream.schema(hot.schema).parquet(f"{root}/in/*"))
        out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out").select("ingest_seq", "post_id", "author_handle")


#: Times of the polls of the search queries, and results that a search gives at most.
POLLS, CAP = (1705406400, 1705410000, 1705413600, 1705417200), 400


def _results(spark: SparkSession, d: str) -> DataFrame:
    """What the site would show of the posts, in both modes."""
    e = F.col("ingest_seq")
    p = rel.posts(spark, d).withColumn("lang", F.when(e % 4 == 3, "en").otherwise("ja")).withColumn("is_repost", e % 5 == 1)
    return p.select("ingest_seq", *StructType.fromDDL(search.RESULT).names, F.lit(search.QUERY).alias("query"), F.explode(F.array(F.lit("live"), F.lit("top"))).alias("mode"))


@query
def q_search_source(spark, d):
    """Two polls through the search source, with a filter that it takes over."""
    root = _scratch_root(spark, "search")
    for k in (0, 1):
        _results(spark, d).filter(F.col("ingest_seq") % 2 == k).drop("ingest_seq").write.parquet(f"{root}/poll={POLLS[k]}")
    found = search.read(spark, root, cap=CAP)
    return found.filter((F.col("likes") >= 3000) & (F.col("lang") == "ja")).select("poll", "mode", "seq", "post_id", "likes", seconds("posted_at"), seconds("observed_at"))


@query
def q_search_runs(spark, d):
    """The run log of a stream of polls: one with results, one without, one that can't be read, one with results."""
    root = _scratch_root(spark, "polls")
    results, name = _results(spark, d), search.register(spark)
    stream = spark.readStream.format(name).option("path", f"{root}/polls").option("cap", CAP).load()
    for k, poll in enumerate(POLLS):
        path = f"{root}/polls/poll={poll}"
        if k == 2:
            spark.createDataFrame([("no results",)], "value string").coalesce(1).write.text(path)
        else:
            results.filter(F.col("ingest_seq") % 2 == k // 2 if k != 1 else F.lit(False)).drop("ingest_seq").write.parquet(path)
        start_cycles(spark, stream, f"{root}/state", rel.KEYWORDS, f"{root}/checkpoint", None).awaitTermination()
    return Store(spark, f"{root}/state").read("runs").select("run_id", "posts_scanned", "status")


@query
def q_html_cards(spark, d):
    """The cards of all posts rendered as result pages, and all web pages, read as HTML."""
    safe = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    attr = lambda name, c: F.coalesce(F.concat(F.lit(f' {name}="'), safe(F.col(c)), F.lit('"')), F.lit(""))
    card = F.concat(
        F.lit('<article><div><a role="link"'), attr("href", "user_href"), F.lit("><img src=x></a><a"), attr("href", "href"), F.lit("><time"), attr("datetime", "datetime"), F.lit(">1h</time></a></div><div data-testid=\"tweetText\"><span>"),
        safe(F.col("body")), F.lit('</span></div><div><button data-testid="reply"'), attr("aria-label", "reply_label"), F.lit('><i>9</i></button><button data-testid="retweet">'), safe(F.col("retweet_label")),
        F.lit('</button><button data-testid="like"'), attr("aria-label", "like_label"), F.lit("></button></div></article>"),
    )
    made = rel.cards(spark, d).select(F.floor(F.col("ingest_seq") / 20).alias("page_id"), F.struct("ingest_seq", "observed_at", card.alias("html")).alias("card"))
    pages = made.groupBy("page_id").agg(F.array_sort(F.collect_list("card")).alias("cards"))
    html = F.concat(F.lit("<html><body><p>Results<main>"), F.array_join(F.col("cards.html"), "\n"), F.lit("</main>"))
    web = rel.read(spark, d, "pages").select((-1 - F.col("page_id")).alias("page_id"), "html")
    parsed = html_cards.parse_cards(pages.select("page_id", html.alias("html")).unionByName(web))
    at = F.get("cards", F.col("position"))
    named = parsed.join(pages, "page_id", "left").withColumn("ingest_seq", at["ingest_seq"]).withColumn("observed_at", at["observed_at"])
    c = raw.extract_cards(named)
    return c.select("ingest_seq", "post_id", "author_handle", "url", "text_snippet", seconds("posted_at"), "likes", "retweets", "replies")


@query
def q_point_reads(spark, d):
    """Posts that a store doesn't hold, by a look-up of their ids in its buckets."""
    store = Store(spark, _scratch_root(spark, "points"), bucket_rows=1000)
    store.write("notices", rel.known_ids(spark, d).withColumn("notified_at", F.lit(None).cast("timestamp")), 1)
    store.commit(1)
    p = rel.posts(spark, d)
    return state.drop_known(p, store.lookup("notices", p.select("post_id"))).select("ingest_seq", "post_id")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return catalog_sql.oracle_sql()
