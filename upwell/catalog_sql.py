"""DuckDB SQL for the registered queries."""

from __future__ import annotations

_K = "['earthquake drill','earthquake','地震','台風','flood','outage','recall','事件','license','token']"

_OBSERVED = "e.ts + to_minutes(CAST(e.event_id * 37 % 480 AS BIGINT)) AS observed_at"

_P = f"""n AS (SELECT count(*) AS n FROM documents),
P AS (
  SELECT e.event_id AS ingest_seq, CAST(e.event_id AS VARCHAR) AS post_id, concat('user_', e.user_id) AS author_handle,
    concat('https://x.com/user_', e.user_id, '/status/', e.event_id) AS url,
    substring(CASE WHEN e.event_id % 4 = 0 THEN concat({_K}[1 + (e.event_id // 4) % 10], ' ', substring(d.text, 1, 200)) ELSE substring(d.text, 1, 200) END, 1, 200) AS text_snippet,
    e.ts AS posted_at, {_OBSERVED},
    e.event_id * 7919 % 6000 AS likes, e.event_id * 6151 % 500 AS retweets, e.event_id * 3571 % 400 AS replies,
    e.event_id * 2741 % 300 AS quotes, e.event_id * 4409 % 700 AS bookmarks,
    CASE WHEN e.event_id % 5 <> 0 THEN e.event_id * 9973 % 600000 END AS impressions, e.user_id
  FROM events e JOIN documents d ON d.doc_id = e.event_id % (SELECT n FROM n)),
H AS (SELECT *, greatest((epoch_us(observed_at) - epoch_us(posted_at))::DOUBLE / 3.6e9::DOUBLE, 0.01::DOUBLE) AS h, greatest(likes, 1)::DOUBLE AS l1 FROM P),
V AS (SELECT *, likes::DOUBLE / greatest(h, 0.25::DOUBLE) AS vl, retweets::DOUBLE / greatest(h, 0.25::DOUBLE) AS vr, replies::DOUBLE / greatest(h, 0.25::DOUBLE) AS vp,
    quotes::DOUBLE / greatest(h, 0.25::DOUBLE) AS vq, bookmarks::DOUBLE / greatest(h, 0.25::DOUBLE) AS vb,
    quotes::DOUBLE / l1 AS rq, bookmarks::DOUBLE / l1 AS rb, replies::DOUBLE / l1 AS rr, 450::DOUBLE / (1::DOUBLE + 0.2::DOUBLE * h) AS need FROM H),
D AS (SELECT *, (h <= 2 AND likes >= 1800 AND retweets >= 150 AND replies >= 70) AS inst,
    (h BETWEEN 1 AND 6 AND vl >= need AND coalesce(impressions, 0) >= 200000 AND rr >= 0.045::DOUBLE AND (bookmarks >= 20 OR quotes >= 10)) AS sust,
    (rq >= 0.06::DOUBLE AND rb >= 0.12::DOUBLE AND rr >= 0.07::DOUBLE) AS hot,
    0::DOUBLE + 2.5::DOUBLE * vl + 2.0::DOUBLE * vr + 1.8::DOUBLE * vp + 0.8::DOUBLE * vq + 1.2::DOUBLE * vb
      + CASE WHEN coalesce(impressions, 0) > 0 THEN 1.5::DOUBLE * ln(1 + impressions::DOUBLE / 10000::DOUBLE) ELSE 0 END AS score,
    round_even(greatest(CASE WHEN h <= 2 THEN least(likes::DOUBLE / 1800, retweets::DOUBLE / 150, replies::DOUBLE / 70) ELSE 0 END,
      CASE WHEN h BETWEEN 1 AND 6 THEN least(vl / need, coalesce(impressions, 0)::DOUBLE / 200000, rr / 0.045::DOUBLE, greatest(bookmarks::DOUBLE / 20, quotes::DOUBLE / 10)) ELSE 0 END) * 1000, 0) / 1000 AS progress,
    list_filter({_K}, lambda k: contains(text_snippet, k))[1] AS kw FROM V),
E AS (SELECT *, CASE WHEN inst THEN 'instant' WHEN sust THEN 'sustained' END AS explosive_type, hot AS is_gekiatsu,
    round_even(h * 100, 0) / 100 AS elapsed_hours, round_even(score * 10, 0) / 10 AS buzz_score,
    round_even(rq * 1000, 0) / 1000 AS quote_like_ratio, round_even(rb * 1000, 0) / 1000 AS bookmark_like_ratio, round_even(rr * 1000, 0) / 1000 AS reply_like_ratio FROM D)"""

_STATE = """known AS (SELECT CAST(event_id AS VARCHAR) AS post_id FROM events WHERE event_id % 7 = 0),
authors AS (SELECT DISTINCT concat('user_', user_id) AS author_handle, TIMESTAMP '2024-01-16 00:00:00' + to_minutes(CAST(user_id AS BIGINT)) AS last_at FROM events WHERE user_id % 3 = 0)"""

_COOL = "(a.last_at IS NULL OR epoch_us(x.observed_at) - epoch_us(a.last_at) >= 7200000000)"
_FRESH = f"fresh AS (SELECT x.* FROM E x LEFT JOIN authors a USING (author_handle) WHERE kw IS NOT NULL AND explosive_type IS NOT NULL AND post_id NOT IN (SELECT post_id FROM known) AND {_COOL})"


def _with(body: str, *more: str) -> str:
    return f"WITH {', '.join([_P, *more])} {body}"


_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _parse(raw: str) -> str:
    """SQL for a localized counter."""
    s = f"replace(regexp_replace(coalesce({raw}, ''), '^[\\s　]+|[\\s　]+$', '', 'g'), ',', '')"
    unit = f"CASE right({s}, 1) WHEN '万' THEN 1e4 WHEN '億' THEN 1e8 WHEN 'K' THEN 1e3 WHEN 'k' THEN 1e3 WHEN 'M' THEN 1e6 WHEN 'm' THEN 1e6 END"
    digits = f"CASE WHEN {unit} IS NULL THEN {s} ELSE left({s}, length({s}) - 1) END"
    return f"CAST(trunc(CASE WHEN regexp_matches({digits}, '{_NUMBER}') THEN CAST({digits} AS DOUBLE) * coalesce({unit}, 1)::DOUBLE ELSE 0 END) AS BIGINT)"


_LABEL = r"[0-9,.]+[万億KkMm]?"


def _label(word: str, c: str) -> str:
    return (
        f"CASE ingest_seq % 4 WHEN 1 THEN concat('{word} ', format('{{:,}}', {c})) WHEN 2 THEN concat('{word} ', {c} // 1000, '.5K') "
        f"WHEN 3 THEN '{word}' ELSE concat('{word} ', {c}, '件') END"
    )


_CARDS = f"""cards AS (SELECT ingest_seq, posted_at, observed_at, text_snippet, author_handle, post_id,
  CASE WHEN ingest_seq % 10 = 9 THEN '/explore' WHEN ingest_seq % 10 = 8 THEN concat('https://x.com/user/status/', post_id) ELSE concat('/', author_handle, '/status/', post_id) END AS href,
  {_label('Reply', 'replies')} AS reply_label, {_label('Repost', 'retweets')} AS retweet_label, {_label('Like', 'likes')} AS like_label FROM P)"""
_CARD_ID = r"regexp_extract(href, '/status/([0-9]+)', 1)"
_CARD_URL = "CASE WHEN starts_with(href, '/') THEN concat('https://x.com', href) ELSE href END"
_CARD_TIME = "CASE WHEN ingest_seq % 13 <> 0 THEN posted_at END"


def _label_count(label: str) -> str:
    return _parse(f"regexp_extract({label}, '{_LABEL}', 0)")


_DETAIL = r"""details AS (SELECT ingest_seq, post_id, CASE
  WHEN ingest_seq % 6 = 1 THEN '1.2万 view 5 6 7K Relevant 8' WHEN ingest_seq % 6 = 2 THEN 'no statistics 1 2 3 4'
  WHEN ingest_seq % 6 = 3 THEN concat_ws(' ', '3K VIEWS', replies, retweets, likes, '1.5K', '77')
  ELSE concat_ws(chr(10), concat(coalesce(impressions, 0), ' Views'), replies, retweets, likes, concat(bookmarks, ',0'), 'Relevant', '99') END AS t FROM P),
found AS (SELECT *, regexp_extract(t, '(?i)([0-9,.]+[万億KkMm]?)\s*Views?', 0) AS f, regexp_extract(t, '(?i)([0-9,.]+[万億KkMm]?)\s*Views?', 1) AS v FROM details),
rest AS (SELECT *, substring(t, strpos(t, f) + length(f)) AS a FROM found),
parsed AS (SELECT ingest_seq, post_id, f, v, regexp_extract_all(CASE WHEN strpos(a, 'Relevant') > 0 THEN left(a, strpos(a, 'Relevant') - 1) ELSE a END, '[0-9,.]+[万億KkMm]?')[4] AS b FROM rest)"""
_IMPRESSIONS, _BOOKMARKS = _parse("v"), f"CASE WHEN f = '' THEN 0 ELSE {_parse('b')} END"

_OFFLINE = """CASE WHEN contains(text_snippet, '地震') OR contains(text_snippet, '台風') OR contains(text_snippet, '事件') OR contains(text_snippet, 'earthquake') OR contains(text_snippet, 'flood') THEN '事件・事故'
  WHEN contains(text_snippet, 'outage') OR contains(text_snippet, 'token') OR contains(text_snippet, 'license') THEN 'テクノロジー' WHEN contains(text_snippet, 'recall') THEN '経済' ELSE 'その他' END"""
_VERSIONS = f"""base AS (SELECT *, CASE WHEN ingest_seq % 9 <> 0 THEN {_OFFLINE} END AS genre, ingest_seq % 2 = 0 AS notified, ingest_seq AS seq FROM P WHERE ingest_seq % 4 <> 0),
later AS (SELECT * REPLACE (CASE WHEN ingest_seq % 6 <> 0 THEN likes + 7 END AS likes, 'renamed' AS author_handle), '経済' AS genre, ingest_seq % 2 = 0 AS notified, ingest_seq + 10000000000 AS seq FROM P WHERE ingest_seq % 3 = 0),
merged AS (SELECT post_id, arg_min_null(author_handle, seq) AS author_handle, arg_max_null(likes, seq) AS likes, arg_max_null(retweets, seq) AS retweets, arg_max_null(replies, seq) AS replies,
  arg_max_null(quotes, seq) AS quotes, arg_max_null(bookmarks, seq) AS bookmarks, arg_max_null(genre, seq) AS genre, CAST(floor(epoch(arg_min_null(observed_at, seq))) AS BIGINT) AS detected_at_s,
  arg_min_null(notified, seq) AS notified, min(seq) AS seq FROM (SELECT * FROM base UNION ALL BY NAME SELECT * FROM later) GROUP BY post_id)"""

_RUNS = """per AS (SELECT (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) // 3600000000 AS hr, count(*) AS n FROM events GROUP BY 1),
runs AS (SELECT h.hr + 1 AS run_id, 1704067200 + h.hr * 3600 AS started_at_s, CASE WHEN (h.hr // 5) % 3 = 0 THEN 0 ELSE 1 + coalesce(per.n, 0) END AS posts_scanned FROM range(720) h(hr) LEFT JOIN per USING (hr)),
islands AS (SELECT *, count(*) FILTER (posts_scanned > 0) OVER (ORDER BY run_id) AS island FROM runs),
streaks AS (SELECT *, count(*) FILTER (posts_scanned = 0) OVER (PARTITION BY island ORDER BY run_id) AS streak FROM islands)"""

_MESSAGES = "msg AS (SELECT * REPLACE (CASE WHEN ingest_seq % 5 <> 0 THEN url END AS url), CASE WHEN ingest_seq % 3 <> 0 THEN '経済' ELSE 'その他' END AS genre FROM E WHERE explosive_type IS NOT NULL)"
_KW_LINE = "CASE WHEN kw IS NOT NULL THEN concat(chr(10), '🔑 マッチしたワード: ', kw) ELSE '' END"
_LEAD = "concat(author_handle, ' の投稿が', CAST(elapsed_hours AS VARCHAR), '時間でいいね', format('{:,}', likes), '・引用', format('{:,}', quotes))"


def _header(instant: str, sustained: str) -> str:
    return f"concat(CASE WHEN is_gekiatsu THEN '🔥🔥🔥 激アツ投稿' ELSE '🔥 急上昇検知' END, ' [', CASE WHEN explosive_type = 'instant' THEN '{instant}' ELSE '{sustained}' END, '/', genre, ']')"


def _share(c: str) -> str:
    return f"CASE WHEN is_gekiatsu THEN concat('(', CAST(round_even({c} * 100, 0) AS BIGINT), '%)') ELSE '' END"


_TOPS = """tops AS (
  (SELECT 'likes' AS list, row_number() OVER (ORDER BY likes DESC, ingest_seq) AS pos, author_handle AS author, likes, quotes, bookmarks, CAST(NULL AS BIGINT) AS progress_percent, url, kw AS matched_keyword FROM E WHERE kw IS NOT NULL ORDER BY likes DESC, ingest_seq LIMIT 5)
  UNION ALL
  (SELECT 'progress', row_number() OVER (ORDER BY progress DESC, ingest_seq), author_handle, likes, quotes, bookmarks, CAST(round_even(progress * 100, 0) AS BIGINT), url, kw FROM E WHERE kw IS NOT NULL ORDER BY progress DESC, ingest_seq LIMIT 5))"""
_COUNTS = """(SELECT count(*) FROM P) AS posts_scanned, (SELECT count(*) FROM E WHERE kw IS NOT NULL) AS whitelisted, (SELECT count(*) FROM E WHERE kw IS NOT NULL AND explosive_type IS NOT NULL) AS candidates,
  (SELECT count(*) FROM fresh) AS posts_flagged, (SELECT count(*) FROM fresh WHERE ingest_seq % 2 = 0) AS notified_count"""
_LIST_LINE = "concat('いいね', likes, ' 引用', quotes, ' BM', bookmarks)"
_EMPTY = "(キーワードに一致する投稿は今回ありませんでした)"


def _lines(kind: str, line: str) -> str:
    return f"coalesce((SELECT string_agg({line}, chr(10) ORDER BY pos) FROM tops WHERE list = '{kind}'), '{_EMPTY}')"


def oracle_sql() -> dict[str, str]:
    out = {
        "q_elapsed_velocity": _with("SELECT ingest_seq, h AS hours, vl AS v_likes, vr AS v_retweets, vp AS v_replies, vq AS v_quotes, vb AS v_bookmarks FROM V"),
        "q_ratios": _with("SELECT ingest_seq, rq AS r_quotes, rb AS r_bookmarks, rr AS r_replies FROM V"),
        "q_is_instant": _with("SELECT ingest_seq, inst AS is_instant FROM D"),
        "q_is_sustained": _with("SELECT ingest_seq, sust AS is_sustained FROM D"),
        "q_explosive_type": _with("SELECT ingest_seq, explosive_type FROM E"),
        "q_highlight": _with("SELECT ingest_seq, is_gekiatsu FROM E"),
        "q_rank_score": _with("SELECT ingest_seq, round_even(score * 1000000, 0) / 1000000 AS score FROM D"),
        "q_progress": _with("SELECT ingest_seq, progress FROM D"),
        "q_filter_explosive": _with("SELECT ingest_seq, post_id, author_handle, likes FROM E WHERE explosive_type IS NOT NULL"),
        "q_rank_candidates": _with(
            "SELECT ingest_seq, post_id, elapsed_hours, buzz_score, quote_like_ratio, bookmark_like_ratio, reply_like_ratio, is_gekiatsu, explosive_type FROM E WHERE explosive_type IS NOT NULL ORDER BY buzz_score DESC, ingest_seq"
        ),
        "q_top_progress": _with("SELECT ingest_seq, post_id, progress FROM D ORDER BY progress DESC, ingest_seq LIMIT 5"),
        "q_top_likes": _with("SELECT ingest_seq, post_id, likes, kw AS matched_keyword FROM D WHERE kw IS NOT NULL ORDER BY likes DESC, ingest_seq LIMIT 5"),
        "q_label_count": _with(f"SELECT ingest_seq, {_label_count('reply_label')} AS n_reply, {_label_count('retweet_label')} AS n_retweet, {_label_count('like_label')} AS n_like FROM cards", _CARDS),
        "q_extract_id": _with(f"SELECT ingest_seq, {_CARD_ID} AS post_id, author_handle AS handle, {_CARD_URL} AS link FROM cards", _CARDS),
        "q_card_extract": _with(
            f"SELECT ingest_seq, {_CARD_ID} AS post_id, author_handle, {_CARD_URL} AS url, text_snippet, CAST(floor(epoch(coalesce({_CARD_TIME}, observed_at))) AS BIGINT) AS posted_at_s, "
            f"{_label_count('like_label')} AS likes, {_label_count('retweet_label')} AS retweets, {_label_count('reply_label')} AS replies FROM cards WHERE {_CARD_ID} <> ''",
            _CARDS,
        ),
        "q_detail_parse": _with(f"SELECT ingest_seq, {_IMPRESSIONS} AS impressions, {_BOOKMARKS} AS bookmarks FROM parsed", _DETAIL),
        "q_parse_ts": _with(f"SELECT ingest_seq, CAST(floor(epoch({_CARD_TIME})) AS BIGINT) AS iso_s, CASE WHEN ingest_seq % 5 <> 0 THEN CAST(floor(epoch(posted_at)) AS BIGINT) END AS legacy_s FROM P"),
        "q_normalize_items": _with(
            "SELECT ingest_seq, post_id, CASE WHEN ingest_seq % 8 <> 0 THEN author_handle ELSE '' END AS author_handle, CASE ingest_seq % 4 WHEN 0 THEN url WHEN 3 THEN '' ELSE concat('https://alt.example/', post_id) END AS url, "
            "CASE WHEN ingest_seq % 5 <> 0 THEN CAST(floor(epoch(posted_at)) AS BIGINT) END AS posted_at_s, left(concat(text_snippet, ' tail'), 200) AS text_snippet, "
            "CASE WHEN ingest_seq % 3 <> 0 THEN likes ELSE 0 END AS likes, retweets, CASE WHEN ingest_seq % 7 <> 0 THEN replies ELSE 0 END AS replies FROM P WHERE ingest_seq % 9 <> 0"
        ),
        "q_keyword_load": _with(f"SELECT CAST(k.i - 1 AS BIGINT) AS pos, {_K}[k.i] AS keyword, (SELECT count(*) FROM P WHERE contains(text_snippet, {_K}[k.i])) AS n_posts FROM range(1, 11) k(i)"),
        "q_keyword_match": _with("SELECT ingest_seq, kw IS NOT NULL AS matched FROM D"),
        "q_first_keyword": _with("SELECT ingest_seq, kw AS matched_keyword FROM D"),
        "q_keyword_join": _with("SELECT ingest_seq, kw AS matched_keyword FROM D WHERE kw IS NOT NULL"),
        "q_whitelist": _with("SELECT ingest_seq, post_id, kw AS matched_keyword FROM D WHERE kw IS NOT NULL"),
        "q_source_predicate": _with("SELECT ingest_seq, likes, replies FROM P WHERE ingest_seq % 4 <> 3 AND likes >= 500 AND replies >= 20 AND ingest_seq % 5 <> 1"),
        "q_union_modes": _with("SELECT post_id, ingest_seq AS seq, likes, retweets FROM P UNION ALL SELECT post_id, ingest_seq + (SELECT count(*) FROM events), likes + 100, retweets + 10 FROM P WHERE ingest_seq % 3 = 0"),
        "q_dedupe_posts": _with("SELECT post_id, ingest_seq AS first_seq, likes + CASE WHEN ingest_seq % 3 = 0 THEN 100 ELSE 0 END AS likes, retweets + CASE WHEN ingest_seq % 3 = 0 THEN 10 ELSE 0 END AS retweets, replies, impressions FROM P"),
        "q_quote_count": _with(
            "SELECT P.ingest_seq, count(DISTINCT l.label) AS quotes FROM P LEFT JOIN (SELECT ingest_seq, CASE WHEN (k + ingest_seq) % 5 <> 0 THEN concat('q', k % 4) END AS label "
            "FROM (SELECT ingest_seq, unnest(range(ingest_seq % 6 + 1)) AS k FROM P WHERE ingest_seq % 3 <> 0)) l USING (ingest_seq) GROUP BY P.ingest_seq"
        ),
        "q_prefilter": _with("SELECT ingest_seq, post_id FROM D WHERE (likes >= 800 OR replies >= 50) AND h <= 6 AND kw IS NOT NULL"),
        "q_detail_enrich": _with(
            f"SELECT D.ingest_seq, CASE WHEN w THEN D.ingest_seq % 50 ELSE 0 END AS quotes, CASE WHEN w THEN {_BOOKMARKS} ELSE 0 END AS bookmarks, CASE WHEN w THEN {_IMPRESSIONS} END AS impressions "
            "FROM (SELECT *, ((likes >= 800 OR replies >= 50) AND h <= 6 AND kw IS NOT NULL) AS w FROM D) D JOIN parsed USING (ingest_seq)",
            _DETAIL,
        ),
        "q_alt_enrich": _with("SELECT ingest_seq, post_id, CASE WHEN ingest_seq % 5 = 0 THEN 0 ELSE ingest_seq * 9973 % 600000 + CASE WHEN ingest_seq % 11 = 0 THEN 1 ELSE 0 END END AS impressions FROM P WHERE ingest_seq % 6 <> 0"),
        "q_handles": _with("SELECT DISTINCT author_handle FROM P WHERE likes * 10 >= 30000 ORDER BY 1"),
        "q_semi_handles": _with("SELECT ingest_seq, author_handle FROM P WHERE author_handle IN (SELECT author_handle FROM P WHERE likes * 10 >= 59000)"),
        "q_anti_known": _with("SELECT ingest_seq, post_id FROM P WHERE post_id NOT IN (SELECT post_id FROM known)", _STATE),
        "q_cooldown": _with(f"SELECT x.ingest_seq, x.author_handle FROM P x LEFT JOIN authors a USING (author_handle) WHERE {_COOL}", _STATE),
        "q_upsert": _with("SELECT * FROM merged", _VERSIONS),
        "q_stream_parity": _with("SELECT * FROM merged", _VERSIONS),
        "q_mark_notified": _with("SELECT post_id, notified OR ok AS notified, CASE WHEN ok THEN 1706745600 WHEN notified THEN CAST(floor(epoch(observed_at)) AS BIGINT) END AS notified_at_s FROM (SELECT *, seq % 5 = 0 OR (seq % 7 < 3 AND seq % 2 = 1) AS ok FROM base)", _VERSIONS),
        "q_recent_flagged": _with("SELECT post_id, CAST(floor(epoch(observed_at)) AS BIGINT) AS detected_at_s FROM base ORDER BY observed_at DESC, post_id LIMIT 20", _VERSIONS),
        "q_meta_latest": _with("SELECT concat('author_last_notified:', author_handle) AS key, arg_max_null(CASE WHEN ingest_seq % 11 <> 0 THEN CAST(ingest_seq AS VARCHAR) END, ingest_seq) AS value FROM P GROUP BY author_handle"),
        "q_run_log": f"WITH {_RUNS} SELECT run_id, started_at_s, started_at_s + 120 AS finished_at_s, posts_scanned, posts_scanned % 5 AS posts_flagged, 'success' AS status FROM runs",
        "q_run_counts": _with(f"SELECT {_COUNTS}", _STATE, _FRESH),
        "q_genre_finalize": _with(
            "SELECT ingest_seq, CASE WHEN ingest_seq % 17 = 0 THEN 'その他' WHEN ingest_seq % 5 = 0 THEN '政治' WHEN ingest_seq % 5 = 3 THEN '経済' ELSE 'その他' END AS genre, "
            "CASE WHEN ingest_seq % 17 = 0 THEN '本文なし' WHEN ingest_seq % 5 = 0 THEN 'r' WHEN ingest_seq % 5 = 1 THEN 'x' WHEN ingest_seq % 5 = 3 THEN NULL ELSE '分類失敗' END AS reason FROM P"
        ),
        "q_message_text": _with(
            f"SELECT ingest_seq, concat({_header('⚡瞬間', '📈持続')}, chr(10), {_LEAD}, {_share('quote_like_ratio')}, '・ブックマーク', format('{{:,}}', bookmarks), {_share('bookmark_like_ratio')}, chr(10), coalesce(url, ''), {_KW_LINE}) AS text FROM msg",
            _MESSAGES,
        ),
        "q_push_payload": _with(
            f"SELECT ingest_seq, {_header('瞬間', '持続')} AS title, concat({_LEAD}, '・ブックマーク', format('{{:,}}', bookmarks), {_KW_LINE}) AS message, 'bell' AS sound, CASE WHEN ingest_seq % 2 = 0 THEN '0' ELSE '2' END AS priority, "
            "url AS link, CASE WHEN url IS NOT NULL THEN '投稿を開く' END AS url_title, CASE WHEN ingest_seq % 2 <> 0 THEN '60' END AS retry, CASE WHEN ingest_seq % 2 <> 0 THEN '3600' END AS expire FROM msg",
            _MESSAGES,
        ),
        "q_priority_route": _with("SELECT ingest_seq, CASE WHEN (SELECT ingest_seq % 20 = 0 FROM P WHERE ingest_seq % 10 = 0 ORDER BY observed_at DESC, ingest_seq DESC LIMIT 1) THEN '0' ELSE '2' END AS priority FROM P"),
        "q_status_report": _with("SELECT * FROM tops", _TOPS),
        "q_status_text": _with(
            f"""SELECT 'success' AS status, '2024-02-01T00:00:00Z' AS updated_at, concat_ws(chr(10), '✅ 正常に動作しています', '最終実行: 11分前', concat('収集件数: ', posts_scanned, '件'), concat('通知件数: ', notified_count, '件'),
  '', '【いいね数 上位(キーワード一致のみ)】', {_lines('likes', f"concat('・@', author, ' ', {_LIST_LINE}, ' [', matched_keyword, ']')")},
  '', '【通知条件への到達度 上位(キーワード一致のみ)】', {_lines('progress', f"concat('・@', author, ' 達成度', progress_percent, '% (', {_LIST_LINE}, ') [', matched_keyword, ']')")}) AS text FROM counts
UNION ALL SELECT 'session_expired', '2024-02-01T00:10:29Z', concat_ws(chr(10), '⚠️ ログインセッションが切れています', '最終実行: 1分前', '', 'エラー内容: login')
UNION ALL SELECT 'error', '2024-02-01T00:10:30Z', concat_ws(chr(10), '❌ 直近の実行でエラーが発生しました', '最終実行: 1分前', '', 'エラー内容: boom')
UNION ALL SELECT 'odd', '2024-02-01T00:00:31Z', concat_ws(chr(10), '❓ 状態不明', '最終実行: 10分前')
UNION ALL SELECT 'success', '2024-02-01T00:00:29Z', concat_ws(chr(10), '✅ 正常に動作しています', '最終実行: 11分前', '収集件数: 3件', '通知件数: 0件', '', '【いいね数 上位(キーワード一致のみ)】', '{_EMPTY}')""",
            _STATE, _FRESH, _TOPS, f"counts AS (SELECT {_COUNTS})",
        ),
        "q_webhook": _with("SELECT concat('a', ingest_seq) AS reply_token FROM P WHERE ingest_seq % 7 > 1 AND ingest_seq % 3 < 2"),
        "q_streaks": f"WITH {_RUNS} SELECT run_id, posts_scanned, streak FROM streaks",
        "q_alerts": f"""WITH RECURSIVE {_RUNS}, due AS (SELECT run_id, started_at_s, streak FROM streaks WHERE streak >= 3),
fired AS (SELECT min(started_at_s) AS t FROM due UNION SELECT (SELECT min(d.started_at_s) FROM due d WHERE d.started_at_s >= fired.t + 86400) FROM fired WHERE t IS NOT NULL)
SELECT run_id, started_at_s AS at_s, streak FROM due WHERE started_at_s IN (SELECT t FROM fired WHERE t IS NOT NULL)""",
        "q_pipeline": _with("SELECT ingest_seq, post_id, author_handle, kw AS matched_keyword, elapsed_hours, buzz_score, is_gekiatsu, explosive_type FROM fresh ORDER BY buzz_score DESC, ingest_seq", _STATE, _FRESH),
    }
    out["q_session_alerts"] = f"""WITH RECURSIVE {_RUNS}, due AS (SELECT run_id, started_at_s FROM runs WHERE posts_scanned = 0),
fired AS (SELECT min(started_at_s) AS t FROM due UNION SELECT (SELECT min(d.started_at_s) FROM due d WHERE d.started_at_s >= fired.t + 86400) FROM fired WHERE t IS NOT NULL)
SELECT run_id, started_at_s AS at_s FROM due WHERE started_at_s IN (SELECT t FROM fired WHERE t IS NOT NULL)"""
    fields = ["updated_at", "status", "started_at", "posts_scanned", "posts_flagged", "notified_count", "error_message"]
    values = ["'\"' || stamp || '\"'", "CASE WHEN run_id % 2 = 0 THEN '\"session_expired\"' ELSE '\"error\"' END", "'\"' || stamp || '\"'", "'0'", "'0'", "'0'", "'\"run ' || run_id || '\"'"]
    lines = " || ',' || chr(10) || ".join(f"'  \"{f}\" : ' || {v}" for f, v in zip(fields, values, strict=True))
    out["q_failed_report"] = f"WITH {_RUNS} SELECT '{{' || chr(10) || {lines} || chr(10) || '}}' AS value FROM (SELECT run_id, strftime(make_timestamp(started_at_s * 1000000), '%Y-%m-%d %H:%M:%S') AS stamp FROM runs WHERE posts_scanned = 0)"
    text = out["q_message_text"].rpartition("SELECT ingest_seq, ")[2].removesuffix(" AS text FROM msg")
    out["q_trial_outbox"] = f"""WITH {_P}, {_MESSAGES}, who AS (SELECT concat('📋 通知確認テスト結果', chr(10), CASE WHEN count(*) FILTER (length(post_id) % 2 = 0) > 0 THEN '✅' ELSE '❌' END, ' first', chr(10), '❌ second') AS who FROM msg)
SELECT post_id, author_handle, {text} AS text, {_header('瞬間', '持続')} AS title, 'siren' AS sound, '2' AS priority FROM msg
UNION ALL SELECT 'system:trial', who, concat('🔥 急上昇検知 [📈持続/システム通知]', chr(10), who, ' の投稿が-時間でいいね0・引用0・ブックマーク0', chr(10)), '🔥 急上昇検知 [持続/システム通知]', 'siren', '2' FROM who"""
    found = """r AS (SELECT ingest_seq % 2 AS k, mode, j, post_id, likes, posted_at,
    row_number() OVER (PARTITION BY ingest_seq % 2, mode ORDER BY CASE mode WHEN 'live' THEN epoch_us(posted_at) ELSE likes END DESC, post_id) - 1 AS place
  FROM P, (VALUES ('live', 0), ('top', 1)) m(mode, j) WHERE ingest_seq % 4 <> 3 AND likes >= 500 AND replies >= 20 AND ingest_seq % 5 <> 1),
shown AS (SELECT * FROM r WHERE place < 400)"""
    out["q_search_source"] = _with(
        "SELECT 1705406400 + 3600 * k AS poll, mode, (2 * k + j) * 16777216 + place AS seq, post_id, likes, CAST(floor(epoch(posted_at)) AS BIGINT) AS posted_at_s, 1705406400 + 3600 * k AS observed_at_s FROM shown WHERE likes >= 3000", found
    )
    out["q_search_runs"] = _with(
        "SELECT i + 1 AS run_id, CASE i WHEN 0 THEN (SELECT count(DISTINCT post_id) FROM shown WHERE k = 0) WHEN 3 THEN (SELECT count(DISTINCT post_id) FROM shown WHERE k = 1) ELSE 0 END AS posts_scanned, "
        "CASE i WHEN 2 THEN 'error' ELSE 'success' END AS status FROM range(4) t(i)", found
    )
    out["q_late_details"] = _with(
        "SELECT ingest_seq, post_id, CASE WHEN w THEN quotes ELSE 0 END AS quotes, CASE WHEN w THEN bookmarks ELSE 0 END AS bookmarks, CASE WHEN w THEN impressions END AS impressions "
        "FROM (SELECT *, ingest_seq % 3 <> 0 AND ingest_seq % 7 <> 0 AS w FROM P)"
    )
    out["q_strict_cooldown"] = f"""WITH RECURSIVE {_P}, due AS (SELECT author_handle, ingest_seq, post_id, epoch_us(observed_at) AS t FROM D WHERE inst OR sust),
fired AS (SELECT author_handle, min({{'t': t, 's': ingest_seq}}) AS f FROM due GROUP BY author_handle
  UNION ALL SELECT * FROM (SELECT p.author_handle, min({{'t': x.t, 's': x.ingest_seq}}) AS f FROM fired p JOIN due x ON x.author_handle = p.author_handle AND x.t >= p.f.t + 7200000000 GROUP BY p.author_handle))
SELECT ingest_seq, post_id, author_handle FROM due WHERE ingest_seq IN (SELECT f.s FROM fired)"""
    out["q_html_cards"] = out["q_card_extract"]
    out["q_point_reads"] = out["q_anti_known"]
    out["q_quote_query"] = _with("SELECT ingest_seq, replace(url_encode(text_snippet), '%2F', '/') AS quoted FROM P")
    out["q_first_sightings"] = _with("SELECT post_id, CAST(floor(epoch(posted_at)) AS BIGINT) AS posted_at_s FROM P")
    at = lambda k: _P.replace(_OBSERVED, f"TIMESTAMP '2024-01-16 1{2 + k}:00:00' AS observed_at")
    chosen = f"SELECT *, {_OFFLINE} AS genre, ingest_seq % 3 <> 0 AS notified, CAST(epoch(observed_at) AS BIGINT) AS detected_at_s FROM E WHERE kw IS NOT NULL AND explosive_type IS NOT NULL"
    columns = "post_id, author_handle, likes, genre, detected_at_s, notified, CASE WHEN notified THEN detected_at_s END AS notified_at_s"
    out["q_cycle_state"] = f"""WITH first AS (WITH {at(0)} {chosen} AND ingest_seq % 2 = 0), second AS (WITH {at(1)} {chosen} AND post_id NOT IN (SELECT post_id FROM first) AND author_handle NOT IN (SELECT author_handle FROM first WHERE notified))
SELECT {columns} FROM first UNION ALL SELECT {columns} FROM second"""
    shapes = [
        "CAST(likes AS VARCHAR)", "format('{:,}', likes)", "concat(' ', likes::DOUBLE / 8, 'K ')", "concat(likes::DOUBLE / 16, '万')", "concat(likes::DOUBLE / 4, 'm')", "''", "'1.2.3'", "',.'",
        "concat('　', likes, '　')", "'2.3億'", "'4.1M'", "'0.57万'",
    ]
    out["q_parse_count"] = _with(f"SELECT ingest_seq, {_parse('raw')} AS n FROM (SELECT ingest_seq, [{', '.join(shapes)}][1 + ingest_seq % {len(shapes)}] AS raw FROM P)")
    return out
