"""Thresholds, weights and fixed texts of the post-surge rules.

All numbers and texts below are fixed values: results depend on them.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Thresholds:
    instant_max_hours: float = 2.0
    instant_likes: int = 1800
    instant_retweets: int = 150
    instant_replies: int = 70

    sustained_min_hours: float = 0.3
    velocity_min_age_hours: float = 1.0
    sustained_max_hours: float = 6.0
    base_velocity: float = 450.0
    velocity_decay: float = 0.2
    sustained_impressions: int = 200_000
    sustained_reply_ratio: float = 0.045
    sustained_bookmarks: int = 20
    sustained_quotes: int = 10

    highlight_quote_ratio: float = 0.06
    highlight_bookmark_ratio: float = 0.12
    highlight_reply_ratio: float = 0.07

    least_elapsed_hours: float = 0.01
    velocity_floor_hours: float = 0.25
    author_cooldown_hours: float = 2.0

    source_likes: int = 500
    source_replies: int = 20
    detail_likes: int = 800
    detail_replies: int = 50
    profile_likes: int = 30_000

    zero_streak: int = 3
    alert_cooldown_hours: float = 24.0


@dataclass(frozen=True)
class Weights:
    likes: float = 2.5
    retweets: float = 2.0
    replies: float = 1.8
    quotes: float = 0.8
    bookmarks: float = 1.2
    impressions: float = 1.5
    impressions_unit: float = 10_000.0


@dataclass(frozen=True)
class PushConfig:
    """Settings of the push payload; an empty value means the default."""

    sound: str = ""
    priority: str = ""
    school_priority: str = ""
    retry: str = ""
    expire: str = ""

    def value(self, name: str) -> str:
        return getattr(self, name) or PUSH_DEFAULTS[name]

    @classmethod
    def from_env(cls, env: Mapping[str, str], prefix: str = "PUSH_") -> PushConfig:
        """Settings from variables such as ``PUSH_SOUND``; unset and empty ones are defaults."""
        return cls(**{f.name: env.get(prefix + f.name.upper(), "") for f in fields(cls)})


PUSH_DEFAULTS = {"sound": "siren", "priority": "2", "school_priority": "0", "retry": "60", "expire": "3600"}

SNIPPET_CHARS = 200
CLASSIFIER_CHARS = 500
TOP_K = 5
RECENT_LIMIT = 20

UNFILTERED_MARK = "(フィルタ無効・全件通過)"
GENRES = ["スポーツ", "芸能", "政治", "経済", "エンタメ", "事件・事故", "テクノロジー", "その他"]
DEFAULT_GENRE = "その他"
STATUS_COMMAND = "動作確認"
EMPTY_LIST_LINE = "(キーワードに一致する投稿は今回ありませんでした)"
LIKES_TITLE = "【いいね数 上位(キーワード一致のみ)】"
PROGRESS_TITLE = "【通知条件への到達度 上位(キーワード一致のみ)】"
HEADLINES = {
    "success": "✅ 正常に動作しています",
    "session_expired": "⚠️ ログインセッションが切れています",
    "error": "❌ 直近の実行でエラーが発生しました",
}
UNKNOWN_HEADLINE = "❓ 状態不明"
#: Parts of the report's text (fixed values); braces take figures.
LAST_RUN, MINUTES_AGO = "最終実行: ", "分前"
SCANNED, NOTIFIED, ITEMS = "収集件数: ", "通知件数: ", "件"
ERROR_LINE = "エラー内容: "
LIKES_WORD, QUOTES_WORD, MARKS_WORD, PROGRESS_WORD = "いいね", " 引用", " BM", "達成度"
#: Parts of the messages (fixed values).
HOT_HEADER, USUAL_HEADER = "🔥🔥🔥 激アツ投稿", "🔥 急上昇検知"
MESSAGE_KINDS, PUSH_KINDS = ("⚡瞬間", "📈持続"), ("瞬間", "持続")
LEAD_POST, LEAD_HOURS, LEAD_QUOTES, LEAD_MARKS = " の投稿が", "時間でいいね", "・引用", "・ブックマーク"
KEYWORD_LINE = "\n🔑 マッチしたワード: "
#: Alerts about the job itself (fixed values): topic, hours shown, texts and links.
SYSTEM_GENRE, SYSTEM_HOURS = "システム通知", "-"
SESSION_TEXT, SESSION_URL = "⚠️ ログインセッションが切れました。ログイン手順を再実行してください", "https://x.com/login"
ZERO_POSTS_TEXT = "⚠️ {streak}回連続で投稿を0件しか取得できていません。Xのページ構造が変わった可能性があります(要確認)"
#: Summary of a trial of the channels (fixed values).
TRIAL_TITLE, TRIAL_OK, TRIAL_FAILED = "📋 通知確認テスト結果", "✅ ", "❌ "
SITE = "https://x.com"
URL_TITLE = "投稿を開く"

THRESHOLDS = Thresholds()
WEIGHTS = Weights()
