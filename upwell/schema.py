"""Schemas of posts, raw inputs and state tables."""

from __future__ import annotations

POST = (
    "post_id string, author_handle string, url string, text_snippet string, posted_at timestamp, likes long, retweets long, "
    "replies long, quotes long, bookmarks long, impressions long, ingest_seq long, observed_at timestamp"
)
API_ITEM = "id string, url string, twitterUrl string, createdAt string, text string, author struct<userName:string>, likeCount long, retweetCount long, replyCount long"
API_VIEW = "id string, viewCount long"
CARD = "href string, datetime string, user_href string, body string, reply_label string, retweet_label string, like_label string"
DETAIL = "url string, detail_text string"
STORED_POST = (
    "post_id string, author_handle string, url string, posted_at timestamp, text_snippet string, likes long, retweets long, replies long, "
    "quotes long, bookmarks long, genre string, detected_at timestamp, notified boolean, notified_at timestamp, seq long"
)
RUN = "run_id long, started_at timestamp, finished_at timestamp, posts_scanned long, posts_flagged long, status string, error_message string"
META = "key string, value string, seq long"
NOTICE = "post_id string, notified_at timestamp"
OUTBOX = "post_id string, author_handle string, text string, title string, message string, sound string, priority string, link string, url_title string, retry string, expire string"
SENT = "post_id string, first_ok boolean, second_ok boolean"
AUTHOR_STATE = "author_handle string, last_notified_at timestamp"
WEBHOOK = "events array<struct<type:string,replyToken:string,message:struct<type:string,text:string>>>"
STATUS = (
    "updated_at string, status string, started_at string, finished_at string, posts_scanned long, posts_flagged long, notified_count long, error_message string, "
    "top5_by_likes array<struct<author:string,likes:long,quotes:long,bookmarks:long,url:string,matched_keyword:string>>, "
    "top5_by_progress array<struct<author:string,likes:long,quotes:long,bookmarks:long,progress_percent:long,url:string,matched_keyword:string>>"
)
#: Counters that a later sighting replaces; everything else keeps its first value.
MUTABLE = ["likes", "retweets", "replies", "quotes", "bookmarks", "genre"]
