"""Keyword whitelist: order of the list decides, not place in the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upwell.config import UNFILTERED_MARK
from upwell.sources.keywords import keyword_array


def first_keyword(text: Column, keywords: list[str]) -> Column:
    """The first listed keyword in the text, case-sensitive; null if there is none."""
    return F.try_element_at(F.filter(keyword_array(keywords), lambda k: F.contains(text, k)), F.lit(1))


def matches(text: Column, keywords: list[str]) -> Column:
    """Whether any keyword is in the text; an empty list lets everything pass."""
    if not keywords:
        return F.lit(True)
    return F.coalesce(F.exists(keyword_array(keywords), lambda k: F.contains(text, k)), F.lit(False))


def whitelist(posts: DataFrame, keywords: list[str]) -> DataFrame:
    """Posts with a keyword, and it as ``matched_keyword``; all of them if the list is empty."""
    if not keywords:
        return posts.withColumn("matched_keyword", F.lit(UNFILTERED_MARK))
    return posts.withColumn("matched_keyword", first_keyword(F.col("text_snippet"), keywords)).filter("matched_keyword is not null")


#: Keywords meet texts on their first characters, so many at most.
ANCHOR_CHARS = 4
#: A keyword relation of so many bytes at most is broadcast; a longer one is shuffled.
BROADCAST_BYTES = 8 << 20


def keyword_join(posts: DataFrame, keywords: DataFrame) -> DataFrame:
    """``whitelist`` for lists too long for a constant: ``keywords(pos, keyword)`` as a relation.

    Texts and keywords meet by equality of an anchor: a keyword's first ``ANCHOR_CHARS``
    characters, or all of a shorter one, and every distinct run of such lengths in a text.
    Each distinct text is looked at once. An empty list lets everything pass, as there;
    blank keywords don't count.
    """
    listed = keywords.filter("keyword <> ''").select("pos", "keyword", F.substring("keyword", 1, ANCHOR_CHARS).alias("anchor"))
    found = listed.agg(F.collect_set(F.length("anchor")).alias("sizes"), F.coalesce(F.sum(F.octet_length("keyword") + 32), F.lit(0)).alias("bytes")).first()
    if not found["sizes"]:
        return posts.withColumn("matched_keyword", F.lit(UNFILTERED_MARK))
    text, n = F.col("text_snippet"), F.length("text_snippet")

    def runs(size: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1)))
        return F.when(n >= size, F.transform(places, lambda i: F.substring(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))

    anchors = F.explode(F.array_distinct(F.concat(*map(runs, sorted(found["sizes"]))))).alias("anchor")
    texts = posts.select("text_snippet").filter("text_snippet <> ''").distinct()
    if found["bytes"] <= BROADCAST_BYTES:
        met = texts.select("text_snippet", anchors).join(F.broadcast(listed), "anchor")
    else:
        # only digests go through the shuffle; two texts of one digest just meet each other's keywords
        keyed = texts.withColumn("_digest", F.xxhash64("text_snippet"))
        keys = keyed.select("_digest", anchors).join(listed, "anchor").select("_digest", "pos", "keyword").distinct()
        met = keyed.join(keys, "_digest")
    hits = met.filter(F.contains("text_snippet", F.col("keyword")))
    best = hits.groupBy("text_snippet").agg(F.min_by("keyword", "pos").alias("matched_keyword"))
    return posts.join(best, "text_snippet").select(*posts.columns, "matched_keyword")
