"""Search cards from the HTML of result pages.

One Arrow pass walks each page's tree as it is parsed and finds, in every ``article``, the first
element of each kind that a card is read from. What the texts mean is left to ``extract_cards``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Elements that have no content and no end tag (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Test ids whose elements hold the counters, and the card's columns (fixed values).
COUNTERS = {"reply": "reply_label", "retweet": "retweet_label", "like": "like_label"}
BODY = "tweetText"
#: Characters of an element's text that are kept; a post shows 200 of them.
TEXT_CHARS = 2000
CARD_COLUMNS = ["href", "datetime", "user_href", "body", "reply_label", "retweet_label", "like_label"]
CARD_KINDS = "position int, " + ", ".join(f"{c} string" for c in CARD_COLUMNS)


@dataclass
class _Card:
    """An article that is open; ``depth`` is the number of elements around it."""

    depth: int
    place: int
    found: dict[str, str | None] = field(default_factory=dict)


@dataclass
class _Text:
    """An element whose inner text, from a part of the page's text on, is a column of some cards."""

    depth: int
    column: str
    cards: list[_Card]
    begin: int


class CardParser(HTMLParser):
    """Gathers cards in the order in which their articles begin.

    End tags close the innermost open element of their name with all inside it; those without
    one are passed over. What is open at the end of a page ends there. An element is looked at
    once and serves all open cards that lack its kind, so broken pages take no longer than others.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.links: list[tuple[int, str | None]] = []  # open a elements, by depth
        self.count: dict[str, int] = {}
        self.cards: list[_Card] = []
        self.lack: dict[str, list[_Card]] = {c: [] for c in ("time", *CARD_COLUMNS[2:])}
        self.texts: list[_Text] = []
        self.parts: list[str] = []
        self.begun = 0
        self.done: list[_Card] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        at = dict(reversed(attrs))  # the first of equal attributes counts
        if tag == "article":
            card = _Card(len(self.open), self.begun)
            self.begun += 1
            self.cards.append(card)
            for missing in self.lack.values():
                missing.append(card)
        if self.cards:
            self._look(tag, at)
        if tag == "br":
            self.handle_data("\n")
        if tag not in VOID:
            if tag == "a":
                self.links.append((len(self.open), at.get("href")))
            self.open.append(tag)
            self.count[tag] = self.count.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash means nothing in HTML

    def _found(self, kind: str) -> list[_Card]:
        """The open cards that lack a kind of element; from now on they have it."""
        new = [c for c in self.lack[kind] if c.depth >= 0]
        self.lack[kind] = []
        return new

    def _look(self, tag: str, at: dict[str, str | None]) -> None:
        if tag == "time":
            for card in self._found("time"):
                card.found |= {"datetime": at.get("datetime"), "href": self.links[-1][1] if self.links else None}
        if tag == "a" and at.get("role") == "link" and (at.get("href") or "").startswith("/"):
            for card in self._found("user_href"):
                card.found["user_href"] = at["href"]
        column = "body" if at.get("data-testid") == BODY else COUNTERS.get(at.get("data-testid") or "")
        if column:
            label = at.get("aria-label") if column != "body" else None
            new = self._found(column)
            for card in new:
                card.found[column] = label or ""
            if new and not label and tag not in VOID:
                self.texts.append(_Text(len(self.open), column, new, len(self.parts)))

    def handle_data(self, data: str) -> None:
        if self.texts and data:
            self.parts.append(data)

    def handle_endtag(self, tag: str) -> None:
        if self.count.get(tag):
            name = None
            while name != tag:
                name = self.open.pop()
                self.count[name] -= 1
            self._end(len(self.open))

    def _end(self, depth: int) -> None:
        while self.links and self.links[-1][0] >= depth:
            self.links.pop()
        while self.texts and self.texts[-1].depth >= depth:
            text = self.texts.pop()
            held = self.parts[text.begin : text.begin + TEXT_CHARS]  # a part has a character at least
            for card in text.cards:
                card.found[text.column] = "".join(held)[:TEXT_CHARS]
        if not self.texts:
            self.parts.clear()
        while self.cards and self.cards[-1].depth >= depth:
            card = self.cards.pop()
            card.depth = -1  # no longer open
            self.done.append(card)

    def finish(self) -> list[_Card]:
        self.close()
        self._end(0)
        return sorted((c for c in self.done if "datetime" in c.found), key=lambda c: c.place)


def cards_of(html: str | None) -> list[dict[str, str | None]]:
    """The cards of a page: articles that hold a time, with what they were found to hold."""
    if not html or "<time" not in html.lower():
        return []
    parser = CardParser()
    parser.feed(html)
    return [c.found for c in parser.finish()]


def parse_cards(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Raw cards of ``pages(html)``: ``key, position`` (from 0 in a page) and the columns of a card.

    An article without a time element is no card. The link is that of the time's innermost ``a``,
    the author's that of the first ``a`` with role link and a path, the body the text of the first
    ``tweetText`` (its first ``TEXT_CHARS`` characters); counters have the label of their first element or, without a label, its
    text. What isn't there is null. Null and empty pages have no cards, broken ones those that
    can be read, pages of any length are read whole; repeated pages give repeated cards.
    Other columns are ignored.
    """
    base = pages.select(key, F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for k, html in enumerate(batch.column("html")):
                for place, card in enumerate(cards_of(html.as_py())):
                    at.append(k)
                    rows.append((place, *(card.get(c) for c in CARD_COLUMNS)))
            cols = [pa.array([r[j] for r in rows], pa.int32() if j == 0 else pa.string()) for j in range(1 + len(CARD_COLUMNS))]
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at, pa.int32())), *cols], [key, "position", *CARD_COLUMNS])

    return base.mapInArrow(run, StructType([StructField(key, base.schema[key].dataType), *StructType.fromDDL(CARD_KINDS).fields]))
