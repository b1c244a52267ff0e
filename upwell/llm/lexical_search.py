"""Ranked lexical search with block-max pruning.

1. Runs of documents, as they are read, form blocks. A block has a forward index: for each
   document its terms and how often it holds them, and for each term the greatest part of a
   score that a document of the block can get from it.
2. The sum of these maxima over an item's terms bounds the scores of a whole block. A first
   pass over the blocks scores, for each item, those of its greatest bounds; its results give
   a threshold.
3. A second pass scores the other blocks whose bound reaches the threshold; all others are
   passed over without a look at their documents.

Scores are integers, so bounds and ties are exact.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from upwell.llm._common import Scratch, give_back, require_integer, ship_package, worker_cache

#: Documents of a block, and terms of its documents after which it ends early.
BLOCK, BLOCK_TERMS = 64, 1 << 18
#: Terms, with repeats over items, and items that are held against the index at once.
BATCH_TERMS, BATCH_ITEMS = 1 << 18, 1 << 12
#: Blocks of an item that the first pass scores, about.
FIRST_BLOCKS = 8
#: Results that a task keeps before it drops those that can't stay.
HELD = 1 << 18

#: Bytes of terms as they are, A-Z in lower case, all others as blanks.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

#: Lists of a block as bytes: numbers as little-endian, terms with a zero byte, which no term has, between them.
LISTS = {"doc": "<i8", "null": "?", "size": "<i8", "term": "", "df": "<i4", "start": "<i4", "slot": "<i4", "tf": "<i4", "top": "<i4"}
BLOCK_KINDS = ", ".join(f"{name} binary" for name in LISTS if name != "top")


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case."""
    return text.translate(_FOLD).split()


class _Block:
    """Documents of a block as they come."""

    def __init__(self):
        self.doc, self.size, self.start, self.slot, self.tf, self.at = [], [], [0], [], [], {}

    def add(self, doc: int | None, terms: list[bytes]) -> None:
        at = self.at
        counts = Counter(terms)
        self.doc.append(doc)
        self.size.append(len(terms))
        self.slot.extend([at.setdefault(t, len(at)) for t in counts])
        self.tf.extend(counts.values())
        self.start.append(len(self.slot))

    def row(self) -> pa.RecordBatch:
        lists = {"doc": [d or 0 for d in self.doc], "null": [d is None for d in self.doc], "size": self.size, "start": self.start, "slot": self.slot, "tf": self.tf}
        lists["df"] = np.bincount(self.slot, minlength=len(self.at))
        cols = {n: b"\0".join(self.at) if n == "term" else np.array(lists[n]).astype(kind).tobytes() for n, kind in LISTS.items() if n != "top"}
        return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in cols.values()], list(cols))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = _Block()
    for batch in batches:
        for doc, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
            terms = terms_of(text.as_py())
            if terms:
                block.add(doc.as_py(), terms)
            if len(block.doc) >= BLOCK or len(block.slot) >= BLOCK_TERMS:
                yield block.row()
                block = _Block()
    if block.doc:
        yield block.row()
    give_back()


def _values(batch: pa.RecordBatch, name: str, k: int) -> np.ndarray:
    return np.frombuffer(batch.column(name)[k].as_py(), LISTS[name])


def _terms(batch: pa.RecordBatch, k: int) -> list[bytes]:
    return batch.column("term")[k].as_py().split(b"\0")


def impacts(tf: np.ndarray, size: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """The part of a score that a term has before its weight, for documents of ``size`` terms."""
    tf, m = tf.astype(np.int64), 50 + 50 * size.astype(np.int64) * documents // terms
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)  # less than a million


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _with_maxima(documents: int, terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = []
            for k in range(len(batch)):
                size = np.repeat(_values(batch, "size", k), np.diff(_values(batch, "start", k)))
                top = np.zeros(len(_values(batch, "df", k)), LISTS["top"])
                np.maximum.at(top, _values(batch, "slot", k), impacts(_values(batch, "tf", k), size, documents, terms).astype(LISTS["top"]))
                tops.append(top.tobytes())
            yield batch.append_column("top", pa.array(tops, pa.binary()))

    return run


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = [_values(batch, "size", k) for k in range(len(batch))]
        yield pa.RecordBatch.from_arrays([pa.array([len(s) for s in sizes]), pa.array([int(s.sum()) for s in sizes])], ["documents", "terms"])


@dataclass
class LexicalIndex:
    """Blocks with maxima, the number of documents that have terms, and of all their terms."""

    blocks: DataFrame
    documents: int
    terms: int


def build_index(docs: DataFrame, scratch: Scratch) -> LexicalIndex:
    """Indexes every whole text of ``docs(doc_id, text)`` but those without terms; nothing is shuffled."""
    ship_package(require_integer(docs, "doc_id").sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).filter("text is not null")
    raw = scratch.save(base.mapInArrow(_blocks, BLOCK_KINDS), "blocks")
    n = raw.select("size").mapInArrow(_totals, "documents long, terms long").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("documents", "terms"))).first()
    index = scratch.save(raw.mapInArrow(_with_maxima(n[0], n[1]), BLOCK_KINDS + ", top binary"), "index")
    scratch.drop(raw)
    return LexicalIndex(index, n[0], n[1])


@dataclass
class Queries:
    """A batch of items: their distinct terms, and for each item the positions of its terms."""

    item_ids: list[int | None]
    terms: list[bytes]
    begin: np.ndarray
    cols: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    key: str = ""

    @staticmethod
    def of(rows: list[tuple[int | None, list[bytes]]]) -> Queries:
        at: dict[bytes, int] = {}
        cols = [at.setdefault(t, len(at)) for _, terms in rows for t in terms]
        begin = np.cumsum([0, *(len(terms) for _, terms in rows)])
        return Queries([i for i, _ in rows], list(at), begin, np.array(cols, np.int64))

    def __post_init__(self):
        self.item = np.repeat(np.arange(len(self.item_ids)), np.diff(self.begin))

    def positions(self) -> dict[bytes, int]:
        return worker_cache("lexical_search", self.key, lambda: {t: k for k, t in enumerate(self.terms)})

    def place(self, terms: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Which slots of a block hold terms of the batch, and which."""
        at = self.positions().get
        found = np.array([at(t, -1) for t in terms], np.int64)
        slots = np.flatnonzero(found >= 0)
        return slots, found[slots]

    def bounds(self, slots: np.ndarray, held: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each item the sum of a block's maxima, and for each term of an item its column in the block."""
        column = np.full(len(self.terms), -1, np.int64)
        column[held] = np.arange(len(held))
        column = column[self.cols]
        part = np.where(column >= 0, np.append(top[slots], 0).astype(np.int64)[column] * self.weights, 0)
        return np.add.reduceat(part, self.begin[:-1]), column


def _frequencies(queries):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = queries.value
        total = np.zeros(len(q.terms), np.int64)
        for batch in batches:
            for k in range(len(batch)):
                slots, held = q.place(_terms(batch, k))
                total[held] += _values(batch, "df", k)[slots]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "df"])

    return run


def _greatest(queries, first: int):
    """The greatest bounds of each item in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = queries.value
        best = np.zeros((first, len(q.item_ids)), np.int64)
        for batch in batches:
            rows = [q.bounds(*q.place(_terms(batch, k)), _values(batch, "top", k))[0] for k in range(len(batch))]
            best = np.sort(np.concatenate([best, rows]), axis=0)[-first:] if rows else best
        at, item = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(best[at, item])], ["item", "bound"])

    return run


class _Best:
    """The best results of each item that a task has met."""

    def __init__(self, least: np.ndarray, limit: int):
        self.least, self.limit, self.parts, self.n = least.copy(), limit, [], 0

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        self.parts.append((item, score, doc, null))
        self.n += len(item)
        if self.n > HELD:
            self.shrink()

    def shrink(self) -> tuple[np.ndarray, ...]:
        empty = [np.empty(0, np.int64)] * 3 + [np.empty(0, bool)]
        item, score, doc, null = (np.concatenate(c) for c in zip(empty, *self.parts, strict=True))
        order = np.lexsort((doc, null, -score, item))
        item, score, doc, null = item[order], score[order], doc[order], null[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        last = place == self.limit - 1
        self.least[item[last]] = np.maximum(self.least[item[last]], score[last])
        kept = (item, score, doc, null)
        kept = tuple(c[place < self.limit] for c in kept)
        self.parts, self.n = [kept], int((place < self.limit).sum())
        return kept


def _scores(queries, documents: int, terms: int, first: np.ndarray, least: np.ndarray | None, limit: int):
    """Scores documents of the blocks whose bounds are at least ``first``, or under it but at least ``least``.

    Without ``least`` any score above 0 counts. What a task has found raises its threshold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, best = queries.value, _Best(np.ones(len(first), np.int64) if least is None else least, limit)
        for batch in batches:
            for k in range(len(batch)):
                slots, held = q.place(_terms(batch, k))
                bounds, column = q.bounds(slots, held, _values(batch, "top", k))
                live = (bounds >= best.least) & ((bounds >= first) if least is None else (bounds < first))
                if not live.any():
                    continue
                docs = _values(batch, "doc", k)
                slot, tf = _values(batch, "slot", k), _values(batch, "tf", k)
                row = np.repeat(np.arange(len(docs)), np.diff(_values(batch, "start", k)))
                narrow = np.full(len(_values(batch, "df", k)), -1, np.int64)
                narrow[slots] = np.arange(len(slots))
                at = np.flatnonzero(narrow[slot] >= 0)
                table = np.zeros((len(docs), len(slots)), np.int64)
                table[row[at], narrow[slot[at]]] = impacts(tf[at], _values(batch, "size", k)[row[at]], documents, terms)
                use = np.flatnonzero(live[q.item] & (column >= 0))
                item, begin = np.unique(q.item[use], return_index=True)
                score = np.add.reduceat(table[:, column[use]] * q.weights[use], begin, axis=1)
                r, c = np.nonzero(score >= best.least[item])
                best.add(item[c], score[r, c], docs[r], _values(batch, "null", k)[r])
        item, score, doc, null = best.shrink()
        ids = pa.array(q.item_ids, pa.int64()).take(pa.array(item))
        yield pa.RecordBatch.from_arrays([pa.array(item), ids, pa.array(doc, mask=null), pa.array(score)], ["item", "item_id", "doc_id", "score"])
        give_back()

    return run


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sorted(set(terms_of(t.as_py()))) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(found, pa.list_(pa.binary()))], ["item_id", "terms"])


def _ranked(found: DataFrame, limit: int) -> DataFrame:
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit)


def _search_batch(spark: SparkSession, index: LexicalIndex, q: Queries, limit: int, scratch: Scratch) -> DataFrame:
    q.key = f"{scratch.root}:{scratch.mark()}:{id(q)}"
    shared = spark.sparkContext.broadcast(q)
    df = np.zeros(len(q.terms), np.int64)
    got = index.blocks.select("term", "df").mapInArrow(_frequencies(shared), "at long, df long").groupBy("at").agg(F.sum("df").alias("df")).toArrow()
    df[got.column("at").to_numpy()] = got.column("df").to_numpy()
    shared.destroy()
    # a term that no document holds adds nothing to a score
    q.weights = np.array([weight(index.documents, n) if n else 0 for n in df.tolist()], np.int64)[q.cols]
    shared = spark.sparkContext.broadcast(q)
    bounds = index.blocks.select("term", "top").mapInArrow(_greatest(shared, FIRST_BLOCKS), "item long, bound long")
    order = Window.partitionBy("item").orderBy(F.desc("bound"))
    firsts = bounds.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= FIRST_BLOCKS).groupBy("item").agg(F.min("bound").alias("bound")).toArrow()
    first = np.ones(len(q.item_ids), np.int64)
    first[firsts.column("item").to_numpy()] = firsts.column("bound").to_numpy()
    kinds = "item long, item_id long, doc_id long, score long"
    scored = lambda least: scratch.save(index.blocks.mapInArrow(_scores(shared, index.documents, index.terms, first, least, limit), kinds), "scored")
    early = scored(None)
    least = np.ones(len(q.item_ids), np.int64)
    lasts = _ranked(early, limit).filter(F.col("rank") == limit).select("item", "score").toArrow()
    least[lasts.column("item").to_numpy()] = lasts.column("score").to_numpy()
    late = scored(least)
    shared.destroy()
    return _ranked(early.unionByName(late), limit)


def search(index: LexicalIndex, items: DataFrame, limit: int = 50, scratch: Scratch | None = None) -> DataFrame:
    """The best documents of each item: ``item_id, rank`` (int), ``doc_id, score`` (long).

    Terms are maximal runs of ASCII letters and digits and of characters beyond ASCII; only A-Z
    are lower-cased. A document scores by each distinct term of an item; the ``limit`` highest
    scores above 0 are ranked from 1, equal ones by ascending doc_id, null ids last. Null and
    empty texts have no terms, so they find nothing and aren't found. Rows that repeat a
    doc_id are documents of their own; repeated items give their results once, different texts
    that share an item_id each give theirs. ``doc_id`` and ``item_id`` must be integer columns;
    other columns are ignored. Items are held against the index in batches of bounded size
    (one item at least).
    """
    spark = require_integer(items, "item_id").sparkSession
    scratch = scratch or Scratch(spark)
    given = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text")).filter("text is not null").distinct()
    asked = given.mapInArrow(_item_terms, "item_id long, terms array<binary>").filter(F.size("terms") > 0)
    asked = scratch.save(asked, "asked")
    n = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    batches = max(-(-n[0] // BATCH_ITEMS), -(-n[1] // BATCH_TERMS))
    found = []
    for k in range(batches if index.documents else 0):
        mine = asked.filter(F.pmod(F.xxhash64("item_id", "terms"), F.lit(batches)) == k)
        rows = [(r["item_id"], [bytes(t) for t in r["terms"]]) for r in mine.collect()]
        if rows:
            found.append(_search_batch(spark, index, Queries.of(rows), limit, scratch).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out
