"""Benchmark decontamination by pigeonhole pieces and bit-parallel edit distance.

With an error budget of k, an item is cut into k + 1 pieces; a passage within k edits
of the item holds at least one piece unchanged.

1. Text that many items share, such as a prompt, would make every document that quotes it meet
   all of them. So an item's pieces are cut where each holds a run of characters that few
   items have; any k + 1 pieces that don't overlap keep the guarantee.
2. Pieces are known by digests. One pass over the documents hashes the run of characters at
   every position; where a filter may hold that run as the beginning of a piece, the run is
   extended to the lengths of whole pieces and asked for again.
3. Digests of documents and pieces are joined. Only documents that meet an item there are
   read again, each with the items it met, in parts of bounded size.
4. Myers' algorithm measures the best match of an item around each exact piece hit.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upwell.llm._common import Scratch, drop_ids, fresh_name, keep_ids, require_integer, ship_package

#: One edit in so many characters of an item is allowed.
CHARS_PER_ERROR = 20
#: Items of fewer characters allow no edit and match whole words only.
MIN_CHARS = 24
#: Leading characters of a piece that are looked for at every position, and those that its digest covers.
ANCHOR, WHOLE = 12, 32
#: A run of characters that more texts of the benchmark hold is hot; lengths of runs that pieces are cut by, best first.
HOT_TEXTS, RUNS = 8, (12, 8)
#: Bits of the filter of digests: for each digest, and at least and at most in all (32 MB).
BITS_PER_DIGEST, FILTER_BITS = 256, (1 << 16, 1 << 28)
#: Items that a document is held against at once.
ITEMS_AT_ONCE = 256
#: Characters of joined texts that are hashed at once.
HASH_CHARS = 1 << 20

_STEP, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def normalise(text: str | None) -> str:
    """Lower case, runs of white space as one space."""
    return " ".join((text or "").lower().split())


#: Two characters of one word; scripts without spaces have no such pairs.
_JOINED = regex.compile(r"[[\w]--[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]]{2}", regex.V1)


def whole_words(text: str, start: int, end: int) -> bool:
    """Whether ``text[start:end]`` cuts no word at its ends."""
    return not any(_JOINED.fullmatch(text, i - 1, i + 1) for i in (start, end) if 0 < i < len(text))


class Item:
    """One benchmark text with its match masks."""

    def __init__(self, item_id: int, text: str, chars_per_error: int = CHARS_PER_ERROR):
        self.item_id, self.text, self.n = item_id, text, len(text)
        self.budget = self.n // chars_per_error if self.n >= MIN_CHARS else 0
        self.top = 1 << (self.n - 1)
        self.ones = (1 << self.n) - 1
        self.masks: dict[str, int] = defaultdict(int)
        for i, c in enumerate(text):
            self.masks[c] |= 1 << i
        self.masks = dict(self.masks)

    def pieces(self) -> Iterator[tuple[str, int]]:
        """The k + 1 pieces with their offsets."""
        parts = self.budget + 1
        for i in range(parts):
            start, end = i * self.n // parts, (i + 1) * self.n // parts
            yield self.text[start:end], start

    def distance(self, window: str) -> int:
        """The least edit distance of the item to any substring of ``window``."""
        pv, mv, score = self.ones, 0, self.n
        best = score
        masks, ones, top = self.masks, self.ones, self.top
        for c in window:
            eq = masks.get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | ~(xh | pv) & ones
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
                if score < best:
                    best = score
            ph = ph << 1 & ones  # a match may begin anywhere in the window
            mh = mh << 1 & ones
            pv = mh | ~(xv | ph) & ones
            mv = ph & xv
        return best

    def edits_in(self, text: str) -> int | None:
        """The edits of its best match in a normalised text; None beyond the budget."""
        hits = {start - offset for piece, offset in self.pieces() for start in _places(text, piece)}
        if self.n < MIN_CHARS:
            return 0 if any(whole_words(text, h, h + self.n) for h in hits) else None
        best, ordered, at = self.budget + 1, sorted(hits), 0
        while at < len(ordered) and best:
            # hits whose windows overlap are measured together
            begin = until = ordered[at]
            while at < len(ordered) and ordered[at] <= until + self.n:
                until = ordered[at]
                at += 1
            best = min(best, self.distance(text[max(0, begin - self.budget) : until + self.n + self.budget]))
        return best if best <= self.budget else None


def _places(text: str, piece: str) -> Iterator[int]:
    at = text.find(piece)
    while at >= 0:
        yield at
        at = text.find(piece, at + 1)


def spread(h: np.ndarray, n: int) -> np.ndarray:
    x = (h ^ (h >> np.uint64(31))) * _SPREAD + np.uint64(n)
    return (x ^ (x >> np.uint64(32))) * _STEP


def run_hashes(codes: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """Length and hashes of the runs of codes at every position, up to a length."""
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, min(longest, len(codes)) + 1):
        h = h[: len(codes) - n + 1] * _STEP + codes[n - 1 :]
        yield n, h


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)


def runs_of_pieces(codes: np.ndarray, lengths: tuple[int, ...], held: DigestFilter) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and digests of the runs of the given lengths that the filter may hold."""
    longer = [n for n in lengths if n > ANCHOR]
    for n, h in run_hashes(codes, ANCHOR):
        if n in lengths or (n == ANCHOR and longer):
            digests = spread(h, n)
            at = held.places(digests)
            if n in lengths:
                yield at, digests[at]
            if n == ANCHOR and len(at):
                at, h = at.copy(), h[at]
                for m in range(ANCHOR + 1, longer[-1] + 1 if longer else 0):
                    fits = at + m <= len(codes)
                    at, h = at[fits], h[fits]
                    h = h * _STEP + codes[at + m - 1]
                    if m in longer:
                        digests = spread(h, m)
                        known = held.places(digests)
                        yield at[known], digests[known]


class DigestFilter:
    """Finds every digest of the pieces and few others; three bits for each in a table."""

    SHIFTS = (0, 21, 42)

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def bit(digests: np.ndarray, shift: int, size: int) -> np.ndarray:
        return (digests >> np.uint64(shift)) * _SPREAD >> np.uint64(20) & np.uint64(size - 1)

    def places(self, digests: np.ndarray) -> np.ndarray:
        """Where digests pass."""
        at = None
        for shift in self.SHIFTS:
            bit = self.bit(digests if at is None else digests[at], shift, 64 * len(self.words))
            held = np.flatnonzero((self.words[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1))
            at = held if at is None else at[held]
        return at


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Benchmark rows with normalised texts and their digests; rows without text are left out."""
    for batch in batches:
        texts = [normalise(t.as_py()) for t in batch.column("text")]
        keys = [xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts]
        rows = pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(keys, pa.binary()), pa.array(texts, pa.string())], ["item_id", "item_key", "text"])
        yield rows.filter(pa.array([bool(t) for t in texts], pa.bool_()))


def run_digests(text: str, n: int) -> np.ndarray:
    """Digests of the runs of ``n`` characters at every position."""
    h = np.empty(0, np.uint64)
    for m, hashes in run_hashes(codes_of(text), n):
        h = spread(hashes, n) if m == n else h
    return h.view(np.int64)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.unique(np.concatenate([run_digests(t.as_py(), n) for n in RUNS])) for t in batch.column("text")]
        keys = batch.column("item_key").take(pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found])))
        yield pa.RecordBatch.from_arrays([keys, pa.array(np.concatenate([*found, np.empty(0, np.int64)]))], ["item_key", "run"])


def cut(text: str, budget: int, hot: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of ``budget`` + 1 pieces that don't overlap, each with a run that isn't hot if that can be."""
    parts, n = budget + 1, len(text)
    even = [(i * n // parts, (i + 1) * n // parts) for i in range(parts)]
    for size in RUNS if len(hot) else ():
        cool = np.flatnonzero(~np.isin(run_digests(text, size), hot))
        if all(np.searchsorted(cool, a) < np.searchsorted(cool, min(b, a + WHOLE) - size, side="right") for a, b in even):
            return even
        starts, at = [], 0
        for r in cool.tolist():
            if r >= at:
                starts.append(r)
                at = r + size
        if len(starts) >= parts:
            groups = [starts[i * len(starts) // parts : (i + 1) * len(starts) // parts] for i in range(parts)]
            return [(g[0], g[-1] + size) for g in groups]
    return even


def _pieces(chars_per_error: int):
    """From texts of items with their hot runs to one row for each piece; the first of an item carries its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, t, hot in zip(batch.column("item_key"), batch.column("text"), batch.column("hot"), strict=True):
                text, hot = t.as_py(), np.array(hot.as_py() or [], np.int64)
                pieces = [(text[a : min(b, a + WHOLE)], a) for a, b in cut(text, Item(0, text, chars_per_error).budget, hot)]
                sizes = {n for p, _ in pieces for n in (len(p), min(len(p), ANCHOR))}
                digests = {n: spread(h, n).view(np.int64) for n, h in run_hashes(codes_of(text), max(sizes)) if n in sizes}
                for k, (piece, at) in enumerate(pieces):
                    n = len(piece)
                    rows.append((key.as_py(), None if k else text, n, int(digests[n][at]), int(digests[min(n, ANCHOR)][at])))
            kinds = [("item_key", pa.binary()), ("text", pa.string()), ("length", pa.int32()), ("digest", pa.int64()), ("lead", pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, (_, kind) in enumerate(kinds)], [n for n, _ in kinds])

    return run


def _build_filter(pieces: DataFrame) -> DigestFilter:
    """The filter of all digests; its words are set on the executors, and their number is bounded."""
    digests = pieces.select("digest").union(pieces.select("lead")).distinct()
    least, most = FILTER_BITS
    size = min(most, max(least, 1 << (digests.count() * BITS_PER_DIGEST - 1).bit_length()))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one = batch.column("digest").to_numpy().view(np.uint64)
            bit = np.concatenate([DigestFilter.bit(one, shift, size) for shift in DigestFilter.SHIFTS])
            yield pa.RecordBatch.from_arrays([pa.array((bit >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (bit & np.uint64(63))).view(np.int64))], ["at", "word"])

    got = digests.mapInArrow(words, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    table = np.zeros(size // 64, np.uint64)
    table[got.column("at").to_numpy()] = got.column("word").to_numpy().view(np.uint64)
    return DigestFilter(table)


def _hits(shared, lengths: tuple[int, ...]):
    """``text_key, digest`` of the runs of each text that pass the filter."""

    def flush(texts: list[str], keys: list[bytes]) -> pa.RecordBatch:
        # no piece holds a line break, so a run across two texts meets none
        joined = "\n".join(texts)
        ends = np.cumsum([len(t) + 1 for t in texts])
        pairs = [np.empty((0, 2), np.int64)]
        for a in range(0, len(joined), HASH_CHARS):
            for at, digests in runs_of_pieces(codes_of(joined[a : a + HASH_CHARS + WHOLE - 1]), lengths, shared.value):
                pairs.append(np.stack([np.searchsorted(ends, a + at, side="right"), digests.view(np.int64)], axis=1))
        found = np.unique(np.concatenate(pairs), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()).take(pa.array(found[:, 0])), pa.array(found[:, 1])], ["text_key", "digest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[str] = []
        keys: list[bytes] = []
        held = 0
        for batch in batches:
            for key, t in zip(batch.column("text_key"), batch.column("text"), strict=True):
                text = normalise(t.as_py())
                texts.append(text)
                keys.append(key.as_py())
                held += len(text) + 1
                if held >= HASH_CHARS:
                    yield flush(texts, keys)
                    texts, keys, held = [], [], 0
        if texts:
            yield flush(texts, keys)

    return run


def _verify(chars_per_error: int):
    """``text_key, item_key, edits`` of the items that a text holds, from those it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = lru_cache(ITEMS_AT_ONCE * 16)(lambda text: Item(0, text, chars_per_error))
        for batch in batches:
            rows = []
            for key, t, items in zip(batch.column("text_key"), batch.column("text"), batch.column("items"), strict=True):
                text = normalise(t.as_py())
                for item in items.as_py():
                    edits = make(item["text"]).edits_in(text)
                    if edits is not None:
                        rows.append((key.as_py(), item["item_key"], edits))
            cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.binary(), pa.binary(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["text_key", "item_key", "edits"])

    return run


def _text_key():
    return F.unhex(F.sha2(F.col("text").cast("string"), 256))


def _leaks(docs: DataFrame, benchmark: DataFrame, chars_per_error: int, scratch: Scratch) -> DataFrame:
    """``text_key, item_id, edits`` for every distinct text and item within its budget, saved."""
    spark = require_integer(benchmark, "item_id").sparkSession
    ship_package(spark)
    given = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    named = scratch.save(given.mapInArrow(_normalised, "item_id long, item_key binary, text string"), "items")
    unique = named.select("item_key", "text").dropDuplicates(["item_key"])
    runs = scratch.save(unique.mapInArrow(_runs, "item_key binary, run long"), "runs")
    hot = runs.groupBy("run").agg(F.count("*").alias("n")).filter(F.col("n") > HOT_TEXTS).select("run")
    warm = runs.join(hot, "run").groupBy("item_key").agg(F.collect_list("run").alias("hot"))  # no more than an item is long
    cuts = unique.join(warm, "item_key", "left").mapInArrow(_pieces(chars_per_error), "item_key binary, text string, length int, digest long, lead long")
    pieces = scratch.save(cuts, "pieces")
    scratch.drop(runs)
    lengths = tuple(sorted(r["length"] for r in pieces.select("length").distinct().collect()))  # at most WHOLE
    result = "text_key binary, item_id long, edits long"
    if not lengths:
        return scratch.save(spark.createDataFrame([], result), "leaks")
    shared = spark.sparkContext.broadcast(_build_filter(pieces))
    texts = docs.select(_text_key().alias("text_key"), F.col("text").cast("string").alias("text")).filter("text is not null")
    hits = texts.mapInArrow(_hits(shared, lengths), "text_key binary, digest long")
    met = scratch.save(hits.join(pieces.select("digest", "item_key"), "digest").select("text_key", "item_key").distinct(), "met")
    shared.destroy()
    per_text = scratch.save(met.groupBy("text_key").agg(F.ceil(F.count("*") / ITEMS_AT_ONCE).cast("long").alias("parts")), "per_text")
    items = pieces.filter("text is not null").select("item_key", F.struct("item_key", "text").alias("item"))
    parts = met.join(items, "item_key").join(per_text, "text_key").withColumn("part", F.pmod(F.xxhash64("item_key"), F.col("parts")))
    lists = parts.groupBy("text_key", "part").agg(F.collect_list("item").alias("items"))
    once = keep_ids(texts, "text_key", per_text.select("text_key")).dropDuplicates(["text_key"])
    found = once.join(lists, "text_key").select("text_key", "text", "items").mapInArrow(_verify(chars_per_error), "text_key binary, item_key binary, edits long")
    leaks = scratch.save(found.join(named.select("item_key", "item_id").distinct(), "item_key").select("text_key", "item_id", "edits"), "leaks")
    scratch.drop(named, pieces, met, per_text)
    return leaks


def find_leaks(docs: DataFrame, benchmark: DataFrame, chars_per_error: int = CHARS_PER_ERROR) -> DataFrame:
    """``doc_id, item_id, edits`` for every document and item within the item's budget.

    Both texts are lower-cased and their white space made single spaces. An item of n
    characters allows n // ``chars_per_error`` edits; under ``MIN_CHARS`` characters it
    allows none and must not begin or end within a word. Null and empty documents and
    items match nothing. Repeated document rows repeat their pairs; different texts that
    share an item_id each give a row, repeated items one. A null doc_id stays null, and
    doc_id keeps its type; ``item_id`` must be an integer column. Other columns are ignored.
    """
    leaks = _leaks(docs, benchmark, chars_per_error, Scratch(docs.sparkSession))
    rows = docs.select("doc_id", _text_key().alias("text_key"))
    return keep_ids(rows, "text_key", leaks.select("text_key")).join(leaks, "text_key").select("doc_id", "item_id", "edits")


def without_leaks(docs: DataFrame, benchmark: DataFrame, chars_per_error: int = CHARS_PER_ERROR) -> DataFrame:
    """The rows of ``docs`` in which no item is found; few others are shuffled.

    Null and empty texts stay, repeated rows stay or go together, and the columns are those
    of ``docs``.
    """
    leaks = _leaks(docs, benchmark, chars_per_error, Scratch(docs.sparkSession))
    key = fresh_name("text_key", docs)
    return drop_ids(docs.withColumn(key, _text_key()), key, leaks.select("text_key")).drop(key)
