"""Packing of documents into windows with lexical neighbours.

1. Every document is encoded once. The document frequencies of all ids, over the whole corpus,
   give the weights of a BM25 index whose terms are token ids.
2. Documents are dealt to shards by their rarest id that another document has too, so
   documents about the same thing meet; an id that many documents hold is dealt in parts.
3. Each shard has an inverted index. A seed fills windows of its own; the room in its last one
   goes to its best unused neighbours, first those that fit whole, then one that is cut. The
   rest of that one is the next seed, so only the last window of a shard is not full.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from upwell.llm._common import Scratch, give_back, ship_package, worker_cache
from upwell.llm.bpe import PATTERN, byte_alphabet

#: Tokens of a shard, about; it is what a task holds at once, besides one document.
SHARD_TOKENS = 1 << 21
#: Ids of a seed that are looked up, weightiest first, and neighbours that are considered.
QUERY_TERMS, NEIGHBOURS = 16, 32
#: White space that may be next to other white space: blanks and line breaks in pairs, any other alone.
BLANKS = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c", "\x85", "\xa0")
#: The usual constants of BM25.
K1, B = 1.2, 0.75


class Ids:
    """Token ids of texts as the tokenizers library gives them, as bytes of little-endian numbers.

    Where ids are in order of merges, a faster public library with the same merges encodes texts
    whose characters are classed alike by both; all others go to the tokenizers library. Texts
    without white space side by side are split by a plainer pattern, which needs no look ahead.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        self.path, self.library, self.fast = path, None, None
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if all(a < b for a, b in zip(merged, merged[1:])) and spec["model"]["type"] == "BPE":
            import tiktoken

            alphabet = byte_alphabet()
            special = set(self.special)
            ranks = {bytes(alphabet[c] for c in t): i for t, i in vocab.items() if t not in special}
            make = lambda pattern: tiktoken.Encoding("fast", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy
            self.fast, self.plain = make(PATTERN), make(PATTERN.replace(r"|\s+(?!\S)", ""))
        self.later = re.compile("[\u0558-\U0010ffff]").search
        self.rare = ("\x1c", "\x1d", "\x1e", "\x1f", *self.special)

    def odd(self, text: str) -> bool:
        """Whether a text may hold special strings, or characters that libraries class differently."""
        return any(map(text.__contains__, self.rare)) or (not text.isascii() and self.later(text) is not None)

    @staticmethod
    def pairs(text: str) -> bool:
        """Whether a text may have white space side by side."""
        return any(map(text.__contains__, BLANKS))

    def of(self, text: str) -> np.ndarray:
        if self.fast is not None and not self.odd(text):
            return self.fast(text) if self.pairs(text) else self.plain(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.no_truncation()
            self.library.no_padding()
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


def kind_of(size: int) -> str:
    """The smallest unsigned number for ids below ``size``."""
    return "<u2" if size <= 1 << 16 else "<u4"


def distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids of a document in order, and how often it has each."""
    ordered = np.sort(ids, kind="stable")  # by digits, for small numbers
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[first], np.diff(np.append(first, len(ordered)))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*arrays, np.empty(0, np.int32)]).astype(np.int32)))


def _encode(path: str, end_id: int, size: int):
    """Documents with their ids; the last row of a task has sums instead: documents by id, then documents and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, number = worker_cache("packing", path, lambda: Ids(path)).of, kind_of(size)
        sums, kind = np.zeros(size + 2, np.int64), None
        for batch in batches:
            each = [np.append(ids_of(t.as_py() or ""), np.uint32(end_id)).astype(number) for t in batch.column("text")]
            kind = batch.column("doc_id").type
            if each:
                sums[:size] += np.bincount(np.concatenate([distinct(e)[0] for e in each]), minlength=size)
                sums[size:] += len(each), sum(map(len, each))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([e.tobytes() for e in each], pa.binary()), pa.nulls(len(each), pa.list_(pa.int64()))], ["doc_id", "ids", "sums"])
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.binary()), pa.array([sums], pa.list_(pa.int64()))], ["doc_id", "ids", "sums"])
        give_back()

    return run


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = 0
    for batch in batches:
        for row in batch.column("sums"):
            total = total + row.values.to_numpy()
    if not np.isscalar(total):
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])


@dataclass
class Corpus:
    """What BM25 knows of the whole corpus: documents by id, number of documents, their mean length."""

    frequency: np.ndarray
    documents: int
    mean: float

    def __post_init__(self):
        self.idf = np.log1p((self.documents - self.frequency + 0.5) / (self.frequency + 0.5))
        self.shared = np.where(self.frequency > 1, self.idf, -1).astype(np.float32)

    def impacts(self, terms: np.ndarray, counts: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return self.idf[terms] * counts * (K1 + 1) / (counts + K1 * (1 - B + B * length / self.mean))

    def key(self, ids: np.ndarray) -> int:
        """The rarest id of a document among those that another document has, -1 without any."""
        weights = self.shared[ids]
        best = weights.argmax()
        return int(ids[best]) if weights[best] >= 0 else -1


class Index:
    """The inverted index of a shard: impacts of each id's documents."""

    def __init__(self, docs: list[np.ndarray], corpus: Corpus):
        self.n = len(docs)
        each = [distinct(d) for d in docs]
        sizes = np.array([len(t) for t, _ in each])
        terms, counts = np.concatenate([t for t, _ in each]), np.concatenate([c for _, c in each])
        impact = corpus.impacts(terms, counts, np.repeat([len(d) for d in docs], sizes))
        self.begin = np.concatenate([[0], np.cumsum(sizes)])
        self.terms, self.impact = terms, impact
        order = np.argsort(terms, kind="stable")
        self.owner, self.weight = np.repeat(np.arange(self.n), sizes)[order], impact[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=len(corpus.idf)))])

    def neighbours(self, doc: int, used: np.ndarray, limit: int = NEIGHBOURS, terms: int = QUERY_TERMS) -> list[int]:
        """Unused documents by falling BM25 score, the earlier first among equals."""
        own = slice(self.begin[doc], self.begin[doc + 1])
        impact = self.impact[own]
        asked = self.terms[own][np.argsort(-impact, kind="stable")[:terms]]
        at = np.concatenate([np.arange(self.first[t], self.first[t + 1]) for t in asked])
        score = np.bincount(self.owner[at], self.weight[at], self.n)
        score[used] = 0
        best = np.argpartition(-score, limit)[:limit] if limit < self.n else np.arange(self.n)
        best = best[score[best] > 0]
        return best[np.lexsort((best, -score[best]))].tolist()


def fill_windows(lengths: list[int], window: int, neighbours: Callable[[int, np.ndarray], list[int]]) -> Iterator[list[tuple[int, int, int]]]:
    """Windows as lists of ``(document, start, length)``; all are full but the last one, cut into powers of two."""
    used = np.zeros(len(lengths), bool)
    after, rest = 0, None  # the next document in order, and what is left of a cut one
    while True:
        while after < len(lengths) and used[after]:
            after += 1
        if rest is None:
            if after == len(lengths):
                return
            used[after] = True
            rest = after, 0
        (doc, at), rest = rest, None
        while lengths[doc] - at >= window:
            yield [(doc, at, window)]
            at += window
        if lengths[doc] == at:
            continue
        held, room, cut = [(doc, at, lengths[doc] - at)], window - (lengths[doc] - at), None
        for other in neighbours(doc, used):
            if lengths[other] <= room:
                used[other] = True
                held.append((other, 0, lengths[other]))
                room -= lengths[other]
                if not room:
                    break
            elif cut is None:
                cut = other
        while room:
            if cut is None:  # no neighbour is left: the next document in order
                while after < len(lengths) and used[after]:
                    after += 1
                if after == len(lengths):
                    break
                cut = after
            used[cut] = True
            n = min(room, lengths[cut])
            held.append((cut, 0, n))
            room -= n
            if n < lengths[cut]:
                rest = cut, n
            cut = None
        if room:
            yield from _powers(held, window - room)
        else:
            yield held


def _powers(held: list[tuple[int, int, int]], total: int) -> Iterator[list[tuple[int, int, int]]]:
    """A window that is not full as windows of falling powers of two."""
    held = held[::-1]
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        part = []
        while room:
            doc, at, n = held.pop()
            if n > room:
                held.append((doc, at + room, n - room))
                n = room
            part.append((doc, at, n))
            room -= n
        yield part


def _keyed(corpus: Corpus, shard_tokens: int, kind: str):
    """Adds the key of each document, and which part of the key's documents it belongs to.

    The documents of a key are no more than those that hold the id, so the number of its parts
    is known without a count of keys.
    """
    ways = np.maximum(1, np.ceil(corpus.frequency * corpus.mean / shard_tokens)).astype(np.int64)
    lone = max(1, int(np.ceil(corpus.documents * corpus.mean / shard_tokens)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId()
        for batch in batches:
            keys = np.array([corpus.key(np.frombuffer(r, kind)) for r in batch.column("ids").to_pylist()], np.int64)
            parts = (row + np.arange(len(keys))) % np.where(keys < 0, lone, ways[keys])
            row += len(keys)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(keys.astype(np.int32)), pa.array(parts)], ["doc_id", "ids", "key", "part"])

    return run


def _pack(corpus: Corpus, window: int, shard_tokens: int, keep_ids: bool, kind: str):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
        """Shards: documents up to so many ids, or one that is longer."""
        keys, docs, held = [], [], 0
        for batch in batches:
            begin = 0
            for k, ids in enumerate(batch.column("ids").to_pylist()):
                docs.append(np.frombuffer(ids, kind))
                held += len(docs[-1])
                if held >= shard_tokens:
                    yield pa.concat_arrays([*keys, batch.column("doc_id").slice(begin, k + 1 - begin)]), docs
                    begin, keys, docs, held = k + 1, [], [], 0
            keys.append(batch.column("doc_id").slice(begin))
        if docs:
            yield pa.concat_arrays(keys), docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 32
        for keys, docs in rows(batches):
            index = Index(docs, corpus)
            pieces = []
            for held in fill_windows([len(d) for d in docs], window, index.neighbours):
                offset = 0
                for doc, start, n in held:
                    pieces.append((doc, start, n, zlib.crc32(docs[doc][start : start + n].astype("<u4").tobytes()), len(docs[doc]), sequence, offset))
                    offset += n
                sequence += 1
            for at in range(0, len(pieces), 4096):
                part = pieces[at : at + 4096]
                table = np.array(part, np.int64)
                cols = [keys.take(pa.array(table[:, 0])), *(pa.array(table[:, k]) for k in range(1, 7))]
                if keep_ids:
                    cols.append(_lists([docs[d][s : s + n] for d, s, n, *_ in part]))
                yield pa.RecordBatch.from_arrays(cols, [*names, "ids"] if keep_ids else names)
        give_back()

    return run


def corpus_of(tokens: DataFrame, size: int) -> Corpus:
    """From the sums of all tasks; as many numbers as the vocabulary has ids."""
    sums = tokens.filter("sums is not null").select("sums").mapInArrow(_sum_up, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(size + 2, np.int64)
    total[sums.column("at").to_numpy()] = sums.column("n").to_numpy()
    return Corpus(total[:size], int(total[size]), total[size + 1] / max(1, total[size]))


def pack_documents(
    docs: DataFrame, tokenizer_path: str, window: int = 1024, end_id: int = 0, shard_tokens: int = SHARD_TOKENS, keep_ids: bool = True, scratch: Scratch | None = None
) -> DataFrame:
    """One row for each piece of ``docs(doc_id, text)``: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is the ids of its whole text (null: empty) and ``end_id``; with ``keep_ids`` the
    piece's ``ids`` follow as an array of int. Each id is in exactly one piece, the pieces of a
    sequence lie without gaps, and a sequence has ``window`` ids or, at the end of a shard, a
    smaller power of two. ``ids_crc32`` is over the ids as little-endian unsigned 32-bit
    numbers, ``doc_tokens`` counts the document with its last id. Rows that repeat a doc_id, or
    have none, are documents of their own; doc_id keeps its type and other columns are
    ignored. An empty table has no pieces. Neighbours are sought inside a shard, and which
    documents share one depends on the number of shuffle partitions.
    """
    if window < 1:
        raise ValueError("a window holds at least one id")
    spark = docs.sparkSession
    ship_package(spark)
    scratch = scratch or Scratch(spark)
    size = max(Ids(tokenizer_path).size, end_id + 1)
    kind = kind_of(size)
    base = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    key = base.schema["doc_id"]
    kinds = StructType([StructField("doc_id", key.dataType), *StructType.fromDDL("ids binary, sums array<bigint>").fields])
    tokens = scratch.save(base.mapInArrow(_encode(tokenizer_path, end_id, size), kinds), "tokens")
    corpus = corpus_of(tokens, size)
    documents = tokens.filter("ids is not null").select("doc_id", "ids")
    keyed = documents.mapInArrow(_keyed(corpus, shard_tokens, kind), StructType([kinds["doc_id"], kinds["ids"], *StructType.fromDDL("key int, part long").fields]))
    dealt = keyed.repartition("key", "part").sortWithinPartitions("key", "part")
    fields = [kinds["doc_id"], *(StructField(n, LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))]
    schema = StructType(fields + (StructType.fromDDL("ids array<int>").fields if keep_ids else []))
    return dealt.select("doc_id", "ids").mapInArrow(_pack(corpus, window, shard_tokens, keep_ids, kind), schema)
