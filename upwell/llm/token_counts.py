"""Token counts through a cache of digests.

Each text is known by the SHA-256 of its normalised content. Digests join with the
stored counts of the same tokenizer version; only one copy of each missing text is
encoded, and the new counts are appended to the cache.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upwell.llm._common import Scratch, drop_ids, ship_package, worker_cache

CACHE_SCHEMA = "text_digest binary, tokenizer_digest string, n_tokens long"
#: Entries of a worker's memo of pre-token counts, and the longest pre-token in it.
MEMO_ENTRIES, MEMO_CHARS = 300_000, 64


def tokenizer_digest(path: str) -> str:
    """Names the tokenizer version: the SHA-256 of its file."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


class _BpeCounts(dict):
    """Counts by pre-token, each asked once from the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        from upwell.llm.bpe import PATTERN

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.words = regex.compile(PATTERN).findall
        self.plain = regex.compile("[^՘-\U0010ffff]*").fullmatch
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, specials)) or "(?!)").search

    def __missing__(self, word: str) -> int:
        n = self.ask(word)
        if len(self) < MEMO_ENTRIES and len(word) <= MEMO_CHARS:
            self[word] = n
        return n

    def ask(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def count(self, text: str) -> int:
        # merges never cross pre-tokens, so their counts add up; texts with special strings
        # or characters of changing Unicode classes go to the library whole
        if self.special(text) or not self.plain(text):
            return self.ask(text)
        return sum(map(self.__getitem__, self.words(text)))


class _PieceCounts:
    """Counts of a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def count(self, text: str) -> int:
        return len(self.model.encode(text))


def counter(path: str) -> _BpeCounts | _PieceCounts:
    return worker_cache("token_counts", path, lambda: _PieceCounts(path) if path.endswith(".model") else _BpeCounts(path))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 512, scratch: Scratch | None = None) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: ``doc_id, n_bytes, n_tokens, over_limit``.

    The normalised content is the text itself, a null as the empty text (0 bytes, 0
    tokens), so equal content has equal counts. ``cache_path`` is a Parquet folder of
    ``CACHE_SCHEMA`` that all executors reach; it need not exist. Counts of this
    tokenizer file's digest are read from it, and those of new texts are appended.
    Rows with null or repeated doc_ids get their own results, doc_id keeps its type, and
    other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    scratch = scratch or Scratch(spark)
    version = tokenizer_digest(tokenizer_path)
    path = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        spark.createDataFrame([], CACHE_SCHEMA).write.parquet(cache_path)
    stored = lambda: spark.read.schema(CACHE_SCHEMA).parquet(cache_path).filter(F.col("tokenizer_digest") == version)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select("doc_id", text.alias("text"))
    digest = F.unhex(F.sha2(F.col("text"), 256))
    keys = scratch.save(base.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), digest.alias("text_digest")), "keys")
    known = stored().select("text_digest").distinct()
    missing = keys.join(known, "text_digest", "left_anti")
    # one copy of each missing text: the least doc_id, null if only rows without one hold it
    chosen = scratch.save(missing.groupBy("text_digest").agg(F.min("doc_id").alias("chosen")), "chosen")
    # most texts are the only copy of a miss, so what is skipped is the small side; a row is
    # known by its doc_id and digest, so rows that repeat both are all encoded, and agree
    row = F.struct(F.col("doc_id"), F.col("text_digest")).alias("row")
    others = keys.join(chosen.withColumn("miss", F.lit(True)), "text_digest", "left").filter("miss is null or not (chosen <=> doc_id)")
    skip = scratch.save(others.select(row).distinct(), "skip")
    keyed = base.withColumn("text_digest", digest).withColumn("row", row)
    fresh = drop_ids(keyed, "row", skip).select("text_digest", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = counter(tokenizer_path).count
            n = [count(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("text_digest"), pa.array(n, pa.int64())], ["text_digest", "n_tokens"])

    counted = fresh.mapInArrow(run, "text_digest binary, n_tokens long").groupBy("text_digest").agg(F.max("n_tokens").alias("n_tokens"))
    rows = counted.select("text_digest", F.lit(version).alias("tokenizer_digest"), "n_tokens")
    rows.write.mode("append").parquet(cache_path)
    counts = scratch.save(stored().groupBy("text_digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    scratch.drop(chosen, skip)
    # every text has its count by now; one that lacks it must not vanish quietly
    whole = F.coalesce("n_tokens", F.raise_error(F.lit("a text has no token count")).cast("long"))
    out = keys.join(counts, "text_digest", "left").select("doc_id", "n_bytes", whole.alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
