"""Exact byte-level BPE by per-prefix dynamic programming, and its decoding.

For every prefix of a pre-token there is exactly one token that can stand last in
its encoding. It is found among the vocabulary entries that are suffixes of the
prefix (an automaton lists them) as the one that may follow the last token of the
shorter prefix; back-pointers from the full length then give the ids.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from upwell.llm._common import give_back, plain_names, ship_package, worker_cache

#: Entries of a worker's memos of pre-tokens and of pairs of tokens, some 300 bytes each
#: together; beyond them results are computed, not stored.
MEMO_ENTRIES = 100_000
MEMO_BYTES = 64

#: The pre-token pattern of this public vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _pair(left: int, right: int) -> int:
    return left << 32 | right


class PrefixBpe:
    """Encoder and decoder over one tokenizer file of kind byte-level BPE."""

    def __init__(self, path: str, memo_entries: int = MEMO_ENTRIES):
        self.memo_entries = memo_entries
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.token_bytes = {i: raw(t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes |= {i: t.encode() for t, i in self.special.items()}
        self.pair_rank: dict[int, int] = {}  # by _pair of two ids
        self.made_from: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair = vocab[left], vocab[right]
            self.pair_rank[_pair(*pair)] = rank
            self.made_from.setdefault(vocab[left + right], (rank, *pair))
        self.suffixes = ahocorasick.Automaton()
        for token, i in vocab.items():
            b = raw(token)
            if len(b) == 1 or i in self.made_from:
                self.suffixes.add_word(b.decode("latin-1"), (i, len(b)))
        self.suffixes.make_automaton()
        self.words = regex.compile(PATTERN).findall
        self.later = re.compile("[\u0558-\U0010ffff]").search
        self.library_split = None
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else lambda t: [t]
        self._fits: dict[int, bool] = {}

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes of two tokens ends with just these two.

        Walks back in time: of the two pieces at the boundary the later made one is
        undone first. A merge across the boundary would have come first if its rank
        is below that of the undone step; at equal rank the leftmost merge wins.
        """
        key, none = _pair(left, right), (-1, -1, -1)
        before, inclusive, ok = len(self.pair_rank), False, True
        while True:
            rank = self.pair_rank.get(_pair(left, right))
            if rank is not None and (rank < before or inclusive and rank == before):
                ok = False
                break
            l, r = self.made_from.get(left, none), self.made_from.get(right, none)
            if l[0] < 0 and r[0] < 0:
                break
            if l[0] > r[0]:
                before, inclusive, left = l[0], False, l[2]
            else:
                before, inclusive, right = r[0], True, r[1]
        if len(self._fits) < self.memo_entries:
            self._fits[key] = ok
        return ok

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        piece = word if word.isascii() else word.encode().decode("latin-1")
        token_at, size_at = [-1] * (len(piece) + 1), [0] * (len(piece) + 1)
        known = self._fits.get
        for end, (token, size) in self.suffixes.iter(piece):
            end += 1
            if size_at[end]:
                continue  # the last token of a prefix is unique
            start = end - size
            if start:
                before = token_at[start]
                if before < 0:
                    continue
                ok = known(before << 32 | token)
                if ok is None:
                    ok = self.fits(before, token)
                if not ok:
                    continue
            token_at[end], size_at[end] = token, size
        ids, at = [], len(piece)
        while at:
            ids.append(token_at[at])
            at -= size_at[at]
        ids.reverse()
        return ids

    def pre_tokens(self, part: str) -> list[str]:
        """Pre-tokens of a text without special strings.

        What counts as a letter or number depends on the Unicode version from U+0558
        on, so there the library's own splitter decides.
        """
        if self.later(part):
            if self.library_split is None:
                from tokenizers import pre_tokenizers  # few workers need it

                self.library_split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
            return [part[a:b] for _, (a, b) in self.library_split(part)]
        return self.words(part)

    def pieces(self, text: str) -> Iterator[tuple[bool, list[str]]]:
        """Runs of pre-tokens, and special strings (true) between them."""
        for k, part in enumerate(self.split_special(text)):
            if part:
                yield bool(k % 2), [part] if k % 2 else self.pre_tokens(part)

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for special, words in self.pieces(text):
            for w in words:
                ids += [self.special[w]] if special else self.encode_word(w)
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


class _Memo(dict):
    """Pre-token to its ids as text, of bounded size."""

    def __init__(self, bpe: PrefixBpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str) -> str:
        ids = ",".join(map(str, self.bpe.encode_word(word)))
        if len(self) < self.bpe.memo_entries and len(word) <= MEMO_BYTES:
            self[word] = ids
        return ids


def worker_bpe(path: str, memo_entries: int = MEMO_ENTRIES) -> tuple[PrefixBpe, _Memo, dict[str, bytes]]:
    """The encoder of this Python worker with its memo and its table for decoding."""

    def make() -> tuple[PrefixBpe, _Memo, dict[str, bytes]]:
        bpe = PrefixBpe(path, memo_entries)
        give_back()  # what parsing the file took
        return bpe, _Memo(bpe), {str(i): b for i, b in bpe.token_bytes.items()}

    return worker_cache("bpe", f"{memo_entries}:{path}", make)


def encode_text(path: str, text: str, memo_entries: int = MEMO_ENTRIES) -> str:
    """Decimal ids of a text joined by commas."""
    bpe, memo, _ = worker_bpe(path, memo_entries)
    out = []
    for special, words in bpe.pieces(text):
        out.append(str(bpe.special[words[0]]) if special else ",".join(map(memo.__getitem__, words)))
    return ",".join(out)


def decode_text(path: str, ids: str, memo_entries: int = MEMO_ENTRIES) -> str:
    table = worker_bpe(path, memo_entries)[2]
    return b"".join(map(table.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""


def encode_documents(docs: DataFrame, tokenizer_path: str, keep_ids: bool = False, memo_entries: int = MEMO_ENTRIES) -> DataFrame:
    """Encodes and decodes each whole text; adds to every row of ``docs``

    ``n_tokens`` long, ``ids_sha256`` and ``decoded_sha256`` strings, and with
    ``keep_ids`` also ``ids`` (array of int). ``memo_entries`` bounds a worker's memory, results
    don't depend on it. A null text counts as empty: no
    tokens and the digests of nothing. Columns of ``docs`` of these names are replaced.
    Rows are neither dropped nor merged, so repeated rows give repeated results.
    """
    ship_package(docs.sparkSession)
    added = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    kinds = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep_ids:
        added.append(("ids", pa.list_(pa.int32())))
        kinds += ", ids array<int>"
    kept = docs.drop(*[n for n, _ in added])
    base = plain_names(kept, "text")
    schema = StructType(base.schema.fields + StructType.fromDDL(kinds).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, all_ids = [], []
            for text in batch.column("text"):
                ids = encode_text(tokenizer_path, text.as_py() or "", memo_entries)
                back = decode_text(tokenizer_path, ids, memo_entries)
                n = ids.count(",") + 1 if ids else 0
                rows.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
                if keep_ids:
                    all_ids.append(np.fromstring(ids, np.int32, sep=","))
            cols = [pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(added[:3])]
            if keep_ids:
                cols.append(pa.array(all_ids, added[3][1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, *(n for n, _ in added)])
        give_back()

    return base.mapInArrow(run, schema).toDF(*kept.columns, *(n for n, _ in added))
