"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities over the pieces of a fixed public vocabulary. A word's
likelihood is the sum over all its segmentations into pieces, by the forward algorithm;
a text's is the product over its words. Probabilities come from expectation
maximisation, whose expected piece counts are sums over all segmentations too.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upwell.llm._common import give_back, plain_names, ship_package, worker_cache

#: Bound of the training sample: documents for each language (expected number), whole texts.
TRAIN_DOCS = 300
EM_ROUNDS, SMOOTHING = 3, 0.05
#: Entries of a worker's memo of word scores (some 200 bytes each) and bytes of its scores; results don't depend on them.
MEMO_ENTRIES, MEMO_BYTES = 100_000, 64 << 20
#: Words whose lattices are built at once, and numbers in those lattices.
WORDS_AT_ONCE, LATTICE_CELLS = 2_000, 4_000_000
#: Long texts are taken in parts of so many characters and a little more, cut outside words.
PART_CHARS = 1 << 20
_PACK = 1 << 20
#: Keeps sums near 1: each character's probability is scaled by this.
CHAR_SCALE = 14.0
FLOOR = 1e-7
#: Sums over words of so many letters stay in range: (FLOOR * CHAR_SCALE) ** 51 is above 1e-300.
#: Longer words are summed as logs.
PLAIN_LETTERS = 50
#: Words of more letters are summed one at a time, in windows of so many letters.
WINDOW = 4096

_RUNS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_OUTSIDE = regex.compile(r"[^\p{L}\p{M}]")


def words_of(text: str | None) -> list[str]:
    """Lower-cased letter runs."""
    return _RUNS.findall((text or "").lower())


def word_parts(text: str | None) -> Iterator[list[str]]:
    """``words_of`` in lists of bounded size."""
    text = (text or "").lower()
    at = 0
    while at < len(text):
        cut = _OUTSIDE.search(text, at + PART_CHARS) if at + PART_CHARS < len(text) else None
        end = cut.start() if cut else len(text)
        yield _RUNS.findall(text, at, end)
        at = end


def load_pieces(model_path: str) -> list[str]:
    """Vocabulary pieces that can stand in a lower-cased word; "▁" marks a word's start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    some = regex.compile(r"▁?[\p{L}\p{M}]*").fullmatch
    pieces = (model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)))
    return sorted({p for p in pieces if p and some(p) and p == p.lower()})


class Lattice:
    """Segmentation lattices over a fixed set of pieces."""

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        self.size = np.array([len(p) for p in pieces] + [1])  # the last stands for any unknown character
        self.automaton = ahocorasick.Automaton()
        for i, p in enumerate(pieces):
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.single = np.zeros(0x110000, bool)
        self.single[[ord(p) for p in pieces if len(p) == 1] + [10]] = True

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Source node, target node and piece of every edge, in order of the offset in the word;

        then the bounds of each offset, and the last node of each word. Nodes count the
        characters of all words, each with its start mark, plus one before each word.
        """
        joined = "\n" + "\n".join("▁" + w for w in words) + "\n"
        found = np.fromiter((e * _PACK + p for e, p in self.automaton.iter(joined)), np.int64)
        alone = np.flatnonzero(~self.single[np.frombuffer(joined.encode("utf-32-le"), np.uint32)])
        found = np.sort(np.concatenate([found, alone * _PACK + len(self.pieces)]))
        target, piece = found // _PACK, found % _PACK
        lengths = np.array([len(w) + 2 for w in words])
        ends = np.cumsum(lengths)  # the separator after each word
        start = np.repeat(ends - lengths, lengths)
        offset = (target - start[target - 1]).astype(np.int16)
        order = np.argsort(offset, kind="stable")  # targets already rise
        target, piece, offset = target[order], piece[order], offset[order]
        bounds = np.searchsorted(offset, np.arange(1, lengths.max() + 1))
        return target - self.size[piece], target, piece, bounds, ends - 1

    def forward(self, words: list[str], prob: np.ndarray, keep: bool = False):
        """Scaled sums over all segmentations of each word, one column per language.

        ``prob``: pieces (and the unknown one) by languages, already scaled.
        """
        source, target, piece, bounds, last = self.edges(words)
        alpha = np.zeros((int(last[-1]) + 2, prob.shape[1]))
        first = np.concatenate([[0], last[:-1] + 1])
        alpha[first] = 1.0
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if a < b:
                t = target[a:b]
                cut = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
                alpha[t[cut]] = np.add.reduceat(alpha[source[a:b]] * prob[piece[a:b]], cut, axis=0)
        if not keep:
            return alpha[last]
        beta = np.zeros_like(alpha)
        beta[last] = 1.0
        for a, b in zip(bounds[:-1][::-1], bounds[1:][::-1], strict=True):
            if a < b:
                np.add.at(beta, source[a:b], beta[target[a:b]] * prob[piece[a:b]])
        return alpha, beta, source, target, piece, last

    def log_forward(self, words: list[str], log_prob: np.ndarray, keep: bool = False):
        """As ``forward``, in logs throughout: for words whose sums would leave the range."""
        source, target, piece, bounds, last = self.edges(words)
        alpha = np.full((int(last[-1]) + 2, log_prob.shape[1]), -np.inf)
        alpha[np.concatenate([[0], last[:-1] + 1])] = 0.0
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if a < b:
                t = target[a:b]
                cut = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
                alpha[t[cut]] = np.logaddexp.reduceat(alpha[source[a:b]] + log_prob[piece[a:b]], cut, axis=0)
        if not keep:
            return alpha[last]
        beta = np.full_like(alpha, -np.inf)
        beta[last] = 0.0
        for a, b in zip(bounds[:-1][::-1], bounds[1:][::-1], strict=True):
            if a < b:
                np.logaddexp.at(beta, source[a:b], beta[target[a:b]] + log_prob[piece[a:b]])
        return alpha, beta, source, target, piece, last


    def windows(self, word: str, back: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Edges of one long word as ``edges`` gives them, by rising (or falling) target, a window at a time."""
        marked = "▁" + word
        reach = int(self.size.max())
        starts = range(0, len(marked), WINDOW)
        for a in reversed(starts) if back else starts:
            low = max(0, a - reach + 1)
            part = marked[low : a + WINDOW]
            found = np.fromiter(((low + e + 1) * _PACK + p for e, p in self.automaton.iter(part) if low + e >= a), np.int64)
            alone = a + 1 + np.flatnonzero(~self.single[np.frombuffer(part[a - low :].encode("utf-32-le"), np.uint32)])
            found = np.sort(np.concatenate([found, alone * _PACK + len(self.pieces)]))
            target, piece = found // _PACK, found % _PACK
            yield target - self.size[piece], target, piece

    def long_forward(self, word: str, log_prob: np.ndarray) -> np.ndarray:
        """``log_forward`` of one word; what is kept doesn't grow with the word."""
        reach = int(self.size.max())
        alpha = np.full((reach + WINDOW + 1, log_prob.shape[1]), -np.inf)
        alpha[reach] = 0.0  # row ``reach`` is the node before the window
        n = len(word) + 1
        for k, (source, target, piece) in enumerate(self.windows(word)):
            base = k * WINDOW - reach
            if k:
                alpha[: reach + 1] = alpha[WINDOW:]
            for u, t, p in _by_target(source, target, piece):
                alpha[t - base] = np.logaddexp.reduce(alpha[u - base] + log_prob[p], axis=0)
        return alpha[n - base]

    def long_counts(self, word: str, log_prob: np.ndarray) -> np.ndarray:
        """Expected number of each piece in a word, for one language."""
        n = len(word) + 1
        alpha, beta = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        alpha[0] = beta[n] = 0.0
        for edges in self.windows(word):
            for u, t, p in _by_target(*edges):
                alpha[t] = np.logaddexp.reduce(alpha[u] + log_prob[p])
        expected = np.zeros(len(log_prob))
        for source, target, piece in self.windows(word, back=True):
            for u, t, p in reversed(list(_by_target(source, target, piece))):
                beta[u] = np.logaddexp(beta[u], beta[t] + log_prob[p])
            expected += np.bincount(piece, np.exp(alpha[source] + log_prob[piece] + beta[target] - alpha[n]), len(log_prob))
        return expected


def _by_target(source: np.ndarray, target: np.ndarray, piece: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    cut = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
    for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(target)], strict=True):
        yield source[i:j], int(target[i]), piece[i:j]


@dataclass
class LanguageModel:
    languages: list[str]
    pieces: list[str]
    log_prob: np.ndarray  # pieces and the unknown one, by languages
    _lattice: Lattice | None = field(default=None, repr=False)

    @property
    def lattice(self) -> Lattice:
        if self._lattice is None:
            self._lattice = Lattice(self.pieces)
            self._scaled = np.exp(self.log_prob) * CHAR_SCALE ** self._lattice.size[:, None]
        return self._lattice

    def __getstate__(self):
        return {"languages": self.languages, "pieces": self.pieces, "log_prob": self.log_prob, "_lattice": None}

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each word by language."""
        out = np.empty((len(words), len(self.languages)))
        lattice = self.lattice
        for at, kind in _parts(words, len(self.languages)):
            part = [words[i] for i in at]
            if kind == "window":
                out[at[0]] = lattice.long_forward(part[0], self.log_prob)
            elif kind == "log":
                out[at] = lattice.log_forward(part, self.log_prob)
            else:
                out[at] = np.log(lattice.forward(part, self._scaled)) - np.array([len(w) + 1 for w in part])[:, None] * np.log(CHAR_SCALE)
        return out


def _parts(words: list[str], languages: int) -> Iterator[tuple[np.ndarray, str]]:
    """Positions of words whose lattices are built at once, and how they are summed."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    kinds = np.digitize(length, [PLAIN_LETTERS + 1, WINDOW + 1])
    for i in np.flatnonzero(kinds == 2):
        yield np.array([i]), "window"
    for kind, name in enumerate(("plain", "log")):
        at = np.flatnonzero(kinds == kind)
        room = np.cumsum(length[at] + 2) * max(1, languages) // LATTICE_CELLS
        full = np.maximum(np.arange(len(at)) // WORDS_AT_ONCE, room)
        for part in np.split(at, np.flatnonzero(np.diff(full)) + 1):
            if len(part):
                yield part, name


def train_language(counts: dict[str, int], lattice: Lattice, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Log probability of each piece, the unknown one last, by expectation maximisation over words."""
    words = sorted(counts)
    weight = np.array([counts[w] for w in words], dtype=float)
    size = len(lattice.pieces) + 1
    prob = np.full(size, 1.0 / size)
    for _ in range(rounds if words else 0):
        expected = np.zeros(size)
        scaled = (np.maximum(prob, FLOOR) * CHAR_SCALE**lattice.size)[:, None]
        log_prob = np.log(np.maximum(prob, FLOOR))[:, None]
        for at, kind in _parts(words, 1):
            part, w = [words[i] for i in at], weight[at]
            if kind == "window":
                expected += w[0] * lattice.long_counts(part[0], log_prob[:, 0])
                continue
            if kind == "log":
                alpha, beta, source, target, piece, last = lattice.log_forward(part, log_prob, keep=True)
                owner = np.searchsorted(last, target)
                share = np.exp(alpha[source, 0] + log_prob[piece, 0] + beta[target, 0] - alpha[last, 0][owner]) * w[owner]
            else:
                alpha, beta, source, target, piece, last = lattice.forward(part, scaled, keep=True)
                owner = np.searchsorted(last, target)
                share = alpha[source, 0] * scaled[piece, 0] * beta[target, 0] / alpha[last, 0][owner] * w[owner]
            expected += np.bincount(piece, share, size)
        prob = (expected + SMOOTHING) / (expected + SMOOTHING).sum()
    return np.log(np.maximum(prob, FLOOR))


def train(texts: list[tuple[str, str]], pieces: list[str], rounds: int = EM_ROUNDS) -> LanguageModel:
    """A model of ``(lang, text)`` pairs on one machine."""
    languages = sorted({lang for lang, _ in texts})
    lattice = Lattice(pieces)
    columns = [train_language(Counter(w for one, text in texts if one == lang for w in words_of(text)), lattice, rounds) for lang in languages]
    return LanguageModel(languages, pieces, np.stack(columns, axis=1) if columns else np.zeros((len(pieces) + 1, 0)))


def held_out(doc_id: str = "doc_id", modulus: int = 4, remainder: int = 2):
    """True where crc32 of the id as text leaves the remainder; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            for words in word_parts(text.as_py()):
                counts.update((lang, w) for w in words)
        cols = [pa.array([lang for lang, _ in counts], pa.string()), pa.array([w for _, w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, ["lang", "word", "n"])


def fit(docs: DataFrame, pieces: list[str], train_docs: int = TRAIN_DOCS) -> LanguageModel:
    """Trains on rows of ``docs(doc_id, text, lang)`` that are not held out and have a lang.

    About ``train_docs`` documents of each language are taken by the hash of doc_id, all if
    there are fewer, with their whole texts: a bounded sample to fit on. Words are counted and
    each language is trained on the executors; the driver receives a number for each piece and
    language. Null ids, texts and langs don't count, repeated rows count again, and a
    language of whose sample no text has a letter isn't learned.
    """
    ship_package(docs.sparkSession)
    usable = docs.filter(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    usable = usable.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counted = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counted:
        return train([], pieces)
    unit = 1 << 30
    share = F.from_json(F.lit(json.dumps({lang: min(unit, unit * train_docs // n) for lang, n in counted.items()})), "map<string,long>")
    chosen = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(unit)) < F.element_at(share, F.col("lang")))
    words = chosen.select("lang", "text").mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))

    def learn(group: pa.Table) -> pa.Table:
        counts = dict(zip(group.column("word").to_pylist(), group.column("n").to_pylist(), strict=True))
        column = train_language(counts, Lattice(pieces))
        return pa.table({"lang": group.column("lang").slice(0, 1), "log_prob": pa.array([column], pa.list_(pa.float64()))})

    learned = words.groupBy("lang").applyInArrow(learn, "lang string, log_prob array<double>").toArrow().sort_by("lang")
    columns = [c.values.to_numpy() for c in learned.column("log_prob")]
    return LanguageModel(learned.column("lang").to_pylist(), pieces, np.stack(columns, axis=1) if columns else np.zeros((len(pieces) + 1, 0)))


class _Scorer:
    """Scores texts with a memo of word scores."""

    def __init__(self, model: LanguageModel, memo_entries: int = MEMO_ENTRIES):
        self.model = model
        row_bytes = 8 * max(1, len(model.languages))
        self.memo_entries = min(memo_entries, MEMO_BYTES // row_bytes)
        #: Words that are scored and held at once.
        self.at_once = max(64, 8 * LATTICE_CELLS // row_bytes)
        self.memo: dict[str, int] = {}
        self.table = np.empty((0, len(model.languages)))

    def word_rows(self, words: list[str]) -> np.ndarray:
        """Scores of words, one row each; the memo takes new words until it is full."""
        at = np.fromiter(map(self.memo.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        if not len(missing):
            return self.table[at]
        new = {w: i for i, w in enumerate(dict.fromkeys(words[i] for i in missing), len(self.table))}
        at[missing] = [new[words[i]] for i in missing]
        table = np.concatenate([self.table, self.model.word_scores(list(new))])
        if len(table) <= self.memo_entries:
            self.memo.update(new)
            self.table = table
        return table[at]

    def _add(self, words: list[str], owner: np.ndarray, sums: np.ndarray) -> None:
        for a in range(0, len(words), self.at_once):
            scores, own = self.word_rows(words[a : a + self.at_once]), owner[a : a + self.at_once]
            cut = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            sums[own[cut]] += np.add.reduceat(scores, cut, axis=0)

    def totals(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """For each text the log-likelihood by language, None without a word."""
        sums, count = np.zeros((len(texts), len(self.model.languages))), np.zeros(len(texts), np.int64)
        some = count > 0
        words: list[str] = []
        for i, text in enumerate(texts):
            for part in word_parts(text):
                words += part
                count[i] += len(part)
                if len(words) > self.at_once:
                    self._add(words, np.repeat(np.arange(len(texts)), count), sums)
                    words, some, count = [], some | (count > 0), np.zeros_like(count)
        self._add(words, np.repeat(np.arange(len(texts)), count), sums)
        some |= count > 0
        return [s if ok else None for s, ok in zip(sums, some, strict=True)]

    def judge(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = []
        for total in self.totals(texts):
            if total is None or not len(total):
                out.append(("und", 0.0))
                continue
            post = np.exp(total - total.max())
            best = int(np.argmax(total))
            out.append((self.model.languages[best], float(post[best] / post.sum())))
        return out


_GROUP = 128


def _scorer(key: str, model: LanguageModel, memo_entries: int) -> _Scorer:
    # a copy, as the broadcast value outlives the stage and must not hold the lattice
    return worker_cache("langid", f"{memo_entries}:{key}", lambda: _Scorer(replace(model), memo_entries))


def _judges(docs: DataFrame, model: LanguageModel, memo_entries: int):
    """A function from a text column to judgements, to run on executors."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    key = f"{spark.sparkContext.applicationId}-{hash(model.log_prob.tobytes())}"

    def judge(column: pa.Array) -> list[tuple[str, float]]:
        scorer, got = _scorer(key, shared.value, memo_entries), []
        for at in range(0, len(column), _GROUP):
            got += scorer.judge(column[at : at + _GROUP].to_pylist())
        return got

    return judge


def identify(docs: DataFrame, model: LanguageModel, memo_entries: int = MEMO_ENTRIES) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` to every row of ``docs`` by its whole ``text``.

    ``lang_pred`` is a learned language, or ``und`` with score 0 if the text is null or has
    no letter (or nothing was learned); the score is the posterior with equal priors, and
    ties go to the first language by name. Existing columns of these names are replaced;
    repeated rows give the same.
    """
    kept = docs.drop("lang_pred", "score")
    base = plain_names(kept, "text")
    judge = _judges(docs, model, memo_entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = judge(batch.column("text"))
            cols = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, "lang_pred", "score"])
        give_back()

    judged = base.mapInArrow(run, base.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema)
    return judged.toDF(*kept.columns, "lang_pred", "score")


def accepted(docs: DataFrame, model: LanguageModel, least: float = 0.5, memo_entries: int = MEMO_ENTRIES) -> DataFrame:
    """The rows of ``docs`` with a language other than ``und`` and a score of ``least`` or more."""
    judge = _judges(docs, model, memo_entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([lang != "und" and score >= least for lang, score in judge(batch.column("text"))], pa.bool_()))
        give_back()

    base = plain_names(docs, "text")
    return base.mapInArrow(run, base.schema).toDF(*docs.columns)
