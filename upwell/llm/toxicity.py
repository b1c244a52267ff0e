"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes ratios.

Each feature is the presence of an n-gram, scaled by its log-count ratio between toxic
and other training texts; logistic regression is fitted on the scaled features (as in
Wang and Manning, "Baselines and Bigrams", 2012).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upwell.llm._common import Scratch, plain_names, ship_package

#: Bounds of the training sample: rows of each class (expected number).
TRAIN_TOXIC, TRAIN_OTHER = 2000, 4000
SIZES = (3, 4, 5, 6, 7, 8)
BITS = 20
#: A feature needs this many training texts and this many standard errors of its ratio.
LEAST_TEXTS, LEAST_Z = 3, 3.0
#: The classifier keeps so many features at most, those of most standard errors.
FEATURES = 1 << 17
SMOOTHING, RIDGE, STEPS = 1.0, 1e-3, 400
#: Texts are hashed in parts of so many characters, which overlap so that no n-gram is lost.
PART_CHARS = 1 << 20
#: Slots of a text that are held, with repeats, before they are made distinct.
HELD_SLOTS = 1 << 20

_STEP, _SPREAD = np.uint32(0x01000193), np.uint32(0x9E3779B1)


def gram_slots(text: str) -> Iterator[np.ndarray]:
    """Slots (below 2**BITS) of all n-grams of a part of a text, by size.

    Letters are lower-cased; every run of other characters is one space.
    """
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where((raw >= 97) & (raw <= 122) | (raw >= 0xC0), raw, np.uint32(32))
    blank = codes == 32
    codes = codes[~(blank & np.concatenate([[False], blank[:-1]]))]
    h = codes.copy()
    for n in range(2, max(SIZES) + 1):
        if len(h) < 2:
            return
        h = h[:-1] * _STEP + codes[n - 1 :]
        if n in SIZES:
            yield (h ^ np.uint32(n)) * _SPREAD >> np.uint32(32 - BITS)


def parts(text: str) -> Iterator[str]:
    step = PART_CHARS - max(SIZES)
    for at in range(0, max(1, len(text)), step):
        yield text[at : at + PART_CHARS]


def present(text: str | None) -> np.ndarray:
    """Distinct slots of a whole text."""
    seen = np.zeros(1 << BITS, bool)
    for part in parts(text or ""):
        for slots in gram_slots(part):
            seen[slots] = True
    return np.flatnonzero(seen)


@dataclass
class ToxicityModel:
    bias: float
    weight: np.ndarray  # by slot; 0 where a feature isn't selected

    def __post_init__(self):
        self.used = self.weight != 0

    def score(self, text: str | None) -> float:
        held, n = [], 0
        for part in parts(text or ""):
            for s in gram_slots(part):
                held.append(s[self.used[s]])
                n += len(held[-1])
            if n > HELD_SLOTS:  # no more than that, and the features once, however long the text is
                held = [np.unique(np.concatenate(held))]
                n = 0
        slots = np.unique(np.concatenate(held)) if held else np.empty(0, np.uint32)
        z = self.bias + float(self.weight[slots].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def _constant(toxic: bool) -> ToxicityModel:
    return ToxicityModel(4.0 if toxic else -4.0, np.zeros(1 << BITS))


def _count_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each class that hold a slot, one row per slot seen in the partition."""
    counts = np.zeros((2, 1 << BITS), np.int32)
    for batch in batches:
        for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
            counts[toxic, present(text.as_py())] += 1
    slots = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(counts[1, slots], pa.int64()), pa.array(counts[0, slots], pa.int64())], ["slot", "in_toxic", "in_other"])


class _Sums:
    """Sums over groups that lie one after another, of the given sizes; 0 for empty ones."""

    def __init__(self, sizes: np.ndarray):
        self.n, self.some = len(sizes), np.flatnonzero(sizes)
        self.starts = (np.cumsum(sizes) - sizes)[self.some]
        self.held = np.empty(int(sizes.sum()))

    def __call__(self, values: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of ``values[at]``."""
        out = np.zeros(self.n)
        if len(self.some):
            np.take(values, at, out=self.held, mode="clip")
            out[self.some] = np.add.reduceat(self.held, self.starts)
        return out


def fit_weights(y: np.ndarray, cols: list[np.ndarray], ratio: np.ndarray) -> tuple[float, np.ndarray]:
    """Bias and weight of each feature by ridge logistic regression, both classes at the same weight.

    ``cols`` has the features of each text; they enter as their ``ratio``. Features are held
    by text and by feature, so that both sums of a step run along memory.
    """
    size = np.array([len(c) for c in cols])
    col = np.concatenate(cols).astype(np.int64)
    row = np.repeat(np.arange(len(cols)), size)[np.argsort(col, kind="stable")]  # texts, by feature
    by_text, by_feature = _Sums(size), _Sums(np.bincount(col, minlength=len(ratio)))
    w = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    theta, bias = np.zeros(len(ratio)), 0.0
    push, push_b = theta.copy(), bias
    norm = by_text(ratio**2, col)
    rate = 4.0 / (np.percentile(norm, 99) + 1 + 4 * RIDGE)
    for k in range(STEPS):  # accelerated gradient steps
        z = push_b + by_text(push * ratio, col)
        g = w * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y)
        grad = by_feature(g, row) * ratio + RIDGE * push
        nxt, nxt_b = push - rate * grad, push_b - rate * g.sum()
        m = k / (k + 3)
        push, push_b = nxt + m * (nxt - theta), nxt_b + m * (nxt_b - bias)
        theta, bias = nxt, nxt_b
    return bias, theta * ratio


def held_out(modulus: int = 5, remainder: int = 0):
    """True where crc32 of doc_id as text leaves the remainder; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, n_toxic: int = TRAIN_TOXIC, n_other: int = TRAIN_OTHER) -> ToxicityModel:
    """Trains on labelled rows that are not held out.

    About ``n_toxic`` and ``n_other`` of them are taken by the hash of doc_id, all if there
    are fewer: a bounded sample to fit on, with whole texts. Labels other than 0 and 1 don't
    count; of several for a document the highest does. Null ids and null texts don't count,
    and a document of several rows counts once for each. Slots are counted and weights fitted
    on the executors, by one task that holds the features of the sample; the driver receives
    at most ``FEATURES`` of them. Without both classes every text has one score.
    """
    ship_package(docs.sparkSession)
    usable = labels.filter("doc_id is not null and toxic in (0, 1)").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    unit = 1 << 30
    share = F.when(F.col("toxic") == 1, min(unit, unit * n_toxic // max(1, total.get(1, 0)))).otherwise(min(unit, unit * n_other // max(1, total.get(0, 0))))
    scratch = Scratch(docs.sparkSession)
    # a small saved table, which Spark broadcasts when its size allows
    sample = scratch.save(usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(unit)) < share), "labels")
    rows = scratch.save(docs.select("doc_id", "text").filter("text is not null").join(sample, "doc_id").select("doc_id", F.col("text").cast("string").alias("text"), "toxic"), "sample")
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return _constant(1 in n)
    counted = rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(_count_slots, "slot long, in_toxic long, in_other long")
    p = (F.col("in_toxic") + SMOOTHING) / (n[1] + 2 * SMOOTHING)
    q = (F.col("in_other") + SMOOTHING) / (n[0] + 2 * SMOOTHING)
    error = F.sqrt((1 - p) / (n[1] * p) + (1 - q) / (n[0] * q))
    total = counted.groupBy("slot").agg(F.sum("in_toxic").alias("in_toxic"), F.sum("in_other").alias("in_other"))
    telling = (F.col("in_toxic") + F.col("in_other") >= LEAST_TEXTS) & (F.abs(F.log(p / q)) >= LEAST_Z * error)
    chosen = total.filter(telling).select("slot", F.log(p / q).alias("ratio"), (F.abs(F.log(p / q)) / error).alias("z"))
    chosen = chosen.orderBy(F.desc("z"), "slot").limit(FEATURES).toArrow().sort_by("slot")
    slots, ratio = chosen.column("slot").to_numpy(), chosen.column("ratio").to_numpy()

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.full(1 << BITS, -1, np.int32)
        at[slots] = np.arange(len(slots))
        for batch in batches:
            cols = [at[present(t.as_py())] for t in batch.column("text")]
            ids = batch.column("doc_id").cast(pa.string())
            yield pa.RecordBatch.from_arrays([ids, batch.column("toxic"), pa.array([c[c >= 0] for c in cols], pa.list_(pa.int32()))], ["doc_id", "toxic", "cols"])

    def learn(group: pa.Table) -> pa.Table:
        # the same sums in any order of arrival
        cols = [c.values.to_numpy() for c in group.column("cols")]
        order = sorted(range(len(cols)), key=lambda k: (group.column("doc_id")[k].as_py(), cols[k].tobytes()))
        y = group.column("toxic").to_numpy().astype(float)[order]
        bias, w = fit_weights(y, [cols[k] for k in order], ratio)
        return pa.table({"bias": [bias], "weight": pa.array([w], pa.list_(pa.float64()))})

    texts = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(held, "doc_id string, toxic int, cols array<int>")
    got = texts.withColumn("model", F.lit("all")).groupBy("model").applyInArrow(learn, "bias double, weight array<double>").toArrow()
    scratch.clear()
    weight = np.zeros(1 << BITS)
    weight[slots] = got.column("weight")[0].values.to_numpy()
    return ToxicityModel(got.column("bias")[0].as_py(), weight)


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (score >= 0.5) to each row by its whole text.

    A null text counts as empty: it has the score of no feature. Rows are judged alone;
    existing columns of these names are replaced.
    """
    spark = docs.sparkSession
    ship_package(spark)
    kept = docs.drop("score", "predicted")
    base = plain_names(kept, "text")
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([shared.value.score(t.as_py()) for t in batch.column("text")])
            cols = [pa.array(got, pa.float64()), pa.array((got >= 0.5).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, "score", "predicted"])

    scored = base.mapInArrow(run, base.withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0)).schema)
    return scored.toDF(*kept.columns, "score", "predicted")
