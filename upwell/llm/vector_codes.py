"""Compression of vectors to codes, with codebooks by Elkan's form of Lloyd's algorithm.

A vector of integers is cut into parts, and each part is replaced by the nearest entry of the
codebook of its position. Between rounds each part keeps an upper bound of the distance to its
entry and a lower bound for every entry. When entries move, the bounds are shifted by as much;
an entry is passed over only if a bound, or the distance between two entries, proves that it is
further away. All that is left is compared by exact integer distances, ties go to the lower
entry, so the codes are those of the plain algorithm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from upwell.llm._common import Scratch, ship_package

#: Steps of a stored lower bound: the greatest distance possible is one less.
STEPS = 1 << 16
#: Distances that are bounds are widened by so much for rounding.
WIDER = 1 + 1e-9


@dataclass
class Codebooks:
    """Entries of each part, ``values[part, entry, position]``; as many numbers as parameters allow."""

    values: np.ndarray

    def sha256(self) -> str:
        """Of all decimal numbers by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.values.ravel().tolist())).encode()).hexdigest()

    def between(self) -> np.ndarray:
        """Half the distance of any two entries of a part, at most; beyond reach for an entry itself."""
        gap = self.values[:, :, None, :] - self.values[:, None, :, :]
        half = np.sqrt((gap * gap).sum(axis=3)) / 2 / WIDER
        half[:, np.arange(half.shape[1]), np.arange(half.shape[1])] = np.inf
        return half

    def moved(self, before: Codebooks) -> np.ndarray:
        """How far each entry is from where it was, at least."""
        gap = self.values - before.values
        return np.sqrt((gap * gap).sum(axis=2)) * WIDER


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = a - b
    return (gap * gap).sum(axis=-1)


@dataclass
class Bounds:
    """Of one part of many vectors: the entry, a distance that it is within, and for each entry one that it is beyond."""

    entry: np.ndarray
    upper: np.ndarray
    lower: np.ndarray


def first_entries(x: np.ndarray, book: np.ndarray) -> Bounds:
    """Nearest entries without knowledge: all distances are taken."""
    d = _squared(x[:, None, :], book[None])
    entry = d.argmin(axis=1)  # the lowest of equal ones
    return Bounds(entry, np.sqrt(d[np.arange(len(x)), entry]) * WIDER, np.sqrt(d) / WIDER)


def next_entries(x: np.ndarray, book: np.ndarray, half: np.ndarray, moved: np.ndarray, old: Bounds) -> tuple[Bounds, int]:
    """Nearest entries from the bounds of the round before, and how many distances it took."""
    entry, k = old.entry.astype(np.int64), len(book)
    upper = old.upper + moved[entry]
    lower = np.maximum(old.lower - moved[None], 0)
    # strictly nearer than half way to any other entry: it stays
    rows = np.flatnonzero(upper >= half[entry].min(axis=1))
    own = _squared(x[rows], book[entry[rows]])
    upper[rows] = np.sqrt(own) * WIDER
    lower[rows, entry[rows]] = np.sqrt(own) / WIDER
    near = (lower[rows] <= upper[rows, None]) & (half[entry[rows]] <= upper[rows, None])
    near[np.arange(len(rows)), entry[rows]] = False
    i, j = np.nonzero(near)
    d = _squared(x[rows[i]], book[j])
    lower[rows[i], j] = np.sqrt(d) / WIDER
    # one number orders by distance, then by entry
    best = own * k + entry[rows]
    np.minimum.at(best, i, d * k + j)
    entry[rows] = best % k
    upper[rows] = np.sqrt(best // k) * WIDER
    return Bounds(entry, upper, lower), len(rows) + len(i)


def _vectors(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(batch), parts, -1)


def _matrix(column: pa.Array, kind: str, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _assign(book: Codebooks, moved: np.ndarray | None, reach: float, last: bool):
    """One round over the saved vectors: codes with their bounds or, in the last one, with their errors."""
    parts, k, _ = book.values.shape
    unit = (STEPS - 1) / reach

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half, taken = book.between(), 0
        for batch in batches:
            v = _vectors(batch, parts)
            if moved is not None:
                entry = _matrix(batch.column("code"), "u1", parts)
                upper = _matrix(batch.column("upper"), "<f8", parts)
                lower = _matrix(batch.column("lower"), "<u2", parts, k) / unit / WIDER
            found = []
            for p in range(parts):
                x, c = v[:, p], book.values[p]
                if moved is None:
                    found.append(first_entries(x, c))
                    taken += len(x) * k
                else:
                    bounds, n = next_entries(x, c, half[p], moved[p], Bounds(entry[:, p], upper[:, p].copy(), lower[:, p]))
                    found.append(bounds)
                    taken += n
            code = np.stack([b.entry for b in found], axis=1)
            cols = {"vec_id": batch.column("vec_id"), "label": batch.column("label")}
            if last:
                cols |= {"code": _binary(code.astype(np.uint8)), "error": pa.array(_squared(v, book.values[np.arange(parts), code]).sum(axis=1))}
            else:
                steps = np.stack([np.minimum(b.lower * unit, STEPS - 1) for b in found], axis=1).astype("<u2")
                upper = np.stack([b.upper for b in found], axis=1).astype("<f8")
                cols |= {"v": batch.column("v"), "code": _binary(code.astype(np.uint8)), "upper": _binary(upper), "lower": _binary(steps)}
            distances = np.zeros(len(batch), np.int64)
            distances[:1], taken = taken, 0
            yield pa.RecordBatch.from_arrays([*cols.values(), pa.array(distances)], [*cols, "distances"])

    return run


def _sums(parts: int, entries: int):
    """Sums of the parts of each entry, once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = count = None
        for batch in batches:
            if not len(batch):
                continue
            v, code = _vectors(batch, parts), _matrix(batch.column("code"), "u1", parts)
            if total is None:
                total, count = np.zeros((parts, entries, v.shape[2]), np.int64), np.zeros((parts, entries), np.int64)
            for p in range(parts):
                np.add.at(total[p], code[:, p], v[:, p])
                count[p] += np.bincount(code[:, p], minlength=entries)
        if total is not None:
            p, e = np.nonzero(count)
            cols = [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["part", "entry", "n", "total"])

    return run


def _moved_books(state: DataFrame, book: Codebooks) -> Codebooks:
    """Each entry at the mean of its parts, rounded down; unused ones stay."""
    parts, entries, width = book.values.shape
    sums = state.select("code", "v").mapInArrow(_sums(parts, entries), "part int, entry int, n long, total array<bigint>")
    by = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("total")[i]) for i in range(width))).alias("total"))
    values = book.values.copy()
    for r in by.collect():  # at most parts x entries rows
        values[r["part"], r["entry"]] = np.array(r["total"], np.int64) // r["n"]
    return Codebooks(values)


def integer_vectors(embeddings: DataFrame, scale: int) -> DataFrame:
    """``vec_id, label, v`` of the rows whose vector has components, all of them finite: ``v`` is floor(scale * x)."""
    usable = F.coalesce(F.size("embedding") > 0, F.lit(False)) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")).filter(F.coalesce(usable, F.lit(False)))
    return kept.select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))


def compress(
    embeddings: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, scratch: Scratch | None = None
) -> tuple[DataFrame, Codebooks]:
    """Codes of ``embeddings(vec_id, embedding, label)`` and their codebooks.

    Per usable row: ``vec_id, label, code`` (binary, a byte for each part), ``error`` (long, the squared
    distance to the entries, on integers) and ``distances`` (how many the last round took to
    find the codes, summed into the first row of each batch). Rows whose vector is null or empty, or
    holds null or non-finite components, are left out. Each part's codebook begins with that
    part of the ``entries`` smallest vec_ids (of all, if there are fewer; null ids last, equal ids
    by their vectors), and ``rounds`` times each entry goes to the mean of its parts, rounded
    down. Repeated rows are vectors of their own. Vectors must be of one length, a multiple of
    ``parts``, and small enough for 64-bit distances: ``ValueError`` otherwise. Without a usable
    row there are no rows and no entries. Other columns are ignored.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte for each part: 1 to 256 entries")
    spark = embeddings.sparkSession
    ship_package(spark)
    scratch = scratch or Scratch(spark)
    state = scratch.save(integer_vectors(embeddings, scale), "vectors")
    far = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    n, least, most, largest = state.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v")), F.max(far)).first()
    kinds = StructType([state.schema["vec_id"], state.schema["label"]])
    result = StructType(kinds.fields + StructType.fromDDL("code binary, error bigint, distances bigint").fields)
    if not n:
        return spark.createDataFrame([], result), Codebooks(np.zeros((parts, 0, 0), np.int64))
    if least != most or most % parts:
        raise ValueError(f"vectors of {least} to {most} components: they must be of one length that {parts} divides")
    width = most // parts
    if 4 * largest * largest * width * entries >= 2**62:
        raise ValueError(f"a component of {largest:.3g} is too large for exact distances")
    seeds = [r["v"] for r in state.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()]
    book, moved = Codebooks(np.array(seeds, np.int64).reshape(len(seeds), parts, width).transpose(1, 0, 2).copy()), None
    # no distance between a vector and an entry is larger
    reach = float(2 * max(1.0, largest) * np.sqrt(width)) * WIDER + 1
    bounds = StructType(kinds.fields + [state.schema["v"]] + StructType.fromDDL("code binary, upper binary, lower binary, distances bigint").fields)
    for _ in range(rounds):
        before, book_before = state, book
        state = scratch.save(before.mapInArrow(_assign(book, moved, reach, False), bounds), "bounds")
        scratch.drop(before)
        book = _moved_books(state, book)
        moved = book.moved(book_before)
    return state.mapInArrow(_assign(book, moved, reach, True), result), book


def with_label_error(codes: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds ``label_error``: the error summed over rows of an equal label, nulls together."""
    sums = scratch.save(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "label_error")
    sums = sums.select(F.col("label").alias("_label"), "label_error")
    return codes.join(sums, codes["label"].eqNullSafe(sums["_label"])).drop("_label")
