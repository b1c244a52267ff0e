"""Shared plumbing: scratch tables, bounded id filters, connected components."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType

ROOT = Path(__file__).resolve().parents[2]

#: Bytes of an Arrow batch between the JVM and Python.
ARROW_BYTES = 4 << 20
#: Rows of the broadcast bitmap of ids at least and at most (64 bits each; about 12 MB at most).
BITMAP_WORDS = (1 << 10, 1 << 18)
#: Rows of a file of a scratch table at least, where their number is known, and files that are not worth merging.
ROWS_PER_FILE, FEW_FILES = 10_000, 8
#: Bits of the bitmap for each id, as long as it is below its greatest size.
BITS_PER_ID = 16


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    A folder of our own is made only in local mode, where there is one machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = tempfile.mkdtemp(prefix="upwell-shared-")
    spark.sparkContext.setCheckpointDir(base)
    return f"file://{base}"


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/upwell-{uuid.uuid4().hex}"
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))
        self._fs.deleteOnExit(self._path(self.root))
        self._n = 0
        self._tables: list[str] = []

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str = "t", rows: int | None = None) -> DataFrame:
        """Writes a table. ``rows`` is about how many it has: small ones are not cut into many

        files, each of which costs a task and, on local disks, a process that sets its mode.
        """
        if rows is not None:
            df = df.coalesce(max(FEW_FILES, -(-rows // ROWS_PER_FILE)))
        self._n += 1
        path = self.path(f"{name}-{self._n}")
        df.write.parquet(path)
        saved = self.spark.read.schema(df.schema).parquet(path)
        saved.scratch_path = path
        self._tables.append(path)
        return saved

    def drop(self, *tables: DataFrame) -> None:
        """Frees tables that no later step reads."""
        for df in tables:
            self._fs.delete(self._path(df.scratch_path), True)
            self._tables.remove(df.scratch_path)

    def mark(self) -> int:
        """To free with ``clear`` what is saved from now on."""
        return len(self._tables)

    def clear(self, mark: int = 0, keep: tuple[DataFrame, ...] = ()) -> None:
        """Frees the tables saved since ``mark`` but those of ``keep``, which later steps read."""
        kept = {df.scratch_path for df in keep}
        for path in self._tables[mark:]:
            if path not in kept:
                self._fs.delete(self._path(path), True)
        self._tables[mark:] = [p for p in self._tables[mark:] if p in kept]


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable on executors whose PYTHONPATH lacks it.

    Also bounds the Arrow batches of the session, whose buffers lie outside the heap.
    """
    batch = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(batch).rstrip("b")) > ARROW_BYTES:
        spark.conf.set(batch, str(ARROW_BYTES))
    on_path = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if str(ROOT) in on_path or getattr(spark.sparkContext, "_upwell_shipped", False):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="upwell-ship-"), "upwell_pkg.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for file in (ROOT / "upwell").rglob("*.py"):
            out.write(file, file.relative_to(ROOT))
    spark.sparkContext.addPyFile(archive)
    spark.sparkContext._upwell_shipped = True


def give_back() -> None:
    """Returns freed memory of this process to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


_held: dict[tuple[str, str], object] = {}


def worker_cache(owner: str, key: str, make: Callable[[], object]) -> object:
    """What a Python worker keeps between tasks: one object, of the operator that runs now.

    A worker serves stage after stage, so what earlier operators kept is let go.
    """
    if (owner, key) not in _held:
        if _held:
            _held.clear()
            give_back()
        _held[owner, key] = make()
    return _held[owner, key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_name(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores added until no column of the frames has it."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns_of(df: DataFrame) -> list:
    """The columns in order, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def plain_names(df: DataFrame, *needed: str) -> DataFrame:
    """``df`` with names that ``mapInArrow`` can look up, whatever they held, for all columns but the needed ones."""
    return df.toDF(*(c if c in needed else f"_c{k}" for k, c in enumerate(df.columns)))


def require_integer(df: DataFrame, column: str) -> DataFrame:
    """``df`` if the column has an integer type (or no type at all), else ``ValueError``."""
    kind = df.schema[column].dataType
    if not isinstance(kind, (IntegralType, NullType)):
        raise ValueError(f"{column} must be an integer column, not {kind.simpleString()}")
    return df


def _marked(df: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, str]:
    """``df`` with a boolean column, and its name: false means that ``key`` is surely not among ``ids``.

    The filter is a bitmap sized by the number of ids up to a fixed bound, so its broadcast
    cannot outgrow it; when it fills up it stops saving work but stays right. Null keys are
    never in. ``ids`` is read twice, so it should be a saved table.
    """
    least, most = BITMAP_WORDS
    wanted = ids.count() * BITS_PER_ID // 64
    bits = 64 * min(most, max(least, 1 << max(0, wanted - 1).bit_length()))
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    one = lambda s: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(s, F.lit(64)).cast("int"))
    at, word, held, maybe = (fresh_name(n, df) for n in ("_slot", "_word", "_held", "_maybe"))
    bitmap = (
        ids.toDF("id")
        .filter("id is not null")
        .select(slot(F.col("id")).alias(at))
        .select(F.floor(F.col(at) / 64).cast("int").alias(word), one(F.col(at)).alias("bit"))
        .groupBy(word)
        .agg(F.bit_or("bit").alias(held))
    )
    keyed = df.withColumn(at, slot(F.col(key))).withColumn(word, F.floor(F.col(at) / 64).cast("int"))
    hit = (F.col(held).bitwiseAND(one(F.col(at))) != 0) & F.col(key).isNotNull()
    joined = keyed.join(F.broadcast(bitmap), word, "left").withColumn(maybe, F.coalesce(hit, F.lit(False)))
    return joined.select(*columns_of(df), maybe), maybe


def keep_ids(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows whose key is among ``ids`` (one column); only rows that pass the bitmap are shuffled."""
    marked, maybe = _marked(df, key, ids)
    return marked.filter(maybe).drop(maybe).join(ids.toDF(key).distinct().hint("shuffle_hash"), key, "left_semi").select(*columns_of(df))


def drop_ids(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows whose key is not among ``ids`` (null keys stay); most rows are not shuffled."""
    marked, maybe = _marked(df, key, ids)
    sure = marked.filter(~F.col(maybe)).drop(maybe)
    left = marked.filter(maybe).drop(maybe).join(ids.toDF(key).distinct().hint("shuffle_hash"), key, "left_anti")
    return sure.unionByName(left.select(*columns_of(df)))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of ``edges(a, b)``: ``node, component`` with the smallest node.

    Alternating large-star and small-star steps, as in "Connected Components in
    MapReduce and Beyond" (Kiveris et al., 2014), each one aggregate and one join.
    The minima are written before the join, so that Spark can split a hot node.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = scratch.save(e.filter("u <> v").distinct(), "edges")
    state = lambda d: d.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1000003)).first()
    before = state(e)
    while before[0]:
        n = before[0]
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.save(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low", n)
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.save(large.filter("u <> v").distinct(), "large", n)
        low2 = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")), "low", n)
        hung = large.join(low2, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = hung.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        nxt = scratch.save(small.unionByName(low2.select("u", F.col("m").alias("v"))).distinct(), "edges", n)
        after = state(nxt)
        scratch.drop(e, low, large, low2)
        e = nxt
        if after == before:
            break
        before = after
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
