"""State in a folder that all executors share, committed cycle by cycle.

What a cycle adds to a table is a run, a folder of its own. Runs become state all at once, when
the cycle's manifest appears: one small file that names the runs of all tables, written aside
and then renamed, unless there is one of that number. Readers look at manifests only, so a
cycle that ended early shows nothing, and of two writers of one number one wins.

Runs are in levels. As soon as a level has so many, they are merged into one run of the next:
what a cycle writes follows what it adds, not what is stored. Runs of tables with a key are cut
into buckets by the key's hash, and each bucket has a Bloom filter, so a look-up of some keys
reads few files.

What a cycle has decided and sent, its steps, is kept aside by its number, so that a repeated
cycle finds it. Manifests and steps have a lifetime; a look at older state raises an error.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from upwell.operators import state
from upwell.schema import AUTHOR_STATE, META, NOTICE, RUN, STORED_POST

SCHEMAS = {"posts": STORED_POST, "notices": NOTICE, "authors": AUTHOR_STATE, "runs": RUN, "meta": META}
#: How the runs of a table become one state.
MERGES = {
    "posts": state.last_posts,
    "notices": lambda rows: rows.groupBy("post_id").agg(F.max("notified_at").alias("notified_at")),
    "authors": lambda rows: rows.groupBy("author_handle").agg(F.max("last_notified_at").alias("last_notified_at")),
    "runs": lambda rows: rows.dropDuplicates(["run_id"]),
    "meta": lambda rows: rows.groupBy("key").agg(F.max_by(F.struct("value", "seq"), "seq").alias("v")).select("key", "v.value", "v.seq"),
}
#: Keys that look-ups go by.
KEYS = {"posts": "post_id", "notices": "post_id", "authors": "author_handle"}
#: Runs of a level that are merged, rows of a bucket, about, and manifests that are kept.
FANOUT, BUCKET_ROWS, KEEP = 8, 1_000_000, 48
#: Bits of a Bloom filter for each key, and how many of them a key sets; runs of fewer rows have none and are read whole.
BLOOM_BITS, BLOOM_HASHES, BLOOM_ROWS = 12, 4, 1000


class StateExpired(LookupError):
    """A state that was removed at the end of its lifetime."""


class StaleCycle(RuntimeError):
    """A cycle whose number is below one that is committed, and that isn't committed itself."""


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only in local mode, where it is unset, one for the session."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = tempfile.mkdtemp(prefix="upwell-state-")
    spark.sparkContext.setCheckpointDir(base)
    return f"file://{base}"


def _bucket(key: Column, buckets: int | Column) -> Column:
    return F.pmod(key, buckets if isinstance(buckets, Column) else F.lit(buckets)).cast("int")


def _bits(hashes: np.ndarray, size: int) -> np.ndarray:
    """The bits that each key sets, a row for each key."""
    low, high = hashes.astype(np.uint64) & np.uint64(0xFFFFFFFF), hashes.astype(np.uint64) >> np.uint64(32)
    return (low[:, None] + np.arange(1, BLOOM_HASHES + 1, dtype=np.uint64) * (high | np.uint64(1))[:, None]) % np.uint64(size)


def _bloom(group: pa.Table) -> pa.Table:
    hashes = group.column("h").to_numpy()
    size = max(64, len(hashes) * BLOOM_BITS + 7 & ~7)
    held = np.zeros(size, bool)
    held[_bits(hashes, size).ravel()] = True
    one = group.slice(0, 1).select(["run", "bucket"])
    return one.append_column("size", pa.array([size], pa.int64())).append_column("bits", pa.array([np.packbits(held).tobytes()], pa.binary()))


def _may_hold(asked: pa.Table, blooms: pa.Table) -> pa.Table:
    """The bucket, if any of the asked keys may be in it."""
    hit = False
    if len(asked) and len(blooms):
        size, held = blooms.column("size")[0].as_py(), np.unpackbits(np.frombuffer(blooms.column("bits")[0].as_py(), np.uint8)).astype(bool)
        hit = bool(held[_bits(asked.column("h").to_numpy(), size)].all(axis=1).any())
    return blooms.select(["run", "bucket"]).slice(0, 1 if hit else 0)


class Store:
    def __init__(self, spark: SparkSession, root: str, fanout: int = FANOUT, bucket_rows: int = BUCKET_ROWS, keep: int = KEEP):
        self.spark, self.root, self.fanout, self.bucket_rows, self.keep = spark, root.rstrip("/"), fanout, bucket_rows, keep
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._staged: dict[int, dict[str, str]] = {}
        self._written = ""

    # files

    def _exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{name}"))

    def _names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/{folder}"))) if self._exists(folder) else []

    def _delete(self, names: Iterable[str]) -> None:
        for name in names:
            self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def _create(self, name: str, content: dict) -> bool:
        """Writes a small file unless there is one; a reader sees all of it or nothing."""
        target = self._fs.makeQualified(self._path(f"{self.root}/{name}"))
        aside = self._path(f"{target.toString()}.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(aside, True)
        out.write(bytearray(json.dumps(content, ensure_ascii=False).encode()))
        out.close()
        jvm = self.spark._jvm
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        never_over = self.spark.sparkContext._gateway.new_array(rename, 1)
        never_over[0] = rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(aside, target, never_over)
        except Py4JJavaError as e:
            self._fs.delete(aside, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def _content(self, name: str) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    # manifests

    def manifests(self) -> list[int]:
        return [int(n[:-5]) for n in self._names("_manifests") if re.fullmatch(r"\d+\.json", n)]

    def _manifest(self, number: int) -> dict:
        return self._content(f"_manifests/{number:09d}.json")

    def result(self, number: int) -> dict | None:
        """What a committed cycle left in its manifest; None if it isn't committed."""
        return self._manifest(number)["result"] if self._exists(f"_manifests/{number:09d}.json") else None

    def snapshot(self, before: int | None = None) -> dict:
        """The last manifest, or the last one before a number; one without tables if there never was any."""
        numbers = self.manifests()
        under = [n for n in numbers if before is None or n < before]
        if under:
            return self._manifest(under[-1])
        if numbers and self._manifest(numbers[0])["expired"]:
            raise StateExpired(f"the state before {before} was removed; the oldest that is kept is of {numbers[0]}")
        return {"number": None, "expired": False, "tables": {}}

    # tables

    def _read(self, table: str, runs: list[dict]) -> DataFrame:
        paths = [f"{self.root}/{leaf}" for r in runs for leaf in r["files"].values()]
        return self.spark.read.schema(SCHEMAS[table]).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMAS[table])

    def rows(self, table: str, before: int | None = None) -> DataFrame:
        """What the runs of a table hold; keys may repeat."""
        return self._read(table, self.snapshot(before)["tables"].get(table, []))

    def read(self, table: str, before: int | None = None) -> DataFrame:
        """The state of a table after all cycles or those before a number; empty if there are none."""
        merged = MERGES[table](self.rows(table, before))
        if table == "posts":
            merged = state.apply_notices(merged, self.read("notices", before))
        return merged

    def lookup(self, table: str, keys: DataFrame, before: int | None = None) -> DataFrame:
        """Rows of a table, not merged, that include all those of the given keys (one column).

        Runs with no more rows than there are keys, and those without filters, are read whole. Of the
        others only buckets whose filter may hold one of the keys are read. Keys meet filters bucket by bucket, so no
        task holds more of them than a bucket has rows, about.
        """
        runs = self.snapshot(before)["tables"].get(table, [])
        asked = keys.toDF("key").filter("key is not null").select(F.xxhash64("key").alias("h")).distinct()
        n = asked.count() if runs else 0
        filtered = lambda r: r["rows"] > n and "bloom" in r
        large = [r for r in runs if filtered(r)] if n else []
        hits: set[tuple[str, int]] = set()
        if large:
            each = F.array(*(F.struct(F.lit(r["path"]).alias("run"), F.lit(r["buckets"]).alias("buckets")) for r in large))
            meets = asked.select("h", F.explode(each).alias("r")).select("r.run", _bucket(F.col("h"), F.col("r.buckets")).alias("bucket"), "h")
            blooms = self.spark.read.schema("run string, bucket int, size long, bits binary").parquet(*(f"{self.root}/{r['bloom']}" for r in large))
            found = meets.groupBy("run", "bucket").cogroup(blooms.groupBy("run", "bucket")).applyInArrow(_may_hold, "run string, bucket int")
            hits = {(r["run"], r["bucket"]) for r in found.collect()}  # names of files
        some = [r | {"files": {b: f for b, f in r["files"].items() if not filtered(r) or (r["path"], int(b)) in hits}} for r in runs] if n else []
        return self._read(table, some)

    def write(self, table: str, df: DataFrame, number: int) -> DataFrame:
        """Writes what a cycle adds to a table, and gives it as stored; state when the cycle commits."""
        path = f"{table}/r{number:09d}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{path}")
        self._written = path
        if table in MERGES:
            staged = self._staged.setdefault(number, {})
            if table in staged:
                self._delete([staged[table]])
            staged[table] = path
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{path}")

    def _run(self, table: str, path: str, level: int) -> list[dict]:
        """A written folder as a run, cut into buckets and with filters if the table has a key; nothing if it is empty."""
        df = self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.root}/{path}")
        rows = df.count()
        if not rows:
            self._delete([path])
            return []
        run = {"path": path, "level": level, "rows": rows, "buckets": 1, "files": {"0": path}}
        if table not in KEYS:
            return [run]
        h = F.xxhash64(KEYS[table])
        buckets = 1 << (-(-rows // self.bucket_rows) - 1).bit_length()
        if buckets > 1:
            cut = f"{path}-cut"
            df.withColumn("bucket", _bucket(h, buckets)).repartition(buckets, "bucket").write.partitionBy("bucket").parquet(f"{self.root}/{cut}")
            self._delete([path])
            files = {n.removeprefix("bucket="): f"{cut}/{n}" for n in self._names(cut) if n.startswith("bucket=")}
            run |= {"path": cut, "buckets": buckets, "files": files}
            df = self._read(table, [run])
        if rows < BLOOM_ROWS:
            return [run]
        run["bloom"] = f"bloom/{run['path']}"
        hashed = df.select(F.lit(run["path"]).alias("run"), _bucket(h, buckets).alias("bucket"), h.alias("h")).filter(F.col("h").isNotNull())
        hashed.groupBy("run", "bucket").applyInArrow(_bloom, "run string, bucket int, size long, bits binary").write.parquet(f"{self.root}/{run['bloom']}")
        return [run]

    def _tiered(self, table: str, runs: list[dict], number: int, made: list[str]) -> list[dict]:
        """Merges each level that is full into a run of the next one."""
        level = 0
        while any(r["level"] >= level for r in runs):
            full = [r for r in runs if r["level"] == level]
            if len(full) >= self.fanout:
                path = f"{table}/r{number:09d}-{uuid.uuid4().hex}-level{level + 1}"
                MERGES[table](self._read(table, full)).write.parquet(f"{self.root}/{path}")
                new = self._run(table, path, level + 1)
                made += [p for r in new for p in (r["path"], r.get("bloom")) if p]
                runs = [r for r in runs if r["level"] != level] + new
            level += 1
        return runs

    def commit(self, number: int, result: dict | None = None) -> bool:
        """Makes what was written for a cycle state, all tables at once; false if the number is taken.

        A number below a committed one raises ``StaleCycle``: later cycles didn't see its rows.
        """
        staged = self._staged.pop(number, {})
        if self._exists(f"_manifests/{number:09d}.json"):
            self._delete(staged.values())
            return False
        known = self.manifests()
        if known and known[-1] > number:
            self._delete(staged.values())
            raise StaleCycle(f"cycle {number} comes after {known[-1]}, which is committed")
        base, made = self.snapshot(number), list(staged.values())
        tables = {t: list(runs) for t, runs in base["tables"].items()}
        for table, path in staged.items():
            new = self._run(table, path, 0)
            made += [p for r in new for p in (r["path"], r.get("bloom")) if p]
            tables[table] = self._tiered(table, tables.get(table, []) + new, number, made)
        old = known[: max(0, len(known) + 1 - self.keep)]
        content = {"number": number, "expired": bool(old) or base["expired"], "tables": tables, "result": result or {}}
        if not self._create(f"_manifests/{number:09d}.json", content):
            self._delete(set(made))
            return False
        # runs that were merged at once are named by no manifest
        self._delete(set(made) - {p for runs in tables.values() for r in runs for p in (r["path"], r.get("bloom"))})
        if old:
            self._expire(old[-1], self._manifest((known + [number])[len(old)]))
        return True

    def _expire(self, last: int, oldest: dict) -> None:
        """Removes manifests and steps up to a number, and folders that the oldest manifest after it doesn't name."""
        held = {r["path"] for runs in oldest["tables"].values() for r in runs}
        self._delete(f"_manifests/{n:09d}.json" for n in self.manifests() if n <= last)
        self._delete(f"_steps/{n}" for n in self._names("_steps") if int(n) <= last)
        for table in self._names(""):
            for parent in [table] if not table.startswith(("_", "bloom")) else [f"bloom/{t}" for t in self._names("bloom")] if table == "bloom" else []:
                gone = [n for n in self._names(parent) if (m := re.match(r"r(\d+)-", n)) and int(m[1]) <= last and f"{parent.removeprefix('bloom/')}/{n}" not in held]
                self._delete(f"{parent}/{n}" for n in gone)

    def create(self) -> None:
        """An empty state, as cycle 0, where there is none."""
        if not self.manifests():
            self.commit(0)

    # steps of a cycle

    def has(self, name: str, number: int) -> bool:
        return self._exists(f"_steps/{number:09d}/{name}.json")

    def at(self, name: str, number: int) -> DataFrame:
        """The rows of a step."""
        step = self._content(f"_steps/{number:09d}/{name}.json")
        return self.spark.read.schema(StructType.fromJson(step["schema"])).parquet(f"{self.root}/{step['path']}")

    def step(self, name: str, df: DataFrame, number: int) -> DataFrame:
        """Keeps a step of a cycle, if it isn't kept yet, and gives what is kept."""
        if not self.has(name, number):
            self.write(name, df, number)
            self._create(f"_steps/{number:09d}/{name}.json", {"path": self._written, "schema": df.schema.jsonValue()})
        return self.at(name, number)

    def steps(self, name: str) -> list[int]:
        """The numbers of the cycles that have such a step."""
        return [int(n) for n in self._names("_steps") if self.has(name, int(n))]

    def claim(self, name: str, number: int) -> bool:
        """Takes a one-time step of a cycle: true for the first caller only."""
        return self._create(f"_steps/{number:09d}/{name}.claim", {})

    def write_text(self, name: str, df: DataFrame) -> None:
        """A small text result as a single file in a folder."""
        df.coalesce(1).write.mode("overwrite").text(f"{self.root}/{name}")
