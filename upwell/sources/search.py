"""The search as a Spark data source, in batch and as a stream.

A site's answers to search queries are kept as polls: folders ``poll=<seconds>`` of Parquet
files with a row for each result, its ``query`` and ``mode``. The source gives each poll, query
and mode a partition of its own. The operators of a query are the site's predicate; what Spark
filters by is pushed down to the reader too, where it drops whole partitions, or rows before
they leave the Python worker. As a stream, a poll is an offset.

A partition is never held whole: its results get their places in passes over the columns that
order and select them, and then go out in batches, in the order of the files.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime, timezone
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as api
from pyspark.sql.types import StructType

from upwell.sources.raw import SessionExpired, SourceUnavailable

NAME = "upwell_search"
#: The query and the modes that are searched if none are given (fixed values).
QUERY, MODES = "lang:ja min_faves:500 min_replies:20 -filter:retweets", "live,top"
#: What the results hold, and what the source adds.
RESULT = (
    "post_id string, author_handle string, url string, text_snippet string, lang string, is_repost boolean, posted_at timestamp, "
    "likes long, retweets long, replies long, quotes long, bookmarks long, impressions long"
)
SIGHTING = f"poll long, query string, mode string, {RESULT}, seq long, observed_at timestamp"
#: Places of a partition's results in ``seq``: a partition has fewer of them.
RESULTS = 1 << 24
#: Rows of a file that are decoded at once, and results that are ordered at once.
BATCH, HELD = 1 << 13, 1 << 20


def open_path(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or a local path, and the path in it."""
    return pafs.FileSystem.from_uri(path) if path.partition(":")[2].startswith("/") else (pafs.LocalFileSystem(), path)


def query_filter(query: str) -> tuple[ds.Expression, set[str]]:
    """The predicate of a query's operators, and the columns it reads; its other words must be in the text."""
    kept, columns = pc.scalar(True), set()
    for word in query.split():
        name, _, value = word.partition(":")
        if name == "lang":
            column, one = "lang", pc.field("lang") == value
        elif name in ("min_faves", "min_replies", "min_retweets"):
            column = {"min_faves": "likes", "min_replies": "replies", "min_retweets": "retweets"}[name]
            one = pc.field(column) >= int(value)
        elif word == "-filter:retweets":
            column, one = "is_repost", ~pc.field("is_repost")
        elif name == "from":
            column, one = "author_handle", pc.field("author_handle") == value
        else:
            column, one = "text_snippet", pc.match_substring(pc.field("text_snippet"), word)
        kept = kept & one
        columns.add(column)
    return kept, columns


def _condition(f: api.Filter) -> ds.Expression | None:
    """A pushed filter over one column; None if the source leaves it to Spark."""
    if isinstance(f, api.Not):
        inner = _condition(f.child)
        return None if inner is None else ~inner
    if len(getattr(f, "attribute", ())) != 1 or isinstance(getattr(f, "value", None), datetime):
        return None
    column = pc.field(f.attribute[0])
    by_kind = {
        api.EqualTo: lambda: column == f.value,
        api.GreaterThan: lambda: column > f.value,
        api.GreaterThanOrEqual: lambda: column >= f.value,
        api.LessThan: lambda: column < f.value,
        api.LessThanOrEqual: lambda: column <= f.value,
        api.In: lambda: column.isin(list(f.value)),
        api.IsNull: lambda: column.is_null(),
        api.IsNotNull: lambda: column.is_valid(),
        api.StringContains: lambda: pc.match_substring(column, f.value),
        api.StringStartsWith: lambda: pc.starts_with(column, f.value),
    }
    make = by_kind.get(type(f))
    return make() if make else None


@dataclass
class Part(api.InputPartition):
    """One poll of one query and mode; ``order`` is its place in the order of collection."""

    poll: int
    query: str
    mode: str
    order: int
    heartbeat: bool = False


class _Search:
    """What both readers share."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema = schema
        if "path" not in options:
            raise SourceUnavailable("the search needs a path")
        self.path = options["path"].rstrip("/")
        self.queries = options.get("queries", QUERY).split("\n")
        self.modes = options.get("modes", MODES).split(",")
        self.cap = int(options["cap"]) if "cap" in options else None
        self.session = options.get("session")
        self.pushed: list[api.Filter] = []

    def check_session(self, poll: int) -> None:
        """The session file tells until when it holds; searches need one if the option names it."""
        if self.session is None:
            return
        fs, path = open_path(self.session)
        if fs.get_file_info(path).type == pafs.FileType.NotFound:
            raise SourceUnavailable(f"no session at {self.session}")
        with fs.open_input_stream(path) as f:
            until = json.loads(f.read()).get("expires")
        if until is not None and poll >= until:
            raise SessionExpired(f"the session ended at {until}")

    def polls(self) -> list[int]:
        fs, path = open_path(self.path)
        if fs.get_file_info(path).type == pafs.FileType.NotFound:
            raise SourceUnavailable(f"no polls at {self.path}")
        names = (re.fullmatch(r"poll=(\d+)", i.base_name) for i in fs.get_file_info(pafs.FileSelector(path)))
        return sorted(int(m[1]) for m in names if m)

    def parts(self, polls: Sequence[int], heartbeat: bool) -> list[Part]:
        every = [Part(p, q, m, 0, heartbeat and not (i or j)) for p in polls for i, q in enumerate(self.queries) for j, m in enumerate(self.modes)]
        for k, part in enumerate(every):
            part.order = k
        return [p for p in every if self.may_hold(p)]

    def may_hold(self, part: Part) -> bool:
        """Whether the pushed filters on poll, query and mode leave anything of a partition."""
        named = [c for f in self.pushed if getattr(f, "attribute", ("",))[0] in ("poll", "query", "mode") and (c := _condition(f)) is not None]
        row = pa.table({"poll": [part.poll], "query": [part.query], "mode": [part.mode]})
        return all(row.filter(c).num_rows for c in named)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        self.check_session(partition.poll)
        found = _Found(self.path, partition)
        places = found.places(self.cap)
        at = datetime.fromtimestamp(partition.poll, timezone.utc)
        kinds = _arrow(self.schema)
        if partition.heartbeat:
            beat = pa.table({f.name: pa.array([at if f.name == "observed_at" else partition.poll if f.name == "poll" else None], f.type) for f in kinds})
            yield from beat.to_batches()
        for first, table in found.rows({f.split()[0] for f in RESULT.split(", ")}, found.holding(places)):
            place = places[first : first + table.num_rows]
            table = table.append_column("seq", pa.array(partition.order * RESULTS + place.astype(np.int64))).filter(pa.array(place >= 0))
            for name, value in {"poll": partition.poll, "query": partition.query, "mode": partition.mode, "observed_at": at}.items():
                table = table.append_column(name, pa.repeat(pa.scalar(value, kinds.field(name).type), table.num_rows))
            for f in self.pushed:
                table = table.filter(_condition(f))
            yield from table.select(kinds.names).cast(kinds).to_batches()


class _Found:
    """What a poll holds for a query and mode: results in batches, in the same order whenever they are read."""

    def __init__(self, path: str, part: Part):
        self.poll, self.by = part.poll, "posted_at" if part.mode == "live" else "likes"
        operators, named = query_filter(part.query)
        self.wanted, self.named = (pc.field("query") == part.query) & (pc.field("mode") == part.mode) & operators, {"query", "mode"} | named
        with self._source():
            self.fs, path = open_path(f"{path}/poll={part.poll}")
            data = ds.dataset(path, filesystem=self.fs, format="parquet")
            self.schema = data.schema
            #: Row groups that may hold results, and how many results come before each.
            self.groups = [(f.path, g.id) for f in data.get_fragments() for g in f.subset(self.wanted, schema=data.schema).row_groups]
            self.starts = np.zeros(len(self.groups), np.int64)

    @contextmanager
    def _source(self) -> Iterator[None]:
        try:
            yield
        except Exception as error:
            raise SourceUnavailable(f"poll {self.poll}: {error}") from error

    def rows(self, columns: set[str], groups: Iterable[int] | None = None) -> Iterator[tuple[int, pa.Table]]:
        """The results in batches, each with the number of those before it; of some row groups, once all were read, or of all."""
        with self._source():
            kinds = [self.schema.field(c) for c in sorted(columns | self.named)]
            first = 0
            for path, some in groupby(range(len(self.groups)) if groups is None else groups, lambda k: self.groups[k][0]):
                with self.fs.open_input_file(path) as f:
                    file = pq.ParquetFile(f, buffer_size=1 << 20)
                    has = set(file.schema_arrow.names)
                    for k in some:
                        if groups is None:
                            self.starts[k] = first
                        first = int(self.starts[k])
                        for batch in file.iter_batches(BATCH, [self.groups[k][1]], [c.name for c in kinds], use_threads=False):
                            table = pa.table({c.name: batch[c.name].cast(c.type) if c.name in has else pa.nulls(len(batch), c.type) for c in kinds}).filter(self.wanted)
                            yield first, table.select(sorted(columns))
                            first += table.num_rows

    def places(self, cap: int | None) -> np.ndarray:
        """The place of each result, newest (live) or most liked (top) first; -1 for those beyond the cap.

        Each pass places the next ``HELD`` of them, so an uncapped poll is passed over once for so many results.
        """
        order = [(self.by, "descending"), ("post_id", "ascending"), ("number", "ascending")]
        places, done = None, 0
        while places is None or done < (len(places) if cap is None else min(cap, len(places))):
            size = HELD if cap is None else min(HELD, cap - done)
            best, held, n, last = [], 0, 0, None
            for first, table in self.rows({self.by, "post_id"}):
                n = first + table.num_rows
                table = table.append_column("number", pa.array(np.arange(first, n)))
                if places is not None:
                    table = table.filter(pa.array(places[first:n] < 0))
                if last is not None:
                    table = table.filter(pc.field(self.by) >= last)
                if table.num_rows:
                    best.append(table)
                    held += table.num_rows
                if held >= 2 * size + BATCH:
                    best, held = [_first(best, order, size)], size
                    last = best[0][self.by][-1] if size and best[0][self.by][-1].is_valid else None
            if places is None:
                places = np.full(n, -1, np.int32)
            if best:
                taken = _first(best, order, size)["number"].to_numpy()
                places[taken] = done + np.arange(len(taken))
                done += len(taken)
        return places

    def holding(self, places: np.ndarray) -> list[int]:
        """The row groups in which results have a place."""
        return [k for k, (a, b) in enumerate(pairwise([*self.starts, len(places)])) if (places[a:b] >= 0).any()]


def _first(tables: list[pa.Table], order: list[tuple[str, str]], size: int) -> pa.Table:
    table = pa.concat_tables(tables)
    return table.take(pc.sort_indices(table, sort_keys=order)[:size])  # a slice would keep the others


def _arrow(schema: StructType) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "bigint": pa.int64(), "boolean": pa.bool_(), "timestamp": pa.timestamp("us", "UTC")}
    return pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in schema])


class SearchReader(_Search, api.DataSourceReader):
    """All polls."""

    def pushFilters(self, filters: list[api.Filter]) -> Iterable[api.Filter]:  # noqa: N802
        for f in filters:
            if _condition(f) is None:
                yield f
            else:
                self.pushed.append(f)

    def partitions(self) -> Sequence[Part]:
        return self.parts(self.polls(), False)


class SearchStream(_Search, api.DataSourceStreamReader):
    """Polls one after another; a poll's first row tells its time and has no post_id."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"poll": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"poll": max(self.polls(), default=-1)}

    def partitions(self, start: dict, end: dict) -> Sequence[Part]:
        return self.parts([p for p in self.polls() if start["poll"] < p <= end["poll"]], True)


class SearchSource(api.DataSource):
    """Options: ``path``; ``queries``, one a line; ``modes``; ``cap``, the most results of a poll, query

    and mode, newest (live) or most liked (top) first; ``session``, a JSON file with ``expires``.
    Filters that Spark pushes down apply after the cap.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SIGHTING

    def reader(self, schema: StructType) -> SearchReader:
        return SearchReader(schema, dict(self.options))

    def streamReader(self, schema: StructType) -> SearchStream:  # noqa: N802
        return SearchStream(schema, dict(self.options))


def register(spark: SparkSession) -> str:
    """Makes the source known to a session, with filters pushed down; returns its name."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SearchSource)
    return NAME


def read(spark: SparkSession, path: str, **options: str | int) -> DataFrame:
    """All polls at a path, as a relation of its own.

    Spark 4.1 keeps with a relation what it last pushed down to a Python source, also for a later
    plan that pushes nothing, which would then lack rows; a filter that all rows pass makes
    every plan push its own. Where one plan scans the polls more than once with different
    filters, as a self-join, each scan needs its own call of this function.
    """
    return spark.read.format(register(spark)).options(path=path, **options).load().filter("poll >= 0")
