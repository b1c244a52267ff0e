"""Sending messages: a Spark data source whose writer posts rows to two channels over HTTP.

Each row is posted once to either channel, with a key by which a channel knows a message it has
had; Spark may run a failed task again. The tasks' commit messages carry the channels' answers.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Row
from pyspark.sql import datasource as api
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from upwell.operators import notify
from upwell.sources.search import open_path

NAME = "upwell_push"
ANSWER = "post_id string, first_status int, second_status int, second_body string"
#: Seconds that a channel has to answer (fixed value), and characters of an answer that are kept.
TIMEOUT, BODY_CHARS = 10, 2000
#: Fields of the second channel and the columns they come from (fixed names).
FIELDS = {"title": "title", "message": "message", "sound": "sound", "priority": "priority", "url": "link", "url_title": "url_title", "retry": "retry", "expire": "expire"}


@dataclass
class Answers(api.WriterCommitMessage):
    """What the channels answered to the rows of one task."""

    rows: list[tuple[str, int | None, int | None, str | None]] = field(default_factory=list)


def post(url: str, body: bytes, headers: dict[str, str]) -> tuple[int | None, str | None]:
    """Status and text of the answer; none of them if there is no answer."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=TIMEOUT) as answer:  # noqa: S310
            return answer.status, answer.read(4 * BODY_CHARS).decode("utf-8", "replace")[:BODY_CHARS]
    except urllib.error.HTTPError as error:
        return error.code, error.read(4 * BODY_CHARS).decode("utf-8", "replace")[:BODY_CHARS]
    except OSError:
        return None, None


class PushWriter(api.DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def _first(self, row: Row) -> tuple[int | None, str | None]:
        url = self.options.get("first_url")
        if not url:
            return None, None
        body = {"to": self.options.get("first_to", ""), "messages": [{"type": "text", "text": row["text"]}]}
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {self.options.get('first_token', '')}", "Idempotency-Key": f"{row['send_key']}:first"}
        return post(url, json.dumps(body, ensure_ascii=False).encode(), headers)

    def _second(self, row: Row) -> tuple[int | None, str | None]:
        url = self.options.get("second_url")
        if not url:
            return None, None
        body = {"token": self.options.get("second_token", ""), "user": self.options.get("second_user", "")}
        body |= {name: row[column] for name, column in FIELDS.items() if row[column] is not None}
        return post(url, urllib.parse.urlencode(body).encode(), {"Idempotency-Key": f"{row['send_key']}:second"})

    def write(self, iterator: Iterator[Row]) -> Answers:
        answers = Answers()
        for row in iterator:
            first, (second, body) = self._first(row)[0], self._second(row)
            answers.rows.append((row["post_id"], first, second, body))
        return answers

    def commit(self, messages: list[Answers | None]) -> None:
        """Keeps the answers of all tasks in one file; there are as many as posts were sent."""
        rows = [r for m in messages if m is not None for r in m.rows]
        kinds = pa.schema([("post_id", pa.string()), ("first_status", pa.int32()), ("second_status", pa.int32()), ("second_body", pa.string())])
        fs, path = open_path(self.options["answers"])
        fs.create_dir(path)
        pq.write_table(pa.Table.from_pylist([dict(zip(kinds.names, r, strict=True)) for r in rows], kinds), f"{path}/answers.parquet", filesystem=fs)

    def abort(self, messages: list[Answers | None]) -> None:
        """Nothing is kept: what was sent is known to the channels by its key."""


class PushSink(api.DataSource):
    """Options: ``first_url, first_to, first_token``, ``second_url, second_token, second_user``, and ``answers``, a folder."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return ANSWER

    def writer(self, schema: StructType, overwrite: bool) -> PushWriter:
        return PushWriter(dict(self.options))


@dataclass
class HttpSender:
    """A sender for cycles: posts the outbox and tells which channels took what.

    ``answers`` is a folder that the driver and executors share. Channels that have no URL take
    nothing. It is idempotent as far as the channels heed the key of a message.
    """

    answers: str
    options: dict[str, str]
    tasks: int = 8
    idempotent: bool = True

    def __call__(self, outbox: DataFrame) -> DataFrame:
        spark = outbox.sparkSession
        spark.dataSource.register(PushSink)
        folder = f"{self.answers}/{uuid.uuid4().hex}"
        outbox.repartition(self.tasks).write.format(NAME).mode("append").options(**self.options, answers=folder).save()
        got = spark.read.schema(ANSWER).parquet(folder)
        return got.select(
            "post_id", notify.first_accepted(F.col("first_status")).alias("first_ok"), notify.second_accepted(F.col("second_status"), F.col("second_body")).alias("second_ok")
        )
