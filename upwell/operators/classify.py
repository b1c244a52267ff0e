"""Topic labels through a pluggable classifier, validated against the fixed list."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upwell.config import CLASSIFIER_CHARS, DEFAULT_GENRE, GENRES
from upwell.functions.text import trimmed

#: A classifier takes the text column and returns a column with the reply as JSON text.
Classifier = Callable[[Column], Column]

#: Words of the offline classifier and their topics, first match first.
OFFLINE = [
    (("地震", "台風", "事件", "earthquake", "flood"), "事件・事故"),
    (("outage", "token", "license"), "テクノロジー"),
    (("recall",), "経済"),
]


def offline(text: Column) -> Column:
    """A deterministic classifier that needs no service."""
    genre = F.lit(DEFAULT_GENRE)
    for words, label in reversed(OFFLINE):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(text, F.lit(w))
        genre = F.when(hit, F.lit(label)).otherwise(genre)
    return F.to_json(F.struct(genre.alias("genre"), F.lit("offline").alias("reason")))


def finalize(text: Column, reply: Column) -> Column:
    """``struct<genre, reason>`` of a reply: the default for blank texts, other labels and bad replies."""
    got = F.from_json(reply, "genre string, reason string")
    blank = trimmed(F.coalesce(text, F.lit(""))) == ""
    bad = got["genre"].isNull() & got["reason"].isNull()
    genre = F.when(~blank & got["genre"].isin(GENRES), got["genre"]).otherwise(F.lit(DEFAULT_GENRE))
    reason = F.when(blank, "本文なし").when(bad, "分類失敗").otherwise(got["reason"])
    return F.struct(genre.alias("genre"), reason.alias("reason"))


#: Replies by the digest of the text that was asked about.
ANSWERS = "digest string, reply string"


@dataclass(frozen=True)
class Batched:
    """A classifier behind a service. ``make`` gives a client, once for each Python worker.

    A client takes a list of texts and returns their replies as JSON text, None where there is
    none. ``answers`` is a folder of ``ANSWERS`` that all executors share: a text that has a reply
    there is not asked about again. Of a call that fails, or takes longer than
    ``seconds``, the texts have no reply this time.
    """

    make: Callable[[], Callable[[list[str]], list[str | None]]]
    answers: str
    size: int = 32
    seconds: float = 30.0


_clients: dict[str, Callable] = {}


def _client(batched: Batched) -> Callable[[list[str]], list[str | None]]:
    name = f"{batched.make.__module__}.{batched.make.__qualname__}:{batched.answers}"
    if name not in _clients:
        _clients[name] = batched.make()
    return _clients[name]


def replies(client: Callable[[list[str]], list[str | None]], texts: list[str], seconds: float) -> list[str | None]:
    """What a client says to some texts, Nones if it fails or takes too long."""
    got: list[str | None] = []

    def call() -> None:
        try:
            got.extend(client(texts))
        except Exception:  # noqa: BLE001 - a post whose topic isn't known has the default
            got.clear()

    thread = threading.Thread(target=call, daemon=True)
    thread.start()
    thread.join(seconds)
    return got if not thread.is_alive() and len(got) == len(texts) else [None] * len(texts)


def ask(posts: DataFrame, batched: Batched, text: str = "text_snippet") -> DataFrame:
    """All known replies, after each distinct text of ``posts`` that has none was asked about."""
    spark = posts.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(batched.answers)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        spark.createDataFrame([], ANSWERS).write.parquet(batched.answers)
    known = lambda: spark.read.schema(ANSWERS).parquet(batched.answers).dropDuplicates(["digest"])
    asked = F.substring(text, 1, CLASSIFIER_CHARS)
    texts = posts.filter(trimmed(F.coalesce(asked, F.lit(""))) != "").select(F.sha2(asked, 256).alias("digest"), asked.alias("text")).dropDuplicates(["digest"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), batched.size):
                part = rows.iloc[at : at + batched.size]
                got = replies(_client(batched), part["text"].tolist(), batched.seconds)
                yield pd.DataFrame({"digest": part["digest"].tolist(), "reply": got})

    new = texts.join(known().select("digest"), "digest", "left_anti").mapInPandas(run, ANSWERS)
    new.filter("reply is not null").write.mode("append").parquet(batched.answers)
    return known()


def classify_batch(posts: DataFrame, batched: Batched, text: str = "text_snippet") -> DataFrame:
    """Adds ``genre`` and ``reason`` by a service that is asked once about each text.

    Null and blank texts aren't asked about; they and those without a reply have the default.
    Existing columns of these names are replaced.
    """
    base = posts.drop("genre", "reason")
    said = ask(posts, batched, text).select(F.col("digest").alias("_digest"), F.col("reply").alias("_reply"))
    joined = base.join(said, F.sha2(F.substring(text, 1, CLASSIFIER_CHARS), 256) == F.col("_digest"), "left")
    return joined.withColumn("_c", finalize(F.col(text), F.col("_reply"))).select(*base.columns, F.col("_c.genre").alias("genre"), F.col("_c.reason").alias("reason"))


def classify(posts: DataFrame, classifier: Classifier | Batched = offline) -> DataFrame:
    """Adds ``genre``. A classifier may be a Pandas UDF; it sees the first 500 characters."""
    if isinstance(classifier, Batched):
        return classify_batch(posts, classifier).drop("reason")
    text = F.col("text_snippet")
    reply = classifier(F.substring(text, 1, CLASSIFIER_CHARS))
    return posts.withColumn("genre", finalize(text, reply)["genre"])
