"""The ordered keyword list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from upwell.functions.text import trimmed

KEYWORD_SCHEMA = "pos long, keyword string"


def parse_keywords(texts: DataFrame) -> DataFrame:
    """``pos, keyword`` from whole file texts (column ``value``): comments and blanks out,

    several words to a line by comma, first place of repeated words kept.
    """
    lines = texts.select(F.posexplode(F.split("value", r"\r\n|\n|\r")).alias("line_no", "line"))
    lines = lines.withColumn("line", trimmed(F.col("line"))).filter((F.col("line") != "") & ~F.startswith("line", F.lit("#")))
    words = lines.select("line_no", F.posexplode(F.split("line", "[,、]")).alias("word_no", "word")).withColumn("word", trimmed(F.col("word")))
    first = words.filter("word <> ''").groupBy(F.col("word").alias("keyword")).agg(F.min(F.struct("line_no", "word_no")).alias("at"))
    # a keyword list is short, so its places are numbered by counting lower ones in one array
    all_at = first.agg(F.array_sort(F.collect_list("at")).alias("all_at"))
    return first.select((F.array_position(all_at.scalar(), F.col("at")) - 1).cast("long").alias("pos"), "keyword")


def load_keywords(spark: SparkSession, path: str) -> list[str]:
    """The keywords of a file in order; none if the file is missing."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return []
    found = parse_keywords(spark.read.text(path, wholetext=True))
    return [r["keyword"] for r in found.orderBy("pos").collect()]


def keyword_array(keywords: list[str]) -> Column:
    return F.array(*map(F.lit, keywords)) if keywords else F.expr("cast(array() as array<string>)")
