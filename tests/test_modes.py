from __future__ import annotations

from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from upwell.config import PushConfig
from upwell.functions.text import quote_query
from upwell.plans import modes
from upwell.sources.raw import SourceUnavailable
from upwell.streaming.stream import first_sightings


def test_trial(spark):
    row = modes.trial_outbox(spark).first()
    assert row["text"].startswith("🔥🔥🔥 激アツ投稿 [📈持続/テスト]\ntest_account の投稿が0.5時間でいいね12,345・引用100(15%)・ブックマーク300(25%)")
    assert row["priority"] == "2" and row["retry"] == "60"
    assert {r["channel"]: r["ok"] for r in modes.trial(spark).collect()} == {"first": True, "second": False}


def test_settings_fall_back_to_defaults():
    config = PushConfig.from_env({"PUSH_SOUND": "bell", "PUSH_PRIORITY": ""})
    assert (config.value("sound"), config.value("priority"), config.value("school_priority")) == ("bell", "2", "0")


def test_missing_input(spark, tmp_path):
    assert modes.require_input(spark, str(tmp_path)) == str(tmp_path)
    with pytest.raises(SourceUnavailable) as failed:
        modes.require_input(spark, str(tmp_path / "none"), expired=True)
    assert failed.value.expired


def test_quoted_query(spark):
    assert spark.range(1).select(quote_query(F.lit("lang:ja min:5 あ"))).first()[0] == "lang%3Aja%20min%3A5%20%E3%81%82"
    every = "".join(map(chr, range(32, 127))) + "é\n"
    assert spark.range(1).select(quote_query(F.lit(every))).first()[0] == quote(every)


def test_trial_summary(spark):
    row = modes.trial_summary(spark, {"first": True, "second": False}).first()
    assert "✅ first\n❌ second の投稿が-時間で" in row["text"] and row["link"] is None


def test_first_sightings_stream(spark, tmp_path):
    df = spark.sql("select cast(id % 3 as string) post_id, timestamp'2024-01-01 00:00:00' posted_at, id v from range(9)")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = first_sightings(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    out.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["post_id"] for r in spark.table("seen").collect()) == ["0", "1", "2"]
