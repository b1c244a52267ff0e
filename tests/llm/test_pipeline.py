"""The pipeline against a plain version of each stage on the small tables."""

from __future__ import annotations

import hashlib
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_near_duplicates import brute
from tests.llm.test_text_operators import plain_secrets
from upwell.llm import decontam, langid, secret_scan
from upwell.llm.queries import oracle_sql, queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    out, docs = [], spark.read.parquet(f"{DATA}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / f"{k}")
        stage(spark, docs, DATA).write.parquet(path)
        out.append((name, docs, spark.read.parquet(path)))
        docs = spark.read.parquet(path)
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns(staged):
    for _, before, after in staged[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert staged[-1][2].columns[:5] == staged[-1][1].columns


def test_language_stage(spark, staged):
    _, before, after = staged[0]
    model = langid.fit(before, langid.load_pieces(public_tokenizers.path("piece_bpe_32k.model")))
    want = {r["doc_id"] for r in langid.identify(before, model).collect() if r["lang_pred"] != "und" and r["score"] >= 0.5}
    assert set(texts(after)) == want
    assert {r["doc_id"] for r in before.collect() if re.search(r"[^\W\d_]{20}", r["text"] or "")} <= want


def test_near_duplicate_stage(staged):
    _, before, after = staged[1]
    groups = brute(sorted(texts(before).items()), 5, 80)
    assert set(texts(after)) == {d for d, c in groups.items() if d == c} and len(texts(after)) < len(texts(before))


def test_decontamination_stage(spark, staged):
    _, before, after = staged[2]
    items = [decontam.Item(r["item_id"], decontam.normalise(r["text"])) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    held = {d for d, t in texts(before).items() if any(i.distance(decontam.normalise(t)) <= i.budget for i in items)}
    assert set(texts(after)) == set(texts(before)) - held and held


def test_secret_stage(spark, staged):
    _, before, after = staged[3]
    found = {r["doc_id"]: r["spans"] for r in secret_scan.report(secret_scan.scan(spark, before)).collect()}
    new = texts(after)
    changed = 0
    for d, t in texts(before).items():
        spans = [tuple(map(int, s.split(":")[1:])) for s in found[d].split(",") if s]
        assert {(a, b) for a, _, b, _ in plain_secrets(t)} <= set(spans)
        parts, pos = [], 0
        for a, b in sorted(spans):
            if a >= pos:
                parts += [t[pos:a], "<secret>"]
            pos = max(pos, b)
        assert new[d] == "".join(parts) + t[pos:]
        changed += bool(spans)
    assert 0 < changed < len(new)
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())


def test_encoding_stage(staged):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in staged[4][2].collect():
        ids = library.encode(r["text"], add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_run_and_registry(spark, staged):
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, DATA).collect()) == sorted(texts(staged[4][2]))
    names = queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(oracle_sql()) <= set(names)


def test_stages_take_empty_input(spark):
    empty = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).collect() == []
