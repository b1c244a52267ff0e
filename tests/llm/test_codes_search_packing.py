"""Vector codes, lexical search and packing, against plain versions of them."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from upwell.llm import lexical_search, packing, vector_codes
from upwell.llm._common import Scratch
from upwell.llm.queries import oracle_sql, queries

BPE = public_tokenizers.path("byte_bpe_50k.json")
DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_lexical_search"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries()[name](spark, DATA)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.select(*cols).collect()), key=repr) == sorted(want, key=repr) and want


def plain_codes(rows, parts, entries, rounds):
    """Lloyd on integers, all distances taken."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    v = np.array([r[1] for r in kept], np.int64).reshape(len(kept), parts, -1)
    books = v[:entries].transpose(1, 0, 2).copy()
    nearest = lambda: ((v[:, :, None, :] - books[None]) ** 2).sum(axis=3)
    for _ in range(rounds):
        code = nearest().argmin(axis=2)
        for p in range(parts):
            for e in range(books.shape[1]):
                if (code[:, p] == e).any():
                    books[p, e] = v[code[:, p] == e, p].sum(axis=0) // (code[:, p] == e).sum()
    d = nearest()
    return sorted((r[0] if r[0] is not None else -1, bytes(c), int(x)) for r, c, x in zip(kept, d.argmin(axis=2).astype(np.uint8), d.min(axis=2).sum(axis=1), strict=True)), books


SCHEMA = "vec_id long, embedding array<float>, label int, code string, upper string"


@pytest.mark.parametrize(("n", "entries", "rounds"), [(300, 16, 3), (40, 64, 2), (300, 256, 1), (500, 5, 6)])
def test_codes_equal_plain_lloyd(spark, n, entries, rounds):
    rng = np.random.default_rng(n + entries)
    rows = [(int(i), [float(x) for x in rng.choice([-0.5, -0.25, 0.0, 0.125, 1.0], 8)], int(i) % 3 or None) for i in rng.permutation(n)]  # many ties
    rows += [(i + n, [float(x) for x in rng.normal(size=8)], 1) for i in range(n)]
    rows += [(None, None, 1), (7, [float("nan")] * 8, 1), (8, [], 2), (9, [1.0, None] * 4, 2), (None, rows[0][1], 3), rows[0], rows[0], (5 * n, [float("inf")] * 8, 0)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(5)
    scratch = Scratch(spark)
    codes, book = vector_codes.compress(df, parts=4, entries=entries, rounds=rounds, scratch=scratch)
    got = vector_codes.with_label_error(scratch.save(codes, "codes"), scratch).collect()
    want, books = plain_codes([r[:3] for r in rows], 4, entries, rounds)
    assert sorted((r["vec_id"] if r["vec_id"] is not None else -1, bytes(r["code"]), r["error"]) for r in got) == want
    assert (book.values == books).all()
    by_label = defaultdict(int)
    for r in got:
        by_label[r["label"]] += r["error"]
    assert all(r["label_error"] == by_label[r["label"]] for r in got) and None in by_label
    if n >= 300 and rounds > 1:
        assert sum(r["distances"] for r in got) < 0.7 * len(got) * 4 * entries  # bounds spare work


def test_codes_of_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    codes, book = vector_codes.compress(empty, parts=4)
    assert codes.collect() == [] and codes.columns == ["vec_id", "label", "code", "error", "distances"] and book.values.size == 0
    for bad in ([[1.0] * 4, [1.0] * 8], [[1.0] * 6], [[1e30] * 4]):
        with pytest.raises(ValueError):
            vector_codes.compress(spark.createDataFrame([(i, v, 0, "", "") for i, v in enumerate(bad)], SCHEMA), parts=4)


def plain_search(docs, items, limit):
    words = lambda t: [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", t or "")]
    held = [(i, Counter(words(t)), len(words(t))) for i, t in docs if words(t)]
    n, total = len(held), sum(s for *_, s in held)
    df = Counter(w for _, c, _ in held for w in c)
    out = []
    for item, text in set(items):
        found = []
        for i, c, size in held:
            m = 50 + 50 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 20 * m)) for w in set(words(text)) if c[w])
            if score > 0:
                found.append((-score, i is None, i or 0))
        found.sort()
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(found[:limit])]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("block", "limit", "batch"), [(4, 3, 1 << 18), (64, 50, 40), (1, 7, 300)])
def test_search_equals_plain_scores(spark, monkeypatch, block, limit, batch):
    monkeypatch.setattr(lexical_search, "BLOCK", block)
    monkeypatch.setattr(lexical_search, "BATCH_TERMS", batch)
    rng = random.Random(block)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)] + ["Ärger", "日本", "ÉTÉ", "x" * 5000, "don't", "a_b", "42"]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    docs = [(i, text(int(rng.paretovariate(0.5)) % 300)) for i in range(300)]
    docs += [(400, None), (401, ""), (402, "?!. "), (403, "ärger ÄRGER Ärger"), docs[5], docs[5], (None, docs[6][1]), (None, "w1 w2 42"), (500, "w1 " * 60_000)]
    docs += [(600 + i, "same words here 42") for i in range(20)]  # ties
    items = [(i, text(rng.randrange(1, 30))) for i in range(30)] + [(30, None), (31, ""), (32, "zzz-unknown"), (33, "Same WORDS here"), (33, "w1"), (33, "w1"), (None, "日本 w3")]
    d = spark.createDataFrame([(*r, "a", "b") for r in docs], "doc_id long, text string, term string, score string").repartition(6)
    q = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank int")
    scratch = Scratch(spark)
    index = lexical_search.build_index(d, scratch)
    got = lexical_search.search(index, q, limit, scratch)
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert sorted(map(tuple, got.collect()), key=repr) == plain_search(docs, items, limit)


def test_blocks_are_passed_over(spark, monkeypatch):
    """Only blocks whose bound reaches the threshold are scored."""
    queries_ = lexical_search.Queries.of([(1, [b"a", b"b"]), (2, [b"b"])])
    queries_.weights = np.array([10, 3, 3])
    slots, held = queries_.place([b"b", b"z", b"a"])
    bounds, column = queries_.bounds(slots, held, np.array([5, 99, 7]))
    assert bounds.tolist() == [85, 15] and slots[column].tolist() == [2, 0, 0]


def test_search_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, item_id long")
    some = spark.createDataFrame([(1, "a b", 1)], none.schema)
    for docs, items in ((none, some), (some, none), (none, none)):
        scratch = Scratch(spark)
        assert lexical_search.search(lexical_search.build_index(docs, scratch), items, 5, scratch).collect() == []
    with pytest.raises(ValueError):
        lexical_search.build_index(spark.createDataFrame([("1", "a")], "doc_id string, text string"), Scratch(spark))


def check_pieces(rows, docs, window, library):
    """Every id lies in one piece and every sequence is gapless; returns the padding."""
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in docs}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["length"] == len(part) > 0 and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        if "ids" in r:
            assert r["ids"] == part
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, want in Counter(i for i, _ in docs).items():
        assert Counter(at for s, n in pieces[i] for at in range(s, s + n)) == dict.fromkeys(range(len(ids[i])), want)
    padding = 0
    for held in sequences.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_packing_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    rows = [r.asDict() for r in queries()["op13_lexical_packing"](spark, DATA).collect()]
    assert check_pieces(rows, docs, 1024, Tokenizer.from_file(BPE)) == 0
    sequences = Counter(r["sequence_id"] for r in rows)
    full = Counter()
    for r in rows:
        full[r["sequence_id"]] += r["length"]
    assert sum(n == 1024 for n in full.values()) > 0.8 * len(full) and max(sequences.values()) > 3


@pytest.mark.parametrize("window", [1, 24, 1000])
def test_packing_of_odd_rows(spark, window):
    texts = [None, "", "   ", "same text", "same text", "é ñ 日本 😀 \x1c  ", "x" * 3000, "word " * 4000, "a<|endoftext|>b", "tabs\t\tand\n\n lines \r\n", " lead and trail "]
    docs = list(enumerate(texts)) + [(3, "same text"), (3, "same text")]
    df = spark.createDataFrame([(*r, "x", "y") for r in docs], "doc_id int, text string, ids string, key string").repartition(3)
    out = packing.pack_documents(df, BPE, window, shard_tokens=4000)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    assert check_pieces([r.asDict() for r in out.collect()], docs, window, Tokenizer.from_file(BPE)) == 0
    nameless = spark.createDataFrame([(None, "a b"), (None, "a b"), (None, None)], "doc_id string, text string")
    assert sorted(r["length"] for r in packing.pack_documents(nameless, BPE, 64).collect()) in ([1, 3, 3], [1, 1, 2, 3], [1, 1, 1, 1, 3])
    assert packing.pack_documents(df.limit(0), BPE).collect() == []


def test_ids_equal_the_library():
    from tests.llm.test_text_operators import random_texts

    mine, library = packing.Ids(BPE), Tokenizer.from_file(BPE)
    assert mine.fast is not None
    rng = random.Random(4)
    blanks = ["".join(rng.choices([" ", "a", "B7", "'s", "\n", "\t", "é", "\xa0", "."], [5, 3, 1, 1, 2, 1, 1, 1, 1], k=rng.randrange(12))) for _ in range(5000)]
    for text in ["", *random_texts(3000), *blanks, " "]:
        assert mine.of(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_neighbours_by_plain_bm25():
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 50, rng.integers(1, 80)).astype(np.int32) for _ in range(60)]
    docs[7] = docs[3].copy()
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=50)
    corpus = packing.Corpus(df, 60, float(np.mean([len(d) for d in docs])))
    index, used = packing.Index(docs, corpus), np.zeros(60, bool)
    used[[3, 10, 11]] = True
    score = lambda d: sum(math.log(1 + (60 - df[t] + 0.5) / (df[t] + 0.5)) * (n := (docs[d] == t).sum()) * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(docs[d]) / corpus.mean)) for t in set(docs[3].tolist()))
    got = index.neighbours(3, used, limit=20, terms=80)
    want = sorted((d for d in range(60) if not used[d]), key=lambda d: -score(d))[:20]
    assert got == want and 7 in got[:3]


def test_windows_are_filled_by_neighbours():
    asked = []

    def neighbours(doc, used):
        asked.append(doc)
        return [d for d in {0: [4, 2, 1], 2: [3]}.get(doc, []) if not used[d]]

    got = list(packing.fill_windows([25, 7, 9, 30, 3], 20, neighbours))
    # document 0 fills a window; 4 and 2 fit whole, 1 is cut; its rest is the next seed
    assert got[:2] == [[(0, 0, 20)], [(0, 20, 5), (4, 0, 3), (2, 0, 9), (1, 0, 3)]] and asked[:2] == [0, 1]
    assert got[2] == [(1, 3, 4), (3, 0, 16)] and [sum(n for *_, n in w) for w in got[3:]] == [8, 4, 2]
