"""Pair operators against brute force, and the shared plumbing."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from upwell.llm import embed_dedup, minhash
from upwell.llm._common import Scratch, _marked, components, drop_ids, keep_ids, require_integer


class Sets:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def root(self, n):
        while self.up[n] != n:
            n = self.up[n]
        return n

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text: str | None, width: int) -> frozenset:
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if len(words) < width:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute(rows, width, percent):
    sets = [(d, shingles(t, width)) for d, t in rows if d is not None]
    groups = Sets(d for d, _ in sets)
    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                groups.join(a, b)
    return {d: groups.root(d) for d, _ in sets}


def near_copies(seed: int, n_groups: int, size: int, words: int):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, d = [], 0
    for _ in range(n_groups):
        origin = [rng.choice(vocab) for _ in range(words)]
        for _ in range(size):
            copy = list(origin)
            for _ in range(rng.randrange(0, max(1, words // 6))):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((d, " ".join(copy)))
            d += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("width", "words"), [(2, 60), (5, 120), (2, 9)])
def test_near_duplicates_equal_brute_force(spark, width, words):
    rows = near_copies(width, 8, 25, words)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width).collect()}
    want = brute(rows, width, 80)
    assert {d: r["component_id"] for d, r in got.items()} == want
    assert all(r["n_shingles"] == len(shingles(dict(rows)[d], width)) and r["kept"] == (d == want[d]) for d, r in got.items())
    assert len(set(want.values())) < len(want)


def test_loose_members_of_large_stars(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 16)
    monkeypatch.setattr(minhash, "SMALL_STAR", 3)
    rows = near_copies(11, 2, 120, 40)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == brute(rows, 2, 80)


@pytest.mark.parametrize("spread", [6, 12, 30])
def test_links_within_a_block(spread):
    rng = np.random.default_rng(spread)
    base = rng.integers(0, 1 << 62, 60)
    sets = []
    for _ in range(300):
        part = base.copy()
        part[rng.integers(0, 60, rng.integers(0, spread))] = rng.integers(0, 1 << 62)
        sets.append(np.unique(np.concatenate([part[: rng.integers(40, 61)], rng.integers(0, 1 << 62, rng.integers(0, spread))])))
    comp, loose = rng.integers(0, 80, 300), rng.random(300) < 0.6
    groups = Sets(range(80))
    for u in range(300):
        for v in range(300):
            n = len(np.intersect1d(sets[u], sets[v]))
            if u != v and loose[u] and comp[u] != comp[v] and 100 * n >= 80 * (len(sets[u]) + len(sets[v]) - n):
                groups.join(int(comp[u]), int(comp[v]))
    got = minhash.block_links(comp, loose, np.concatenate(sets), np.array([len(x) for x in sets]), 80)
    mine = Sets(range(80))
    for a, b in got:
        assert mine.root(a) != mine.root(b)  # a forest
        mine.join(a, b)
    assert [mine.root(c) for c in range(80)] == [groups.root(c) for c in range(80)]


def test_near_duplicate_edges(spark):
    long = " ".join(f"t{i}" for i in range(60_000))
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "One\ttwo"), (8, "É two"), (9, "é two"),
        (10, long), (11, long + " tail"), (10, long), (None, "one two"), (12, "a b"), (12, "c d"), (13, "c d"), (14, "A B"),
    ]
    docs = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "doc_id long, text string, kept string, component_id string, bucket int")
    out = minhash.near_duplicates(docs, 2).collect()
    assert len(out) == len(rows)
    comp = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in out}
    assert comp[1, 0] == 1 and comp[2, 0] == 2 and comp[3, 0] == 3
    assert comp[5, 1] == 4 and comp[7, 1] == 6 and comp[9, 1] == 9 and comp[11, 60_000] == 10
    assert comp[13, 1] == 12 and comp[14, 1] == 12  # the texts of document 12 tie both
    lone = [r for r in out if r["doc_id"] is None]
    assert lone[0]["component_id"] is None and lone[0]["kept"]
    kept = minhash.kept_documents(docs.filter("doc_id is null or doc_id <> 12 or text = 'a b'"), 2)
    assert kept.columns == docs.columns
    # the repeated rows of 10 both stay, 13 has lost its partner
    ids = sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect())
    assert ids == [-1, 1, 2, 3, 4, 6, 8, 9, 10, 10, 12, 13]
    none = docs.limit(0)
    assert minhash.near_duplicates(none, 2).collect() == [] == minhash.kept_documents(none).collect()


def test_densified_signatures_estimate_similarity():
    perm = minhash.OnePermutation()
    rng = np.random.default_rng(0)
    for n in (5, 50, 2000):
        hits = []
        for _ in range(60):
            pool = rng.integers(0, 2**64, int(n * 1.25), dtype=np.uint64)
            a, b = np.unique(pool[:n]), np.unique(pool[int(n * 0.25) :])
            j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            hits.append((perm.signature(a) == perm.signature(b)).mean() - j)
        assert abs(np.mean(hits)) < 0.08


def vectors(seed: int = 0):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for label in (0, 1, None):
        for _ in range(12):
            centre = rng.normal(size=24)
            for _ in range(rng.integers(1, 14)):
                rows.append((k, [float(x) for x in (centre + rng.normal(size=24) * rng.choice([0.05, 0.25, 0.35])) * rng.choice([1, 50])], label))
                k += 1
    return rows


@pytest.mark.parametrize("tile", [16, 512])
def test_vectors_equal_brute_force(spark, tile):
    rows = vectors()
    rows += [(1000 + i, rows[0][1], 0) for i in range(5)]  # copies
    rows += [(2000, None, 0), (2001, [], 0), (2002, [0.0] * 24, 0), (2003, [float("nan")] * 24, 0), (2004, [None] * 24, 0), (2005, [float("inf")] + [1.0] * 23, 0), (2006, [1.0, 2.0], 0), (2007, [1.0, 2.0], 0), (None, rows[0][1], 0), (2008, [1e-30] * 24, 1), (2009, [1e30] * 24, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    ok = lambda v: v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    usable = [(i, np.array(v, np.float32).astype(float), y) for i, v, y in rows if i is not None and y is not None and ok(v)]
    groups, links = Sets(r[0] for r in rows if r[0] is not None), dict.fromkeys((r[0] for r in rows if r[0] is not None), 0)
    for n, (a, x, y) in enumerate(usable):
        for b, z, w in usable[:n]:
            if y == w and len(x) == len(z) and (x / np.abs(x).max()) @ (z / np.abs(z).max()) / np.linalg.norm(x / np.abs(x).max()) / np.linalg.norm(z / np.abs(z).max()) >= 0.93:
                groups.join(a, b)
                links[a] += 1
                links[b] += 1
    got = embed_dedup.near_vectors(df.withColumn("rep", df["label"]).withColumn("class", df["label"]), 0.93, tile).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["vec_id"] is None:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, None, True)
        else:
            assert (r["n_links"], r["component_id"], r["kept"]) == (links[r["vec_id"]], groups.root(r["vec_id"]), groups.root(r["vec_id"]) == r["vec_id"])
    assert sum(links.values()) > 100
    assert embed_dedup.near_vectors(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        embed_dedup.near_vectors(df.withColumn("vec_id", df["vec_id"].cast("string")))


def test_many_lengths_of_vectors(spark):
    rng = np.random.default_rng(8)
    rows = [(20 * d + k, [float(v) for v in np.abs(rng.normal(size=d)) + 0.1 * k], "x") for d in range(1, 25) for k in range(8)]
    got = {r["vec_id"]: r["n_links"] for r in embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"), 0.9).collect()}
    for i, v, _ in rows:
        want = sum(j != i and len(v) == len(w) and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.9 for j, w, _ in rows)
        assert got[i] == want


def test_tiles_that_are_not_compared_hold_no_link():
    rng = np.random.default_rng(3)
    x = embed_dedup._unit(rng.normal(size=(600, 8)) * np.array([3, 2, 1, 0.5, 0.3, 0.2, 0.1, 0.1]))
    reach, width = float(np.sqrt(2 - 2 * 0.95)), 1 / 6
    cells, own, counts = np.unique(np.floor((x @ embed_dedup.principal_axes(x))[:, :3] / width).astype(int), axis=0, return_inverse=True, return_counts=True)
    first, ways, partners = embed_dedup.pack_cells(cells, counts, 40, width, reach)
    tiles = first + ways - 1
    assert len(set(first.tolist())) > 5 and all(counts[first == f].sum() <= 40 * w for f, w in zip(first, ways, strict=True))
    compared = 0
    for a in range(600):
        near = {int(f) for f, _ in partners[own[a]]}
        assert int(first[own[a]]) in near
        compared += sum(int(first[own[b]]) in near for b in range(600))
        assert all(int(first[own[b]]) in near for b in np.flatnonzero(x @ x[a] >= 0.95))
    assert compared < 600 * 600 * 0.8 and tiles.max() < 600


def test_suffix_bounds_lose_no_pair():
    rng = np.random.default_rng(5)
    x = embed_dedup._unit(rng.normal(size=(300, 40)) * np.linspace(3, 0.1, 40))
    i, j = embed_dedup.close_pairs(x, x, 0.8)
    exact = {(a, b) for a, b in zip(*np.nonzero(x @ x.T >= 0.8), strict=True)}
    assert exact <= set(zip(i.tolist(), j.tolist(), strict=True))


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + k) for k in range(1, 80)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    groups = Sets({n for e in edges for n in e})
    for a, b in edges:
        groups.join(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    linked = {n for e in edges if e[0] != e[1] for n in e}
    assert got == {n: groups.root(n) for n in linked}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).collect() == []


def test_id_filters(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(500)] + [(None, "null"), (7, "again")], "k long, v string")
    ids = spark.createDataFrame([(i,) for i in range(0, 500, 7)] + [(None,)], "x long")
    keep, gone = keep_ids(df, "k", ids), drop_ids(df, "k", ids)
    assert sorted(r["k"] for r in keep.collect()) == sorted([*range(0, 500, 7), 7])
    assert gone.count() == df.count() - keep.count() and gone.filter("k is null").count() == 1
    marked, maybe = _marked(df, "k", ids)
    assert marked.filter(maybe).count() < 120
    assert keep.columns == gone.columns == df.columns
    odd = df.selectExpr("k", "k as id", "v as _slot", "v as _word", "v as _held", "v as _maybe", "v as `a.b`")
    for f in (keep_ids, drop_ids):
        out = f(odd, "k", ids)
        assert out.columns == odd.columns and all(r["_slot"] == r["_held"] == r["_maybe"] == r["a.b"] for r in out.collect())
    with pytest.raises(ValueError):
        require_integer(df, "v")


def test_scratch_tables_are_freed(spark):
    scratch = Scratch(spark)
    first = scratch.save(spark.range(3), "a")
    mark = scratch.mark()
    second, third = scratch.save(spark.range(4), "b"), scratch.save(spark.range(5), "c")
    scratch.clear(mark, keep=(third,))
    assert first.count() == 3 and third.count() == 5 and len(scratch._tables) == 2
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(second.scratch_path)
