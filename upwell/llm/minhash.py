"""Near-duplicate documents by one-permutation MinHash, confirmed on full shingle sets.

1. One pass hashes each document's distinct shingles, takes one minimum per bin of a
   single permutation, fills empty bins by optimal densification, and keys the bands.
2. Documents with equal sets form a class; one representative goes on.
3. Each bucket of two or more representatives gets a centre, the member that shares
   most buckets with others, and star-shaped candidate edges to it: as many edges as
   members, never all pairs. Edges are confirmed on the full sets.
4. A star can miss a link between two members of which one is not linked with the
   centre. So members that ended outside their centre's component ("loose") are
   compared with the others of that star in blocks of bounded size, where documents that
   share no rare shingle are passed over; a task emits only links that join two components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upwell.llm._common import Scratch, components, drop_ids, give_back, keep_ids, require_integer, ship_package, worker_cache

BANDS, ROWS = 40, 5
#: A block of a star, or of the loose comparison, holds about so many documents and shingles at most.
BLOCK_DOCS, BLOCK_SHINGLES = 4096, 400_000
#: A star of no more members has its centre's set sent to each of them.
SMALL_STAR = 64

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_M = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(32)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _M[2])) * _M[1]
    x = (x ^ (x >> _M[2])) * _M[1]
    return x ^ (x >> _M[2])


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text.

    Words are runs without ASCII white space, A-Z lower-cased. Fewer words than
    ``width`` make one shingle; no words make none.
    """
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(h))
    n = len(h) - width + 1
    acc = np.full(n, width, np.uint64)
    for k in range(width):
        acc = _mix(acc * _M[0] + h[k : k + n])
    return np.unique(acc)


class OnePermutation:
    """Band keys of a sorted hash set."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 7):
        self.bands, self.rows = bands, rows
        self.bins = bands * rows
        rng = np.random.default_rng(seed)
        #: For each bin the order in which it asks the bins for a value when it is empty.
        self.turn = np.argsort(rng.random((self.bins, self.bins)), axis=1).argsort(axis=1).astype(np.int32)
        self.edges = np.array([(i << 64) // self.bins for i in range(self.bins)], dtype=np.uint64)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        # bins are ranges of the hash, so the first value at or after an edge is the bin's minimum
        first = np.searchsorted(hashes, self.edges)
        after = np.append(first[1:], len(hashes))
        filled = np.flatnonzero(first < after)
        sig = np.empty(self.bins, np.uint64)
        sig[filled] = hashes[first[filled]]
        empty = np.flatnonzero(first >= after)
        if len(empty):
            donor = filled[self.turn[np.ix_(empty, filled)].argmin(axis=1)]
            sig[empty] = sig[donor]
        return sig

    def band_keys(self, hashes: np.ndarray) -> np.ndarray:
        sig = self.signature(hashes).reshape(self.bands, self.rows)
        acc = np.arange(1, self.bands + 1, dtype=np.uint64)
        for k in range(self.rows):
            acc = _mix(acc * _M[0] + sig[:, k])
        return acc.view(np.int64)


_FEATURES = "doc_id long, n_shingles long, set_key binary, bands array<long>"


def _features(width: int, bands: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        perm = worker_cache("minhash", f"{bands}-{rows}", lambda: OnePermutation(bands, rows))
        for batch in batches:
            sizes, digests, keys = [], [], []
            for text in batch.column("text"):
                h = shingle_hashes(text.as_py(), width)
                sizes.append(len(h))
                digests.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                keys.append(perm.band_keys(h) if len(h) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "set_key", "bands"],
            )
        give_back()

    return run


def _sets(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(t.as_py(), width).view(np.int64) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "shingles"])
        give_back()

    return run


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after another."""
    size = high - low
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - (ends - size), size)


def block_links(comp: np.ndarray, loose: np.ndarray, flat: np.ndarray, sizes: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of components that a link joins, for links with a loose document; a forest of them.

    Sets that reach ``percent`` share a shingle among the rarest of each, as many as they
    may lack and one more, so only documents that meet there are compared in full.
    """
    labels, at = np.unique(comp, return_inverse=True)
    if len(labels) < 2:
        return []
    values, code = np.unique(flat, return_inverse=True)
    rank = np.empty(len(values), np.int64)
    rank[np.argsort(np.bincount(code), kind="stable")] = np.arange(len(values))  # rare ones first
    doc = np.repeat(np.arange(len(sizes)), sizes)
    code = rank[code][np.lexsort((rank[code], doc))]
    starts = np.cumsum(sizes) - sizes
    lead = sizes + percent * sizes // -100 + 1
    leading = np.flatnonzero(np.arange(len(code)) - starts[doc] < lead[doc])
    order = leading[np.argsort(code[leading], kind="stable")]
    holders, first = doc[order], np.searchsorted(code[order], np.arange(len(values) + 1))
    root, seen = np.arange(len(labels)), np.zeros(len(values), np.int32)
    out: list[tuple[int, int]] = []
    for u in np.flatnonzero(loose):
        own = code[starts[u] : starts[u] + sizes[u]]
        met = np.unique(holders[_ranges(first[own[: lead[u]]], first[own[: lead[u]] + 1])])
        fits = 100 * np.minimum(sizes[met], sizes[u]) >= percent * np.maximum(sizes[met], sizes[u])
        met = met[fits & (root[at[met]] != root[at[u]])]
        if not len(met):
            continue
        seen[own] = 1
        both = np.add.reduceat(seen[code[_ranges(starts[met], starts[met] + sizes[met])]], np.cumsum(sizes[met]) - sizes[met])
        seen[own] = 0
        for v in met[100 * both >= percent * (sizes[u] + sizes[met] - both)]:
            a, b = sorted((root[at[u]], root[at[v]]))
            if a != b:
                root[root == b] = a
                out.append((int(comp[u]), int(comp[v])))
    return out


def _compare_block(percent: int) -> Callable[[pa.Table], pa.Table]:
    """Links between components among the documents of one pair of blocks."""

    def run(block: pa.Table) -> pa.Table:
        lists = block.column("shingles").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        out = block_links(block.column("component").to_numpy(), block.column("loose").to_numpy(zero_copy_only=False), lists.flatten().to_numpy(), sizes, percent)
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def _star_block(percent: int) -> Callable[[pa.Table], pa.Table]:
    """Links between a centre and some members of its star."""

    def run(block: pa.Table) -> pa.Table:
        head = block.column("head").to_numpy(zero_copy_only=False)
        docs = block.column("doc").to_numpy()
        lists = block.column("shingles").combine_chunks()
        begin = lists.offsets.to_numpy()
        values, sizes = lists.values.to_numpy(), np.diff(begin).astype(np.int64)
        linked = np.zeros(len(docs), bool)
        for centre in np.flatnonzero(head):  # several, if texts repeat its doc_id
            own = np.sort(values[begin[centre] : begin[centre + 1]])
            at = np.minimum(np.searchsorted(own, values), len(own) - 1)
            hits = np.concatenate([[0], np.cumsum(own[at] == values)])
            common = hits[begin[1:]] - hits[begin[:-1]]
            linked |= (100 * common >= percent * (sizes + sizes[centre] - common)) & ~head
        return pa.table({"a": pa.array(np.full(linked.sum(), docs[head][0]), pa.int64()), "b": pa.array(docs[linked], pa.int64())})

    return run


def _star_links(edges: DataFrame, sets: DataFrame, sizes: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The edges of stars that are links on full sets.

    A small star's sets meet edge by edge. A larger one is cut into blocks of members, and its
    centre's set is sent once to each of them.
    """
    of = edges.join(sizes.withColumnRenamed("doc_id", "doc"), "doc").groupBy("centre").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_DOCS), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int")
    large = scratch.save(of.filter(F.col("n") > SMALL_STAR).select("centre", blocks.alias("blocks")), "large_stars")
    left = edges.join(large.select("centre"), "centre", "left_anti").join(sets.toDF("doc", "mine"), "doc")
    both = left.join(sets.toDF("centre", "theirs"), "centre")
    common = F.size(F.array_intersect("mine", "theirs"))
    links = both.filter(100 * common >= percent * (F.size("mine") + F.size("theirs") - common)).select(F.col("centre").alias("a"), F.col("doc").alias("b"))
    placed = edges.join(large, "centre").select("centre", "doc", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int").alias("blk"))
    members = placed.join(sets.toDF("doc", "shingles"), "doc").select("centre", "blk", "doc", "shingles", F.lit(False).alias("head"))
    heads = large.select("centre", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("blk")).join(sets.toDF("centre", "shingles"), "centre")
    heads = heads.select("centre", "blk", F.col("centre").alias("doc"), "shingles", F.lit(True).alias("head"))
    return links.unionByName(members.unionByName(heads).groupBy("centre", "blk").applyInArrow(_star_block(percent), "a long, b long"))


def _loose_links(edges: DataFrame, comp: DataFrame, sets: DataFrame, sizes: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links (as pairs of components) that the stars could not see."""
    with_self = edges.select("centre", F.col("doc").alias("doc_id")).unionByName(edges.select("centre", F.col("centre").alias("doc_id")).distinct())
    of = comp.withColumnRenamed("node", "doc_id")
    placed = (
        with_self.join(of, "doc_id", "left")
        .withColumn("component", F.coalesce("component", "doc_id"))
        .join(sizes, "doc_id")
    )
    n = edges.count()
    first = placed = scratch.save(placed, "placed", n)
    homes = placed.filter("centre = doc_id").select("centre", F.col("component").alias("home"), F.col("n_shingles").alias("own"))
    placed = scratch.save(placed.join(homes, "centre").withColumn("loose", F.col("component") != F.col("home")), "placed", n)
    scratch.drop(first)
    blocks = lambda n, s: F.greatest(F.ceil(n / BLOCK_DOCS), F.ceil(s / BLOCK_SHINGLES))
    stars = placed.groupBy("centre").agg(
        blocks(F.count_if("loose"), F.sum(F.when(F.col("loose"), F.col("n_shingles")).otherwise(0))).cast("int").alias("n_loose"),
        blocks(F.count_if(~F.col("loose")), F.sum(F.when(F.col("loose"), 0).otherwise(F.col("n_shingles")))).cast("int").alias("n_home"),
        F.count("*").alias("n"),
    )
    stars = scratch.save(stars.filter("n_loose > 0 and n > 2").drop("n"), "stars", n)
    # a loose document meets every block; one at home only the blocks of loose ones
    spread = placed.join(stars, "centre").withColumn(
        "blk", F.pmod(F.xxhash64("doc_id"), F.when(F.col("loose"), F.col("n_loose")).otherwise(F.col("n_home"))).cast("int")
    )
    pairs = F.expr(
        """if(loose,
             concat(transform(sequence(0, n_loose - 1), x -> named_struct('i', least(x, blk), 'home', false, 'j', greatest(x, blk))),
                    if(n_home > 0, transform(sequence(0, greatest(n_home - 1, 0)), x -> named_struct('i', blk, 'home', true, 'j', x)),
                       array())),
             transform(sequence(0, n_loose - 1), x -> named_struct('i', x, 'home', true, 'j', blk)))"""
    )
    dealt = spread.select("doc_id", "component", "loose", "centre", F.explode(pairs).alias("at"))
    full = dealt.join(sets, "doc_id").select("centre", "at", "doc_id", "component", "loose", "shingles")
    return full.groupBy("centre", "at").applyInArrow(_compare_block(percent), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 2, percent: int = 80, bands: int = BANDS, rows: int = ROWS, scratch: Scratch | None = None) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: ``doc_id, n_shingles, component_id, kept``.

    Two documents are linked when 100 * |A & B| >= percent * |A | B| over their sets of
    ``width``-word shingles, each known by 64 bits of a hash: two of a pair of documents with
    s shingles are taken for one with odds of about s * s / 2**64. ``component_id`` is the smallest doc_id reachable by links,
    ``kept`` is doc_id = component_id. Null, empty and blank texts have an empty set, link
    with nothing and are kept. Rows of a null doc_id link with nothing: component_id null,
    kept true. Rows that repeat a doc_id count as one document, linked by any of its
    texts. ``doc_id`` must be an integer column; other columns are ignored.
    """
    spark = require_integer(docs, "doc_id").sparkSession
    ship_package(spark)
    scratch = scratch or Scratch(spark)
    mark = scratch.mark()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    feats = scratch.save(texts.mapInArrow(_features(width, bands, rows), _FEATURES), "features")
    n = feats.count()
    real = feats.filter("doc_id is not null and set_key is not null")
    classes = scratch.save(real.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "classes", n)
    reps = real.join(classes.select(F.col("rep").alias("doc_id"), "set_key"), ["doc_id", "set_key"], "left_semi").dropDuplicates(["doc_id", "set_key"])
    reps = scratch.save(reps.select("doc_id", "n_shingles", "bands"), "reps", n)

    rows_of = reps.select("doc_id", F.explode("bands").alias("bucket"))
    shared = scratch.save(rows_of.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "shared", n)
    members = scratch.save(rows_of.join(shared, "bucket"), "members", n)
    degree = scratch.save(members.groupBy("doc_id").agg(F.sum("n").alias("degree")), "degree", n)
    ranked = scratch.save(members.select("bucket", "doc_id").join(degree, "doc_id"), "ranked", n)
    centres = ranked.groupBy("bucket").agg((-F.max(F.struct("degree", (-F.col("doc_id")).alias("neg")))["neg"]).alias("centre"))
    centres = scratch.save(centres, "centres", n)
    scratch.drop(shared, members, degree)
    edges = ranked.join(centres, "bucket").filter("doc_id <> centre").select("centre", F.col("doc_id").alias("doc")).distinct()
    edges = scratch.save(edges, "stars", n)
    scratch.drop(ranked, centres)

    wanted = scratch.save(edges.select("doc").union(edges.select("centre").distinct()).distinct(), "wanted", n)
    sets = scratch.save(keep_ids(texts, "doc_id", wanted).mapInArrow(_sets(width), "doc_id long, shingles array<long>"), "sets")
    sizes = reps.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"))
    links = _star_links(edges, sets, sizes, percent, scratch)
    # texts that repeat a doc_id tie their classes together
    same = real.groupBy("doc_id").agg(F.min("set_key").alias("x"), F.max("set_key").alias("y")).filter("x <> y")
    same = real.join(same.select("doc_id"), "doc_id").join(classes, "set_key").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    first = scratch.save(components(links.unionByName(same), scratch), "components")

    more = scratch.save(_loose_links(edges, first, sets, sizes, percent, scratch), "more_links")
    second = components(more, scratch)
    final = (
        first.join(second.select(F.col("node").alias("component"), F.col("component").alias("lower")), "component", "left")
        .select("node", F.coalesce("lower", "component").alias("component"))
        .unionByName(second.join(first.select("node"), "node", "left_anti"))
    )
    final = scratch.save(final.dropDuplicates(["node"]), "final", n)
    of_class = scratch.save(classes.join(final, classes["rep"] == final["node"], "left").select("set_key", F.coalesce("component", "rep").alias("component_id")), "of_class", n)
    scratch.clear(mark, keep=(feats, of_class))
    got = feats.select("doc_id", "n_shingles", "set_key").join(of_class, "set_key", "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id"))
    return got.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def kept_documents(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows of documents whose component has a smaller doc_id.

    Rows that repeat a kept doc_id all stay; columns are those of ``docs``.
    """
    scratch = Scratch(docs.sparkSession)
    gone = near_duplicates(docs, width, percent, scratch=scratch).filter("not kept").select("doc_id")
    gone = scratch.save(gone.distinct(), "gone")
    scratch.clear(keep=(gone,))
    return drop_ids(docs, "doc_id", gone)
