"""Near-duplicate vectors by PCA-ordered tiled comparison.

Vectors are dealt to cells of their leading principal coordinates, and neighbouring cells
are packed to tiles; two tiles whose boxes lie further apart than any link are not
compared, and their vectors do not meet. Within a pair of tiles, dot products accumulate
over the leading principal dimensions first; the rest of a product is at most the product
of the suffix norms, so a pair stops as soon as its cosine cannot reach the threshold.
What survives is confirmed in double precision on the input values. A task returns
numbers of links and a spanning forest of them, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upwell.llm._common import Scratch, components, require_integer, ship_package

#: A tile holds about so many vectors, and so many numbers, at most; rows are compared in slabs.
TILE, TILE_NUMBERS, SLAB = 4096, 1 << 21, 128
#: Axes are fitted on about so many vectors; they only set the order of work.
SAMPLE = 4096
#: Leading axes that tiles are cut along, and the least width of a cell (13**3 cells at most).
LEADING, LEAST_WIDTH = 3, 1 / 6
#: Leading dimensions after which a pair may stop.
STEPS = (8, 16, 32)
SLACK = 1e-9


def principal_axes(vectors: np.ndarray) -> np.ndarray:
    """Orthonormal axes as columns, by falling second moment."""
    return np.linalg.eigh(vectors.T @ vectors)[1][:, ::-1]


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows over their norms; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def suffix_norms(m: np.ndarray) -> np.ndarray:
    """Norms of the rows from each dimension on, and a last column of 0."""
    return np.pad(np.sqrt(np.maximum(0, np.cumsum((m * m)[:, ::-1], axis=1)[:, ::-1])), ((0, 0), (0, 1)))


def close_pairs(
    a: np.ndarray, b: np.ndarray, threshold: float, steps: tuple[int, ...] = STEPS, ra: np.ndarray | None = None, rb: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of two unit matrices in principal order whose product may reach the threshold."""
    d = a.shape[1]
    cuts = [0, *(s for s in steps if s < d), d]
    ra = suffix_norms(a) if ra is None else ra
    rb = suffix_norms(b) if rb is None else rb
    part = a[:, : cuts[1]] @ b[:, : cuts[1]].T
    i, j = np.nonzero(part + ra[:, [cuts[1]]] * rb[:, cuts[1]][None, :] >= threshold - SLACK)
    got = part[i, j]
    for lo, hi in zip(cuts[1:-1], cuts[2:], strict=True):
        got = got + np.einsum("ij,ij->i", a[i, lo:hi], b[j, lo:hi])
        live = got + ra[i, hi] * rb[j, hi] >= threshold - SLACK
        i, j, got = i[live], j[live], got[live]
    return i, j


class _Forest:
    """Which rows links have joined so far, and the links that joined two trees."""

    def __init__(self, n: int):
        self.parent, self.links = np.arange(n), []

    def _root(self, k: int) -> int:
        while self.parent[k] != k:
            k = self.parent[k]
        return k

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        apart = self.parent[a] != self.parent[b]
        for s, t in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
            p, q = self._root(s), self._root(t)
            if p != q:
                self.parent[max(p, q)] = min(p, q)
                self.links.append((s, t))
        while (self.parent[self.parent] != self.parent).any():
            self.parent = self.parent[self.parent]


def _compare(threshold: float) -> Callable[[pa.Table], pa.Table]:
    def run(pair: pa.Table) -> pa.Table:
        ids = pair.column("rep").to_numpy()
        order = np.argsort(ids, kind="stable")  # the same forest however rows arrive
        ids = ids[order]
        copies = pair.column("copies").to_numpy()[order]
        tile = pair.column("tile").to_numpy()[order]
        lists = pair.column("embedding").combine_chunks()
        x = _unit(lists.flatten().to_numpy().astype(np.float64).reshape(len(ids), -1)[order])
        y = x @ principal_axes(x[:: -(-len(x) // SAMPLE)])
        norms = suffix_norms(y)
        key = pair.column("pair")[0].as_py()
        left = np.flatnonzero(tile == key["i"])
        right = np.flatnonzero(tile == key["j"])
        links = np.zeros(len(ids), np.int64)
        forest = _Forest(len(ids))
        for at in range(0, len(left), SLAB):
            rows = left[at : at + SLAB]
            others = right[at:] if key["i"] == key["j"] else right
            i, j = close_pairs(y[rows], y[others], threshold, STEPS, norms[rows], norms[others])
            u, v = rows[i], others[j]
            if key["i"] == key["j"]:
                u, v = u[u < v], v[u < v]
            # rows are confirmed in parts, so that a dense tile needs little memory
            for k in range(0, len(u), 65536):
                a, b = u[k : k + 65536], v[k : k + 65536]
                sure = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
                a, b = a[sure], b[sure]
                links += np.bincount(a, copies[b], len(ids)).astype(np.int64) + np.bincount(b, copies[a], len(ids)).astype(np.int64)
                forest.add(a, b)
        some = np.flatnonzero(links)
        a = np.concatenate([ids[some], ids[[s for s, _ in forest.links]]]).astype(np.int64)
        b = np.concatenate([np.full(len(some), -1), ids[[t for _, t in forest.links]]]).astype(np.int64)
        n = np.concatenate([links[some], np.zeros(len(forest.links), np.int64)])
        return pa.table({"a": a, "b": pa.array(b, mask=np.arange(len(b)) < len(some)), "n": n})

    return run


def pack_cells(cells: np.ndarray, counts: np.ndarray, tile: int, width: float, reach: float) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """For cells of leading coordinates: first tile and number of tiles of each, and the cells' packs' partners.

    Cells in order are packed until a tile is full; a larger cell has tiles of its own.
    Partners are positions of packs, as rows of ``(first tile, tiles)``, whose boxes are
    within ``reach``, the own one included.
    """
    pack, filled = np.zeros(len(cells), np.int64), 0
    for k in range(len(cells)):
        filled += counts[k]
        pack[k] = pack[k - 1] if k else 0
        if k and filled > tile:
            pack[k] += 1
            filled = counts[k]
    n = pack[-1] + 1
    low, high = np.full((n, cells.shape[1]), np.inf), np.full((n, cells.shape[1]), -np.inf)
    np.minimum.at(low, pack, cells * width)
    np.maximum.at(high, pack, (cells + 1) * width)
    ways = -(-np.bincount(pack, counts).astype(np.int64) // tile)
    first = np.cumsum(ways) - ways
    near = []
    for p in range(n):
        gap = np.maximum(0, np.maximum(low - high[p], low[p] - high))
        near.append(np.flatnonzero((gap * gap).sum(axis=1) <= reach * reach))
    return first[pack], ways[pack], [np.stack([first[q], ways[q]], axis=1) for q in (near[p] for p in pack)]


def _deal(tile: int, width: float, reach: float) -> Callable[[pa.Table], pa.Table]:
    """From the cells of a group to their tiles and the tiles that these are compared with."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([(f"c{k}", "ascending") for k in range(LEADING)])
        cells = np.stack([group.column(f"c{k}").to_numpy() for k in range(LEADING)], axis=1)
        room = max(1, min(tile, TILE_NUMBERS // max(1, group.column("dim")[0].as_py())))
        first, ways, partners = pack_cells(cells, group.column("n").to_numpy(), room, width, reach)
        lists = pa.array([[{"first": int(f), "ways": int(w)} for f, w in rows] for rows in partners], pa.list_(pa.struct([("first", pa.int64()), ("ways", pa.int64())])))
        return group.drop_columns("n").append_column("first", pa.array(first)).append_column("ways", pa.array(ways)).append_column("partners", lists)

    return run


def near_vectors(embeddings: DataFrame, threshold: float = 0.93, tile: int = TILE, scratch: Scratch | None = None) -> DataFrame:
    """Per row of ``embeddings(vec_id, embedding, label)``: ``vec_id, n_links, component_id, kept``.

    Vectors are compared when their labels are equal and not null, and so are their
    lengths. Those with a cosine of ``threshold`` or more are linked: ``n_links`` counts the
    other rows linked directly, ``component_id`` is the smallest vec_id reachable, and
    ``kept`` is vec_id = component_id. Vectors that are null, empty or zero, or hold null or
    non-finite components, link with nothing. Rows of a null vec_id are not compared: no
    links, component_id null, kept true. Rows that repeat a vec_id count as vectors of their
    own in ``n_links`` and share a component. ``vec_id`` must be an integer column; other
    columns are ignored.
    """
    spark = require_integer(embeddings, "vec_id").sparkSession
    ship_package(spark)
    scratch = scratch or Scratch(spark)
    mark = scratch.mark()
    x_type = "double" if embeddings.schema["embedding"].dataType.elementType.typeName() == "double" else "float"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{x_type}>").alias("embedding"), "label")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    nonzero = F.exists("embedding", lambda x: x != 0)
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & nonzero, F.lit(False))
    # equal vectors form a class that is compared once; a digest stands for it elsewhere
    digest = F.sha2(F.concat_ws("|", F.col("label").cast("string"), F.transform("embedding", lambda x: x + F.lit(0).cast(x_type)).cast("string")), 256)
    keyed = scratch.save(rows.withColumn("class", F.when(usable, digest)), "keyed")
    classes = keyed.filter("class is not null").groupBy("class").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = scratch.save(classes, "classes")
    reps = keyed.join(classes.withColumnRenamed("rep", "vec_id"), ["class", "vec_id"]).dropDuplicates(["class"])
    reps = scratch.save(reps.select(F.col("vec_id").alias("rep"), "copies", "label", F.size("embedding").alias("dim"), "embedding"), "reps")

    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    width = max(reach / 2, LEAST_WIDTH)
    cell = [f"c{k}" for k in range(LEADING)]
    placed = scratch.save(_coordinates(reps, scratch, width), "placed")
    counts = placed.groupBy("label", "dim", *cell).agg(F.count("*").alias("n"))
    schema = f"label {reps.schema['label'].dataType.simpleString()}, dim int, {', '.join(f'{c} long' for c in cell)}, first long, ways long, partners array<struct<first:long,ways:long>>"
    tiles = scratch.save(counts.groupBy("label", "dim").applyInArrow(_deal(tile, width, reach), schema), "tiles")
    tiled = placed.join(tiles, ["label", "dim", *cell]).withColumn("tile", F.col("first") + F.pmod(F.xxhash64("rep"), F.col("ways")))
    others = F.flatten(F.transform("partners", lambda p: F.sequence(p["first"], p["first"] + p["ways"] - 1)))
    pairs = F.transform(others, lambda o: F.struct(F.least(o, "tile").alias("i"), F.greatest(o, "tile").alias("j")))
    dealt = tiled.select("rep", "copies", "label", "dim", "embedding", "tile", F.explode(pairs).alias("pair"))
    found = dealt.groupBy("label", "dim", "pair").applyInArrow(_compare(threshold), "a long, b long, n long")
    found = scratch.save(found, "found")
    scratch.drop(reps, placed, tiles)

    links = found.filter("b is null").groupBy("a").agg(F.sum("n").alias("links"))
    # one vec_id may stand in several classes; they share its component
    shared = keyed.filter("class is not null").groupBy("vec_id").agg(F.min("class").alias("x"), F.max("class").alias("y")).filter("x <> y").select("vec_id")
    tied = keyed.join(shared, "vec_id").join(classes, "class").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    joined = components(found.filter("b is not null").select("a", "b").unionByName(tied), scratch)
    by_class = classes.join(links.withColumnRenamed("a", "rep"), "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    by_class = by_class.select("class", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    by_class = scratch.save(by_class, "by_class")
    ids = scratch.save(keyed.select("vec_id", "class"), "ids")  # what is read later holds no vectors
    scratch.clear(mark, keep=(ids, by_class))
    out = ids.join(by_class, "class", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id")).alias("component_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    )


def _coordinates(reps: DataFrame, scratch: Scratch, width: float) -> DataFrame:
    """Adds the cell of each vector: its coordinates along the leading axes over ``width``, rounded down.

    The axes of each length of vectors are fitted on a sample of about ``SAMPLE`` of them.
    """
    total = scratch.save(reps.groupBy("dim").agg(F.count("*").alias("total")), "total")
    unit = 1 << 30
    share = F.least(F.lit(unit), F.floor(F.lit(unit * SAMPLE) / F.col("total"))).cast("long")
    sample = reps.join(total, "dim").filter(F.pmod(F.xxhash64("rep"), F.lit(unit)) < share).select("dim", "embedding")

    def fit(group: pa.Table) -> pa.Table:
        dim = group.column("dim")[0].as_py()
        lists = group.column("embedding").combine_chunks()
        axes = principal_axes(_unit(lists.flatten().to_numpy().astype(np.float64).reshape(len(group), -1)))
        rows = [axes[:, min(k, dim - 1)] for k in range(LEADING)]
        return pa.table({"dim": pa.array([dim], pa.int32())} | {f"axis{k}": pa.array([row], pa.list_(pa.float64())) for k, row in enumerate(rows)})

    axes = sample.groupBy("dim").applyInArrow(fit, "dim int, " + ", ".join(f"axis{k} array<double>" for k in range(LEADING)))
    axes = scratch.save(axes, "axes")
    # dividing by the largest component first keeps squares finite
    most = F.array_max(F.transform("embedding", lambda u: F.abs(u.cast("double"))))
    shrunk = F.zip_with("embedding", F.array_repeat(F.col("_most"), F.size("embedding")), lambda v, m: v.cast("double") / m)
    norm = F.sqrt(F.aggregate("_x", F.lit(0.0), lambda acc, v: acc + v * v))
    dot = lambda k: F.aggregate(F.zip_with("_x", f"axis{k}", lambda u, w: u * w), F.lit(0.0), lambda acc, u: acc + u)
    # a length without a sampled vector has one cell
    at = lambda k: F.coalesce(F.floor(dot(k) / F.col("_norm") / width), F.lit(0)).cast("long").alias(f"c{k}")
    joined = reps.join(axes, "dim", "left").withColumn("_most", most).withColumn("_x", shrunk).withColumn("_norm", norm)
    return joined.select(*reps.columns, *(at(k) for k in range(LEADING)))
