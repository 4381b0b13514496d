"""Exact threshold pairs of embeddings by dual traversal of cover trees.

The distance of unit vectors is sqrt(2 - 2 cosine), so cosine >= t is distance <= sqrt(2 - 2 t). The tree has three tiers:
  cells: each vector joins the nearest of at most MAX_PIVOTS pivots;
  blocks: a cell is cut into blocks of about BLOCK vectors, so that a hot cell is many tasks. Every block is one packed
    row with its centre and covering radius;
  nodes: inside a block, nested nets whose radii halve from level to level, each node with its true covering radius.
Pairs of cells, then of blocks, then of nodes go where the distance of the centres exceeds the threshold distance plus
both radii; node pairs within it minus both radii are linked whole. What is left is compared in double precision.
A block pair gives, for each of its vectors, the number of links and the smallest vector it reaches inside the pair, not
the links themselves: so a group of n near copies gives n rows, not its square.

Where vectors lie far apart in many dimensions, as random ones do, no exact metric tree can prune much, and the work is
that of comparing blocks, evenly spread over tasks.

Defined results for odd input: vectors that are null, empty, zero or hold null or non-finite components link with nothing and
are their own component; vectors of different lengths don't link; equal vectors are one with a count; rows that share
a vec_id keep a row each, and count as vectors each; a null vec_id is 'no vector'; an empty table gives no rows; other
columns aren't read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlpit.llm.common import Scratch
from marlpit.llm.components import connected_components

BLOCK, MAX_PIVOTS, LEVELS = 4096, 256, 7
#: Slack of all bounds, far above the rounding error of a distance and far below any radius in use.
SLACK = 1e-7
TILE = 1024


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    return v / np.sqrt((v * v).sum(1))[:, None]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def net(points: np.ndarray, radius: float) -> np.ndarray:
    """For each point the net member that covers it: greedily, a point farther than radius from all members becomes one."""
    cover = np.full(len(points), -1)
    members = np.zeros(0, dtype=np.int64)
    for at in range(0, len(points), 512):
        part = np.arange(at, min(at + 512, len(points)))
        if len(members):
            d = distances(points[part], points[members])
            near = d.argmin(1)
            held = d[np.arange(len(part)), near] <= radius
            cover[part[held]] = members[near[held]]
            part = part[~held]
        if len(part):
            d = distances(points[part], points[part])
            new = []
            for i in range(len(part)):
                if cover[part[i]] < 0:
                    new.append(part[i])
                    free = (d[i] <= radius) & (cover[part] < 0)
                    cover[part[free]] = part[i]
            members = np.concatenate([members, np.array(new, dtype=np.int64)])
    return cover


class CoverTree:
    """Points in an order in which every node's are a run. Level l has nodes (centre, start, end, radius); radii of nets halve."""

    def __init__(self, points: np.ndarray, packed: bytes | None = None) -> None:
        if packed:
            self.order, self.levels, self.children = pickle.loads(packed)
        else:
            self._build(points)
        self.points = points[self.order]
        self.centres = [points[c] for c, *_ in self.levels]

    def pack(self) -> bytes:
        return pickle.dumps((self.order, self.levels, self.children))

    def _build(self, points: np.ndarray) -> None:
        order = np.arange(len(points))
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        groups = [(0, 0, len(points))] if len(points) else []
        self.children: list[np.ndarray] = []
        for level in range(LEVELS):
            radius = 1.0 / 2**level
            next_groups, parents = [], []
            for g, (_, lo, hi) in enumerate(groups):
                own = order[lo:hi]
                if hi - lo == 1:
                    next_groups.append((own[0], lo, hi))
                    parents.append(g)
                    continue
                cover = net(points[own], radius)
                by = np.argsort(cover, kind="stable")
                order[lo:hi] = own[by]
                heads, starts = np.unique(cover[by], return_index=True)
                for head, s, e in zip(own[heads], lo + starts, lo + np.append(starts[1:], hi - lo)):
                    next_groups.append((head, int(s), int(e)))
                    parents.append(g)
            groups = next_groups
            centre, lo, hi = (np.array([x[i] for x in groups], dtype=np.int64) for i in range(3))
            self.levels.append((centre, lo, hi, np.zeros(len(groups))))
            self.children.append(np.array(parents, dtype=np.int64))
        self.order = order
        for centre, lo, hi, rad in self.levels:
            node = np.repeat(np.arange(len(lo)), hi - lo)
            d = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", points[order], points[centre[node]]), 0))
            d[order == centre[node]] = 0
            np.maximum.at(rad, node, d)


def _expand(pairs: np.ndarray, a: CoverTree, b: CoverTree, level: int) -> np.ndarray:
    """Pairs of children of pairs of nodes."""
    def spans(tree: CoverTree) -> tuple[np.ndarray, np.ndarray]:
        p = tree.children[level]
        n = len(tree.levels[level - 1][0])
        return np.searchsorted(p, np.arange(n)), np.bincount(p, minlength=n)

    (sa, na), (sb, nb) = spans(a), spans(b)
    i, j = pairs.T
    size = na[i] * nb[j]
    k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    i, j = np.repeat(i, size), np.repeat(j, size)
    return np.column_stack([sa[i] + k // nb[j], sb[j] + k % nb[j]])


def _within(a: CoverTree, b: CoverTree, level: int, reach: float, pairs: np.ndarray) -> np.ndarray:
    """The pairs of nodes whose points can be as near as reach."""
    keep = []
    for at in range(0, len(pairs), 100_000):
        i, j = pairs[at : at + 100_000].T
        d = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", a.centres[level][i], b.centres[level][j]), 0))
        keep.append(d <= reach + a.levels[level][3][i] + b.levels[level][3][j] + SLACK)
    return pairs[np.concatenate(keep)] if keep else pairs


def _dense_pairs(a: CoverTree, b: CoverTree, level: int, reach: float) -> np.ndarray:
    """The same from all pairs of a level's nodes, a tile at a time: single precision and the tile's largest radii leave few to bound well."""
    x, y = a.centres[level].astype(np.float32), b.centres[level].astype(np.float32)
    found = [np.zeros((0, 2), dtype=np.int64)]
    for at in range(0, len(x), TILE):
        limit = min(2.0, reach + a.levels[level][3][at : at + TILE].max() + b.levels[level][3].max() + 1e-3)
        i, j = np.nonzero(x[at : at + TILE] @ y.T >= 1 - limit * limit / 2)
        found.append(_within(a, b, level, reach, np.column_stack([i + at, j])))
    return np.concatenate(found)


def dual_links(a: CoverTree, b: CoverTree, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Arrays of linked (place in a, place in b), places being in tree order."""
    reach = np.sqrt(2 - 2 * cosine)
    same = a is b
    size = [len(x[0]) * len(y[0]) for x, y in zip(a.levels, b.levels)]
    # Levels that leave most of the next one's pairs to compare are passed over.
    level = 0
    while level < LEVELS - 1 and size[level] > 0.25 * size[level + 1]:
        level += 1
    pairs = _dense_pairs(a, b, level, reach)
    while True:
        if same:
            pairs = pairs[pairs[:, 0] <= pairs[:, 1]]
        if level == LEVELS - 1:
            break
        level += 1
        (na, nb) = (np.bincount(t.children[level], minlength=len(t.levels[level - 1][0])) for t in (a, b))
        if (na[pairs[:, 0]] * nb[pairs[:, 1]]).sum() > size[level] / 64:
            pairs = _dense_pairs(a, b, level, reach)
        else:
            pairs = _within(a, b, level, reach, _expand(pairs, a, b, level))
    # The last level's nodes: all pairs of their points, tile by tile.
    (_, lo_a, hi_a, _), (_, lo_b, hi_b, _) = a.levels[-1], b.levels[-1]
    single = ((hi_a - lo_a)[pairs[:, 0]] == 1) & ((hi_b - lo_b)[pairs[:, 1]] == 1)
    for at in range(0, int(single.sum()), 200_000):
        i, j = pairs[single][at : at + 200_000].T
        x, y = lo_a[i], lo_b[j]
        held = np.einsum("ij,ij->i", a.points[x], b.points[y]) >= cosine
        if same:
            held &= x < y
        yield x[held], y[held]
    for i, j in pairs[~single]:
        for at in range(lo_a[i], hi_a[i], TILE):
            x, y = np.nonzero(a.points[at : min(at + TILE, hi_a[i])] @ b.points[lo_b[j] : hi_b[j]].T >= cosine)
            x, y = x + at, y + lo_b[j]
            if same:
                x, y = x[x < y], y[x < y]
            yield x, y


def summarize(a: CoverTree, b: CoverTree, ids: tuple[np.ndarray, np.ndarray], counts: tuple[np.ndarray, np.ndarray], cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, links, low) of the vectors that link in this pair of blocks: links counts copies, low is the smallest id reached."""
    same = a is b
    n_a, n = len(a.points), len(a.points) + (0 if same else len(b.points))
    weight = counts[0][a.order] if same else np.concatenate([counts[0][a.order], counts[1][b.order]])
    name = ids[0][a.order] if same else np.concatenate([ids[0][a.order], ids[1][b.order]])
    links, low = np.zeros(n, dtype=np.int64), name.copy()
    kept = []
    for x, y in dual_links(a, b, cosine):
        if len(x):
            y = y if same else y + n_a
            np.add.at(links, x, weight[y])
            np.add.at(links, y, weight[x])
            kept.append((x.astype(np.int32), y.astype(np.int32)))
    while kept:
        before = low.copy()
        for x, y in kept:
            np.minimum.at(low, x, low[y])
            np.minimum.at(low, y, low[x])
        if (before == low).all():
            break
    at = np.flatnonzero(links)
    return name[at], links[at], low[at]


def _valid(embeddings: DataFrame) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    return embeddings.where(F.col("vec_id").isNotNull() & F.coalesce(finite & some, F.lit(False)))


def _pivots(distinct: DataFrame, n: int) -> np.ndarray:
    """A net of a sample of at most 16 * MAX_PIVOTS vectors of lowest hash, its radius halved until it has n members, or all."""
    sample = distinct.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(16 * MAX_PIVOTS, 16 * n))
    rows = [np.array(r.embedding) for r in sample.collect()]
    points = unit(np.array([r for r in rows if len(r) == len(rows[0])])) if rows else np.zeros((0, 1))
    heads = np.zeros(0, dtype=np.int64)
    for level in range(LEVELS):
        heads = np.unique(net(points, 2.0 / 2**level))
        if len(heads) >= n:
            break
    return points[heads[:n]]


def near_pairs(embeddings: DataFrame, cosine: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of embeddings (vec_id long, embedding array)."""
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "cover")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    # Copies: one row for each distinct vector.
    distinct = scratch.save(_valid(rows).groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n")), "distinct")
    total = distinct.count()
    pivots = _pivots(distinct, max(1, min(MAX_PIVOTS, total // BLOCK)))

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["dim"] = pdf["embedding"].map(len).astype("int32")
            pdf["cell"] = np.int32(0)
            usual = pdf["dim"].to_numpy() == pivots.shape[1]
            if usual.any() and len(pivots):
                pdf.loc[usual, "cell"] = (unit(np.stack(pdf.loc[usual, "embedding"])) @ pivots.T).argmax(1).astype("int32")
            yield pdf

    placed = scratch.save(distinct.mapInPandas(cells, "embedding array<double>, vec_id long, n long, dim int, cell int"), "cells")
    cut = placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        raw = np.stack(pdf["embedding"])
        points = unit(raw)
        centre = points.mean(0)
        size = np.sqrt((centre * centre).sum())
        centre = centre / size if size > 1e-9 else points[0]
        radius = float(distances(points, centre[None]).max())
        return pd.DataFrame(
            {"dim": [key[0]], "cell": [key[1]], "block": [key[2]], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "counts": [pdf["n"].to_numpy(np.int64).tobytes()],
             "vectors": [raw.tobytes()], "tree": [CoverTree(points).pack()], "centre": [centre.tolist()], "radius": [radius]}
        )

    schema = "dim int, cell int, block int, ids binary, counts binary, vectors binary, tree binary, centre array<double>, radius double"
    blocks = placed.join(cut, ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    blocks = scratch.save(blocks.groupBy("dim", "cell", "block").applyInPandas(pack, schema), "blocks")
    scratch.drop(placed)
    reach = float(np.sqrt(2 - 2 * cosine))

    def far(a: str, b: str):
        dot = F.aggregate(F.zip_with(f"{a}.centre", f"{b}.centre", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        return F.sqrt(F.greatest(2 - 2 * dot, F.lit(0.0))) > F.col(f"{a}.radius") + F.col(f"{b}.radius") + reach + SLACK

    # Cell pairs: at most MAX_PIVOTS squared for each dimension, on centres and radii that cover the cells' blocks.
    heads = blocks.select("dim", "cell", "block", "centre", "radius")
    wide = heads.groupBy("dim", "cell").agg(F.min_by("centre", "block").alias("centre"))
    reach_of = heads.alias("h").join(wide.alias("w"), ["dim", "cell"]).select("dim", "cell", F.col("w.centre").alias("centre"), (F.col("h.radius") + F.sqrt(F.greatest(2 - 2 * F.aggregate(F.zip_with("h.centre", "w.centre", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))).alias("radius"))
    wide = reach_of.groupBy("dim", "cell").agg(F.first("centre").alias("centre"), F.max("radius").alias("radius"))
    cell_pairs = wide.alias("a").join(wide.alias("b"), (F.col("a.dim") == F.col("b.dim")) & (F.col("a.cell") <= F.col("b.cell"))).where(~far("a", "b"))
    cell_pairs = cell_pairs.select(F.col("a.dim").alias("dim"), F.col("a.cell").alias("cell_a"), F.col("b.cell").alias("cell_b"))
    x = heads.select("dim", F.col("cell").alias("cell_a"), F.struct("block", "centre", "radius").alias("a"))
    y = heads.select("dim", F.col("cell").alias("cell_b"), F.struct("block", "centre", "radius").alias("b"))
    pairs = cell_pairs.join(x, ["dim", "cell_a"]).join(y, ["dim", "cell_b"]).where("cell_a < cell_b or a.block <= b.block").where(~far("a", "b"))
    pairs = scratch.save(pairs.select("dim", "cell_a", F.col("a.block").alias("block_a"), "cell_b", F.col("b.block").alias("block_b")), "pairs")
    n_pairs = pairs.count()

    def side(s: str) -> DataFrame:
        return blocks.select("dim", F.col("cell").alias(f"cell_{s}"), F.col("block").alias(f"block_{s}"), F.struct("ids", "counts", "vectors", "tree").alias(s))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[tuple, tuple] = {}

        def tree(key: tuple, side: dict, dim: int) -> tuple:
            if key not in trees:
                if len(trees) >= 4:
                    trees.pop(next(iter(trees)))
                vectors = np.frombuffer(side["vectors"], np.float64).reshape(-1, dim)
                trees[key] = CoverTree(unit(vectors), side["tree"]), np.frombuffer(side["ids"], np.int64), np.frombuffer(side["counts"], np.int64)
            return trees[key]

        for batch in batches:
            for k in range(batch.num_rows):
                dim, ca, ba, cb, bb = (batch.column(i)[k].as_py() for i in range(5))
                a, ids_a, n_a = tree((dim, ca, ba), batch.column(5)[k].as_py(), dim)
                b, ids_b, n_b = tree((dim, cb, bb), batch.column(6)[k].as_py(), dim)
                found = summarize(a, b, (ids_a, ids_b), (n_a, n_b), cosine)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["id", "links", "low"])

    # Two or three packed pairs for each task, whatever the table's size: a task holds few blocks at a time.
    both = pairs.repartition(max(1, min(n_pairs // 2, 20_000)), "cell_a", "block_a", "cell_b", "block_b").join(side("a"), ["dim", "cell_a", "block_a"]).join(side("b"), ["dim", "cell_b", "block_b"])
    both = both.select("dim", "cell_a", "block_a", "cell_b", "block_b", "a", "b")
    found = scratch.save(both.mapInArrow(compare, "id long, links long, low long"), "found")
    components = connected_components(found.where("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b")), scratch)
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    own = distinct.join(counts, distinct["vec_id"] == counts["id"], "left").drop("id").join(components, distinct["vec_id"] == components["id"], "left")
    own = own.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    named = _valid(rows).join(own, "embedding").select("vec_id", "n_links", "component_id")
    rest = rows.where(~F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False)) | F.col("vec_id").isNull())
    out = named.union(rest.select("vec_id", F.lit(0).cast("long"), F.col("vec_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
