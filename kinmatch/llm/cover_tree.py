"""Embedding near-dedup: all pairs within a cosine threshold, by dual traversal of cover trees.

Cosine >= t means a distance of unit vectors of at most sqrt(2 - 2t). Equal vectors are one class first, with a weight. The top of the
tree is a sample of centres, one for ``BLOCK`` rows, but no more than the root of the rows (so that what the driver holds grows with
the root at most); every class belongs to its nearest one, and cells of more than ``BLOCK`` rows are dealt out into blocks. Below, each block has its own cover tree: levels of halving radii, each node's members within its level's radius of the
node's centre, itself one of them.

A row meets a cell only if its distance to the cell's centre is at most the cell's covering radius plus the threshold. Two blocks that
meet are traversed together, level by level: a pair of nodes goes on only if their centres' distance is at most the threshold plus both
covering radii; if the distance plus both radii is within the threshold, all members are linked at once and only counted. What is left
at the bottom is decided by the cosine of the vectors in double precision. Tasks return each row's number of links and the links of a
spanning forest, so a group of copies never becomes pairs.

Growth. Pairs of nodes are taken in portions, so memory doesn't grow with them. Where vectors lie in clusters, a row meets few cells. Where
they have no structure at this threshold, no covering radius excludes a cell: every block meets every other, and work and dealt rows
grow with the square of the rows over ``BLOCK``. That is the price of an exact result there.

Results for odd input: vectors that are null, zero, of another length than most or hold null or non-finite components link with nothing;
rows that share a vec_id are vectors of their own, linked by the id (their n_links count vectors, not ids); a null vec_id keeps its row
apart, with a null component_id, and kept; an empty table gives no rows; extra columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.llm.common import cut, ragged
from kinmatch.llm.components import by_id, components
from kinmatch.llm.vectors import common_length, matrix, usable

#: Rows of a block, and pairs of nodes or rows that are looked at together.
BLOCK, PORTION = 4096, 1 << 19
#: Distances are bounded with this slack, so rounding never prunes or links a pair that the cosine decides otherwise.
SLACK = 1e-7


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


def net(u: np.ndarray, radius: float) -> np.ndarray:
    """For each row its centre (a row number): centres are further than radius apart, members within radius of theirs."""
    owner = np.full(len(u), -1)
    open_rows = np.arange(len(u))
    while len(open_rows):
        batch = open_rows[:128]
        far = distances(u[batch], u[open_rows])
        for i, row in enumerate(batch.tolist()):
            if owner[row] < 0:
                own = open_rows[(far[i] <= radius) & (owner[open_rows] < 0)]
                owner[own] = row
                owner[row] = row
        open_rows = open_rows[owner[open_rows] < 0]
    return owner


def grow(u: np.ndarray, threshold: float) -> np.ndarray:
    """Paths (rows x levels): each row's centre at every level below the root."""
    paths = []
    radius = float(distances(u[:1], u).max())
    groups = np.zeros(len(u), np.int64)
    while True:
        radius /= 2
        owner = np.empty(len(u), np.int64)
        order = np.argsort(groups, kind="stable")
        cuts = np.flatnonzero(np.diff(groups[order])) + 1
        for own in np.split(order, cuts):
            owner[own] = own[net(u[own], radius)] if len(own) > 1 else own
        paths.append(owner)
        groups = owner
        if radius <= threshold / 8:
            return np.stack(paths, 1)


class Tree:
    """Nodes of one block by level: centre, covering radius, members as a range of the rows in path order."""

    def __init__(self, u: np.ndarray, paths: np.ndarray):
        # a row that is its own centre leads its node, so centres keep their meaning after sorting
        keys = [paths[:, k] for k in range(paths.shape[1])]
        lead = [np.arange(len(u)) != paths[:, k] for k in range(paths.shape[1])]
        self.order = np.lexsort([x for pair in zip(lead[::-1], keys[::-1], strict=True) for x in pair])
        self.u, sorted_paths = u[self.order], paths[self.order]
        self.levels = []
        fresh = np.zeros(len(u), bool)
        fresh[:1] = True
        place = np.empty(len(u), np.int64)
        place[self.order] = np.arange(len(u))
        for k in range(paths.shape[1]):
            fresh[1:] |= sorted_paths[1:, k] != sorted_paths[:-1, k]
            first = np.flatnonzero(fresh)
            centre = place[sorted_paths[first, k]]
            size = np.diff(np.append(first, len(u)))
            far = np.sqrt(np.maximum(2.0 - 2.0 * np.einsum("ij,ij->i", self.u, np.repeat(self.u[centre], size, 0)), 0.0))
            far[centre] = 0.0
            self.levels.append((centre, np.maximum.reduceat(far, first), first, size))

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First child and number of children of nodes at the level above."""
        first, size = self.levels[level - 1][2][nodes], self.levels[level - 1][3][nodes]
        begin = np.searchsorted(self.levels[level][2], first)
        return begin, np.searchsorted(self.levels[level][2], first + size) - begin


def cross(begin_a: np.ndarray, n_a: np.ndarray, begin_b: np.ndarray, n_b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All members of a x members of b for each pair of ranges, in portions."""
    sizes, i = n_a * n_b, 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(np.cumsum(sizes[i:]), PORTION, "right")) + i)
        if j == i + 1 and sizes[i] > PORTION:  # one large pair: by rows
            step = max(1, PORTION // int(n_b[i]))
            for x in range(0, int(n_a[i]), step):
                rows = np.arange(begin_a[i] + x, begin_a[i] + min(x + step, int(n_a[i])))
                yield np.repeat(rows, n_b[i]), np.tile(np.arange(begin_b[i], begin_b[i] + n_b[i]), len(rows))
        else:
            first = ragged(np.zeros(j - i, np.int64), sizes[i:j])
            pair = np.repeat(np.arange(i, j), sizes[i:j])
            yield begin_a[pair] + first // n_b[pair], begin_b[pair] + first % n_b[pair]
        i = j


class Links:
    """Numbers of links, and a forest, over rows 0 .. n - 1."""

    def __init__(self, weight: np.ndarray):
        self.weight, self.count, self.root = weight, np.zeros(len(weight), np.int64), np.arange(len(weight))

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        """Hooks the larger root under the smaller one until all pairs agree."""
        while len(x):
            a, b = self.root[x], self.root[y]
            differ = a != b
            x, y, a, b = x[differ], y[differ], a[differ], b[differ]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def traverse(a: Tree, b: Tree, threshold: float, cosine: float, links: Links, row_a: np.ndarray, row_b: np.ndarray, both: bool) -> None:
    """Links between the rows of two trees. row_*: the trees' rows (in path order) in links; both: count for b's rows too."""
    bound, last = threshold + SLACK, len(a.levels) - 1

    def decide(level: int, x: np.ndarray, y: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Prunes node pairs, links those wholly within the threshold, and returns the rest."""
        reach = a.levels[level][1][x] + b.levels[level][1][y]
        inside = far + reach <= threshold - SLACK
        for i, j in zip(x[inside].tolist(), y[inside].tolist(), strict=True):
            p = row_a[a.levels[level][2][i] : a.levels[level][2][i] + a.levels[level][3][i]]
            q = row_b[b.levels[level][2][j] : b.levels[level][2][j] + b.levels[level][3][j]]
            same = not both and i == j
            links.count[p] += links.weight[q].sum() - (links.weight[p] if same else 0)
            if both:
                links.count[q] += links.weight[p].sum()
            links.join(np.concatenate([p, q]), np.full(len(p) + len(q), p[0]))
        rest = ~inside & (far <= bound + reach)
        return x[rest], y[rest]

    def bottom(x: np.ndarray, y: np.ndarray) -> None:
        for p, q in cross(a.levels[last][2][x], a.levels[last][3][x], b.levels[last][2][y], b.levels[last][3][y]):
            linked = np.einsum("ij,ij->i", a.u[p], b.u[q]) >= cosine
            p, q = row_a[p[linked]], row_b[q[linked]]
            differ = p != q
            p, q = p[differ], q[differ]
            links.count += np.bincount(p, links.weight[q], len(links.count)).astype(np.int64)
            if both:
                links.count += np.bincount(q, links.weight[p], len(links.count)).astype(np.int64)
            links.join(p, q)

    def descend(level: int, x: np.ndarray, y: np.ndarray) -> None:
        """Takes node pairs of a level down, a portion of their children after another."""
        if not len(x):
            return
        if level == last:
            bottom(x, y)
            return
        level += 1
        for p, q in cross(*a.children(level, x), *b.children(level, y)):
            far = np.sqrt(np.maximum(2.0 - 2.0 * np.einsum("ij,ij->i", a.u[a.levels[level][0][p]], b.u[b.levels[level][0][q]]), 0.0))
            descend(level, *decide(level, p, q, far))

    # all centres of the first level, a portion of rows at once
    ca, cb = a.u[a.levels[0][0]], b.u[b.levels[0][0]]
    step = max(1, PORTION // len(cb))
    for i in range(0, len(ca), step):
        far = distances(ca[i : i + step], cb)
        x, y = np.nonzero(far <= bound + a.levels[0][1][i : i + step, None] + b.levels[0][1][None, :])
        descend(0, *decide(0, x + i, y, far[x, y]))


def near_vectors(vectors: DataFrame, cosine: float = 0.9, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of vectors (vec_id, embedding). cosine is over 0."""
    spark, threshold = vectors.sparkSession, float(np.sqrt(2 - 2 * cosine))
    odd = vectors.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1 or vec_id is null").limit(1).count() > 0
    length = common_length(vectors)
    node = F.xxhash64(F.col("vec_id").isNull(), "vec_id", "embedding") if odd else F.col("vec_id").cast("long")
    sound = F.coalesce(usable() & (F.size("embedding") == length), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), node.alias("node"), F.when(sound, F.col("embedding").cast("array<double>")).alias("x"))
    rows = rows.withColumns({"h1": F.xxhash64("x"), "h2": F.xxhash64(F.lit(1), "x")})
    full = rows.where("x is not null")
    classes = cut(full.groupBy("h1", "h2").agg(F.min("node").alias("node"), F.count("*").alias("weight"), F.first("x").alias("x")))
    n = classes.count()
    if not n:
        return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    wanted = min(-(-n // block), math.isqrt(n - 1) + 1)
    chosen = classes.select("node", "x").orderBy(F.xxhash64("node")).limit(wanted).toArrow()
    top = matrix(chosen.column("x"), length)
    top = top / np.linalg.norm(top, axis=1, keepdims=True)

    def unit(batch: pa.RecordBatch) -> np.ndarray:
        x = matrix(batch.column("x"), length)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = distances(unit(batch), top)
                yield pa.record_batch({"node": batch.column("node"), "weight": batch.column("weight"), "x": batch.column("x"), "cell": pa.array(far.argmin(1).astype(np.int32)), "far": pa.array(far.min(1))})

    settled = cut(classes.select("node", "weight", "x").mapInArrow(settle, "node long, weight long, x array<double>, cell int, far double"))
    cells = settled.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).toArrow()  # a row per centre at most
    sizes, radius = np.zeros(len(top), np.int64), np.full(len(top), -np.inf)
    sizes[np.asarray(cells.column("cell"))] = np.asarray(cells.column("n"))
    radius[np.asarray(cells.column("cell"))] = np.asarray(cells.column("radius"))
    blocks = np.maximum(1, -(-sizes // block))
    spark_sizes = F.element_at(F.array(*[F.lit(int(b)) for b in blocks]), F.col("cell") + 1)
    blocked = settled.withColumn("block", F.pmod(F.xxhash64("node"), spark_sizes).cast("int")).drop("far")

    def plant(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        x = matrix(group.column("x"), length)
        paths = grow(x / np.linalg.norm(x, axis=1, keepdims=True), threshold)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, paths.size + 1, paths.shape[1]), pa.int32()), pa.array(paths.ravel().astype(np.int32)))
        return group.append_column("place", pa.array(np.arange(len(x)), pa.int32())).append_column("path", flat)

    planted = cut(blocked.groupBy("cell", "block").applyInArrow(plant, "node long, weight long, x array<double>, cell int, block int, place int, path array<int>"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row to the block pairs in which it may have links."""
        for batch in batches:
            if not batch.num_rows:
                continue
            near = (distances(unit(batch), top) <= (radius + threshold + SLACK)[None, :]) & (sizes > 0)[None, :]
            cell, own = (np.asarray(batch.column(c), np.int64) for c in ("cell", "block"))
            row, other = np.nonzero(near)
            row, other, number = np.repeat(row, blocks[other]), np.repeat(other, blocks[other]), ragged(np.zeros(len(other), np.int64), blocks[other])
            mine, theirs = (cell[row] << 32) + own[row], (other << 32) + number
            for i in range(0, len(row), 8192):
                part = batch.take(pa.array(row[i : i + 8192]))
                low, high = np.minimum(mine[i : i + 8192], theirs[i : i + 8192]), np.maximum(mine[i : i + 8192], theirs[i : i + 8192])
                yield pa.record_batch({"low": pa.array(low), "high": pa.array(high), "second": pa.array((mine[i : i + 8192] == high) & (low != high)), **{c: part.column(c) for c in ("node", "weight", "x", "place", "path")}})

    met = planted.mapInArrow(meet, "low long, high long, second boolean, node long, weight long, x array<double>, place int, path array<int>")

    def join(key: tuple, group: pa.Table) -> pa.Table:
        node, weight = (np.asarray(group.column(c), np.int64) for c in ("node", "weight"))
        second = np.asarray(group.column("second").combine_chunks())
        x = matrix(group.column("x"), length)
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        links = Links(weight)
        trees, own = [], []
        for side in (False, True):
            use = np.flatnonzero(second == side)
            if not len(use):
                continue
            use = use[np.argsort(np.asarray(group.column("place"), np.int64)[use])]
            place = np.asarray(group.column("place"), np.int64)[use]
            paths = np.asarray(group.column("path").combine_chunks().take(pa.array(use)).flatten(), np.int64).reshape(len(use), -1)
            # a centre that isn't here leaves its node to the first member that is
            local = np.searchsorted(place, paths)
            here = (local < len(place)) & (place[np.minimum(local, len(place) - 1)] == paths)
            for k in range(paths.shape[1]):
                _, first = np.unique(paths[:, k], return_index=True)
                heir = dict(zip(paths[first, k].tolist(), first.tolist(), strict=True))
                lost = np.flatnonzero(~here[:, k])
                local[lost, k] = [heir[c] for c in paths[lost, k].tolist()]
            trees.append(Tree(u[use], local))
            own.append(use)
        if len(trees) == 2:
            deep = min(len(t.levels) for t in trees)
            for t in trees:
                t.levels = t.levels[:deep]
            traverse(trees[0], trees[1], threshold, cosine, links, own[0][trees[0].order], own[1][trees[1].order], True)
        elif key[0].as_py() == key[1].as_py():
            traverse(trees[0], trees[0], threshold, cosine, links, own[0][trees[0].order], own[0][trees[0].order], False)
        some = np.flatnonzero((links.count > 0) | (links.root != np.arange(len(node))))
        return pa.table({"node": pa.array(node[some]), "links": pa.array(links.count[some]), "root": pa.array(node[links.root[some]])})

    found = cut(met.groupBy("low", "high").applyInArrow(join, "node long, links long, root long"))
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    reps = classes.select("h1", "h2", F.col("node").alias("rep"), "weight")
    reps = reps.join(counted.withColumnRenamed("node", "rep"), "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    reps = reps.select("h1", "h2", F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0).cast("long")) + F.col("weight") - 1).alias("n_links"))
    linked = full.drop("x").join(reps, ["h1", "h2"]).select("vec_id", "component", "n_links")
    alone = rows.where("x is null").select("vec_id", F.col("node").alias("component"), F.lit(0).cast("long").alias("n_links"))
    out = linked.unionByName(alone)
    named = by_id(out, "vec_id", "n_links") if odd else out.withColumnRenamed("component", "component_id")
    return named.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
