"""Approximate nearest neighbours by multi-index hashing.

Codes. The largest inner product becomes the smallest angle by one more component, sqrt(M^2 - |x|^2) with M the largest norm. On a
bounded sample, rotations are learned that make signs keep angles (iterative quantization: alternate between the signs of the rotated
vectors and the rotation nearest to them); enough of them, from different starts, give the bits.

Index. A code is cut into substrings of 16 bits; a block of codes is filed under each of them, in buckets of equal substrings. A search
with radius r gives substring j a reach t_j with sum(t_j + 1) = r + 1. By pigeonhole a code within r of the query's is within t_j of it
in some substring, so the buckets within reach hold every such code. Only what these buckets hold is compared on whole codes, and
only what is within r is ranked, by the inner product of the floats in double precision.

Learned layout. For each number of substrings in ``layouts`` the sample tells the radius that covers ``cover`` of its true
neighbours, the share of codes that probing fetches and the share within the radius; the cheapest number is taken (``Layout`` tells
these figures). Vectors with structure get long codes whose buckets are selective; for those without, no code is.

Search. Index rows are dealt into blocks, queries into others; every query meets every block, and a pair's k best go on. Queries that
find fewer than k go again with a radius half-way to all bits, so min(k, all) neighbours are always found. Memory is bounded by
the block sizes.

Results for odd input: vectors that are null, zero, of another length than most or hold null or non-finite components take no part;
null ids are left out; rows with one id are candidates each, but never for a query of that id; query rows that repeat in id and vector
are one query, and with one id but other vectors they are queries of their own, told apart by ``query_hash``; an empty table
gives no rows; extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kinmatch.llm.common import cut, ragged
from kinmatch.llm.vectors import common_length, matrix, usable

SUBSTRING = 16
RESULT = "query_id long, query_hash long, vec_id long, score double"


@dataclass(frozen=True)
class Settings:
    """layouts: numbers of substrings to choose from; index and query blocks bound what a task holds."""

    layouts: tuple[int, ...] = (2, 3, 4, 6, 8, 12, 16)
    sample: int = 8192
    calibration_queries: int = 256
    cover: float = 0.97
    rounds: int = 20
    query_block: int = 32_768
    index_block: int = 32_768


@dataclass(frozen=True)
class Layout:
    """Substrings, radius, and on the sample the shares of codes that are probed and that are within the radius."""

    substrings: int
    radius: int
    probed: float
    within: float


def augmented(x: np.ndarray, most: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(most**2 - (x**2).sum(1), 0))[:, None]], 1)


def learn_rotations(x: np.ndarray, bits: int, rounds: int, seed: int = 1) -> np.ndarray:
    """Columns to project on: ``bits`` of them, in groups of rotations learned by iterative quantization."""
    rng, d, out = np.random.default_rng(seed), x.shape[1], []
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    for _ in range(-(-bits // d)):
        r = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(rounds if len(unit) else 0):
            u, _, v = np.linalg.svd(unit.T @ np.where(unit @ r >= 0, 1.0, -1.0))
            r = u @ v
        out.append(r)
    return np.concatenate(out, 1)[:, :bits]


def encode(x: np.ndarray, rotations: np.ndarray) -> np.ndarray:
    """Codes as rows of 16-bit substrings."""
    return np.packbits(x @ rotations >= 0, axis=1, bitorder="little").view("<u2")


def reaches(radius: int, substrings: int) -> list[int]:
    """How far each substring is probed: one more than these add up to one more than the radius; -1: not at all."""
    each, more = divmod(radius + 1, substrings)
    return [each + (j < more) - 1 for j in range(substrings)]


class Index:
    """A block's codes filed under each substring."""

    def __init__(self, codes: np.ndarray):
        n, m = codes.shape
        self.wide = wide(codes)
        self.tables = []
        for j in range(m):
            order = np.argsort(codes[:, j], kind="stable")
            values, first = np.unique(codes[order, j], return_index=True)
            self.tables.append((values, np.append(first, n), order))

    def probe(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows of all buckets within reach of a code's substrings."""
        seen = np.zeros(len(self.wide), bool)
        for (values, first, order), own, reach in zip(self.tables, code, reaches(radius, len(code)), strict=True):
            near = np.flatnonzero(np.bitwise_count(values ^ own) <= reach) if reach >= 0 else np.zeros(0, np.int64)
            seen[order[ragged(first[near], first[near + 1] - first[near])]] = True
        return np.flatnonzero(seen)

    def search(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows within the radius; whole codes are compared only where a bucket was probed."""
        rows = self.probe(code, radius)
        return rows[np.bitwise_count(self.wide[rows] ^ wide(code[None, :])).sum(1) <= radius]


def wide(codes: np.ndarray) -> np.ndarray:
    """Codes in words of 64 bits."""
    return np.ascontiguousarray(np.pad(codes, ((0, 0), (0, -codes.shape[1] % 4)))).view(np.uint64)


def learn_layout(x: np.ndarray, most: float, rotations: np.ndarray, k: int, s: Settings) -> Layout:
    """The layout that costs least where the radius covers the true neighbours of some of the sample within the sample."""
    if len(x) < 2:
        return Layout(min(s.layouts), min(s.layouts) * SUBSTRING, 1.0, 1.0)
    q = x[: s.calibration_queries]
    score = q @ x.T
    score[np.arange(len(q)), np.arange(len(q))] = -np.inf
    near = np.argsort(-score, axis=1)[:, : min(k, len(x) - 1)]
    asked, held = encode(augmented(q, 0.0), rotations), encode(augmented(x, most), rotations)
    best = None
    for m in sorted(s.layouts):
        parts = [np.bitwise_count(asked[:, j, None] ^ held[None, :, j]) for j in range(m)]
        far = np.sum(parts, axis=0, dtype=np.uint16)
        radius = int(np.quantile(np.take_along_axis(far, near, 1), s.cover, method="higher"))
        probed = float(np.mean(np.any([p.astype(np.int16) <= t for p, t in zip(parts, reaches(radius, m), strict=True)], axis=0)))
        within = float(np.mean(far <= radius))
        # a look at each bucket, a whole code where probed, a vector of floats where within
        cost = m + probed * (4 + m / 4) + within * x.shape[1] / 2
        if best is None or cost < best[0]:
            best = cost, Layout(m, radius, probed, within)
    return best[1]


def search_block(q_ids: np.ndarray, q: np.ndarray, q_codes: np.ndarray, ids: np.ndarray, x: np.ndarray, index: Index, radius: int, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query number, ids, scores) of the k best within the radius in a block."""
    for i in range(len(q_ids)):
        found = index.search(q_codes[i], radius)
        found = found[ids[found] != q_ids[i]]
        score = x[found] @ q[i]
        best = np.lexsort((ids[found], -score))[:k]
        yield i, ids[found][best], score[best]


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """query_id, rank (from 1), vec_id, score, query_hash for the rows of vectors (vec_id, embedding) that are queries."""
    s, spark = settings, vectors.sparkSession
    length = common_length(vectors)
    sound = vectors.where(F.col("vec_id").isNotNull() & usable() & (F.size("embedding") == length))
    kind = dict(vectors.dtypes)["embedding"]
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = sound.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast(kind).alias("x"), F.coalesce(is_query, F.lit(False)).alias("query"))
    squares = F.aggregate("x", F.lit(0.0), lambda t, v: t + v.cast("double") * v.cast("double"))
    top = rows.agg(F.count("*").alias("n"), F.count_if(F.col("query")).alias("queries"), F.max(squares).alias("most")).first()
    schema = "query_id long, rank int, vec_id long, score double, query_hash long"
    if not top.n or not top.queries:
        return spark.createDataFrame([], schema)
    most = float(np.sqrt(top.most))
    sample = rows.select("x", F.xxhash64("id").alias("h")).orderBy("h").limit(s.sample).select("x").toArrow()
    x = matrix(sample.column("x"), length)
    rotations = learn_rotations(augmented(x, most), max(s.layouts) * SUBSTRING, s.rounds)
    layout = learn_layout(x, most, rotations, k, s)
    bits = layout.substrings * SUBSTRING
    rotations = rotations[:, :bits]
    # more blocks than the bound asks for, as long as they aren't small, keep all cores at work; results don't depend on them
    index_blocks = max(-(-top.n // s.index_block), min(spark.sparkContext.defaultParallelism, -(-top.n // 4096)))
    query_blocks = -(-top.queries // s.query_block)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, queries = matrix(batch.column("x"), length), np.asarray(batch.column("query"))
                as_row, as_query = (encode(augmented(own, m), rotations) for m in (most, 0.0))
                held = {"code": [c.tobytes() for c in as_row], "query_code": [c.tobytes() if asked else None for c, asked in zip(as_query, queries, strict=True)]}
                yield pa.record_batch({"id": batch.column("id"), "x": batch.column("x"), **{name: pa.array(c, pa.binary()) for name, c in held.items()}})

    coded = cut(rows.mapInArrow(code, f"id long, x {kind}, code binary, query_code binary"))
    asked = coded.where("query_code is not null").select("id", F.xxhash64("x").alias("hash"), "x", F.col("query_code").alias("code")).dropDuplicates(["id", "hash"])
    index = coded.select(F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"), F.pmod(F.xxhash64("id"), F.lit(index_blocks)).cast("int").alias("ib"), "id", F.lit(None).cast("long").alias("hash"), "x", "code")

    def search(queries: DataFrame, radius: int) -> DataFrame:
        def pair(key: tuple, group: pa.Table) -> pa.Table:
            hashes = group.column("hash").combine_chunks()
            is_row = np.asarray(hashes.is_null())
            ids, x = np.asarray(group.column("id"), np.int64), matrix(group.column("x"), length)
            codes = np.frombuffer(b"".join(group.column("code").to_pylist()), "<u2").reshape(len(ids), -1)
            q, own = np.flatnonzero(~is_row), np.flatnonzero(is_row)
            got = list(search_block(ids[q], x[q], codes[q], ids[own], x[own], Index(codes[own]), radius, k)) if len(q) and len(own) else []
            at = q[np.repeat(np.array([g[0] for g in got], np.int64), [len(g[1]) for g in got])]
            flat = lambda i, kind: np.concatenate([np.zeros(0, kind), *(g[i] for g in got)]).astype(kind)
            return pa.table({"query_id": ids[at], "query_hash": hashes.take(pa.array(at)), "vec_id": flat(1, np.int64), "score": flat(2, np.float64)})

        dealt = queries.select(F.pmod(F.xxhash64("id", "hash"), F.lit(query_blocks)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(index_blocks - 1))).alias("ib"), "id", "hash", "x", "code")
        return index.unionByName(dealt).groupBy("qb", "ib").applyInArrow(pair, RESULT)

    order = W.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), "vec_id")
    radius, out = layout.radius, None
    while True:
        found = cut(search(asked, radius).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        full = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("query_hash").alias("hash"))
        done = found if radius >= bits else found.join(full.toDF("query_id", "query_hash"), ["query_id", "query_hash"], "left_semi")
        out = done if out is None else out.unionByName(done)
        if radius >= bits:
            break
        asked = cut(asked.join(full, ["id", "hash"], "left_anti"))
        if not asked.limit(1).count():
            break
        radius = bits if bits - radius < 4 else (radius + bits) // 2
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "query_hash")
