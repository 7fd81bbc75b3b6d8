"""MinHash near-dedup by a multi-index Hamming join.

A document's set is its distinct five-word shingles (64-bit hashes). Its signature is 45 components of 16 bits (b-bit minwise
hashes), cut into 9 chunks of 5. Two signatures that differ in at most 17 components differ in at most one of some chunk's five
(pigeonhole), so they share one of the 45 keys made of a chunk without one component (the allowed chunk error). At a similarity of
0.85 more than 17 of 45 differ with a probability of about 4e-5, at 0.9 of about 1e-7.

The threshold and the layout that belongs to it are a ``Scheme``. Links at 0.8 take 44 components, 11 chunks of 4, and a radius of 21:
at a similarity of 0.8 more than 21 of 44 differ with a probability of about 8e-6.

Keys are never expanded into all pairs. Documents with equal sets are one class first, known by its smallest node. Then

1. each bucket links its members to its smallest one, each class keeps the bucket leader it shares most keys with, and those pairs are
   confirmed on full sets; components follow;
2. within buckets that still hold several components, signatures of different components are compared (vectorised, in blocks). What is
   within the radius of another component stays in the bucket, meets its text, and the bucket's full sets are compared over inverted lists;
   links that join components go out, a forest of them.

So every pair within the signature distance is either compared on full sets or known to be connected already, and no step's output has
a row per pair. Confirming a guess moves texts to the pair's leader and compares sets in a stream; a leader's members are dealt out over
salted groups, a bucket's members over block pairs.

Results for odd input: null text or text without words has an empty set and links with nothing; with one to four words the set has
one element, the whole sequence; rows that share a doc_id are one node, each reporting its own set's size; a null doc_id keeps its
row apart, with a null component_id, and kept; empty tables give no rows; extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.llm.common import cut, ragged, release, slices
from kinmatch.llm.components import by_id, components

SHINGLE = 5
CHUNKS, CHUNK = 9, 5
COMPONENTS = CHUNKS * CHUNK
RADIUS = 2 * CHUNKS - 1
PERCENT = 85
GROUP = ("key", "x", "y")
#: Members of a leader that one group confirms; members of a bucket that one block holds.
GROUP_MEMBERS, BLOCK_MEMBERS = 512, 512


@dataclass(frozen=True)
class Scheme:
    """Links hold at percent / 100 of similarity or more; a signature has chunks * chunk components, at most 45."""

    percent: int = PERCENT
    chunks: int = CHUNKS
    chunk: int = CHUNK

    @property
    def components(self) -> int:
        return self.chunks * self.chunk

    @property
    def radius(self) -> int:
        """The most differences at which one chunk surely has no more than one."""
        return 2 * self.chunks - 1


AT_85, AT_80 = Scheme(), Scheme(80, 11, 4)

_random = np.random.default_rng(20_240_101)
BYTE_VALUE = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
BASE, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
MULTIPLIERS = _random.integers(1, 1 << 63, COMPONENTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _random.integers(1, 1 << 63, COMPONENTS, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all 64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of n texts, A-Z lower-cased, and the n + 1 word numbers at which texts begin."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    small = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    blank = (small == 32) | ((small >= 9) & (small <= 13))
    begins = ~blank
    begins[1:] &= blank[:-1]
    edges = at[:-1][at[:-1] < at[1:]]
    begins[edges] = ~blank[edges]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    number = np.cumsum(begins) - 1
    place = np.arange(len(small)) - starts[np.maximum(number, 0)]
    place[blank] = 0
    powers = np.cumprod(np.full(int(place.max()) + 1, BASE, np.uint64))
    value = BYTE_VALUE[small] * powers[place]
    value[blank] = 0
    return mixed(np.add.reduceat(value, starts)), np.searchsorted(starts, at)


def shingle_sets(data: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """For each text its set, sorted."""
    words, own = word_hashes(data, at)
    n = len(words)
    if n >= SHINGLE:
        folded = np.zeros(n - SHINGLE + 1, np.uint64)
        for k in range(SHINGLE):
            folded = folded * STEP + words[k : n - SHINGLE + 1 + k]
        folded = mixed(folded)
    for a, b in zip(own[:-1].tolist(), own[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            yield np.unique(folded[a : b - SHINGLE + 1])
        elif b > a:
            one = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    one = one * STEP + w
            yield mixed(np.array([one]))
        else:
            yield np.zeros(0, np.uint64)


def signature(elements: np.ndarray, components: int = COMPONENTS) -> np.ndarray:
    """Minima of so many multiplicative hashes, 16 bits of each."""
    least = np.full(components, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(elements), 4096):
        part = elements[i : i + 4096]
        np.minimum(least, (part[None, :] * MULTIPLIERS[:components, None] + OFFSETS[:components, None]).min(1), out=least)
    return (mixed(least) & np.uint64(0xFFFF)).astype(np.uint16)


def sign(batches: Iterator[pa.RecordBatch], scheme: Scheme = AT_85) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, at in slices(batch, "text", 1 << 20):
            n, h1, h2, signs = [], [], [], []
            for s in shingle_sets(data, at):
                n.append(len(s))
                d = xxhash.xxh3_128_digest(s.tobytes())
                h1.append(int.from_bytes(d[:8], "little", signed=True))
                h2.append(int.from_bytes(d[8:], "little", signed=True))
                signs.append(signature(s, scheme.components).tobytes() if len(s) else b"")
            yield pa.record_batch({"node": rows.column("node"), "doc_id": rows.column("doc_id"), "n": pa.array(n, pa.int64()), "h1": pa.array(h1, pa.int64()), "h2": pa.array(h2, pa.int64()), "sig": pa.array(signs, pa.binary())})


def matrix(column: pa.Array, scheme: Scheme) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, scheme.components)


def band_key(signs: np.ndarray, band: np.ndarray, size: int) -> np.ndarray:
    """The key of each signature (a row) for its band: a chunk of at most five without one of its components fits 64 bits; the band is mixed in."""
    chunk, left = np.divmod(band, size)
    value, rows = np.zeros(len(signs), np.uint64), np.arange(len(signs))
    for k in range(size - 1):
        value |= signs[rows, chunk * size + k + (k >= left)].astype(np.uint64) << np.uint64(16 * k)
    return mixed(value) + band.astype(np.uint64) * BASE


def key_rows(batches: Iterator[pa.RecordBatch], scheme: Scheme = AT_85) -> Iterator[pa.RecordBatch]:
    """(key, node) for every band."""
    for batch in batches:
        if not batch.num_rows:
            continue
        signs = matrix(batch.column("sig"), scheme)
        keys = np.stack([band_key(signs, np.full(len(signs), band), scheme.chunk) for band in range(scheme.components)], 1)
        yield pa.record_batch({"key": pa.array(keys.view(np.int64).ravel()), "node": pa.array(np.repeat(np.asarray(batch.column("node"), np.int64), scheme.components))})


def by_group(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[pa.Table]:
    """Rows in the order of names to tables of whole groups."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(c)) for c in names]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0))
        last = 0
        if len(change):  # the last group may go on in the next batch
            last = int(change[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        elif held and any(held[-1].column(c)[-1] != batch.column(c)[0] for c in names):
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def group_numbers(rows: pa.Table) -> np.ndarray:
    key, x, y = (np.asarray(rows.column(c)) for c in GROUP)
    return np.cumsum(np.append(True, (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))) - 1


def probe(batches: Iterator[pa.RecordBatch], scheme: Scheme = AT_85) -> Iterator[pa.RecordBatch]:
    """Rows (key, x, y, side, node, label, sig): those with a signature of another label within the radius in their block pair.

    x = y: all pairs of the block; else only pairs of unlike side. A pair counts only under the first key that it shares.
    """
    for rows in by_group(batches, GROUP):
        key, x, y, side, node, label = (np.asarray(rows.column(c)) for c in (*GROUP, "side", "node", "label"))
        signs, group = matrix(rows.column("sig").combine_chunks(), scheme), group_numbers(rows)
        hit = np.zeros(len(key), bool)
        for d in range(1, len(key)):
            i = np.flatnonzero(group[:-d] == group[d:])
            if not len(i):
                break
            i = i[(label[i] != label[i + d]) & ((x[i] == y[i]) | (side[i] != side[i + d]))]
            equal = signs[i] == signs[i + d]
            near = np.count_nonzero(equal, axis=1) >= scheme.components - scheme.radius
            i, equal = i[near], equal[near].reshape(-1, scheme.chunks, scheme.chunk)
            chunk = (np.count_nonzero(equal, axis=2) >= scheme.chunk - 1).argmax(1)
            left = (~equal[np.arange(len(i)), chunk]).argmax(1)  # the component that differs, or the first if none does
            i = i[band_key(signs[i], chunk * scheme.chunk + left, scheme.chunk).view(np.int64) == key[i]]
            hit[i] = hit[i + d] = True
        found = np.flatnonzero(hit)
        yield pa.record_batch({"key": pa.array(key[found]), "x": pa.array(x[found]), "y": pa.array(y[found]), "side": pa.array(side[found]), "node": pa.array(node[found]), "label": pa.array(label[found])})


def settle(batches: Iterator[pa.RecordBatch], percent: int = PERCENT) -> Iterator[pa.RecordBatch]:
    """Rows (key, x, y, side, node, label, text), a group's together: links on full sets that join labels, a spanning forest of them.

    Intersections of one document with all others of its group are counted over the group's inverted lists.
    """

    def links(sets: list[np.ndarray], node: np.ndarray, label: np.ndarray, side: np.ndarray, all_pairs: bool) -> Iterator[tuple[int, int]]:
        sizes = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        _, root = np.unique(label, return_inverse=True)
        for i, s in enumerate(sets):
            low = np.searchsorted(flat, s)
            holders = owner[ragged(low, np.searchsorted(flat, s, "right") - low)]
            common = np.bincount(holders, minlength=len(sets))
            good = 100 * common >= percent * (sizes[i] + sizes - common)
            good[: i + 1] = False
            good &= root != root[i]
            if not all_pairs:
                good &= side != side[i]
            for j in np.flatnonzero(good).tolist():
                if root[j] != root[i]:
                    root[root == root[j]] = root[i]
                    yield int(node[i]), int(node[j])

    def parts() -> Iterator[tuple]:
        for batch in batches:
            for rows, data, at in slices(batch, "text", 1 << 20):
                yield from zip(zip(*(rows.column(c).to_pylist() for c in GROUP), strict=True), shingle_sets(data, at), *(rows.column(c).to_pylist() for c in ("node", "label", "side")), strict=True)

    def whole(group: tuple, own: list[tuple]) -> Iterator[pa.RecordBatch]:
        sets, node, label, side = zip(*own, strict=True)
        found = list(links(list(sets), np.array(node), np.array(label), np.array(side), group[1] == group[2]))
        yield pa.record_batch({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    now, own = None, []
    for group, *row in parts():
        if group != now and own:
            yield from whole(now, own)
            own = []
        now = group
        own.append(tuple(row))
    if own:
        yield from whole(now, own)


def confirm_rows(batches: Iterator[pa.RecordBatch], percent: int = PERCENT) -> Iterator[pa.RecordBatch]:
    """Rows (leader, salt, node, text) sorted so that a group's leader comes first: links that hold on full sets."""
    group, lead = None, None
    for batch in batches:
        for rows, data, at in slices(batch, "text", 1 << 20):
            a, b = [], []
            leaders, salts, nodes = (rows.column(c).to_pylist() for c in ("leader", "salt", "node"))
            for s, leader, salt, node in zip(shingle_sets(data, at), leaders, salts, nodes, strict=True):
                if leader == node:
                    group, lead = (leader, salt), s
                elif group == (leader, salt):
                    small, large = min(len(s), len(lead)), max(len(s), len(lead))
                    if 100 * small < percent * large:
                        continue
                    found = np.searchsorted(lead, s)
                    common = int(np.count_nonzero(lead[np.minimum(found, len(lead) - 1)] == s))
                    if 100 * common >= percent * (len(s) + len(lead) - common):
                        a.append(leader)
                        b.append(node)
            yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of pairs (a, b), each once, those with 100 * intersection >= percent * union. texts: node, text."""
    groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP_MEMBERS).cast("int").alias("groups"))
    members = pairs.join(groups, "a").select(F.col("a").alias("leader"), F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("salt"), F.col("b").alias("node"))
    leaders = groups.select(F.col("a").alias("leader"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt"), F.col("a").alias("node"))
    asked = members.unionByName(leaders)
    rows = texts.join(asked, "node").select("leader", "salt", "node", "text")
    ordered = rows.repartition("leader", "salt").sortWithinPartitions("leader", "salt", F.col("node") != F.col("leader"))
    return ordered.mapInArrow(lambda batches: confirm_rows(batches, percent), "a long, b long")


def apart(buckets: DataFrame, classes: DataFrame, labels: DataFrame, texts: DataFrame, scheme: Scheme = AT_85) -> DataFrame:
    """Links (a, b) between components that share a bucket: those that the radius allows, confirmed on full sets."""
    marked = buckets.join(labels, "node", "left").select("key", "members", "node", F.coalesce("component", "node").alias("label"))
    marked = cut(marked)
    open_keys = marked.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    open_keys = cut(open_keys)
    blocks = F.ceil(F.col("members") / BLOCK_MEMBERS).cast("int")
    rows = marked.join(open_keys, "key").withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("node"), blocks).cast("int")})
    rows = rows.select("key", "node", "label", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("key", "node", "label", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), (F.col("block") > F.col("other")).cast("int").alias("side"))
    rows = rows.join(classes.select("node", "sig"), "node").repartition(*GROUP).sortWithinPartitions(*GROUP)
    flagged = cut(rows.mapInArrow(lambda batches: probe(batches, scheme), "key long, x int, y int, side int, node long, label long"))
    full = flagged.join(texts, "node").select(*GROUP, "side", "node", "label", "text")
    return cut(full.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(lambda batches: settle(batches, scheme.percent), "a long, b long"))


def near_duplicates(docs: DataFrame, scheme: Scheme = AT_85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs (doc_id, text)."""
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").limit(1).count() > 0
    node = F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text") if odd else F.col("doc_id").cast("long")
    texts = docs.select(node.alias("node"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = cut(texts.mapInArrow(lambda batches: sign(batches, scheme), "node long, doc_id long, n long, h1 long, h2 long, sig binary"))
    filled = signed.where("n > 0")
    classes = cut(filled.groupBy("h1", "h2").agg(F.min("node").alias("node"), F.first("sig").alias("sig")))
    keys = classes.select("node", "sig").mapInArrow(lambda batches: key_rows(batches, scheme), "key long, node long")
    # checkpointed first, so that the join's sides are plain exchanges, whose hot keys Spark can split
    leaders = cut(keys.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("members")).where("members > 1"))
    buckets = cut(keys.join(leaders, "key"))
    del keys, leaders
    release(docs.sparkSession)

    stars = buckets.where("node <> leader").groupBy("leader", "node").agg(F.count("*").alias("shared"))
    # an equal chunk gives so many shared keys
    best = stars.where(F.col("shared") >= scheme.chunk).groupBy("node").agg(F.max(F.struct("shared", (-F.col("leader")).alias("minus"))).alias("best"))
    guess = cut(best.select((-F.col("best.minus")).alias("a"), F.col("node").alias("b")))
    # a class is read for its set through one of its rows
    own_text = texts.select("node", "text").dropDuplicates(["node"]) if odd else texts.select("node", "text")
    links = cut(confirmed(guess, own_text, scheme.percent))
    del stars, best
    release(docs.sparkSession)
    labels = components(links)

    more = apart(buckets, classes, labels, own_text, scheme)
    if more.limit(1).count():
        labels = components(links.unionByName(more))
    release(docs.sparkSession)

    member = classes.select("h1", "h2", F.col("node").alias("rep"))
    out = signed.join(member, ["h1", "h2"], "left").withColumn("rep", F.when(F.col("n") > 0, F.coalesce("rep", "node")).otherwise(F.col("node")))
    out = out.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component_id", F.coalesce("component", "rep"))
    if odd:
        out = by_id(out.select("doc_id", "n", F.col("component_id").alias("component")), "doc_id", "n")
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def one_of_each(docs: DataFrame, scheme: Scheme = AT_85) -> DataFrame:
    """docs without the documents that reach a smaller doc_id. Rows whose doc_id repeats stay or go together."""
    known = near_duplicates(docs.select("doc_id", "text"), scheme)
    gone = known.where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
