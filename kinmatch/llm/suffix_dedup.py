"""Suffix-array dedup with a logarithmic index family: every byte in a 200-byte string that also starts elsewhere goes.

Sharding the suffix space. In each 200-byte window of a text the 16-gram of the smallest hash (leftmost, if equal) is its anchor.
Equal windows have equal anchors at equal places, so windows can only match within the shard of their anchor's 16-gram. Runs of
windows with one anchor are one record: its bytes are the union of its windows. A record travels as two hashes, its 16-gram's
(key) and its content's; only contents under a key with several different contents are fetched, one copy of each.

The index. A task takes its shards' records in batches, bounded in windows and bytes. A batch's windows are put in suffix order (by shard, and
within it by their bytes, to a depth of 200) in an array with the head of each, its shard and as many first bits as 64 leave room for;
neighbours with a common prefix of 200 match. The array is merge-scanned against every level of the index: stretches of both that agree in their heads
are brought into one order, and neighbours from either side with a common prefix of 200 match. Then it becomes a level, and while the
two last levels are of a size, they merge, in one pass over both. So each window is merged a number of times that grows with the
logarithm of the batches. Common prefixes are found by bisection over prefix hashes; bytes confirm every match. A family of levels ends
with a shard once it holds the bytes of ``FAMILY_BATCHES`` batches; a window can have up to 200 bytes of its own, so windows alone
wouldn't bound its memory.

Copies. Records of equal key and content (two 64-bit hashes) are occurrences of one stretch of text and match without their bytes; one
copy of each content goes to the index.

Hot keys: copies of one content are counted before they move. A key's contents are dealt out over slices, one for every
``SLICE_CONTENTS`` of them, by the windows' distance from the anchor, and, where there are more slices than distances, by a hash of
the window; windows that differ in either never match, so nothing is lost and no slice grows with its key.

Results for odd input: null text counts as empty and keeps its row; texts under 200 bytes lose nothing; repeated rows are occurrences
like any others, so texts of at least 200 bytes that repeat go whole; empty tables give no rows; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.llm.common import discard, ragged, release, slices, with_identity, written

LENGTH, GRAM = 200, 16
#: Windows and bytes of a batch, whichever is reached first; batches' bytes after which a family ends with a shard; different contents
#: of a key that one slice takes.
BATCH_WINDOWS, BATCH_BYTES, FAMILY_BATCHES, SLICE_CONTENTS = 1 << 17, 1 << 19, 8, 2_000
#: Distances that a window's start can have from its anchor.
DISTANCES = LENGTH - GRAM + 1

C1, C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
BYTE_VALUE = np.random.default_rng(20_240_207).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FINGER = np.uint64(pow(int(C1), -1, 1 << 64))
FETCHED = pa.schema([("key", pa.int64()), ("slice", pa.int32()), ("content", pa.int64()), ("skip", pa.int32()), ("n", pa.int32()), ("bytes", pa.binary())])
POWERS = np.multiply.accumulate(np.append(np.uint64(1), np.full(LENGTH, C1, np.uint64)))


def words(data: np.ndarray, little: bool = True) -> np.ndarray:
    """The 8 bytes from each position on, as a number; the data are padded by zeros."""
    raw = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.as_strided(raw, (len(data), 8), (1, 1)).copy().view("<u8" if little else ">u8").ravel().astype(np.uint64, copy=False)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 16 bytes from each position on (the last positions' are of no use)."""
    w = words(data)
    far = np.concatenate([w[8:], np.zeros(min(8, len(w)), np.uint64)])
    h = (w ^ (w >> np.uint64(29))) * C1
    h ^= (far ^ (far >> np.uint64(31))) * C2
    h = (h ^ (h >> np.uint64(32))) * C1
    return h ^ (h >> np.uint64(29))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i : i + width]) for each i, by running minima of blocks from both sides."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    square = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def records(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first window, windows, anchor, key) of each record; positions within data."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none, none.astype(np.uint64)
    grams = gram_hashes(data)
    per = LENGTH - GRAM + 1
    place = np.arange(len(data), dtype=np.uint64)
    least = sliding_least(((grams >> np.uint64(32)) << np.uint64(32)) | place, per)[: len(data) - LENGTH + 1]
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(anchor)]
    whole = np.arange(len(anchor)) + LENGTH <= at[text + 1]
    fresh = np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (whole[1:] != whole[:-1]))
    first = np.flatnonzero(fresh)
    count = np.diff(np.append(first, len(anchor)))
    keep = whole[first]
    first, count = first[keep], count[keep]
    return text[first], first, count, anchor[first], grams[anchor[first]]


def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, content, k, v, at, n, lead): the records of every text; at: the first window, lead: bytes before the anchor."""
    for batch in batches:
        for rows, data, at in slices(batch, "text", 1 << 20):
            text, first, count, anchor, key = records(data, at)
            view = memoryview(np.ascontiguousarray(data))
            content = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(first.tolist(), (first + count + LENGTH - 1).tolist(), strict=True)), np.uint64, len(first))
            k, v = (np.asarray(rows.column(c), np.int64)[text] for c in ("_k", "_v"))
            yield pa.record_batch({"key": pa.array(key.view(np.int64)), "content": pa.array(content.view(np.int64)), "k": pa.array(k), "v": pa.array(v), "at": pa.array(first - at[text]), "n": pa.array(count, pa.int32()), "lead": pa.array(anchor - first, pa.int32())})


def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, wanted: array of (key, content, at, n, lead, parts)) to (key, slice, content, skip, n, bytes).

    A slice is a range of distances from the anchor; where there are more parts than distances, a distance and a part of the hashes.
    """
    for batch in batches:
        for rows, data, at in slices(batch, "text", 1 << 20):
            lists = rows.column("wanted")
            which = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
            flat = lists.flatten()
            key, content, first, n, lead, parts = (np.asarray(flat.field(i), np.int64) for i in range(6))
            view = memoryview(np.ascontiguousarray(data))
            out, held = {c: [] for c in FETCHED.names}, 0
            for w, k, c, f, m, l, p in zip(which.tolist(), key.tolist(), content.tolist(), first.tolist(), n.tolist(), lead.tolist(), parts.tolist(), strict=True):
                begin, step, hashed = int(at[w]) + f, -(-DISTANCES // p), -(-p // DISTANCES)
                i = 0
                while i < m:  # windows i .. j - 1 lie in one range of distances from the anchor
                    s = (l - i) // step
                    j = min(m, l - s * step + 1)
                    own = bytes(view[begin + i : begin + j + LENGTH - 1])
                    if hashed > 1:
                        s = s * hashed + xxhash.xxh3_64_intdigest(own) % hashed
                    for name, x in zip(out, (k, s, c, i, j - i, own), strict=True):
                        out[name].append(x)
                    i, held = j, held + len(own)
                if held >= 1 << 22:  # narrow slices repeat most of their bytes
                    yield pa.RecordBatch.from_pydict(out, FETCHED)
                    out, held = {c: [] for c in FETCHED.names}, 0
            yield pa.RecordBatch.from_pydict(out, FETCHED)


class Text:
    """Bytes that grow by batches, with the word at each place and prefix hashes, so that stretches compare without being read.

    Prefix hashes begin anew with each batch, as no window goes over its end.
    """

    def __init__(self):
        self.data, self.words, self.sums = np.zeros(0, np.uint8), np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def add(self, data: np.ndarray) -> int:
        """Appends a batch and a byte of 0; where it begins."""
        base, n = len(self.data), len(data)
        back = np.multiply.accumulate(np.append(np.uint64(1), np.full(n, FINGER, np.uint64)))
        ahead = np.multiply.accumulate(np.append(FINGER, np.full(n, C1, np.uint64)))
        own = np.append(np.uint64(0), np.cumsum(BYTE_VALUE[data] * back[:n])) * ahead
        data = np.append(data, np.uint8(0))
        self.data, self.words, self.sums = (np.concatenate(x) for x in ((self.data, data), (self.words, words(data, little=False)), (self.sums, own)))
        return base

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the windows at x and y, LENGTH at most; equal windows are compared byte by byte."""
        out = np.zeros(len(x), np.int64)
        left = np.arange(len(x))
        for depth in (0, 8, 16):  # most differ soon
            differ = self.words[x[left] + depth] ^ self.words[y[left] + depth]
            apart = np.flatnonzero(differ)
            out[left[apart]] = depth + (differ[apart].astype(">u8").view(np.uint8).reshape(-1, 8) != 0).argmax(1)
            left = left[differ == 0]
        low, high = np.full(len(left), 24), np.full(len(left), LENGTH)
        xl, yl = x[left], y[left]
        apart = self.sums[xl] - self.sums[yl]
        for _ in range((LENGTH - 24).bit_length()):
            middle = (low + high + 1) // 2
            equal = self.sums[xl + middle] - self.sums[yl + middle] == apart * POWERS[middle]
            low, high = np.where(equal, middle, low), np.where(equal, high, middle - 1)
        whole = np.flatnonzero(low == LENGTH)
        for i in range(0, len(whole), 1 << 14):
            part = whole[i : i + (1 << 14)]
            differ = self.window(xl[part]) != self.window(yl[part])
            low[part] = np.where(differ.any(1), differ.argmax(1), LENGTH)
        out[left] = low
        return out

    def window(self, at: np.ndarray) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(self.data, LENGTH)[at]


def in_order(text: Text, at: np.ndarray, tied: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows at ``at``, in the order of their first bytes, to full suffix order; tied: whether a window goes on its predecessor's stretch
    of equal first bytes. Returns the order, and for each place whether the window there equals the one before it.

    A stretch is split by its middle window (two runs in order make its first a bad one): what is smaller by the length of the common
    prefix, what is equal, what is larger. Windows on the same side with prefixes of one length stay a stretch for the next turn.
    """
    order, equal, place = np.arange(len(at)), np.zeros(len(at), bool), np.arange(len(at))
    while True:
        open_ = tied.copy()
        open_[:-1] |= tied[1:]
        place, tied = place[open_], tied[open_]
        if not len(place):
            return order, equal
        begin, x = np.flatnonzero(~tied), at[order[place]]
        size = np.diff(np.append(begin, len(x)))
        stretch, lead = np.repeat(np.arange(len(begin)), size), np.repeat(x[begin + size // 2], size)
        prefix = text.common(x, lead)
        step = np.minimum(prefix, LENGTH - 1)
        smaller = text.data[x + step] < text.data[lead + step]
        rank = np.where(prefix == LENGTH, LENGTH, np.where(smaller, prefix, 2 * LENGTH - prefix))
        key = stretch * (4 * LENGTH) + rank
        by = np.argsort(key, kind="stable")
        order[place], key = order[place][by], key[by]
        joined = np.append(False, key[1:] == key[:-1])
        same = joined & (key % (4 * LENGTH) == LENGTH)
        equal[place] |= same
        tied = joined & ~same


class Level:
    """A suffix array: places of windows in the order of shards and bytes, no two equal, and their heads."""

    def __init__(self, head: np.ndarray, at: np.ndarray, number: np.ndarray):
        self.head, self.at, self.number = head, at, number

    def __len__(self) -> int:
        return len(self.at)

    def take(self, which: np.ndarray) -> "Level":
        return Level(self.head[which], self.at[which], self.number[which])


class Family:
    """Levels of geometrically growing size over all windows that a task was given, and which of them matched.

    A window equal to one in the index is marked, as that one is, and isn't kept again.
    """

    def __init__(self, shards: int = 1):
        self.shard_bits = np.uint64((shards - 1).bit_length())
        self.levels: list[Level] = []
        self.text = Text()
        self.marked = np.zeros(0, bool)

    def add(self, data: np.ndarray, starts: np.ndarray, shard: np.ndarray | int = 0) -> None:
        """A batch: windows begin at starts in data; windows of different shards are never compared."""
        at = self.text.add(data) + starts
        number = len(self.marked) + np.arange(len(starts))
        self.marked = np.concatenate([self.marked, np.zeros(len(starts), bool)])
        head = (self.text.words[at] >> self.shard_bits) | (np.asarray(shard, np.uint64) << (np.uint64(64) - self.shard_bits))
        by = np.argsort(head, kind="stable")
        level = Level(head[by], at[by], number[by])
        order, equal = in_order(self.text, level.at, np.append(False, level.head[1:] == level.head[:-1])[: len(level)])
        level = self._settled(level.take(order), equal)
        for old in self.levels:
            level = self._scanned(level, old)
        self.levels.append(level)
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(self._merged(a, b)[0])

    def _settled(self, level: Level, equal: np.ndarray) -> Level:
        """Marks runs of equal windows and keeps the first of each."""
        self.marked[level.number[equal]] = True
        self.marked[level.number[np.append(equal[1:], False)[: len(level)]]] = True
        return level.take(~equal)

    def _merged(self, a: Level, b: Level) -> tuple[Level, np.ndarray]:
        """Two levels in one order, and which windows equal their predecessors."""
        head = np.concatenate([a.head, b.head])
        by = np.argsort(head, kind="stable")  # two runs in order: a merge
        both = Level(head, np.concatenate([a.at, b.at]), np.concatenate([a.number, b.number])).take(by)
        tied = np.append(False, both.head[1:] == both.head[:-1])[: len(both)]
        begin, ours = np.flatnonzero(~tied), by < len(a)
        if len(begin):  # what only one of them has is in order
            tied &= np.repeat(np.logical_or.reduceat(ours, begin) & np.logical_or.reduceat(~ours, begin), np.diff(np.append(begin, len(both))))
        order, equal = in_order(self.text, both.at, tied)
        return both.take(order), equal

    def _scanned(self, level: Level, old: Level) -> Level:
        """The merge scan: marks equal windows of a level and an old one, and returns the level without them."""
        low, high = np.searchsorted(old.head, level.head, "left"), np.searchsorted(old.head, level.head, "right")
        met = np.flatnonzero(high > low)
        fresh = met[np.append(True, level.head[met][1:] != level.head[met][:-1])[: len(met)]]
        theirs = old.take(ragged(low[fresh], (high - low)[fresh]))
        both, equal = self._merged(theirs, level.take(met))
        self._settled(both, equal)
        # the old one's window comes before the new one's, as equal windows keep their sides' order
        return level.take(~np.isin(level.number, both.number[equal]))


def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All records of a shard, a key's rows together, to (key, content, runs of matched windows)."""

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        key, part, n, skip = (np.asarray(rows.column(c), np.int64) for c in ("key", "slice", "n", "skip"))
        shard = np.cumsum(np.append(False, (key[1:] != key[:-1]) | (part[1:] != part[:-1])))
        family = Family(int(shard[-1]) + 1)
        windows, upto = (np.append(0, np.cumsum(x)) for x in (n, n + (LENGTH - 1)))
        first = 0
        while first < len(n):
            last = max(first + 1, min(int(np.searchsorted(x, x[first] + most, "right")) - 1 for x, most in ((windows, BATCH_WINDOWS), (upto, BATCH_BYTES))))
            some = rows.column("bytes").slice(first, last - first).combine_chunks().cast(pa.large_binary())
            at = np.frombuffer(some.buffers()[1], np.int64)[some.offset : some.offset + len(some) + 1]
            data = np.frombuffer(some.buffers()[2], np.uint8)[at[0] : at[-1]]
            family.add(data, ragged(at[:-1] - at[0], n[first:last]), np.repeat(shard[first:last], n[first:last]))
            first = last
        ends = np.cumsum(n)
        owner = np.repeat(np.arange(len(n)), n)
        hit = np.flatnonzero(family.marked)
        place = hit - (ends - n)[owner[hit]] + skip[owner[hit]]
        fresh = np.append(True, (np.diff(owner[hit]) != 0) | (np.diff(place) != 1)) if len(hit) else np.zeros(0, bool)
        begin = np.flatnonzero(fresh)
        size = np.diff(np.append(begin, len(hit)))
        own = owner[hit][begin]
        yield pa.record_batch({"key": rows.column("key").combine_chunks().take(pa.array(own)), "content": rows.column("content").combine_chunks().take(pa.array(own)), "skip": pa.array(place[begin], pa.int32()), "n": pa.array(size, pa.int32())})

    # shards are in order: what is held is matched whenever a shard is whole and enough bytes are there
    held, most, size, previous = [], FAMILY_BATCHES * BATCH_BYTES, 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, part, n = (np.asarray(batch.column(c), np.int64) for c in ("key", "slice", "n"))
        upto = np.append(0, np.cumsum(n + (LENGTH - 1)))
        change = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
        if previous is not None and previous != (key[0], part[0]):
            change = np.append(0, change)
        previous, first = (key[-1], part[-1]), 0
        for last in change.tolist():
            if size + upto[last] - upto[first] >= most:
                yield from flush([*held, batch.slice(first, last - first)])
                held, size, first = [], 0, last
        held.append(batch.slice(first))
        size += upto[-1] - upto[first]
    if held:
        yield from flush(held)


def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with spans (array of (at, end), unordered, may overlap): merged spans and the text that stays."""
    for batch in batches:
        for rows, data, at in slices(batch, "text"):
            view = memoryview(np.ascontiguousarray(data))
            lists = rows.column("spans")
            offsets = np.asarray(lists.offsets)
            flat = lists.flatten()
            begin, end = (np.asarray(flat.field(i), np.int64) for i in range(2))
            kept, removed = [], []
            for i in range(len(lists)):
                b, e = begin[offsets[i] - offsets[0] : offsets[i + 1] - offsets[0]], end[offsets[i] - offsets[0] : offsets[i + 1] - offsets[0]]
                text = view[int(at[i]) : int(at[i + 1])]
                if not len(b):
                    kept.append(bytes(text))
                    removed.append([])
                    continue
                order = np.argsort(b, kind="stable")
                b, e = b[order], np.maximum.accumulate(e[order])
                fresh = np.append(True, b[1:] > e[:-1])
                runs = list(zip(b[fresh].tolist(), e[np.append(fresh[1:], True)].tolist(), strict=True))
                removed.append([{"begin": x, "end": y} for x, y in runs])
                edges = [0, *(z for r in runs for z in r), len(text)]
                kept.append(b"".join(text[edges[j] : edges[j + 1]] for j in range(0, len(edges), 2)))
            more = [pa.array(kept, pa.binary()), pa.array(removed, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array(np.diff(at))]
            names = [c for c in rows.schema.names if c not in ("spans", "text")]
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), *more], names=[*names, "kept", "removed", "n_bytes"])



def shared_records(docs: DataFrame) -> DataFrame:
    """Records whose key comes more than once, with whether the key has several contents."""
    found = written(docs.select("_k", "_v", "text").mapInArrow(locate, "key long, content long, k long, v long, at long, n int, lead int"), "records")
    keys = found.groupBy("key").agg(F.count("*").alias("rows"), F.min("content").alias("low"), F.max("content").alias("high")).where("rows > 1")
    # on storage first, so that the join's sides are plain exchanges, whose hot keys Spark can split
    keys = written(keys.select("key", (F.col("low") != F.col("high")).alias("several")), "shared-keys")
    shared = written(found.join(keys, "key"), "shared-records")
    discard(found)
    discard(keys)
    return shared


def matched_runs(docs: DataFrame, contents: DataFrame, odd: bool) -> DataFrame:
    """(key, content, skip, n): the windows of different contents that match others. Texts move to meet what is wanted of them."""
    parts = contents.groupBy("key").agg(F.ceil(F.count("*") / SLICE_CONTENTS).cast("int").alias("parts")).where("parts > 1")
    several = contents.join(parts, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    wanted = several.groupBy(F.col("k").alias("_k"), F.col("v").alias("_v")).agg(F.collect_list(F.struct("key", "content", "at", "n", "lead", "parts")).alias("wanted"))
    texts = docs.select("_k", "_v", "text")
    texts = (texts.dropDuplicates(["_k", "_v"]) if odd else texts).join(wanted, ["_k", "_v"])
    bytes_of = texts.select("text", "wanted").mapInArrow(fetch, "key long, slice int, content long, skip int, n int, bytes binary")
    return bytes_of.repartition("key", "slice").sortWithinPartitions("key", "slice").mapInArrow(match, "key long, content long, skip int, n int")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """_k, _v, spans (array of (at, end) byte ranges) of the texts that have repeated windows; docs have _k, _v, text.

    Each step ends on shared storage, and what only earlier steps needed is removed.
    """
    spark = docs.sparkSession
    # a key of one record matches nothing; a key of one content matches itself, as it comes twice
    shared = shared_records(docs)
    release(spark)
    contents = shared.where("several").groupBy("key", "content").agg(F.count("*").alias("copies"), F.min(F.struct("k", "v", "at", "n", "lead")).alias("one"))
    contents = written(contents.select("key", "content", "copies", "one.*"), "contents")
    release(spark)
    odd = shared.where("v <> 0").limit(1).count() > 0
    runs = written(matched_runs(docs, contents, odd), "runs")
    release(spark)
    # windows of a content that comes twice all match; else those that the index found
    twice = shared.join(contents.where("copies > 1").select("key", "content"), ["key", "content"], "left_semi").select("k", "v", "at", "n")
    alone = shared.where("not several").select("k", "v", "at", "n")
    some = shared.where("several").select("key", "content", "k", "v", "at").join(runs, ["key", "content"]).select("k", "v", (F.col("at") + F.col("skip")).alias("at"), "n")
    spans = twice.unionByName(alone).unionByName(some).select(F.col("k").alias("_k"), F.col("v").alias("_v"), "at", (F.col("at") + F.col("n") + (LENGTH - 1)).alias("end"))
    # a text has at most one span for each of its bytes, so a text's spans are bounded by the text
    out = written(spans.groupBy("_k", "_v").agg(F.collect_list(F.struct("at", "end")).alias("spans")), "spans")
    for table in (shared, contents, runs):
        discard(table)
    release(spark)
    return out


def dedup_suffixes(docs: DataFrame) -> DataFrame:
    """docs without text, with kept (binary, what stays of the UTF-8 bytes), removed (array of byte ranges) and n_bytes."""
    known = with_identity(docs.drop("kept", "removed", "n_bytes", "spans"))
    spans = repeated_spans(known)
    joined = known.join(spans, ["_k", "_v"], "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<at:bigint,end:bigint>>"))).drop("_k", "_v")
    names = [c for c in joined.columns if c not in ("text", "spans")]
    schema = ", ".join(f"`{c}` {joined.schema[c].dataType.simpleString()}" for c in names)
    return joined.mapInArrow(remove, f"{schema}, kept binary, removed array<struct<begin:bigint,end:bigint>>, n_bytes long")
