"""Packing documents into fixed windows: bounded-space online best fit.

Each partition keeps a fixed number of open windows. A piece goes into the window it fits most tightly. When none fits and no
more may be opened, the fullest leaves: a gap worth a cut is filled with the head of the piece at hand, a smaller one is padding.
Leftover windows of many partitions are merged end to end; what then remains under a window's size is cut at powers of two, which
need no padding.

Results for odd input: null or empty text is one end id; rows with one doc_id are packed as separate documents; an empty table
gives no pieces; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.llm.common import slices, written
from kinmatch.llm.encoding import encoder

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
#: Partitions whose leftovers one merging task takes: windows x length x 4 bytes x this many are in its memory.
MERGED_AT_ONCE = 16


class Packer:
    """Open windows of one partition. Pieces are (doc_id, doc_tokens, start, ids)."""

    def __init__(self, length: int, windows: int, least_cut: int):
        self.length, self.windows, self.least_cut = length, windows, least_cut
        self.open: list[tuple[int, int, list]] = []  # (free, number, pieces), least free first
        self.opened = 0
        self.closed: list[list] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        while total - at >= self.length:  # whole windows need no search
            self.closed.append([(doc_id, total, at, ids[at : at + self.length])])
            at += self.length
        while at < total:
            size = total - at
            i = bisect_left(self.open, (size,))
            if i == len(self.open):  # none fits
                if len(self.open) < self.windows:
                    self._keep(self.length - size, [(doc_id, total, at, ids[at:])])
                    return
                free, _, pieces = self.open.pop(0)
                if free >= self.least_cut:
                    pieces.append((doc_id, total, at, ids[at : at + free]))
                    at += free
                self.closed.append(pieces)
                continue
            free, _, pieces = self.open.pop(i)
            pieces.append((doc_id, total, at, ids[at:]))
            if free == size:
                self.closed.append(pieces)
            else:
                self._keep(free - size, pieces)
            return

    def _keep(self, free: int, pieces: list) -> None:
        self.opened += 1
        insort(self.open, (free, self.opened, pieces))

    def take(self) -> list[list]:
        out, self.closed = self.closed, []
        return out


def merged(windows: list[list], length: int) -> Iterator[list]:
    """Leftover windows end to end, cut into full ones; the rest is cut into powers of two, the largest first."""
    pieces = [p for w in windows for p in w]
    left = sum(len(p[3]) for p in pieces)
    want = lambda: length if left >= length else 1 << (left.bit_length() - 1)
    now, room = [], want() if left else 0
    for doc_id, total, start, ids in pieces:
        while len(ids):
            part = ids[:room]
            now.append((doc_id, total, start, part))
            ids, start, room, left = ids[len(part) :], start + len(part), room - len(part), left - len(part)
            if not room:
                yield now
                now, room = [], want() if left else 0


def table(sequences: list[list], first_id: int, **more) -> pa.RecordBatch:
    """Pieces of sequences numbered from first_id, as Arrow columns."""
    flat = [(*p, first_id + k) for k, pieces in enumerate(sequences) for p in pieces]
    sizes = np.array([len(p[3]) for p in flat], np.int64)
    numbers = np.array([p[4] for p in flat], np.int64)
    ends = np.cumsum(sizes) - sizes
    fresh = np.append(True, numbers[1:] != numbers[:-1]) if len(flat) else np.zeros(0, bool)
    base = np.maximum.accumulate(np.where(fresh, ends, 0)) if len(flat) else ends
    data = np.concatenate([p[3] for p in flat]).astype("<u4") if flat else np.zeros(0, "<u4")
    bytes_at = np.concatenate([[0], np.cumsum(sizes * 4)])
    ids = pa.Array.from_buffers(pa.binary(), len(flat), [None, pa.py_buffer(bytes_at.astype(np.int32)), pa.py_buffer(data)])
    out = {
        "doc_id": pa.array([p[0] for p in flat], pa.int64()),
        "start": pa.array([p[2] for p in flat], pa.int64()),
        "length": pa.array(sizes),
        "doc_tokens": pa.array([p[1] for p in flat], pa.int64()),
        "sequence_id": pa.array(numbers),
        "offset": pa.array(ends - base),
        "ids": ids,
    }
    return pa.record_batch(out | {k: pa.array(np.full(len(flat), v)) for k, v in more.items()})


def pack_documents(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, windows: int = 64, least_cut: int = 16) -> DataFrame:
    """Pieces of all documents (doc_id, text) in sequences of at most ``length`` ids; ids are little-endian uint32.

    ``length`` is a power of two. ``windows`` open windows per partition bound the memory. Packing needs no shuffle: each scan
    partition packs what it reads, and only its leftovers (at most windows x length ids) move.
    """
    if length & (length - 1):
        raise ValueError("length must be a power of two")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        encode, packer = encoder(tokenizer), Packer(length, windows, least_cut)
        for batch in batches:
            for rows, data, at in slices(batch, "text"):
                ids, sizes = encode(data, at)
                ends = np.cumsum(sizes)
                ids = np.insert(ids, ends, end_id)
                ends = (ends + np.arange(1, len(ends) + 1)).tolist()
                first = 0
                for doc_id, last in zip(rows.column("doc_id").to_pylist(), ends, strict=True):
                    # a copy, so that an open window doesn't hold the batch
                    packer.add(doc_id, ids[first:last].copy())
                    first = last
                if done := packer.take():
                    yield table(done, (part << 32) + n, part=np.int32(part), open=False)
                    n += len(done)
        if packer.open:
            left = [pieces for _, _, pieces in packer.open]
            yield table(left, (part << 32) + n, part=np.int32(part), open=True)

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        rows = zip(*(group.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "start", "ids")), strict=True)
        pieces = [(d, t, s, np.frombuffer(b, "<u4")) for d, t, s, b in rows]
        return pa.Table.from_batches([table(list(merged([pieces], length)), (1 << 62) + (key[0].as_py() << 32))])

    packed = written(docs.select("doc_id", "text").mapInArrow(fill, f"{PIECES}, part int, open boolean"), "packed")
    left = packed.where("open").withColumn("_group", F.floor(F.col("part") / MERGED_AT_ONCE).cast("long"))
    names = [c.split()[0] for c in PIECES.split(", ")]
    return packed.where("not open").select(*names).unionByName(left.groupBy("_group").applyInArrow(merge, PIECES))
