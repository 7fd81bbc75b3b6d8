"""Token ids of documents in binary files: fixed-width bit packing with block offsets.

A file (``.idpack``), all numbers little-endian:

* blocks: each holds ``block_ids`` ids (the last one fewer) of ``width`` bits, lowest bit first, padded to a whole byte;
* index: n_docs x int64 document id, n_docs bytes (1: the id is null), (n_docs + 1) x uint64 first id of each document,
  (n_blocks + 1) x uint64 byte offset of each block;
* footer: uint64 index offset, n_docs, n_ids, n_blocks; uint32 block_ids, width; 8 bytes of magic.

Any range of ids is read by unpacking the blocks that it touches, with numpy only.

Results for odd input: null text is empty, and a document without ids still has its end id; null doc_ids come first and stay
null; rows with one doc_id stay separate rows, ordered by a hash of the text and then the text; an empty table gives one empty manifest and no rows; other
columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.llm.common import new_path, slices
from kinmatch.llm.encoding import encoder

MAGIC = b"IDPACK01"
FOOTER = struct.Struct("<QQQQII8s")
BLOCK_IDS = 1 << 16
MANIFEST = "shard int, path string, n_docs long, n_ids long, n_bytes long"


def pack(ids: np.ndarray, width: int) -> bytes:
    """ids in ``width`` bits each, lowest bit first."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, width: int, n: int) -> np.ndarray:
    """The first n ids of a packed block, uint32."""
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(1, dtype=np.uint32)


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its file system's scheme: one without a scheme is on Spark's default file system, not on each machine's disk."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(there).toString()


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The shared store behind a qualified path, as executors open it; pyarrow refuses a scheme that it doesn't know."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if ":" not in uri.partition("/")[0]:
        raise ValueError(f"{uri} has no scheme, so each machine would take it for a folder of its own")
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


class Writer:
    """Appends documents to one file; holds one block and the index in memory."""

    def __init__(self, stream, width: int, block_ids: int = BLOCK_IDS):
        self.stream, self.width, self.block_ids = stream, width, block_ids
        self.docs, self.nulls, self.starts, self.blocks = [], [], [np.zeros(1, np.uint64)], [0]
        self.rest, self.n_ids, self.n_docs, self.at = np.zeros(0, np.uint32), 0, 0, 0

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.width)
        self.stream.write(data)
        self.at += len(data)
        self.blocks.append(self.at)

    def add(self, doc_ids: pa.Array, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(np.asarray(doc_ids.cast(pa.int64()).fill_null(0), np.int64))
        self.nulls.append(np.asarray(doc_ids.is_null()).astype(np.uint8))
        self.starts.append((self.n_ids + np.cumsum(lengths)).astype(np.uint64))
        self.n_ids += len(ids)
        self.n_docs += len(lengths)
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) // self.block_ids * self.block_ids
        for i in range(0, whole, self.block_ids):
            self._block(ids[i : i + self.block_ids])
        self.rest = ids[whole:]

    def close(self) -> int:
        if len(self.rest):
            self._block(self.rest)
        index = [np.concatenate([np.zeros(0, t), *x]).astype(t).tobytes() for t, x in (("<i8", self.docs), ("<u1", self.nulls), ("<u8", self.starts), ("<u8", [np.array(self.blocks, np.uint64)]))]
        for x in index:
            self.stream.write(x)
        self.stream.write(FOOTER.pack(self.at, self.n_docs, self.n_ids, len(self.blocks) - 1, self.block_ids, self.width, MAGIC))
        return self.at + sum(map(len, index)) + FOOTER.size


class Reader:
    """Random access to one file: ``reader.ids(first, last)`` and ``reader.document(i)``."""

    def __init__(self, path: str):
        store, name = file_system(path)
        self.stream = store.open_input_file(name)
        size = self.stream.size()
        self.index_at, self.n_docs, self.n_ids, n_blocks, self.block_ids, self.width, magic = FOOTER.unpack(self.stream.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} isn't a file of packed ids")
        index, at = self.stream.read_at(size - FOOTER.size - self.index_at, self.index_at), 0
        parts = []
        for kind, n in (("<i8", self.n_docs), ("<u1", self.n_docs), ("<u8", self.n_docs + 1), ("<u8", n_blocks + 1)):
            parts.append(np.frombuffer(index, kind, n, at))
            at += parts[-1].nbytes
        self.doc_ids, self.null, self.starts, self.blocks = parts

    def ids(self, first: int, last: int) -> np.ndarray:
        if first >= last:
            return np.zeros(0, np.uint32)
        a, b = first // self.block_ids, (last - 1) // self.block_ids
        data = self.stream.read_at(int(self.blocks[b + 1] - self.blocks[a]), int(self.blocks[a]))
        out = []
        for k in range(a, b + 1):
            n = min(self.block_ids, self.n_ids - k * self.block_ids)
            out.append(unpack(data[int(self.blocks[k] - self.blocks[a]) : int(self.blocks[k + 1] - self.blocks[a])], self.width, n))
        return np.concatenate(out)[first - a * self.block_ids : last - a * self.block_ids]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))

    def close(self) -> None:
        self.stream.close()


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write files in ascending doc_id order; returns the manifest, one row per file.

    Rows are dealt out by ranges of doc_id and a hash of the text, so shard k's ids all come before shard k + 1's, and a doc_id that
    many rows share is dealt over several shards. A task writes under a name of its own
    attempt, and the manifest (written with Spark's commit protocol) names only the files of attempts that succeeded.
    """
    spark = docs.sparkSession
    folder = qualified(spark, folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        encode, path = encoder(tokenizer), f"{folder}/shard-{task.partitionId():06d}-{task.taskAttemptId()}.idpack"
        store, name = file_system(path)
        store.create_dir(name.rpartition("/")[0], recursive=True)
        writer = None
        with store.open_output_stream(name) as stream:
            writer = Writer(stream, max(encode.width, int(end_id).bit_length()), block_ids)
            for batch in batches:
                for rows, data, at in slices(batch, "text"):
                    ids, n = encode(data, at)
                    ends = np.cumsum(n)
                    writer.add(rows.column("doc_id"), n + 1, np.insert(ids, ends, end_id))
            size = writer.close()
        yield pa.record_batch({"shard": pa.array([task.partitionId()], pa.int32()), "path": [path], "n_docs": [writer.n_docs], "n_ids": [writer.n_ids], "n_bytes": [size]})

    ordered = docs.select("doc_id", F.xxhash64("text").alias("h"), "text").repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/_manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


def read_token_files(manifest: DataFrame, with_ids: bool = True, ids_at_once: int = 1 << 20) -> DataFrame:
    """Documents of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids.

    The driver adds up one row per file; files are read in parallel, a bounded number of ids at once.
    """
    spark = manifest.sparkSession
    shards, base = [], 0
    for row in manifest.orderBy("shard").select("path", "n_docs", "n_ids").collect():
        if row.n_docs:
            shards.append((row.path, base))
            base += row.n_ids
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
                reader, first = Reader(path), 0
                starts = reader.starts.astype(np.int64)
                while first < reader.n_docs:
                    last = max(first + 1, int(np.searchsorted(starts, starts[first] + ids_at_once, "right")) - 1)
                    ids = reader.ids(int(starts[first]), int(starts[last]))
                    own = starts[first : last + 1] - starts[first]
                    view = memoryview(ids.astype("<u4", copy=False)).cast("B")
                    found = {
                        "doc_id": pa.array(reader.doc_ids[first:last], mask=reader.null[first:last].astype(bool)),
                        "start": pa.array(starts[first:last] + before),
                        "n_tokens": pa.array(np.diff(own)),
                        "ids_crc32": pa.array([zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)], pa.int64()),
                    }
                    if with_ids:
                        found["ids"] = pa.ListArray.from_arrays(pa.array(own, pa.int32()), pa.array(ids.astype(np.int32)))
                    yield pa.record_batch(found)
                    first = last
                reader.close()

    if not shards:
        return spark.createDataFrame([], schema)
    table = spark.createDataFrame(shards, "path string, before long").repartition(len(shards))
    return table.mapInArrow(read, schema)


def token_folder(spark: SparkSession) -> str:
    return new_path(spark, "token-files")
