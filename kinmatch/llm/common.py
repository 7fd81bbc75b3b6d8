"""Shared pieces of the corpus operators: durable cut points, row identity, Arrow slicing."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space; Java and RE2 both read this pattern.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only a local master may go without that setting (tests); it then gets a temporary folder, removed at exit.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not found:
        found = sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="kinmatch-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        sc.setCheckpointDir(found)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage: a reliable checkpoint on shared storage.

    Spark removes its files with the last reader only where the application sets spark.cleaner.referenceTracking.cleanCheckpoints;
    otherwise they stay in the folder until someone clears it.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, kind: str) -> str:
    """A fresh path in the shared folder, removed when the process ends."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
    except Exception:  # the JVM may be gone by now
        pass


def written(df: DataFrame, kind: str) -> DataFrame:
    """Compute once into a Parquet table on shared storage and read it from there (for tables too wide to checkpoint row-wise)."""
    spark = df.sparkSession
    path = new_path(spark, kind)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kinmatch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Removes a written table that no later step reads."""
    _remove(df.sparkSession, df._kinmatch_path)


def release(spark: SparkSession) -> None:
    """Between steps: Spark removes shuffle files once the driver's garbage collection finds that no plan refers to them any more.
    Finished steps are on shared storage by then, so nothing that could be needed again goes."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def with_identity(docs: DataFrame, text: str = "text") -> DataFrame:
    """``_k, _v`` identify a row: doc_id and 0, or, where doc_ids repeat or are null, doc_id and a hash of id and text.

    Rows that agree in doc_id and text share an identity. The columns that come in stay as they are.
    """
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").limit(1).count() > 0
    version = F.xxhash64(F.col("doc_id").isNull(), "doc_id", text) if odd else F.lit(0).cast("long")
    return docs.withColumns({"_k": F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), "_v": version})


def slices(batch: pa.RecordBatch, text: str, most: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of rows of about ``most`` bytes of text: (rows, bytes, n + 1 offsets). Null text is empty.

    A longer text comes alone and whole.
    """
    column = pc.fill_null(batch.column(text).cast(pa.large_binary()), b"")
    n = len(column)
    if not n:
        return
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield batch.slice(first, last - first), data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all elements of the ranges [start, start + length), one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def binary_column(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """A binary column over one buffer; at: n + 1 byte offsets."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
