"""Paths on whatever file system Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _open(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _open(spark, path)
    return fs.exists(p)


def first_existing(spark: SparkSession, *paths: str) -> str | None:
    """The first of several places that is there."""
    return next((p for p in paths if exists(spark, p)), None)


def first_line(spark: SparkSession, path: str) -> str | None:
    row = spark.read.text(path).first()
    return row.value if row else None


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Moves a file over another."""
    fs, p = _open(spark, source)
    q = spark._jvm.org.apache.hadoop.fs.Path(target)
    if q.getParent() is not None:
        fs.mkdirs(q.getParent())
    fs.delete(q, False)
    if not fs.rename(p, q):
        raise OSError(f"{source} can't be moved to {target}")


def join_files(spark: SparkSession, folder: str, target: str, header: str = "") -> None:
    """The files of a written folder, in order, as one file. Bytes are copied by the file system's streams, one buffer at a time."""
    fs, p = _open(spark, folder)
    jvm, names = spark._jvm, sorted(f.getPath().getName() for f in fs.listStatus(p) if f.getPath().getName().startswith("part-"))
    _, whole = _open(spark, target)
    if whole.getParent() is not None:
        fs.mkdirs(whole.getParent())
    draft = jvm.org.apache.hadoop.fs.Path(f"{target}.draft")
    out = fs.create(draft, True)
    out.write(header.encode())
    for name in names:
        own = fs.open(jvm.org.apache.hadoop.fs.Path(p, name))
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(own, out, 1 << 16, False)
        own.close()
    out.close()
    rename(spark, f"{target}.draft", target)


def write_whole(spark: SparkSession, path: str, text: str) -> None:
    """A small text, whole or not at all."""
    fs, _ = _open(spark, path)
    out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{path}.draft"), True)
    out.write(text.encode())
    out.close()
    rename(spark, f"{path}.draft", path)


def read_whole(spark: SparkSession, path: str) -> str | None:
    """A small text, or None if it isn't there."""
    if not exists(spark, path):
        return None
    return "\n".join(r.value for r in spark.read.option("wholetext", True).text(path).collect())


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _open(spark, path)
    fs.delete(p, True)


def find_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """path, bytes, modified of the files below root whose names fit a glob."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def profile_text(spark: SparkSession, path: str) -> dict:
    """Header, rows and the likeliest delimiter of a text file."""
    header = first_line(spark, path) or ""
    rows = spark.read.text(path).count()
    return {"header": header, "rows": max(0, rows - 1), "delimiter": max("\t,;|", key=header.count) if header else None}
