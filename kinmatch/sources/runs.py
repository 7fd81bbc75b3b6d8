"""Run records: fingerprints, manifests, resumable chunks, telemetry."""

from __future__ import annotations

import hashlib
import importlib.util
import json
import os
import platform
import resource
import subprocess
import time
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmatch.sources.files import exists
from kinmatch.sources.sinks import read_json, write_json


class ResumeError(RuntimeError):
    """A run can't go on in this folder."""


def sha256_file(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def sha256_ids(ids: Iterable[str]) -> str:
    out = hashlib.sha256()
    for i in ids:
        out.update(f"{i}\n".encode())
    return out.hexdigest()


def fingerprint(config: Mapping) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


def _said(*command: str) -> str | None:
    try:
        return subprocess.run(command, capture_output=True, text=True, timeout=10, check=True).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return None


def code_hashes() -> dict[str, str]:
    """sha256 of each module of the package."""
    root = Path(__file__).resolve().parent.parent
    return {str(f.relative_to(root)): sha256_file(str(f)) for f in sorted(root.rglob("*.py"))}


def manifest(spark: SparkSession, config: Mapping, inputs: Iterable[str] = ()) -> dict:
    """What a run depends on: code, input and settings."""
    return {
        "config": dict(config), "config_sha256": fingerprint(config), "git_commit": _said("git", "rev-parse", "HEAD"), "python": platform.python_version(),
        "spark": spark.version, "code": code_hashes(), "memory_bytes": os.sysconf("SC_PHYS_PAGES") * os.sysconf("SC_PAGE_SIZE"), "hash_seed": os.environ.get("PYTHONHASHSEED"), "inputs": {p: sha256_file(p) for p in inputs if os.path.isfile(p)},
        "gpu": _said("nvidia-smi", "--query-gpu=name", "--format=csv,noheader"), "dependencies": {m: importlib.util.find_spec(m) is not None for m in ("pyspark", "pandas", "pyarrow", "numpy")},
    }


def start(folder: str, record: Mapping, resume: bool = False) -> None:
    """Begins or resumes a run in a folder: resuming needs the same fingerprint, a folder in use needs resume."""
    path = f"{folder}/manifest.json"
    if os.path.exists(path):
        if not resume:
            raise ResumeError(f"{folder} has a run; resume it or choose another folder")
        if read_json(path)["config_sha256"] != record["config_sha256"]:
            raise ResumeError(f"{folder} has a run of another configuration")
    write_json(path, record)


def in_chunks(rows: DataFrame, size: int) -> DataFrame:
    """rows with chunk: runs of ``size`` rows by ordinal."""
    return rows.withColumn("chunk", F.floor(F.col("ordinal") / size).cast("long"))


def finished(spark: SparkSession, folder: str) -> DataFrame | None:
    """(chunk columns, batch) of all chunks whose output is complete, or None before the first."""
    log = f"{folder}/_finished"
    return spark.read.parquet(log) if exists(spark, f"{log}/_SUCCESS") else None


def resumable(rows: DataFrame, folder: str, make: Callable[[DataFrame], DataFrame], chunk: str | Sequence[str] = "chunk", at_once: int = 64) -> DataFrame:
    """make(rows of some chunks) for every chunk, made once; a later call makes only chunks that aren't finished.

    Chunks (a column or several, such as country and number) are made ``at_once`` in one job, each batch in a folder of its own. When a
    batch is written, its chunks go to the log of finished ones, and only what the log names is ever read: a batch that was cut off
    is made again, and calls may differ in ``at_once``.
    """
    spark, keys = rows.sparkSession, [chunk] if isinstance(chunk, str) else list(chunk)
    asked, done = rows.select(*keys).distinct(), finished(spark, folder)
    todo = sorted((tuple(r) for r in (asked if done is None else asked.join(done.select(*keys), keys, "left_anti")).collect()), key=repr)  # a row per chunk
    schema = T.StructType([rows.schema[k] for k in keys])
    for i in range(0, len(todo), at_once):
        chunks = spark.createDataFrame(todo[i : i + at_once], schema)
        batch = f"batch-{uuid.uuid4().hex}"
        make(rows.join(F.broadcast(chunks), keys, "left_semi")).write.option("compression", "zstd").parquet(f"{folder}/{batch}")  # at_once rows
        chunks.withColumn("batch", F.lit(batch)).coalesce(1).write.mode("append").parquet(f"{folder}/_finished")
    done = finished(spark, folder)
    if done is None:
        return make(rows)  # no chunk, no rows
    return spark.read.parquet(*[f"{folder}/{r.batch}" for r in done.select("batch").distinct().collect()])


class Telemetry:
    """Events as JSON lines, with time and memory."""

    def __init__(self, path: str):
        self.path, self.began = path, time.monotonic()
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)

    def event(self, stage: str, **more) -> dict:
        free = os.sysconf("SC_AVPHYS_PAGES") * os.sysconf("SC_PAGE_SIZE")
        row = {"timestamp": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "wall_seconds": round(time.monotonic() - self.began, 3), "stage": stage, "peak_rss_bytes": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024, "available_bytes": free} | more
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(json.dumps(row, default=str) + "\n")
        return row
