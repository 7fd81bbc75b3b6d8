"""Sinks: result TSV, Parquet tables, JSON and text reports."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.operators.decide import matched_lists
from kinmatch.sources.files import join_files, read_whole, remove, write_whole


def _write_tsv(rows: DataFrame, path: str) -> None:
    """One file of all columns but ordinal, in its order: ranges are sorted and written in parallel, then their files are joined."""
    spark, part = rows.sparkSession, f"{path}.parts"
    columns = [c for c in rows.columns if c != "ordinal"]
    # sorted within a range of its own, so no task sorts or writes the whole; AQE may not reorder ranges
    ordered = rows.repartitionByRange("ordinal").sortWithinPartitions("ordinal").select(*columns)
    as_is = {"sep": "\t", "quote": "", "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    ordered.write.mode("overwrite").options(**as_is).csv(part)
    join_files(spark, part, path, "\t".join(columns) + "\n")
    remove(spark, part)


def write_result_tsv(spine: DataFrame, links: DataFrame, path: str, id_column: str) -> None:
    """One row per S1 of the spine (s1_id, ordinal) in its order: the sorted distinct ids, comma-separated, no quotes."""
    rows = matched_lists(spine, links, "ids").select(F.col("s1_id").alias("source1_entity_id"), F.array_join("ids", ",").alias(id_column), "ordinal")
    _write_tsv(rows, path)


def write_records(rows: DataFrame, path: str) -> None:
    """Records back to a TSV of the input's format, in file order."""
    _write_tsv(rows.select("entity_id", "business_name", "business_address", "country", "ordinal"), path)


def write_table(rows: DataFrame, path: str, *partition_by: str) -> None:
    """A Parquet table; readers see all of it or none."""
    rows.write.mode("overwrite").option("compression", "zstd").partitionBy(*partition_by).parquet(path)


def write_predictions(spine: DataFrame, before: DataFrame, after: DataFrame, path: str) -> None:
    """query_id, country, and the sorted targets before and after exclusivity."""
    rows = matched_lists(matched_lists(spine.select("s1_id", "country"), before, "before_dedup_target_ids"), after, "after_dedup_target_ids")
    write_table(rows.withColumnRenamed("s1_id", "query_id"), path)


def write_diagnostics(candidates: DataFrame, truth: DataFrame, path: str) -> None:
    """Candidates with is_ground_truth."""
    marked = candidates.join(truth.select("s1_id", "target_id", F.lit(True).alias("is_ground_truth")), ["s1_id", "target_id"], "left")
    write_table(marked.withColumn("is_ground_truth", F.coalesce("is_ground_truth", F.lit(False))), path)


def write_text(path: str, text: str) -> None:
    """From the driver: whole or not at all. A path with a scheme goes through Spark's file system, like the tables beside it."""
    if "://" in path or path.startswith("file:"):
        write_whole(SparkSession.active(), path, text)
        return
    folder = os.path.dirname(path) or "."
    os.makedirs(folder, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", encoding="utf-8", dir=folder, delete=False) as f:
        f.write(text)
    os.replace(f.name, path)


def write_json(path: str, value: object) -> None:
    write_text(path, json.dumps(value, indent=2, sort_keys=True, default=str) + "\n")


def read_json(path: str, defaults: Mapping | None = None) -> dict:
    """A JSON object over defaults; a missing file gives the defaults, if there are any."""
    if "://" in path or path.startswith("file:"):
        text = read_whole(SparkSession.active(), path)
    elif os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            text = f.read()
    else:
        text = None
    if text is None:
        if defaults is None:
            raise FileNotFoundError(path)
        return dict(defaults)
    return dict(defaults or {}) | json.loads(text)


def report_text(title: str, sections: Mapping[str, object]) -> str:
    """Sections of values, lists and tables of names."""
    lines = [title, "=" * len(title), ""]
    for name, content in sections.items():
        lines.append(f"[{name}]")
        if isinstance(content, Mapping):
            lines += [f"  {k}: {v}" for k, v in content.items()]
        elif isinstance(content, list | tuple):
            lines += [f"  - {v}" for v in content]
        else:
            lines.append(f"  {content}")
        lines.append("")
    return "\n".join(lines)
