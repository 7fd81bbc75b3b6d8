"""Scans of linkage data: quote-free TSV, id lists, ground truth, candidate files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kinmatch.sources.files import exists

RECORD = ("entity_id", "business_name", "business_address", "country")
TRUTH = ("source1_entity_id", "matched_entity_ids")


class InputError(ValueError):
    """The input breaks a rule that its reader states."""


def _tsv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Fixed columns by position: the header is skipped, blank lines too; missing columns are empty, further ones ignored."""
    schema = ", ".join(f"{c} string" for c in columns)
    rows = spark.read.option("sep", "\t").option("header", True).option("enforceSchema", True).option("quote", "").option("mode", "PERMISSIVE").schema(schema).csv(path)
    filled = rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])
    return filled.withColumn("ordinal", F.monotonically_increasing_id())  # the order of the file, as one file is split in order


def read_records(spark: SparkSession, path: str, country: str | None = None, last_wins: bool = False, source: str | None = None) -> DataFrame:
    """entity_id, business_name, business_address, country, ordinal, source (of the id's prefix, unless given).

    last_wins: of rows that share an id the last stays (a lookup); otherwise all stay (a stream).
    """
    rows = _tsv(spark, path, RECORD)
    if country is not None:
        rows = rows.where(F.col("country") == country)
    if last_wins:
        rows = last_of_each(rows)
    return rows.withColumn("source", F.lit(source) if source else F.split("entity_id", "-")[0])


def last_of_each(rows: DataFrame, key: str = "entity_id") -> DataFrame:
    """The last row of each id in file order."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), "ordinal").alias("_r")).select(key, "_r.*").select(*rows.columns)


def read_targets(spark: SparkSession, *paths: str, warnings: list[str] | None = None) -> DataFrame:
    """Records of several files, later files after earlier ones; a missing file is left out, with a warning."""
    out = None
    for i, path in enumerate(paths):
        if not exists(spark, path):
            if warnings is not None:
                warnings.append(f"{path} is missing")
            continue
        rows = read_records(spark, path).withColumn("ordinal", F.col("ordinal") + (i << 55))
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], "entity_id string, business_name string, business_address string, country string, ordinal long, source string")


def read_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(spine: s1_id, ordinal; links: s1_id, target_id). Blank ids are dropped; of rows that share an S1 the last counts."""
    rows = last_of_each(_tsv(spark, path, TRUTH).withColumnRenamed(TRUTH[0], "s1_id"), "s1_id")
    ids = F.filter(F.transform(F.split(TRUTH[1], ","), lambda x: F.trim(x)), lambda x: x != "")
    return rows.select("s1_id", "ordinal"), rows.select("s1_id", F.explode(F.array_distinct(ids)).alias("target_id"))


def read_selected_truth(spark: SparkSession, path: str, selected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As read_truth, for the S1 ids of ``selected`` (entity_id, ordinal) only and in their order.

    A selected id without a row, or with more than one, is an error.
    """
    rows = _tsv(spark, path, TRUTH).withColumnRenamed(TRUTH[0], "s1_id")
    asked = selected.select(F.col("entity_id").alias("s1_id"), F.col("ordinal").alias("_place"))
    counts = asked.join(rows.groupBy("s1_id").agg(F.count("*").alias("n")), "s1_id", "left")
    wrong = counts.where("n is null or n > 1").orderBy("_place").limit(5).collect()
    if wrong:
        raise InputError("; ".join(f"{r.s1_id} has {'no row' if r.n is None else f'{r.n} rows'} in {path}" for r in wrong))
    spine, links = read_truth(spark, path)
    chosen = spine.drop("ordinal").join(asked, "s1_id").select("s1_id", F.col("_place").alias("ordinal"))
    return chosen, links.join(asked.select("s1_id"), "s1_id", "left_semi")


def read_ids(spark: SparkSession, path: str, limit: int | None = None, strict: bool = False) -> DataFrame:
    """entity_id, ordinal of a list with an id on each line, blank lines dropped; the first ``limit``.

    strict: repeated ids or too few are an error; else each id counts once, where it first stands.
    """
    rows = spark.read.text(path).select(F.trim("value").alias("entity_id"), F.monotonically_increasing_id().alias("ordinal")).where("entity_id <> ''")
    once = rows.groupBy("entity_id").agg(F.min("ordinal").alias("ordinal"), F.count("*").alias("n"))
    if strict and once.where("n > 1").limit(1).count():
        raise InputError(f"{path} repeats ids")
    first = once.select("entity_id", "ordinal")
    if limit is not None:
        first = first.orderBy("ordinal").limit(limit)
        if strict and first.count() < limit:
            raise InputError(f"{path} has fewer than {limit} ids")
    return first


def read_first_column(spark: SparkSession, path: str) -> DataFrame:
    """The distinct trimmed ids of a TSV's first column."""
    return _tsv(spark, path, ("entity_id",)).select(F.trim("entity_id").alias("entity_id")).where("entity_id <> ''").distinct()


def read_valid_lines(spark: SparkSession, path: str, country: str | None = None, limit: int | None = None) -> DataFrame:
    """Records of the lines that are UTF-8, the others skipped."""
    lines = spark.read.text(path).withColumn("ordinal", F.monotonically_increasing_id()).where("ordinal > 0 and is_valid_utf8(value) and trim(value) <> ''")
    parts = F.split("value", "\t")
    rows = lines.select(*[F.coalesce(F.get(parts, i), F.lit("")).alias(c) for i, c in enumerate(RECORD)], "ordinal")
    if country is not None:
        rows = rows.where(F.col("country") == country)
    return rows if limit is None else rows.orderBy("ordinal").limit(limit)


def countries(records: DataFrame) -> DataFrame:
    """Distinct countries that aren't empty, in order of first appearance."""
    return records.where("country <> ''").groupBy("country").agg(F.min("ordinal").alias("ordinal")).orderBy("ordinal").select("country")


def select_records(records: DataFrame, ids: DataFrame) -> DataFrame:
    """The records of a list of ids; one that is missing or comes twice is an error."""
    chosen = records.join(ids.select("entity_id"), "entity_id", "left_semi")
    if chosen.groupBy("entity_id").count().where("count > 1").limit(1).count():
        raise InputError("selected ids have more than one record")
    if ids.join(records.select("entity_id"), "entity_id", "left_anti").limit(1).count():
        raise InputError("selected ids have no record")
    return chosen


def require_ids(records: DataFrame) -> DataFrame:
    """The records, unless one has a blank id."""
    first = records.where(F.trim("entity_id") == "").agg(F.min("ordinal")).first()[0]
    if first is not None:
        raise InputError(f"record {records.where(F.col('ordinal') < first).count() + 1} has a blank id")
    return records


def read_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """All finished candidate files of a folder, with the file each row is from."""
    if not exists(spark, f"{folder}/_SUCCESS"):
        raise InputError(f"{folder} isn't finished")
    return spark.read.parquet(folder).withColumn("file", F.col("_metadata.file_path"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Dense ordinals by an order, in two levels: within ranges, and over the ranges' sizes."""
    spread = rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    sizes = spread.groupBy("_p").agg(F.count("*").alias("n"))
    before = sizes.select("_p", (F.sum("n").over(W.orderBy("_p")) - F.col("n")).alias("_before"))
    within = spread.withColumn("_w", F.row_number().over(W.partitionBy("_p").orderBy(*order)))
    return within.join(F.broadcast(before), "_p").withColumn("ordinal", F.col("_before") + F.col("_w") - 1).drop("_p", "_w", "_before")  # a row per partition
