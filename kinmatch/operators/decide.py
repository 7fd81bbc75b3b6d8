"""From scores to links: per-source thresholds, one owner per target, threshold search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# --- fixed values: threshold grids, as literals since sums of steps aren't exact ---
GLOBAL_GRID = tuple(round(0.30 + 0.02 * i, 2) for i in range(31))
SOURCE_GRID = tuple(round(0.40 + 0.05 * i, 2) for i in range(10))


def source_threshold(s2: float, s3: float, target: str = "target_id") -> Column:
    """The threshold of a target: any that isn't S2's takes S3's."""
    return F.when(F.col(target).startswith("S2-"), F.lit(s2)).otherwise(F.lit(s3))


def accept(scored: DataFrame, s2: float = 0.5, s3: float = 0.5) -> DataFrame:
    """Pairs (s1_id, target_id, p) at or above their source's threshold."""
    return scored.where(F.col("p") >= source_threshold(s2, s3))


def accept_strict(scored: DataFrame, s2: float, s3: float) -> DataFrame:
    """As accept, but only targets named S2- or S3- pass (as in the search for thresholds)."""
    known = F.col("target_id").startswith("S2-") | F.col("target_id").startswith("S3-")
    return accept(scored.where(known), s2, s3)


def one_owner(accepted: DataFrame) -> DataFrame:
    """Each target stays with the S1 of the highest p; ties go to the smaller s1_ordinal (s1_id without one)."""
    tie = "s1_ordinal" if "s1_ordinal" in accepted.columns else "s1_id"
    order = W.partitionBy("target_id").orderBy(F.desc("p"), tie)
    return accepted.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def decide(scored: DataFrame, s2: float = 0.5, s3: float = 0.5) -> DataFrame:
    """Threshold, then exclusivity."""
    return one_owner(accept(scored, s2, s3))


def matched_lists(spine: DataFrame, links: DataFrame, name: str = "matched_ids") -> DataFrame:
    """Every S1 of the spine (s1_id) with the sorted array of its targets; none: empty."""
    lists = links.groupBy("s1_id").agg(F.array_sort(F.collect_set("target_id")).alias(name))
    return spine.join(lists, "s1_id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))


def f05(tp: Column, n_true: Column, n_pred: Column) -> Column:
    """F0.5 of one entity by its counts: 1 if both sets are empty, 0 if one is or nothing is common."""
    p, r = tp / n_pred, tp / n_true
    return F.when((n_true == 0) & (n_pred == 0), F.lit(1.0)).when((n_true == 0) | (n_pred == 0) | (tp == 0), F.lit(0.0)).otherwise(1.25 * p * r / (0.25 * p + r))


def _grid(spark: SparkSession, name: str, values: Sequence[float]) -> DataFrame:
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], f"{name}_no int, {name} double")


def _accepted_counts(scored: DataFrame, truth: DataFrame, grids: dict[str, Sequence[float]]) -> DataFrame:
    """s1_id, and for each prefix of targets arrays over its grid: pairs (n) and true pairs (tp) at or above each value.

    One pass over the pairs and one row per S1, whatever the grids' sizes.
    """
    marked = scored.join(truth.select("s1_id", "target_id", F.lit(1).alias("hit")), ["s1_id", "target_id"], "left")
    at_least = lambda prefix, v: F.col("target_id").startswith(prefix) & (F.col("p") >= v)
    arrays = [F.array(*[F.count_if(at_least(prefix, v) & test) for v in grid]).alias(f"{name}{prefix[:2]}") for prefix, grid in grids.items() for name, test in (("n", F.lit(True)), ("tp", F.col("hit").isNotNull()))]
    return marked.groupBy("s1_id").agg(*arrays)


def _with_zeros(rows: DataFrame, counts: DataFrame, grids: dict[str, Sequence[float]]) -> DataFrame:
    zero = lambda grid: F.array(*[F.lit(0).cast("long")] * len(grid))
    names = {f"{name}{prefix[:2]}": grid for prefix, grid in grids.items() for name in ("n", "tp")}
    return rows.join(counts, "s1_id", "left").withColumns({name: F.coalesce(name, zero(grid)) for name, grid in names.items()})


def _true_counts(spine: DataFrame, truth: DataFrame) -> DataFrame:
    return spine.select("s1_id").join(truth.groupBy("s1_id").agg(F.count("*").alias("n_true")), "s1_id", "left").withColumn("n_true", F.coalesce("n_true", F.lit(0).cast("long")))


def search_source_thresholds(spine: DataFrame, truth: DataFrame, scored: DataFrame, s2_grid: Sequence[float] = SOURCE_GRID, s3_grid: Sequence[float] = SOURCE_GRID) -> DataFrame:
    """t2, t3, macro_f05 for the whole grid, best first (ties: the smaller t2, then t3). No exclusivity here.

    Counts per S1 are made once for both sources' grids; an S1 then gives a row for each of S2's thresholds, with S3's beside each
    other, so pairs aren't multiplied by the grid.
    """
    grids = {"S2-": s2_grid, "S3-": s3_grid}
    rows = _with_zeros(_true_counts(spine, truth), _accepted_counts(scored, truth, grids), grids)
    # after the join two columns are enough for a cell, so the aggregate stays narrow
    by_t2 = rows.select("n_true", "nS3", "tpS3", F.posexplode(F.arrays_zip(F.col("nS2").alias("n"), F.col("tpS2").alias("tp"))).alias("i", "own"))
    means = [F.avg(f05(F.col("own.tp") + F.get("tpS3", j), F.col("n_true"), F.col("own.n") + F.get("nS3", j))) for j in range(len(s3_grid))]
    cells = by_t2.groupBy("i").agg(F.array(*[F.struct(F.lit(float(v)).alias("t3"), m.alias("macro_f05")) for v, m in zip(s3_grid, means, strict=True)]).alias("cells"))
    t2 = F.element_at(F.array(*[F.lit(float(v)) for v in s2_grid]), F.col("i") + 1)
    return cells.select(t2.alias("t2"), F.inline("cells")).orderBy(F.desc(F.round("macro_f05", 9)), "t2", "t3")


def search_global_threshold(spine: DataFrame, truth: DataFrame, scored: DataFrame, grid: Sequence[float] = GLOBAL_GRID) -> DataFrame:
    """threshold, macro_f05 for one threshold for all, best first (ties: the smaller)."""
    grids = {"": grid}
    rows = _with_zeros(_true_counts(spine, truth), _accepted_counts(scored, truth, grids), grids)
    entry = [F.struct(F.lit(float(v)).alias("threshold"), F.avg(f05(F.get("tp", i), F.col("n_true"), F.get("n", i))).alias("macro_f05")) for i, v in enumerate(grid)]
    return rows.agg(F.array(*entry).alias("cells")).select(F.inline("cells")).orderBy(F.desc(F.round("macro_f05", 9)), "threshold")
