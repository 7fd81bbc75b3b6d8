"""Models over the 32 features: gradient-boosted trees, and a fixed linear scorer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kinmatch.operators import trees
from kinmatch.operators.features import NAMES, check_schema

# --- fixed values: settings by kind; trees grow by depth, so the number of leaves isn't one of them ---
PRESETS = {
    "boosted": {"maxIter": 400, "stepSize": 0.035, "maxDepth": 7, "subsamplingRate": 0.85, "featureSubsetStrategy": "0.85", "minInstancesPerNode": 30, "seed": 42},
    "histogram": {"maxIter": 300, "stepSize": 0.05, "maxDepth": 5, "maxBins": 255, "seed": 42},
}

#: Weights of the linear scorer, for tests and as a start without training data: native features only.
LINEAR = {"name_lev_sim": 0.25, "name_token_jaccard": 0.25, "name_char_3gram": 0.15, "addr_token_jaccard": 0.2, "addr_lev_sim": 0.1, "num_has_match": 0.05}


class PairModel:
    """fit, probability, save and load of one kind of model."""

    def __init__(self, kind: str = "boosted", **settings):
        if kind not in PRESETS:
            raise ValueError(f"kind must be one of {sorted(PRESETS)}")
        self.kind, self.settings, self.model = kind, PRESETS[kind] | settings, None

    def fit(self, rows: DataFrame, label: str = "label", weight: str | None = None) -> PairModel:
        """rows: the features (as float, like what is scored), a 0/1 label and perhaps a weight."""
        check_schema([c for c in rows.columns if c in NAMES])
        self.model = trees.fit(as_float(rows), NAMES, label, weight, **self.settings)
        return self

    def probability(self, rows: DataFrame, name: str = "p") -> DataFrame:
        """rows with the probability of a link."""
        if self.model is None:
            raise ValueError("the model isn't fitted")
        return as_float(rows).withColumn(name, trees.probability(self.model, *NAMES))

    def save(self, path: str) -> None:
        if self.model is None:
            raise ValueError("the model isn't fitted")
        self.model.save(SparkSession.active(), path)

    @classmethod
    def load(cls, path: str, kind: str = "boosted") -> PairModel:
        out = cls(kind)
        out.model = trees.Forest.load(SparkSession.active(), path)
        return out

    def describe(self) -> dict:
        return {"class": type(self).__name__, "kind": self.kind, "settings": self.settings, "features": NAMES}


def as_float(rows: DataFrame) -> DataFrame:
    return rows.withColumns({n: F.col(n).cast("float") for n in NAMES})


def linear_score() -> Column:
    """A fixed weighted sum of native features, 0 to 1."""
    return sum((F.col(n) * w for n, w in LINEAR.items()), F.lit(0.0))


def mean_of(*columns: str) -> Column:
    """An ensemble: the mean of several probabilities."""
    return sum((F.col(c) for c in columns), F.lit(0.0)) / len(columns)


def training_pairs(spine: DataFrame, truth: DataFrame, candidates: DataFrame, targets: DataFrame, least: int = 2, factor: int = 2) -> DataFrame:
    """(s1_id, target_id, shared_keys, rank, label): every true link whose target is loaded (1 shared key if blocking missed it), and
    the first max(least, factor * positives) other candidates in rank order of each S1 of the spine."""
    loaded = truth.join(targets.select(F.col("entity_id").alias("target_id")).distinct(), "target_id", "left_semi").join(spine.select("s1_id"), "s1_id", "left_semi").select("s1_id", "target_id").distinct()
    key = ["s1_id", "target_id"]
    positive = loaded.join(candidates.select(*key, "shared_keys", "rank"), key, "left").select(*key, F.coalesce("shared_keys", F.lit(1).cast("long")).alias("shared_keys"), F.col("rank"), F.lit(1).alias("label"))
    wrong = candidates.join(spine.select("s1_id"), "s1_id", "left_semi").join(loaded, key, "left_anti")
    n_pos = loaded.groupBy("s1_id").agg(F.count("*").alias("n_pos"))
    wrong = wrong.join(n_pos, "s1_id", "left").withColumn("k", F.row_number().over(W.partitionBy("s1_id").orderBy("rank")))
    negative = wrong.where(F.col("k") <= F.greatest(F.lit(least), factor * F.coalesce("n_pos", F.lit(0)))).select(*key, "shared_keys", "rank", F.lit(0).alias("label"))
    return positive.unionByName(negative)


def reduced_pool(targets: DataFrame, needed: DataFrame, distractors: int = 50_000) -> DataFrame:
    """Targets (entity_id, source, ordinal) that are needed, and the first others of each source in file order."""
    asked = needed.select(F.col("target_id").alias("entity_id")).distinct()
    others = targets.join(asked, "entity_id", "left_anti")
    # the order is cut twice, within runs of file order first, so that no source is sorted in one task
    run = F.floor(F.col("ordinal") / (8 * distractors))
    near = others.withColumn("_k", F.row_number().over(W.partitionBy("source", run).orderBy("ordinal"))).where(F.col("_k") <= distractors)
    kept = near.withColumn("_k", F.row_number().over(W.partitionBy("source").orderBy("ordinal"))).where(F.col("_k") <= distractors).drop("_k")
    return targets.join(asked, "entity_id", "left_semi").unionByName(kept)


def first_by_ordinal(rows: DataFrame, n: int) -> DataFrame:
    """The first n rows in file order."""
    return rows.orderBy("ordinal").limit(n)
