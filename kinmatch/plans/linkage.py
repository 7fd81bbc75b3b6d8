"""Linkage from records to links, training, and evaluation that sees the truth last."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.functions.text import normalize
from kinmatch.operators import blocking, decide, evaluate, features, model, quality
from kinmatch.sources.shared import kept, release

Scorer = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Config:
    top_k: int = 50
    common_limit: int = 300
    rare_limit: int = 150
    s2_threshold: float = 0.85
    s3_threshold: float = 0.80
    near_tie: float = 0.05

    def as_dict(self) -> dict:
        return asdict(self)


def linear(pairs: DataFrame) -> DataFrame:
    """Pairs with texts to pairs with p, natively."""
    return features.native_features(pairs).withColumn("p", model.linear_score())


def trained(fitted: model.PairModel) -> Scorer:
    def score(pairs: DataFrame) -> DataFrame:
        rows = features.fuzzy_features(features.native_features(pairs)).select("s1_id", "target_id", "shared_keys", "rank", *features.NAMES)
        return fitted.probability(rows)

    return score


def _normalized(records: DataFrame) -> DataFrame:
    return records if set(features.TEXTS) <= set(records.columns) else normalize(records)


def retrieve(records: DataFrame, config: Config = Config()) -> tuple[DataFrame, DataFrame, DataFrame]:  # noqa: B008
    """(normalized S1, normalized targets, candidates) of records with a source column, normalized or not."""
    known = _normalized(records)
    s1, targets = known.where("source = 'S1'"), known.where("source <> 'S1'")
    return s1, targets, blocking.candidates(s1, targets, config.top_k, config.common_limit, config.rare_limit)


def score_candidates(s1: DataFrame, targets: DataFrame, pairs: DataFrame, scorer: Scorer = linear) -> DataFrame:
    """(s1_id, target_id, shared_keys, rank, p, s1_ordinal)."""
    scored = scorer(features.with_texts(pairs, s1, targets)).select("s1_id", "target_id", "shared_keys", "rank", "p")
    return scored.join(s1.select(F.col("entity_id").alias("s1_id"), F.col("ordinal").alias("s1_ordinal")), "s1_id")


def link(records: DataFrame, scorer: Scorer = linear, config: Config = Config()) -> DataFrame:  # noqa: B008
    """s1_id, ordinal, matched_ids: every S1 record, in one plan."""
    s1, targets, pairs = retrieve(records, config)
    links = decide.decide(score_candidates(s1, targets, pairs, scorer), config.s2_threshold, config.s3_threshold)
    return decide.matched_lists(s1.select(F.col("entity_id").alias("s1_id"), "ordinal"), links)


def train(records: DataFrame, truth: DataFrame, train_spine: DataFrame, kind: str = "boosted", config: Config = Config(), distractors: int = 50_000, **settings) -> model.PairModel:  # noqa: B008
    """Fits on all true links of the spine (s1_id) and capped hard negatives, against a reduced pool of targets."""
    # keys, pool and features read the records many times
    known = _normalized(records)
    known = known if known is records else kept(known, "records")
    s1 = known.where("source = 'S1'").join(train_spine.select(F.col("s1_id").alias("entity_id")), "entity_id", "left_semi")
    needed = truth.join(train_spine.select("s1_id"), "s1_id", "left_semi")
    targets = kept(model.reduced_pool(known.where("source <> 'S1'"), needed, distractors), "pool")
    pairs = blocking.candidates(s1, targets, config.top_k, config.common_limit, config.rare_limit)
    rows = kept(model.training_pairs(train_spine, needed, pairs, targets), "pairs")
    release(records.sparkSession)
    labels = rows.select("s1_id", "target_id", "label")
    # counted, sampled for the splits' candidates and dealt out
    full = kept(features.pair_features(rows.drop("label"), s1, targets).join(labels, ["s1_id", "target_id"]), "training")
    release(records.sparkSession)
    return model.PairModel(kind, **settings).fit(full)


def validate_model(records: DataFrame, truth: DataFrame, spine: DataFrame, scorer: Scorer, config: Config = Config()) -> tuple[DataFrame, dict]:  # noqa: B008
    """(grid of thresholds, best first; metrics at the best ones, with exclusivity)."""
    s1, targets, pairs = retrieve(records.join(spine.select(F.col("s1_id").alias("entity_id")), "entity_id", "left_semi").unionByName(records.where("source <> 'S1'")), config)
    scored = kept(score_candidates(s1, targets, pairs, scorer), "scored")  # the grid and the metrics read it
    grid = decide.search_source_thresholds(spine, truth, scored)
    best = grid.first()
    links = decide.decide(scored, best.t2, best.t3)
    found = evaluate.metrics(evaluate.entity_counts(spine, truth, links)).first().asDict()
    return grid, found | {"s2_threshold": best.t2, "s3_threshold": best.t3, "feature_names": features.NAMES}


def evaluate_run(spine: DataFrame, candidates: DataFrame, scored: Mapping[str, DataFrame], read_truth: Callable[[], DataFrame], thresholds: Mapping[str, tuple[float, float]], near_tie: float = 0.05) -> dict[str, DataFrame]:
    """Reports by name. The truth is read only here, when candidates and scores are fixed.

    For each model (its scored pairs) and threshold pair: metrics before and after exclusivity, by country too, and the errors.
    """
    # reports read candidates and scores many times
    candidates, scored = kept(candidates, "candidates"), {name: kept(pairs, "scored") for name, pairs in scored.items()}
    faults = quality.candidate_faults(candidates, spine)
    if faults.limit(1).count():
        raise ValueError(f"bad candidates: {faults.limit(5).collect()}")
    truth = read_truth()
    oracle = evaluate.restricted_oracle(truth, candidates)
    counts = evaluate.entity_counts(spine, truth, oracle, "country")
    out = {
        "recall": evaluate.candidate_recall(truth, candidates, spine),
        "candidates": evaluate.candidate_statistics(evaluate.per_entity(spine, candidates)),
        "histogram": evaluate.candidate_histogram(evaluate.per_entity(spine, candidates)),
        "oracle": evaluate.metrics(counts).withColumn("recommendation", evaluate.recommendation(F.col("macro_f05"))),
        "oracle_by_country": evaluate.metrics(counts, "country"),
    }
    for name, pairs in scored.items():
        for label, (s2, s3) in thresholds.items():
            before = decide.accept(pairs, s2, s3)
            after = decide.one_owner(before)
            for state, links in (("before", before), ("after", after)):
                own = evaluate.entity_counts(spine, truth, links, "country")
                out[f"{name}_{label}_{state}"] = evaluate.metrics(own)
                out[f"{name}_{label}_{state}_by_country"] = evaluate.metrics(own, "country")
                out[f"{name}_{label}_{state}_links"] = evaluate.link_metrics(truth, links)
            out[f"{name}_{label}_errors"] = evaluate.decompose_errors(truth, pairs, s2, s3, near_tie)
    return out
