"""Evaluation: per-entity scores, recall at cut-offs, candidate statistics, error decomposition, hashes and diagnostics."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kinmatch.operators import blocking
from kinmatch.operators.decide import accept, f05
from kinmatch.sources.shared import kept

CUTOFFS = (1, 5, 10, 20, 50)
BUCKETS = ("0", "1", "2-5", "6-20", "21-50", ">50")
NEAR_TIE = 0.05


def _zero(name: str) -> Column:
    return F.coalesce(name, F.lit(0).cast("long")).alias(name)


def entity_counts(spine: DataFrame, truth: DataFrame, links: DataFrame, *more: str) -> DataFrame:
    """For each S1 of the spine: n_true, n_pred, tp, f05, f1. Links of other S1 are ignored; all are sets."""
    key = ["s1_id", "target_id"]
    both = truth.select(*key).distinct().withColumn("t", F.lit(1)).join(links.select(*key).distinct().withColumn("p", F.lit(1)), key, "full")
    counts = both.groupBy("s1_id").agg(F.count("t").alias("n_true"), F.count("p").alias("n_pred"), F.count_if(F.col("t").isNotNull() & F.col("p").isNotNull()).alias("tp"))
    rows = spine.select("s1_id", *more).join(counts, "s1_id", "left").select("s1_id", *more, _zero("n_true"), _zero("n_pred"), _zero("tp"))
    tp, n_true, n_pred = F.col("tp"), F.col("n_true"), F.col("n_pred")
    return rows.withColumns({"f05": f05(tp, n_true, n_pred), "f1": F.when((n_true == 0) & (n_pred == 0), 1.0).otherwise(F.when(tp == 0, 0.0).otherwise(2 * tp / (n_true + n_pred)))})


def metrics(counts: DataFrame, *by: str) -> DataFrame:
    """Totals, micro precision and recall, macro F0.5 over all S1, macro F1 over those with links, singleton accuracy."""
    tp, pred, true = F.sum("tp"), F.sum("n_pred"), F.sum("n_true")
    single = F.col("n_true") == 0
    return counts.groupBy(*by).agg(
        F.count("*").alias("entities"), tp.alias("tp"), (pred - tp).alias("fp"), (true - tp).alias("fn"), pred.alias("pred_links"), true.alias("true_links"),
        F.when(pred > 0, tp / pred).otherwise(1.0).alias("precision"), F.when(true > 0, tp / true).otherwise(0.0).alias("recall"),
        F.avg("f05").alias("macro_f05"), F.coalesce(F.avg(F.when(~single, F.col("f1"))), F.lit(0.0)).alias("macro_f1_linked"),
        F.count_if(single).alias("singletons"), F.count_if(single & (F.col("n_pred") == 0)).alias("singletons_right"),
        F.coalesce(F.avg(F.when(single, (F.col("n_pred") == 0).cast("double"))), F.lit(1.0)).alias("singleton_accuracy"),
    )


def of_source(frame: DataFrame, prefix: str) -> DataFrame:
    return frame.where(F.col("target_id").startswith(prefix))


def source_report(spine: DataFrame, truth: DataFrame, links: DataFrame, candidates: DataFrame, prefixes: Sequence[str] = ("S2-", "S3-")) -> DataFrame:
    """metrics restricted to each source, with candidate recall and pair counts; a singleton has no truth in that source."""
    out = None
    for prefix in prefixes:
        t, c = of_source(truth, prefix), of_source(candidates, prefix)
        own = metrics(entity_counts(spine, t, of_source(links, prefix)))
        found = t.select("s1_id", "target_id").distinct().join(c.select("s1_id", "target_id").distinct(), ["s1_id", "target_id"], "left_semi").agg(F.count("*").alias("retrieved"))
        row = own.crossJoin(F.broadcast(found)).crossJoin(F.broadcast(c.agg(F.count("*").alias("candidate_pairs"))))  # one row each
        row = row.withColumns({"source": F.lit(prefix), "candidate_recall": F.when(F.col("true_links") > 0, F.col("retrieved") / F.col("true_links")).otherwise(0.0)})
        out = row if out is None else out.unionByName(row)
    return out


def link_metrics(truth: DataFrame, links: DataFrame) -> DataFrame:
    """tp, fp, fn, precision and recall per source, S2 and S3 in any case; null where the denominator is 0."""
    key = ["s1_id", "target_id"]
    both = truth.select(*key).distinct().withColumn("t", F.lit(1)).join(links.select(*key).distinct().withColumn("p", F.lit(1)), key, "full")
    counts = both.groupBy(F.substring("target_id", 1, 2).alias("source")).agg(F.count_if(F.col("t").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    ratio = lambda n, d: F.when(d > 0, n / d)
    both_sources = truth.sparkSession.createDataFrame([("S2",), ("S3",)], "source string")
    counts = both_sources.join(counts, "source", "full").select("source", _zero("tp"), _zero("fp"), _zero("fn"))
    return counts.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})


def candidate_recall(truth: DataFrame, candidates: DataFrame, countries: DataFrame, cutoffs: Sequence[int] = CUTOFFS) -> DataFrame:
    """source, country (null: all), links, and recall at each cut-off of the global rank. countries: s1_id, country."""
    marked = truth.select("s1_id", "target_id").join(candidates.select("s1_id", "target_id", "rank"), ["s1_id", "target_id"], "left").join(countries.select("s1_id", "country"), "s1_id")
    marked = marked.withColumn("source", F.substring("target_id", 1, 2))
    hits = [F.count_if(F.col("rank") <= k).alias(f"hit_{k}") for k in cutoffs]
    sets = marked.groupingSets([[], [F.col("source")], [F.col("country")], [F.col("country"), F.col("source")]], "source", "country").agg(F.count("*").alias("links"), F.count("rank").alias("hit_all"), *hits)
    names = [*(f"hit_{k}" for k in cutoffs), "hit_all"]
    return sets.select("source", "country", "links", *names, *[F.when(F.col("links") > 0, F.col(n) / F.col("links")).alias(n.replace("hit", "recall")) for n in names])


def bucket(n: Column) -> Column:
    return F.when(n == 0, "0").when(n == 1, "1").when(n <= 5, "2-5").when(n <= 20, "6-20").when(n <= 50, "21-50").otherwise(">50")


def per_entity(spine: DataFrame, candidates: DataFrame) -> DataFrame:
    counts = candidates.groupBy("s1_id").agg(F.count("*").alias("n"))
    return spine.select("s1_id").join(counts, "s1_id", "left").select("s1_id", _zero("n"))


def candidate_histogram(counts: DataFrame) -> DataFrame:
    """bucket, entities: every bucket, empty ones too."""
    spine = counts.sparkSession.createDataFrame([(b,) for b in BUCKETS], "bucket string")
    return spine.join(counts.groupBy(bucket(F.col("n")).alias("bucket")).agg(F.count("*").alias("entities")), "bucket", "left").select("bucket", _zero("entities"))


def nearest_rank(n: str, q: float) -> Column:
    """The value at index round((count - 1) * q), halves to even, of the values in order.

    Values are counted first and the index is found in the running counts, so no list of all values is made.
    """
    return F.expr(f"min(case when upto > bround((total - 1) * {q}) then {n} end)")


def candidate_statistics(counts: DataFrame) -> DataFrame:
    """One row: mean, max, total, zeros, nearest-rank and interpolated percentiles of candidates per S1."""
    values = counts.groupBy("n").agg(F.count("*").alias("c"))  # few distinct values
    order = W.orderBy("n")
    ranked = values.withColumns({"upto": F.sum("c").over(order), "total": F.sum("c").over(W.partitionBy(F.lit(1)))})
    ranks = ranked.agg(*[nearest_rank("n", q).alias(f"p{round(q * 100)}") for q in (0.5, 0.9, 0.95, 0.99)])
    plain = counts.agg(F.count("*").alias("entities"), F.sum("n").alias("pairs"), F.avg("n").alias("mean"), F.max("n").alias("largest"), F.count_if(F.col("n") == 0).alias("without"), F.median("n").alias("median"), F.percentile("n", 0.95).alias("interpolated_p95"))
    return plain.crossJoin(F.broadcast(ranks))  # one row each


def restricted_oracle(truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """True links among the candidates: the best any model could do."""
    return truth.select("s1_id", "target_id").join(candidates.select("s1_id", "target_id"), ["s1_id", "target_id"], "left_semi")


def decompose_errors(truth: DataFrame, scored: DataFrame, s2: float, s3: float, margin: float = NEAR_TIE) -> DataFrame:
    """kind (fn or fp), category, links: where missed links went missing, and what wrong links look like.

    A wrong link is a near tie if the two best accepted scores for its target are within the margin.
    """
    key = ["s1_id", "target_id"]
    # one window over the accepted pairs of a target tells the owner, the gap to the next and what was lost
    best = W.partitionBy("target_id").orderBy(F.desc("p"), "s1_ordinal" if "s1_ordinal" in scored.columns else "s1_id")
    above = accept(scored, s2, s3).withColumns({"r": F.row_number().over(best), "gap": F.col("p") - F.lead("p").over(best)})
    state = scored.select(*key, F.lit(1).alias("seen")).join(above.select(*key, "r", "gap"), key, "left")
    known = truth.select(*key).distinct().withColumn("linked", F.lit(1)).join(kept(state, "states"), key, "full")
    missed = known.where("linked is not null and (r is null or r > 1)")
    why = F.when(F.col("seen").isNull(), "not_retrieved").when(F.col("r").isNull(), "below_threshold").otherwise("lost_by_uniqueness")
    wrong = known.where("linked is null and r = 1")
    how = F.when(F.col("gap") <= margin, "near_tie").otherwise("non_ambiguous")
    spine = truth.sparkSession.createDataFrame([("fn", "not_retrieved"), ("fn", "below_threshold"), ("fn", "lost_by_uniqueness"), ("fp", "near_tie"), ("fp", "non_ambiguous"), ("fp", "other")], "kind string, category string")
    counts = missed.select(F.lit("fn").alias("kind"), why.alias("category")).unionByName(wrong.select(F.lit("fp").alias("kind"), how.alias("category"))).groupBy("kind", "category").agg(F.count("*").alias("links"))
    return spine.join(counts, ["kind", "category"], "left").select("kind", "category", _zero("links"))


# --- fixed values: oracle scores from which recommendation B, and then C, is given ---
LEAST_B, LEAST_C = 0.985, 0.995


def recommendation(oracle_f05: Column) -> Column:
    return F.when(oracle_f05 < LEAST_B, "A").when(oracle_f05 < LEAST_C, "B").otherwise("C")


def candidate_hashes(candidates: DataFrame) -> DataFrame:
    """s1_id, sha256 of its candidates' lines (id, candidate, rank and shared keys) in rank order."""
    line = F.concat(F.col("s1_id"), F.lit("|"), F.col("target_id"), F.lit("|"), F.col("rank").cast("string"), F.lit("|"), F.col("shared_keys").cast("string"), F.lit("\n"))
    rows = candidates.select("s1_id", F.struct("rank", line.alias("line")).alias("x"))
    return rows.groupBy("s1_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), ""), 256).alias("hash"))


def candidate_set_hash(candidates: DataFrame, spine: DataFrame) -> str:
    """One digest of the whole set in the spine's order: each S1's id and its candidates in rank order, every field ended by a zero byte.

    Lines are made and ordered by Spark; the driver takes them in order, a range at a time, and only feeds the digest.
    """
    digest = hashlib.sha256()
    rows = candidates.select("s1_id", F.struct("rank", F.col("target_id")).alias("x")).groupBy("s1_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["target_id"]).alias("ids"))
    lines = spine.select("s1_id", "ordinal").join(rows, "s1_id", "left").select("ordinal", F.concat(F.array_join(F.concat(F.array("s1_id"), F.coalesce("ids", F.array().cast("array<string>"))), "\0"), F.lit("\0")).alias("line"))
    for r in lines.orderBy("ordinal").select("line").toLocalIterator(prefetchPartitions=True):
        digest.update(r.line.encode())
    return digest.hexdigest()


def density(records: DataFrame) -> DataFrame:
    """source, country, records, percent of the source's records."""
    counts = records.groupBy("source", "country").agg(F.count("*").alias("records"))
    return counts.withColumn("percent", 100 * F.col("records") / F.sum("records").over(W.partitionBy("source")))


def blocking_study(truth: DataFrame, s1_keys: DataFrame, target_keys: DataFrame, common: int | None, rare: int | None, cutoffs: Sequence[int] = (20, 50)) -> DataFrame:
    """Recall of pairs by shared keys, without a limit and at cut-offs of their rank; limits of None keep all keys.

    Only S1 records that the truth asks for are ranked, and only as far as the largest cut-off; whether a true pair shares a key at all is
    asked of its two records.
    """
    key = ["s1_id", "target_id"]
    asked = s1_keys.join(truth.select(F.col("s1_id").alias("entity_id")).distinct(), "entity_id", "left_semi")
    if common is None or rare is None:
        first = blocking.first_candidates(asked, target_keys, max(cutoffs))
    else:
        target_keys = target_keys.join(blocking.capped_keys(target_keys, common, rare).select(*blocking.KEY), blocking.KEY, "left_semi")
        first = blocking.top_candidates(blocking.shared_keys(asked, target_keys, None, None), max(cutoffs))
    found = blocking.retrieved(truth, asked, target_keys).withColumn("found", F.lit(1))
    ranked = truth.select(*key).join(found, key, "left").join(first.select(*key, "rank"), key, "left")
    return ranked.agg(F.count("*").alias("links"), F.count("found").alias("hit_all"), *[F.count_if(F.col("rank") <= k).alias(f"hit_{k}") for k in cutoffs])


def retrieval_categories(truth: DataFrame, pairs: DataFrame, k: int = 20) -> DataFrame:
    """category, links: within the first k, retrieved later, not retrieved."""
    ranked = truth.select("s1_id", "target_id").join(pairs.select("s1_id", "target_id", "rank"), ["s1_id", "target_id"], "left")
    return ranked.groupBy(F.when(F.col("rank") <= k, "within_k").when(F.col("rank").isNotNull(), "retrieved").otherwise("not_retrieved").alias("category")).agg(F.count("*").alias("links"))


def summary(spine: DataFrame, links: DataFrame) -> DataFrame:
    """One row: S1 records, those with and without links, links by source."""
    counts = links.groupBy("s1_id").agg(F.count("*").alias("n"), F.count_if(F.col("target_id").startswith("S2-")).alias("n2"))
    rows = spine.select("s1_id").join(counts, "s1_id", "left")
    return rows.agg(F.count("*").alias("entities"), F.count_if(F.col("n").isNull()).alias("singletons"), F.count("n").alias("matched"), F.coalesce(F.sum("n2"), F.lit(0)).alias("s2_links"), (F.coalesce(F.sum("n"), F.lit(0)) - F.coalesce(F.sum("n2"), F.lit(0))).alias("s3_links"))
