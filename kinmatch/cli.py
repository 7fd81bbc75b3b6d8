"""Commands over TSV files: a folder holds {prefix}_source1.tsv, _source2.tsv, _source3.tsv and perhaps a ground truth."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.functions.text import normalize, observed_table
from kinmatch.operators import decide, evaluate, features, model, quality
from kinmatch.plans import linkage
from kinmatch.sources import files, runs, scans, sinks

#: Thresholds where no metadata say otherwise.
DEFAULTS = {"best_s2_threshold": 0.75, "best_s3_threshold": 0.85}


def session() -> SparkSession:
    return SparkSession.builder.appName("kinmatch").config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def source_path(spark: SparkSession, folder: str, number: int) -> str:
    """The file of a source, by either prefix."""
    names = [f"{folder}/{p}_source{number}.tsv" for p in ("test", "train")]
    found = files.first_existing(spark, *names)
    if found is None:
        raise scans.InputError(f"none of {', '.join(names)} is there")
    return found


def load(spark: SparkSession, folder: str, said: list[str]) -> DataFrame:
    """S1, S2 and S3 records of a folder; of targets that share an id the last counts."""
    s1 = scans.read_records(spark, source_path(spark, folder, 1), source="S1")
    names = [files.first_existing(spark, *(f"{folder}/{p}_source{k}.tsv" for p in ("test", "train"))) or f"{folder}/test_source{k}.tsv" for k in (2, 3)]
    return s1.unionByName(scans.last_of_each(scans.read_targets(spark, *names, warnings=said)))


def config(args: argparse.Namespace, metadata: dict) -> linkage.Config:
    return linkage.Config(top_k=args.top_k, s2_threshold=metadata["best_s2_threshold"], s3_threshold=metadata["best_s3_threshold"])


def train(spark: SparkSession, args: argparse.Namespace) -> int:
    """Fits on the first S1 records that aren't held out, searches thresholds on the held-out ones, saves model and metadata."""
    records = load(spark, args.data, [])
    _, truth = scans.read_truth(spark, f"{args.data}/train_ground_truth.tsv")
    s1 = records.where("source = 'S1'").select(F.col("entity_id").alias("s1_id"), "ordinal")
    if args.holdout_ids:
        held = scans.read_ids(spark, args.holdout_ids, args.holdout).select(F.col("entity_id").alias("s1_id"))
    else:
        held = model.first_by_ordinal(s1, args.holdout).select("s1_id")
    fit = model.first_by_ordinal(s1.join(held, "s1_id", "left_anti"), args.sample).select("s1_id")
    fitted = linkage.train(records, truth, fit, args.kind, linkage.Config(top_k=args.top_k), args.distractors, **({"maxIter": args.trees} if args.trees else {}))
    grid, found = linkage.validate_model(records, truth, held, linkage.trained(fitted), linkage.Config(top_k=args.top_k))
    fitted.save(f"{args.model}/trees")
    metadata = {k: v for k, v in found.items() if k not in ("s2_threshold", "s3_threshold")} | {"best_s2_threshold": found["s2_threshold"], "best_s3_threshold": found["s3_threshold"], "model": fitted.describe(), "top_k": args.top_k}
    sinks.write_json(f"{args.model}/model_metadata.json", metadata)
    print(sinks.report_text("Training", {"metrics": {k: v for k, v in metadata.items() if isinstance(v, int | float)}}))
    return 0


def link(spark: SparkSession, args: argparse.Namespace) -> int:
    """Writes matching_results.tsv, candidate_pairs.tsv and a report, then validates both files."""
    said: list[str] = []
    log = runs.Telemetry(f"{args.output}/telemetry.jsonl")
    metadata = sinks.read_json(f"{args.model}/model_metadata.json", DEFAULTS) if args.model else dict(DEFAULTS)
    if metadata.get("top_k", args.top_k) != args.top_k:
        raise scans.InputError(f"the model was trained on the first {metadata['top_k']} candidates; --top-k {args.top_k} is refused")
    scorer = linkage.trained(model.PairModel.load(f"{args.model}/trees")) if args.model else linkage.linear
    records, chosen = load(spark, args.data, said), config(args, metadata)
    table = observed_table(records, "business_name", "business_address")
    normalize(records, table).write.mode("overwrite").parquet(f"{args.output}/normalized")  # keys and features read it, each side twice
    known = spark.read.parquet(f"{args.output}/normalized")
    s1, targets = known.where("source = 'S1'"), known.where("source <> 'S1'")
    spine = s1.select(F.col("entity_id").alias("s1_id"), "ordinal", "country")
    pairs = linkage.blocking.candidates(s1, targets, chosen.top_k, chosen.common_limit, chosen.rare_limit)
    pairs.write.mode("overwrite").parquet(f"{args.output}/candidates")  # both outputs read them
    pairs = spark.read.parquet(f"{args.output}/candidates")
    log.event("candidates", rows=pairs.count())
    links = decide.decide(linkage.score_candidates(s1, targets, pairs, scorer), chosen.s2_threshold, chosen.s3_threshold)
    links.write.mode("overwrite").parquet(f"{args.output}/links")
    links = spark.read.parquet(f"{args.output}/links")
    log.event("links", rows=links.count())
    sinks.write_result_tsv(spine, links, f"{args.output}/matching_results.tsv", "matched_entity_ids")
    sinks.write_result_tsv(spine, pairs, f"{args.output}/candidate_pairs.tsv", "candidate_entity_ids")
    totals = evaluate.summary(spine, links).first().asDict()
    by_country = {r.country: r["count"] for r in spine.groupBy("country").count().collect()}
    sinks.write_text(f"{args.output}/final_report.txt", sinks.report_text("Linkage", {"summary": totals, "S1 records by country": by_country, "settings": chosen.as_dict(), "warnings": said}))
    report = quality.validate(spark, f"{args.output}/matching_results.tsv", f"{args.output}/candidate_pairs.tsv", spine.select("s1_id"), targets.select(F.col("entity_id").alias("target_id")))
    print(report.text())
    return 0 if report.passed else 1


def evaluate_files(spark: SparkSession, args: argparse.Namespace) -> int:
    """Scores a results file against a ground truth, overall and by source."""
    spine, truth = scans.read_truth(spark, args.truth)
    _, links = scans.read_truth(spark, args.results)
    candidates = scans.read_truth(spark, args.candidates)[1] if args.candidates else links
    if args.ids:
        chosen = scans.read_ids(spark, args.ids).select(F.col("entity_id").alias("s1_id"))
        spine, truth, links, candidates = (x.join(chosen, "s1_id", "left_semi") for x in (spine, truth, links, candidates))
    rows = [("all", evaluate.metrics(evaluate.entity_counts(spine, truth, links)).first()), *((r.source, r) for r in evaluate.source_report(spine, truth, links, candidates).collect())]
    text = sinks.report_text("Evaluation", {name: row.asDict() for name, row in rows})
    print(text)
    if args.output:
        sinks.write_text(args.output, text)
    return 0


def validate(spark: SparkSession, args: argparse.Namespace) -> int:
    path = source_path(spark, args.data, 1)
    required = scans.read_first_column(spark, path).select(F.col("entity_id").alias("s1_id"))
    said: list[str] = []
    known = None
    if args.check_ids:
        known = scans.read_targets(spark, *(f"{args.data}/test_source{k}.tsv" for k in (2, 3)), warnings=said).select(F.col("entity_id").alias("target_id")).distinct()
    report = quality.validate(spark, args.matching, args.candidates, required, known if not said else None)
    report.warnings += said
    print(report.text())
    return 0 if report.passed else 1


def subset(spark: SparkSession, args: argparse.Namespace) -> int:
    """The S1 records of a list of ids as a file of their own."""
    records = scans.read_records(spark, source_path(spark, args.data, 1))
    sinks.write_records(records.join(scans.read_ids(spark, args.ids, args.limit).select("entity_id"), "entity_id", "left_semi"), args.output)
    return 0


def density(spark: SparkSession, args: argparse.Namespace) -> int:
    for r in evaluate.density(load(spark, args.data, [])).orderBy("source", "country").collect():  # a row per source and country
        print(f"{r.source}\t{r.country}\t{r.records}\t{r.percent:.2f} %")
    return 0


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="kinmatch", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)

    def command(name, run, *options):
        own = commands.add_parser(name, help=(run.__doc__ or "").split("\n")[0])
        own.set_defaults(run=run)
        for flag, settings in options:
            own.add_argument(flag, **settings)

    data, top_k = ("--data", {"required": True}), ("--top-k", {"type": int, "default": 50})
    command("train", train, data, top_k, ("--model", {"required": True}), ("--kind", {"default": "boosted", "choices": sorted(model.PRESETS)}), ("--holdout-ids", {}), ("--holdout", {"type": int, "default": 5000}), ("--sample", {"type": int, "default": 50_000}), ("--distractors", {"type": int, "default": 50_000}), ("--trees", {"type": int}))
    command("link", link, data, top_k, ("--model", {}), ("--output", {"required": True}))
    command("evaluate", evaluate_files, ("--truth", {"required": True}), ("--results", {"required": True}), ("--candidates", {}), ("--ids", {}), ("--output", {}))
    command("validate", validate, data, ("--matching", {"required": True}), ("--candidates", {}), ("--check-ids", {"action": "store_true"}))
    command("subset", subset, data, ("--ids", {"required": True}), ("--limit", {"type": int}), ("--output", {"required": True}))
    command("density", density, data)
    return out


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    features.check_schema(features.NAMES)
    try:
        return args.run(spark or session(), args)
    except (scans.InputError, runs.ResumeError, UnicodeDecodeError, OSError) as e:
        print(f"ERROR {e}\nFAIL", file=sys.stderr)
        return 1
