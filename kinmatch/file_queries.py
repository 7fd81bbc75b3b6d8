"""Queries for scans, sinks, file rules, run records and models: files made from the benchmark tables, read back, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch import cli, queries
from kinmatch.operators import decide, evaluate, features, model, quality
from kinmatch.plans import linkage
from kinmatch.plans.views import RECORDS_SQL, TRUTH_SQL, doc_records, doc_truth
from kinmatch.sources import files, runs, scans, sinks
from kinmatch.sources.shared import kept, new_path

Query = Callable[[SparkSession, str], DataFrame]
RECORD = ["entity_id", "business_name", "business_address", "country"]
FEW = 40


def _spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_records(spark, sf_dir).where("source = 'S1'").select(F.col("entity_id").alias("s1_id"), "country", "ordinal")


def _files(spark: SparkSession, sf_dir: str) -> list[str]:
    """One TSV for each source, in a folder of its own."""
    folder, rows = new_path(spark, "data"), doc_records(spark, sf_dir)
    for k in (1, 2, 3):
        sinks.write_records(rows.where(F.col("source") == f"S{k}"), f"{folder}/test_source{k}.tsv")
    return [f"{folder}/test_source{k}.tsv" for k in (1, 2, 3)]


def _write_lines(lines: DataFrame, path: str) -> str:
    """lines (value, ordinal) as one text file in order."""
    spark = lines.sparkSession
    lines.repartitionByRange("ordinal").sortWithinPartitions("ordinal").select("value").write.text(f"{path}.parts")
    files.join_files(spark, f"{path}.parts", path)
    files.remove(spark, f"{path}.parts")
    return path


def _said(make: Callable[[], object]) -> str:
    """What an error says, without the paths it names."""
    try:
        make()
    except (scans.InputError, runs.ResumeError, ValueError) as e:
        return " ".join(w.rpartition("/")[2] for w in str(e).split())
    return "no error"


def tsv_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 as a stream, S2 and S3 as one scan in which a missing file is left out."""
    one, two, three = _files(spark, sf_dir)
    return scans.read_records(spark, one).unionByName(scans.read_targets(spark, two, f"{two}.missing", three, warnings=[])).select(*RECORD, "source")


def tsv_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of rows that share an id the last counts: every second record comes again under another name."""
    rows = doc_records(spark, sf_dir)
    again = rows.where("ordinal % 2 = 0").withColumns({"business_name": F.concat(F.lit("again "), "business_name"), "ordinal": F.col("ordinal") + (1 << 40)})
    path = new_path(spark, "lookup.tsv")
    sinks.write_records(rows.unionByName(again), path)
    return scans.read_records(spark, path, last_wins=True).select(*RECORD)


def tsv_of_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.read_records(spark, _files(spark, sf_dir)[1], country="fr").select(*RECORD)


def tsv_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.countries(scans.read_records(spark, _files(spark, sf_dir)[0]))


def truth_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result file written and read back as a ground truth."""
    path = new_path(spark, "truth.tsv")
    sinks.write_result_tsv(_spine(spark, sf_dir), doc_truth(spark, sf_dir), path, "matched_entity_ids")
    return scans.read_truth(spark, path)[1]


def result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result file's text, line by line."""
    path = new_path(spark, "matching_results.tsv")
    sinks.write_result_tsv(_spine(spark, sf_dir), doc_truth(spark, sf_dir), path, "matched_entity_ids")
    return spark.read.text(path).select("value")


def file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 ids with their place in the file."""
    rows = scans.read_records(spark, _files(spark, sf_dir)[0])
    return scans.numbered(rows.select("entity_id", "ordinal").withColumnRenamed("ordinal", "place"), "place").select("entity_id", "ordinal")


def selected_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The truth of a list of ids, in the list's order."""
    path = new_path(spark, "truth.tsv")
    sinks.write_result_tsv(_spine(spark, sf_dir), doc_truth(spark, sf_dir), path, "matched_entity_ids")
    linked = doc_truth(spark, sf_dir).select(F.col("s1_id").alias("entity_id")).distinct()
    asked = linked.join(_spine(spark, sf_dir).select(F.col("s1_id").alias("entity_id"), (-F.col("ordinal")).alias("ordinal")), "entity_id")
    spine, links = scans.read_selected_truth(spark, path, asked)
    return links.join(spine, "s1_id").select("s1_id", "target_id", "ordinal")


def _ids(spark: SparkSession, sf_dir: str) -> str:
    """S1 ids on lines of their own, blanks around them and blank lines between."""
    rows = _spine(spark, sf_dir).select(F.explode(F.array(F.concat(F.lit(" "), "s1_id"), F.lit(""))).alias("value"), "ordinal")
    return _write_lines(rows, new_path(spark, "ids.txt"))


def first_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ids of a list: the limit is the feature."""
    return scans.read_ids(spark, _ids(spark, sf_dir), FEW, strict=True).select("entity_id")


def listed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.read_ids(spark, _ids(spark, sf_dir)).select("entity_id")


def first_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.read_first_column(spark, _files(spark, sf_dir)[2])


def valid_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that aren't UTF-8 are skipped; every seventh gets a byte that can't be."""
    rows = doc_records(spark, sf_dir)
    line = F.concat_ws("\t", *RECORD).cast("binary")
    bad = F.concat(line, F.unhex(F.lit("FF"))).cast("string")
    body = rows.select(F.when(F.col("ordinal") % 7 == 0, bad).otherwise(line.cast("string")).alias("value"), (F.col("ordinal") + 1).alias("ordinal"))
    head = spark.createDataFrame([("\t".join(RECORD), -1)], "value string, ordinal long")
    return scans.read_valid_lines(spark, _write_lines(head.unionByName(body), new_path(spark, "raw.tsv"))).select(*RECORD)


def validation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of a list of ids, which must all be there once."""
    return scans.select_records(scans.require_ids(scans.read_records(spark, _files(spark, sf_dir)[0])), scans.read_ids(spark, _ids(spark, sf_dir))).select(*RECORD)


def input_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What readers say of files that break their rules."""
    ids, known = _ids(spark, sf_dir), scans.read_records(spark, _files(spark, sf_dir)[0])
    twice = spark.read.text(ids).where("value <> ''").withColumn("ordinal", F.monotonically_increasing_id())
    stranger = spark.createDataFrame([("S1-none", 0)], "entity_id string, ordinal long")
    truth = new_path(spark, "truth.tsv")
    sinks.write_result_tsv(_spine(spark, sf_dir), doc_truth(spark, sf_dir), truth, "matched_entity_ids")
    blank = doc_records(spark, sf_dir).where("source = 'S1'").withColumn("entity_id", F.when(F.col("ordinal") == 6, F.lit(" ")).otherwise(F.col("entity_id")))
    path = new_path(spark, "blank.tsv")
    sinks.write_records(blank, path)
    repeated = _write_lines(twice.unionByName(twice), f"{new_path(spark, 'list')}/twice.txt")
    cases = {
        "blank id": lambda: scans.require_ids(scans.read_records(spark, path)),
        "no record": lambda: scans.select_records(known, stranger),
        "two records": lambda: scans.select_records(known.unionByName(known), scans.read_ids(spark, ids)),
        "repeated id": lambda: scans.read_ids(spark, repeated, strict=True),
        "too few": lambda: scans.read_ids(spark, repeated, limit=1_000_000),
        "no truth": lambda: scans.read_selected_truth(spark, truth, stranger),
        "unfinished": lambda: scans.read_candidates(spark, f"{truth}.none/folder"),
        "features": lambda: features.check_schema(["name_lev_sim"]),
    }
    return spark.createDataFrame([(name, _said(make).split(" in ")[0]) for name, make in cases.items() if name != "features"] + [("features", str(_said(cases["features"]) != "no error").lower())], "case string, said string")


def candidate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "candidates")
    sinks.write_table(queries._candidates(spark, sf_dir), path)
    return scans.read_candidates(spark, path).drop("file")


def prediction_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of each S1 before and after exclusivity."""
    scored = queries._scored(spark, sf_dir)
    before = decide.accept(scored, queries.CONFIG.s2_threshold, queries.CONFIG.s3_threshold)
    path = new_path(spark, "predictions")
    sinks.write_predictions(_spine(spark, sf_dir), before, decide.one_owner(before), path)
    return spark.read.parquet(path).select("query_id", "country", *[F.array_join(c, ",").alias(c) for c in ("before_dedup_target_ids", "after_dedup_target_ids")])


def diagnostic_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "diagnostics")
    sinks.write_diagnostics(queries._candidates(spark, sf_dir), doc_truth(spark, sf_dir), path)
    return spark.read.parquet(path).select("s1_id", "target_id", "rank", "is_ground_truth")


def subset_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of the linked S1 as a file in the input's format."""
    path = new_path(spark, "subset.tsv")
    sinks.write_records(doc_records(spark, sf_dir).join(doc_truth(spark, sf_dir).select(F.col("s1_id").alias("entity_id")).distinct(), "entity_id", "left_semi"), path)
    return spark.read.text(path).select("value")


def metadata_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON written whole and read over defaults."""
    path = f"{new_path(spark, 'run')}/model_metadata.json"
    sinks.write_json(path, {"best_s2_threshold": 0.85, "s1_records": _spine(spark, sf_dir).count()})
    found, missing = sinks.read_json(path, cli.DEFAULTS), sinks.read_json(f"{path}.none", cli.DEFAULTS)
    return spark.createDataFrame([(kind, k, float(v)) for kind, own in (("found", found), ("missing", missing)) for k, v in own.items()], "file string, key string, value double")


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text report of a run."""
    totals = evaluate.summary(_spine(spark, sf_dir), queries._links(spark, sf_dir)).first().asDict()
    path = f"{new_path(spark, 'run')}/final_report.txt"
    sinks.write_text(path, sinks.report_text("Linkage", {"summary": totals, "warnings": ["none"]}))
    return spark.read.text(path).select("value")


def dataset_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of a folder with their header, rows and delimiter, and which one a command takes for S1."""
    paths = _files(spark, sf_dir)
    folder = paths[0].rpartition("/")[0]
    found = files.find_files(spark, folder, "*.tsv").where("bytes > 0").select(F.element_at(F.split("path", "/"), -1).alias("name"))
    profiles = [(p.rpartition("/")[2], *(files.profile_text(spark, p)[k] for k in ("header", "rows", "delimiter")), cli.source_path(spark, folder, 1) == p) for p in paths]
    return found.join(spark.createDataFrame(profiles, "name string, header string, rows long, delimiter string, is_s1 boolean"), "name")


def file_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and warnings that whole-file rules give, by case."""
    spine, known = _spine(spark, sf_dir), doc_records(spark, sf_dir).where("source <> 'S1'").select(F.col("entity_id").alias("target_id"))
    folder = new_path(spark, "results")
    good = f"{folder}/good.tsv"
    sinks.write_result_tsv(spine, doc_truth(spark, sf_dir), good, "matched_entity_ids")
    head = "source1_entity_id\tmatched_entity_ids"
    lines = spark.read.text(good).withColumn("ordinal", F.monotonically_increasing_id())
    bodies = {
        "commas": lines.withColumn("value", F.replace("value", F.lit("\t"), F.lit(","))), "header": lines.withColumn("value", F.replace("value", F.lit(head), F.lit("id\tids"))),
        "encoding": lines.withColumn("value", F.concat(F.col("value").cast("binary"), F.when(F.col("ordinal") > 0, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("")))).cast("string")),
        "tab": lines.withColumn("value", F.when(F.col("ordinal") > 0, F.replace("value", F.lit("\t"), F.lit(" "))).otherwise(F.col("value"))),
    }
    names = {"good": good, "missing": f"{folder}/missing.tsv"} | {case: _write_lines(rows, f"{folder}/{case}.tsv") for case, rows in bodies.items()}
    sinks.write_text(f"{folder}/empty.tsv", "")
    out = []
    for case, path in (names | {"empty": f"{folder}/empty.tsv"}).items():
        report = quality.validate(spark, path, f"{folder}/none.tsv", spine, known)
        out.append((case, report.passed, len(report.errors), len(report.warnings), sum(c["rows"] for c in report.counts.values()), sum(c["filled"] for c in report.counts.values())))
    return spark.createDataFrame(out, "case string, passed boolean, errors int, warnings int, rows long, filled long")


def chunked_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run in chunks by country and number that stops after some, and goes on with other batches."""
    folder = new_path(spark, "chunks")
    rows = runs.in_chunks(doc_records(spark, sf_dir), 64).drop("source")
    made: list[int] = []

    def make(part: DataFrame) -> DataFrame:
        if len(made) == 2:
            raise InterruptedError
        made.append(1)
        return part.select("entity_id", "country", "chunk")

    try:
        runs.resumable(rows, folder, make, ("country", "chunk"), at_once=3)
    except InterruptedError:
        pass
    return runs.resumable(rows, folder, lambda part: part.select("entity_id", "country", "chunk"), ("country", "chunk"), at_once=1000)


def id_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest of the S1 ids in file order."""
    ids = (r.s1_id for r in _spine(spark, sf_dir).orderBy("ordinal").select("s1_id").toLocalIterator())
    return spark.createDataFrame([(runs.sha256_ids(ids),)], "digest string")


def candidate_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest of all candidates in the order of the S1 file and of ranks."""
    return spark.createDataFrame([(evaluate.candidate_set_hash(queries._candidates(spark, sf_dir), _spine(spark, sf_dir)),)], "digest string")


def run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests, refused resumes, telemetry and probes: what holds of each."""
    folder = new_path(spark, "run").removeprefix("file:")
    local = "://" not in folder
    config = {"top_k": 50, "tables": sf_dir.rpartition("/")[2]}
    record = runs.manifest(spark, config)
    seen = {
        "same settings, same fingerprint": runs.fingerprint(config) == runs.fingerprint(dict(reversed(config.items()))) == record["config_sha256"],
        "other settings, other fingerprint": runs.fingerprint(config | {"top_k": 51}) != record["config_sha256"],
        "code is hashed": set(record["code"]) >= {"cli.py", "sources/runs.py"},
        "dependencies are probed": record["dependencies"]["pyspark"],
        "memory is probed": record["memory_bytes"] > 0,
    }
    if local:
        runs.start(folder, record)
        log = runs.Telemetry(f"{folder}/telemetry.jsonl")
        row = log.event("candidates", rows=1)
        seen |= {
            "a folder in use is refused": _said(lambda: runs.start(folder, record)) != "no error",
            "another configuration is refused": _said(lambda: runs.start(folder, runs.manifest(spark, {}), resume=True)) != "no error",
            "the same run resumes": _said(lambda: runs.start(folder, record, resume=True)) == "no error",
            "telemetry has memory and counters": row["peak_rss_bytes"] > 0 and row["available_bytes"] > 0 and row["rows"] == 1,
        }
    return spark.createDataFrame(list(seen.items()), "check string, holds boolean")


def truth_withheld(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An evaluation whose truth is read when candidates and scores are there; its metrics before and after exclusivity."""
    spine, pairs, scored = _spine(spark, sf_dir), queries._candidates(spark, sf_dir), queries._scored(spark, sf_dir)
    c = queries.CONFIG
    reports = linkage.evaluate_run(spine, pairs, {"linear": scored}, lambda: doc_truth(spark, sf_dir), {"chosen": (c.s2_threshold, c.s3_threshold)})
    before, after = (reports[f"linear_chosen_{state}"].withColumn("state", F.lit(state)) for state in ("before", "after"))
    return queries.rounded(before.unionByName(after))


def planted_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of candidates and links, planted by rank and id."""
    pairs, spine = queries._candidates(spark, sf_dir), _spine(spark, sf_dir)
    again = pairs.where("rank = 2")
    shifted = pairs.unionByName(again).unionByName(pairs.where("rank = 1").withColumn("s1_id", F.concat(F.lit("x"), "s1_id")))
    links = pairs.where("rank = 1").select("s1_id", F.when(F.col("shared_keys") > 3, F.replace("target_id", F.lit("S2-"), F.lit("S4-"))).otherwise(F.col("target_id")).alias("target_id"))
    found = quality.candidate_faults(shifted, spine).unionByName(quality.link_faults(links, spine, pairs))
    return found.groupBy("fault").agg(F.count("*").alias("entities"))


def saved_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both kinds of model with few trees: fitted, saved, loaded, and scoring all candidates."""
    s1, targets, pairs = queries._retrieved(spark, sf_dir)
    linked = doc_truth(spark, sf_dir).select("s1_id", "target_id", F.lit(1).alias("label"))
    rows = features.pair_features(pairs, s1, targets).join(linked, ["s1_id", "target_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))
    rows, out = kept(rows, "pairs"), None
    for kind in sorted(model.PRESETS):
        fitted = model.PairModel(kind, maxIter=2, maxDepth=4).fit(rows)
        path = new_path(spark, "model")
        fitted.save(path)
        scored = model.PairModel.load(path, kind).probability(fitted.probability(rows, "p"), "q")
        row = scored.agg(F.lit(kind).alias("kind"), F.count("*").alias("pairs"), F.bool_and((F.col("p") >= 0) & (F.col("p") <= 1)).alias("probabilities"), F.bool_and(F.col("p") == F.col("q")).alias("same_after_loading"))
        row = row.withColumn("features", F.lit(len(fitted.describe()["features"])))
        out = row if out is None else out.unionByName(row)
    return out


_FUNCTIONS = (
    tsv_records, tsv_lookup, tsv_of_country, tsv_countries, truth_file, result_lines, file_order, selected_truth, first_ids, listed_ids, first_column, valid_lines, validation_records, input_errors, candidate_files,
    prediction_file, diagnostic_file, subset_lines, metadata_file, report_lines, dataset_files, file_faults, chunked_records, id_fingerprint, candidate_digest, run_records, truth_withheld, planted_faults, saved_models,
)
QUERIES: dict[str, Query] = {f.__name__: f for f in _FUNCTIONS}

_RECORDS = f"WITH {RECORDS_SQL.strip()}"
_TRUE = f"{_RECORDS},{TRUTH_SQL}, spine AS (SELECT entity_id AS s1_id, country, ordinal FROM records WHERE source = 'S1')"
_LINKS = "SELECT s.s1_id, ordinal, COALESCE(string_agg(target_id, ',' ORDER BY target_id), '') AS ids FROM spine s LEFT JOIN truth USING (s1_id) GROUP BY ALL"
_CHECKS = (
    "same settings, same fingerprint", "other settings, other fingerprint", "code is hashed", "dependencies are probed", "memory is probed", "a folder in use is refused", "another configuration is refused",
    "the same run resumes", "telemetry has memory and counters",
)

SQL: dict[str, str] = {
    "tsv_records": f"{_RECORDS} SELECT entity_id, business_name, business_address, country, source FROM records",
    "tsv_lookup": f"{_RECORDS} SELECT entity_id, CASE WHEN ordinal % 2 = 0 THEN 'again ' ELSE '' END || business_name AS business_name, business_address, country FROM records",
    "tsv_of_country": f"{_RECORDS} SELECT entity_id, business_name, business_address, country FROM records WHERE source = 'S2' AND country = 'fr'",
    "tsv_countries": f"{_RECORDS} SELECT DISTINCT country FROM records WHERE source = 'S1' AND country <> ''",
    "truth_file": f"{_TRUE} SELECT DISTINCT s1_id, target_id FROM truth",
    "result_lines": f"{_TRUE} SELECT 'source1_entity_id' || chr(9) || 'matched_entity_ids' AS value UNION ALL SELECT s1_id || chr(9) || ids FROM ({_LINKS})",
    "file_order": f"{_RECORDS} SELECT entity_id, row_number() OVER (ORDER BY ordinal) - 1 AS ordinal FROM records WHERE source = 'S1'",
    "selected_truth": f"{_TRUE} SELECT DISTINCT s1_id, target_id, -ordinal AS ordinal FROM truth JOIN spine USING (s1_id)",
    "first_ids": f"{_TRUE} SELECT s1_id AS entity_id FROM spine ORDER BY ordinal LIMIT {FEW}",
    "listed_ids": f"{_TRUE} SELECT s1_id AS entity_id FROM spine",
    "first_column": f"{_RECORDS} SELECT entity_id FROM records WHERE source = 'S3'",
    "valid_lines": f"{_RECORDS} SELECT entity_id, business_name, business_address, country FROM records WHERE ordinal % 7 <> 0",
    "validation_records": f"{_RECORDS} SELECT entity_id, business_name, business_address, country FROM records WHERE source = 'S1'",
    "input_errors": """SELECT * FROM (VALUES ('blank id', 'record 3 has a blank id'), ('no record', 'selected ids have no record'), ('two records', 'selected ids have more than one record'),
  ('repeated id', 'twice.txt repeats ids'), ('too few', 'no error'), ('no truth', 'S1-none has no row'), ('unfinished', 'folder isn''t finished'), ('features', 'true')) v("case", said)""",
    "candidate_files": f"WITH {queries.CANDIDATES_SQL.strip()} SELECT * FROM candidates",
    "prediction_file": f"WITH {queries.FEATURES_SQL.strip()} SELECT s1_id AS query_id, country, " + ", ".join(f"COALESCE((SELECT string_agg(target_id, ',' ORDER BY target_id) FROM {t} x WHERE x.s1_id = spine.s1_id), '') AS {name}" for t, name in (("accepted", "before_dedup_target_ids"), ("links", "after_dedup_target_ids"))) + " FROM spine",
    "diagnostic_file": f"WITH {queries._RANKED.strip()} SELECT s1_id, target_id, rank, (s1_id, target_id) IN (SELECT (s1_id, target_id) FROM truth) AS is_ground_truth FROM candidates",
    "subset_lines": f"{_TRUE} SELECT 'entity_id' || chr(9) || 'business_name' || chr(9) || 'business_address' || chr(9) || 'country' AS value UNION ALL SELECT entity_id || chr(9) || business_name || chr(9) || business_address || chr(9) || country FROM records WHERE entity_id IN (SELECT s1_id FROM truth)",
    "metadata_file": f"{_TRUE} SELECT * FROM (VALUES ('found', 'best_s2_threshold', 0.85::DOUBLE), ('found', 'best_s3_threshold', 0.85::DOUBLE), ('missing', 'best_s2_threshold', 0.75::DOUBLE), ('missing', 'best_s3_threshold', 0.85::DOUBLE)) v(file, key, value) UNION ALL SELECT 'found', 's1_records', CAST(count(*) AS DOUBLE) FROM spine",
    "report_lines": f"""WITH {queries._ALL.strip()}, totals AS (SELECT count(*) AS entities, count(CASE WHEN n = 0 THEN 1 END) AS singletons, count(CASE WHEN n > 0 THEN 1 END) AS matched, CAST(sum(n2) AS BIGINT) AS s2_links, CAST(sum(n) - sum(n2) AS BIGINT) AS s3_links
  FROM (SELECT s.s1_id, count(target_id) AS n, count(CASE WHEN starts_with(target_id, 'S2-') THEN 1 END) AS n2 FROM spine s LEFT JOIN links USING (s1_id) GROUP BY 1))
SELECT unnest(['Linkage', '=======', '', '[summary]', '  entities: ' || entities, '  singletons: ' || singletons, '  matched: ' || matched, '  s2_links: ' || s2_links, '  s3_links: ' || s3_links, '', '[warnings]', '  - none']) AS value FROM totals""",
    "dataset_files": f"{_RECORDS} SELECT 'test_source' || source[2] || '.tsv' AS name, 'entity_id' || chr(9) || 'business_name' || chr(9) || 'business_address' || chr(9) || 'country' AS header, count(*) AS rows, chr(9) AS delimiter, source = 'S1' AS is_s1 FROM records GROUP BY source",
    "file_faults": f"""{_TRUE}, n AS (SELECT count(*) AS n, count(CASE WHEN ids <> '' THEN 1 END) AS f FROM ({_LINKS}))
SELECT "case", passed, errors, 1 AS warnings, CASE WHEN "case" = 'good' THEN n ELSE 0 END AS rows, CASE WHEN "case" = 'good' THEN f ELSE 0 END AS filled
FROM n, (VALUES ('good', true, 0), ('missing', false, 1), ('commas', false, 1), ('header', false, 1), ('encoding', false, 1), ('tab', false, 2), ('empty', false, 1)) v("case", passed, errors)""",
    "chunked_records": f"{_RECORDS} SELECT entity_id, country, ordinal // 64 AS chunk FROM records",
    "id_fingerprint": f"{_TRUE} SELECT sha256(string_agg(s1_id || chr(10), '' ORDER BY ordinal)) AS digest FROM spine",
    "candidate_digest": f"WITH {queries._RANKED.strip()} SELECT sha256(string_agg(s1_id || chr(0) || ids, '' ORDER BY ordinal)) AS digest FROM (SELECT s.s1_id, ordinal, COALESCE(string_agg(target_id || chr(0), '' ORDER BY rank), '') AS ids FROM spine s LEFT JOIN candidates USING (s1_id) GROUP BY ALL)",
    "run_records": "SELECT unnest([" + ", ".join(f"'{c}'" for c in _CHECKS) + ']) AS "check", true AS holds',
    "truth_withheld": f"WITH {queries._ALL.strip()} " + " UNION ALL ".join(f"SELECT *, '{state}' AS state FROM ({queries._metrics(queries._counts(links))})" for state, links in (("before", "accepted"), ("after", "links"))),
    "planted_faults": f"""WITH {queries._RANKED.strip()}, per AS (SELECT s1_id, count(*) AS n FROM candidates GROUP BY 1),
found AS (SELECT 'repeated_target' AS fault, s1_id FROM per WHERE n > 1 UNION ALL SELECT 'ranks', s1_id FROM per WHERE n > 1 UNION ALL SELECT 'unexpected', s1_id FROM per
  UNION ALL SELECT unnest(['namespace', 'not_a_candidate']), s1_id FROM candidates WHERE rank = 1 AND shared_keys > 3 AND starts_with(target_id, 'S2-'))
SELECT fault, count(*) AS entities FROM found GROUP BY 1""",
    "saved_models": f"WITH {queries.CANDIDATES_SQL.strip()} SELECT kind, count(*) AS pairs, true AS probabilities, true AS same_after_loading, {len(features.NAMES)} AS features FROM candidates, (VALUES ('boosted'), ('histogram')) v(kind) GROUP BY kind",
}
