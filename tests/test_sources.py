"""Scans, sinks, validation of files, run records, streaming."""

import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from kinmatch.operators import quality
from kinmatch.plans.linkage import Config
from kinmatch.sources import files, runs, scans, sinks
from kinmatch.streaming import linkage as streaming

HEADER = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"


@pytest.fixture
def tsv(tmp_path):
    def write(name, body, header=HEADER):
        path = tmp_path / name
        path.write_text(header + body, encoding="utf-8")
        return str(path)

    return write


def test_records(spark, tsv):
    path = tsv("s1.tsv", 'S1-1\tA "quoted\tx\tUS\n\nS1-2\tB\nS1-3\tC\ty\tFR\textra\nS1-1\tlast\tz\tUS\n')
    rows = scans.read_records(spark, path).orderBy("ordinal").collect()
    assert [(r.entity_id, r.business_name, r.business_address, r.country, r.source) for r in rows] == [("S1-1", 'A "quoted', "x", "US", "S1"), ("S1-2", "B", "", "", "S1"), ("S1-3", "C", "y", "FR", "S1"), ("S1-1", "last", "z", "US", "S1")]
    assert {r.business_name for r in scans.read_records(spark, path, last_wins=True).collect()} == {"B", "C", "last"}
    assert scans.read_records(spark, path, country="FR").count() == 1
    assert [r.country for r in scans.countries(scans.read_records(spark, path)).collect()] == ["US", "FR"]


def test_file_order_over_many_splits(spark, tsv):
    path = tsv("long.tsv", "".join(f"S1-{i}\tname {i}\taddress\tUS\n" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        rows = scans.read_records(spark, path).orderBy("ordinal").select("entity_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.entity_id for r in rows] == [f"S1-{i}" for i in range(20_000)]


def test_truth_and_targets(spark, tsv, tmp_path):
    path = tsv("truth.tsv", "S1-1\tS2-1,S3-1,,S2-1\nS1-2\t\nS1-3\n", "source1_entity_id\tmatched_entity_ids\n")
    spine, links = scans.read_truth(spark, path)
    assert spine.count() == 3 and {tuple(r) for r in links.collect()} == {("S1-1", "S2-1"), ("S1-1", "S3-1")}
    said = []
    both = scans.read_targets(spark, tsv("s2.tsv", "S2-1\ta\tb\tUS\n"), str(tmp_path / "none.tsv"), tsv("s3.tsv", "S3-1\ta\tb\tUS\n"), warnings=said)
    assert [r.entity_id for r in both.orderBy("ordinal").collect()] == ["S2-1", "S3-1"] and len(said) == 1
    assert scans.read_targets(spark, str(tmp_path / "none.tsv")).count() == 0


def test_ids(spark, tsv):
    path = tsv("ids.txt", "S1-2\n\nS1-1\nS1-2\n", "")
    assert [r.entity_id for r in scans.read_ids(spark, path).orderBy("ordinal").collect()] == ["S1-2", "S1-1"]
    with pytest.raises(scans.InputError):
        scans.read_ids(spark, path, strict=True)
    with pytest.raises(scans.InputError):
        scans.read_ids(spark, tsv("few.txt", "a\n", ""), limit=2, strict=True)
    assert scans.read_ids(spark, path, limit=1).first().entity_id == "S1-2"
    known = scans.read_records(spark, tsv("s.tsv", "S1-1\tx\ty\tUS\nS1-2\tx\ty\tUS\n"))
    assert scans.select_records(known, scans.read_ids(spark, path)).count() == 2
    with pytest.raises(scans.InputError):
        scans.select_records(known, spark.createDataFrame([("S1-9",)], "entity_id string"))
    with pytest.raises(scans.InputError, match="record 2"):
        scans.require_ids(scans.read_records(spark, tsv("b.tsv", "S1-1\tx\ty\tUS\n\tx\ty\tUS\n")))


def test_invalid_lines_are_skipped(spark, tmp_path):
    path = tmp_path / "raw.tsv"
    path.write_bytes(HEADER.encode() + b"S2-1\ta\tb\tUS\nS2-2\t\xff\xfe\tb\tUS\nS2-3\tc\n")
    assert [r.entity_id for r in scans.read_valid_lines(spark, str(path)).orderBy("ordinal").collect()] == ["S2-1", "S2-3"]


def test_result_file(spark, tmp_path):
    spine = spark.createDataFrame([("S1-2", 0), ("S1-1", 1), ("S1-3", 2)], "s1_id string, ordinal long")
    links = spark.createDataFrame([("S1-1", "S3-1"), ("S1-1", "S2-9"), ("S1-1", "S2-9"), ("S1-2", "S2-1")], "s1_id string, target_id string")
    path = str(tmp_path / "out" / "matching.tsv")
    sinks.write_result_tsv(spine, links, path, "matched_entity_ids")
    assert Path(path).read_text() == "source1_entity_id\tmatched_entity_ids\nS1-2\tS2-1\nS1-1\tS2-9,S3-1\nS1-3\t\n"
    known = links.select("target_id").distinct()
    report = quality.validate(spark, path, str(tmp_path / "none.tsv"), spine, known)
    assert report.passed and len(report.warnings) == 1 and report.text().endswith("PASS")
    pairs = str(tmp_path / "pairs.tsv")
    sinks.write_result_tsv(spine, links.where("s1_id = 'S1-1'"), pairs, "candidate_entity_ids")
    assert any("aren't among" in w for w in quality.validate(spark, path, pairs, spine, known).warnings)


@pytest.mark.parametrize("body, said", [
    ("source1_entity_id,matched_entity_ids\n", "commas"), ("a\tb\n", "header"), ("", "empty"), ("Source1_Entity_ID \tmatched_entity_ids\nS1-1\n", "without a tab"),
    ("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1\nS1-1\tS2-1\n", "more than one row"), ("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S2-1\n", "repeats"),
    ("source1_entity_id\tmatched_entity_ids\nS1-1\tS1-1\n", "S1 ids in a list"), ("source1_entity_id\tmatched_entity_ids\nS1-1\tX-1\n", "prefix"),
    ("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-7\n", "aren't in"), ("source1_entity_id\tmatched_entity_ids\n", "without a row"), ("source1_entity_id\tmatched_entity_ids\nS1-1\t\nS1-2\t\n", "aren't required"),
])
def test_broken_files(spark, tmp_path, body, said):
    path = tmp_path / "m.tsv"
    path.write_text(body)
    report = quality.validate(spark, str(path), None, spark.createDataFrame([("S1-1",)], "s1_id string"), spark.createDataFrame([("S2-1",)], "target_id string"))
    assert not report.passed and any(said in e for e in report.errors), report.errors


def test_missing_and_undecodable_files(spark, tmp_path):
    required = spark.createDataFrame([("S1-1",)], "s1_id string")
    assert "not found" in quality.validate(spark, str(tmp_path / "no.tsv"), None, required).errors[0]
    path = tmp_path / "bad.tsv"
    path.write_bytes(b"source1_entity_id\tmatched_entity_ids\nS1-1\t\xff\n")
    assert "UTF-8" in quality.validate(spark, str(path), None, required).errors[0]


def test_tables_and_reports(spark, tmp_path):
    pairs = spark.createDataFrame([("S1-1", "S2-1", "US", 1), ("S1-1", "S2-2", "US", 2)], "s1_id string, target_id string, country string, rank int")
    truth = spark.createDataFrame([("S1-1", "S2-1")], "s1_id string, target_id string")
    sinks.write_diagnostics(pairs, truth, str(tmp_path / "d"))
    rows = scans.read_candidates(spark, str(tmp_path / "d"))
    assert {(r.target_id, r.is_ground_truth) for r in rows.collect()} == {("S2-1", True), ("S2-2", False)} and "file" in rows.columns
    with pytest.raises(scans.InputError):
        scans.read_candidates(spark, str(tmp_path))
    sinks.write_predictions(spark.createDataFrame([("S1-1", "US"), ("S1-2", "FR")], "s1_id string, country string"), pairs, truth, str(tmp_path / "p"))
    assert {r.query_id: r.after_dedup_target_ids for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {"S1-1": ["S2-1"], "S1-2": []}
    sinks.write_json(str(tmp_path / "m.json"), {"s2": 0.8})
    assert sinks.read_json(str(tmp_path / "m.json"), {"s2": 0.85, "s3": 0.9}) == {"s2": 0.8, "s3": 0.9} and sinks.read_json(str(tmp_path / "no.json"), {"a": 1}) == {"a": 1}
    assert sinks.report_text("T", {"a": {"x": 1}, "b": [2], "c": 3}).count("[") == 3
    assert files.profile_text(spark, str(tmp_path / "m.json"))["rows"] == 2 and files.find_files(spark, str(tmp_path), "*.json").count() == 1
    assert files.first_existing(spark, str(tmp_path / "no"), str(tmp_path / "m.json")).endswith("m.json")


def test_subset_file(spark, tsv, tmp_path):
    known = scans.read_records(spark, tsv("s.tsv", "S1-3\ta\tb\tUS\nS1-1\tc\t\tFR\n"))
    sinks.write_records(known.where("entity_id = 'S1-1'"), str(tmp_path / "sub.tsv"))
    assert (tmp_path / "sub.tsv").read_text() == HEADER + "S1-1\tc\t\tFR\n"


def test_runs(spark, tmp_path):
    record = runs.manifest(spark, Config().as_dict())
    runs.start(str(tmp_path), record)
    with pytest.raises(runs.ResumeError):
        runs.start(str(tmp_path), record)
    runs.start(str(tmp_path), record, resume=True)
    with pytest.raises(runs.ResumeError):
        runs.start(str(tmp_path), runs.manifest(spark, Config(top_k=9).as_dict()), resume=True)
    made = []
    rows = runs.in_chunks(spark.range(10).withColumn("ordinal", F.col("id")), 2)

    def make(part):
        made.append(part.count())
        return part

    assert runs.resumable(rows, str(tmp_path / "chunks"), make, at_once=2).count() == 10 and made == [4, 4, 2]
    assert runs.resumable(rows, str(tmp_path / "chunks"), make, at_once=2).count() == 10 and made == [4, 4, 2]

    def broken(part):
        if len(made) > 3:
            raise InterruptedError
        return make(part)

    # cut off after a batch of two chunks, gone on with batches of another size: every row once
    with pytest.raises(InterruptedError):
        runs.resumable(rows, str(tmp_path / "cut"), broken, at_once=2)
    for at_once in (64, 1):
        assert sorted(r.ordinal for r in runs.resumable(rows, str(tmp_path / "cut"), make, at_once=at_once).collect()) == list(range(10))
    assert made == [4, 4, 2, 4, 6]
    log = runs.Telemetry(str(tmp_path / "t.jsonl"))
    log.event("a", rows=3)
    assert json.loads((tmp_path / "t.jsonl").read_text())["rows"] == 3
    assert runs.sha256_ids(["S1-1", "S1-2"]) != runs.sha256_ids(["S1-2", "S1-1"]) and len(runs.sha256_ids([])) == 64


def test_numbered(spark):
    rows = scans.numbered(spark.range(1000).select((F.col("id") * 7 % 1000).alias("v")), "v").collect()
    assert all(r.ordinal == r.v for r in rows)


def test_stream(spark, tmp_path):
    schema = streaming.RECORD
    targets = spark.createDataFrame([("S2-1", "Alpha Foods", "10 Main St", "US", 0, "S2")], schema)
    for k, name in enumerate(("Alpha Food", "Alpha Foods")):
        spark.createDataFrame([(f"S1-{k}", name, "10 Main St", "US", k, "S1")], schema).write.parquet(str(tmp_path / "in" / f"b{k}"))
        rows = spark.read.parquet(str(tmp_path / "in" / f"b{k}"))
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "arrivals"))
        streaming.link_stream(spark, str(tmp_path / "arrivals"), targets, str(tmp_path / "scores"), str(tmp_path / "state")).awaitTermination()
        low = Config(s2_threshold=0.5, s3_threshold=0.5)
        assert [r.s1_id for r in streaming.current_links(spark, str(tmp_path / "scores"), low).collect()] == [f"S1-{k}"]


def test_entry_works_without_the_corpus_operators(tmp_path):
    """As after those folders are deleted."""
    root = Path(__file__).resolve().parent.parent
    copy = tmp_path / "copy"
    subprocess.run(["cp", "-r", str(root), str(copy)], check=True)
    subprocess.run(["rm", "-rf", str(copy / "kinmatch" / "llm"), str(copy / "tests" / "llm"), str(copy / "corpus_pipeline.py")], check=True)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') for n in q), set(e.oracle_sql()) <= set(q))"], cwd=copy, capture_output=True, text=True, check=True)
    assert said.stdout.split()[1:] == ["False", "True"] and int(said.stdout.split()[0]) > 35
