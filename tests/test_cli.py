"""The commands end to end, on TSV files made of the benchmark's documents."""

import json

import pytest
from pyspark.sql import functions as F

from kinmatch.cli import main
from kinmatch.plans.views import doc_records, doc_truth
from kinmatch.sources import sinks


@pytest.fixture(scope="module")
def folder(spark, sf_dir, tmp_path_factory):
    root = tmp_path_factory.mktemp("data")
    records, truth = doc_records(spark, sf_dir), doc_truth(spark, sf_dir)
    for k in (1, 2, 3):
        sinks.write_records(records.where(f"source = 'S{k}'"), str(root / f"test_source{k}.tsv"))
    sinks.write_result_tsv(records.where("source = 'S1'").select(F.col("entity_id").alias("s1_id"), "ordinal"), truth, str(root / "train_ground_truth.tsv"), "matched_entity_ids")
    return root


def test_link_and_evaluate(spark, folder, tmp_path, capsys):
    assert main(["link", "--data", str(folder), "--output", str(tmp_path)], spark) == 0
    assert "PASS" in capsys.readouterr().out and (tmp_path / "final_report.txt").read_text().startswith("Linkage")
    results = str(tmp_path / "matching_results.tsv")
    assert main(["evaluate", "--truth", str(folder / "train_ground_truth.tsv"), "--results", results, "--candidates", str(tmp_path / "candidate_pairs.tsv"), "--output", str(tmp_path / "e.txt")], spark) == 0
    assert "macro_f05" in (tmp_path / "e.txt").read_text()
    assert main(["validate", "--data", str(folder), "--matching", results, "--candidates", str(tmp_path / "none.tsv"), "--check-ids"], spark) == 0
    (tmp_path / "broken.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-0\tS1-3\n")
    assert main(["validate", "--data", str(folder), "--matching", str(tmp_path / "broken.tsv")], spark) == 1


def test_train_then_link(spark, folder, tmp_path):
    model = str(tmp_path / "model")
    assert main(["train", "--data", str(folder), "--model", model, "--holdout", "20", "--distractors", "50", "--trees", "3"], spark) == 0
    metadata = json.loads((tmp_path / "model" / "model_metadata.json").read_text())
    assert len(metadata["feature_names"]) == 32 and 0 <= metadata["macro_f05"] <= 1
    assert main(["link", "--data", str(folder), "--model", model, "--output", str(tmp_path / "out")], spark) == 0


def test_subset_and_density(spark, folder, tmp_path, capsys):
    (tmp_path / "ids.txt").write_text("S1-3\nS1-6\n")
    assert main(["subset", "--data", str(folder), "--ids", str(tmp_path / "ids.txt"), "--output", str(tmp_path / "sub.tsv")], spark) == 0
    assert len((tmp_path / "sub.tsv").read_text().splitlines()) == 3
    assert main(["density", "--data", str(folder)], spark) == 0 and "S2\ten" in capsys.readouterr().out
    assert main(["density", "--data", str(tmp_path)], spark) == 1
