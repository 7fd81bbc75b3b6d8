"""Registered queries run at production caps; small caps are for fixtures only."""

import pytest
from pyspark.sql import functions as F

from kinmatch import queries
from kinmatch.operators import blocking
from kinmatch.plans import linkage


@pytest.fixture(scope="module")
def shared_word(spark, tmp_path_factory):
    """One S1 record and 100 targets that share one name word and nothing else."""
    path = tmp_path_factory.mktemp("caps")
    ids = [0, *(i for i in range(1, 150) if i % 3)]
    rows = [(i, "alphawd " + " ".join(f"{c}{i:05d}" for c in "uvcdef"), "en", "src0", i) for i in ids]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_caps_are_those_of_production():
    ours, production = queries.CONFIG, linkage.Config()
    assert (ours.top_k, ours.common_limit, ours.rare_limit) == (production.top_k, production.common_limit, production.rare_limit) == (50, 300, 150)


def test_key_of_100_postings_stays(spark, shared_word):
    kept = {(r.key_type, r.key_value): r.postings for r in queries.capped_keys(spark, shared_word).collect()}
    assert kept["n_tok", "alphawd"] == 100


def test_fifty_candidates(spark, shared_word):
    rows = queries.candidates(spark, shared_word).collect()
    assert {r.s1_id for r in rows} == {"S1-0"} and sorted(r["rank"] for r in rows) == list(range(1, 51))


@pytest.mark.parametrize("kind, n, kept", [("n_tok", 60, True), ("n_tok", 61, False), ("sort_n", 30, True), ("sort_n", 31, False), ("addr_pair", 31, False)])
def test_small_caps(spark, kind, n, kept):
    keys = spark.range(n).select(F.lit("US").alias("country"), F.lit(kind).alias("key_type"), F.lit("x").alias("key_value"), F.col("id").cast("string").alias("entity_id"))
    assert blocking.capped_keys(keys, 60, 30).count() == int(kept)
