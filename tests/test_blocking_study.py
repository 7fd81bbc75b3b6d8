import pytest
from pyspark.sql import functions as F

from kinmatch.operators import blocking, evaluate

KEY = "country string, key_type string, key_value string, entity_id string"


def made(spark, n, source, step):
    """Records of few distinct key sets, some keys being common; the ids aren't in the order of the numbers."""
    rows = []
    for i in range(n):
        keys = {f"a{i % 2}", f"b{i * step % 3}", f"c{i % 7}", f"d{i * step % 40}", f"e{i}"}
        rows += [("x" if i % 11 else "y", "n_tok", k, f"{source}-{i * 7919 % 1009}") for k in keys]
    return spark.createDataFrame(rows, KEY)


@pytest.mark.parametrize("k", [1, 3, 50])
@pytest.mark.parametrize("often", [0, 5, 30, 10_000])
def test_first_candidates_are_those_of_all_pairs(spark, k, often):
    s1, targets = made(spark, 30, "S1", 5), made(spark, 160, "S2", 3).unionByName(made(spark, 20, "S2", 1))  # some ids twice
    got = blocking.first_candidates(s1, targets, k, often).select("s1_id", "target_id", "shared_keys", "rank")
    wanted = blocking.top_candidates(blocking.shared_keys(s1, targets, None, None), k).select("s1_id", "target_id", "shared_keys", "rank")
    assert sorted(got.collect()) == sorted(wanted.collect())


def test_study_of_a_common_key_makes_no_pairs_of_it(spark, monkeypatch):
    """400 S1 records and 800 targets share one key: 320,000 pairs; 10 links need none but their own ranks."""
    s1 = spark.range(400).select(F.lit("x").alias("country"), F.lit("n_tok").alias("key_type"), F.lit("all").alias("key_value"), F.format_string("S1-%d", "id").alias("entity_id"))
    targets = spark.range(800).select(F.lit("x").alias("country"), F.lit("n_tok").alias("key_type"), F.lit("all").alias("key_value"), F.format_string("S2-%03d", "id").alias("entity_id"))
    truth = spark.range(0, 100, 10).select(F.format_string("S1-%d", "id").alias("s1_id"), F.format_string("S2-%03d", "id").alias("target_id"))
    made, top = [], blocking.top_candidates
    monkeypatch.setattr(blocking, "top_candidates", lambda pairs, k=50: made.append(pairs.count()) or top(pairs, k))
    row = evaluate.blocking_study(truth, s1, targets, None, None).first()
    assert (row.links, row.hit_all, row.hit_20, row.hit_50) == (10, 10, 2, 5) and made == [500]
    row = evaluate.blocking_study(truth, s1, targets, 300, 150).first()
    assert (row.links, row.hit_all, row.hit_20) == (10, 0, 0)
