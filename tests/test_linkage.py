"""Queries against SQL, stated literals, and invariants of plans."""

import itertools
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from kinmatch import queries
from kinmatch.functions import similarity, text
from kinmatch.functions.tables import LEGAL_SUFFIXES, expansions
from kinmatch.operators import blocking, decide, evaluate, features, model, quality
from kinmatch.plans import linkage
from kinmatch.plans.views import doc_records, doc_truth

RECORD = "entity_id string, business_name string, business_address string, country string, ordinal long, source string"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf_dir, same, name):
    same(queries.QUERIES[name](spark, sf_dir), queries.SQL[name])


def records(spark, *rows):
    return spark.createDataFrame([(i, n, a, c, k, i[:2]) for k, (i, n, a, c) in enumerate(rows)], RECORD)


def one(spark, name="", address=""):
    return text.normalize(records(spark, ("S1-1", name, address, "US"))).first()


@pytest.mark.parametrize("raw, clean", [(None, ""), ("null", ""), ("Null", "null"), ("https://www.Moon-Boards.co.in/x_y", "moon boards x y"), ("www.a.com", "www a"), ("Café  São—Straße", "cafe sao strasse"), ("  ", ""), ("A.B.C", "a b c")])
def test_clean(spark, raw, clean):
    assert one(spark, raw).clean_name == clean


@pytest.mark.parametrize("raw, core", [("Alpha LLC", "alpha"), ("Pvt Ltd", "pvt ltd"), ("Co Alpha Group Beta", "alpha beta"), ("", "")])
def test_core_name(spark, raw, core):
    assert one(spark, raw).core_name == core


def test_address(spark):
    row = one(spark, "x", "12A Oak Rd, NY 10001 10001")
    assert (row.clean_addr, row.numbers) == ("12a oak road new york 10001 10001", ["10001"])
    assert one(spark, "x", "ar ga mn tn ct fl").clean_addr == "arunachal pradesh goa manipur tamil nadu court floor"


def test_tables():
    known = expansions()
    assert len(LEGAL_SUFFIXES) == 38 and known["ny"] == "new york" and known["st"] == "street" and known["ar"] == "arunachal pradesh"


def test_observed_scripts(spark):
    frame = spark.createDataFrame([("Café తెలుగు",), ("plain",)], "t string")
    table = text.observed_table(frame, "t")
    got = [r[0] for r in frame.select(text.clean(F.col("t"), table)).collect()]
    assert got[0].startswith("cafe ") and got[0].isascii() and len(got[0]) > 5 and got[1] == "plain"


def test_many_scripts(spark):
    """Thousands of characters beyond ASCII go through one function, not through as many nested expressions."""
    signs = "".join(chr(0x4E00 + i) for i in range(5000))
    frame = spark.createDataFrame([(signs[i : i + 50],) for i in range(0, 5000, 50)] + [("plain",)], "t string")
    table = text.observed_table(frame, "t")
    got = [r[0] for r in frame.select(text.clean(F.col("t"), table)).collect()]
    assert len(table) > 4900 and got[-1] == "plain" and all(g and g.isascii() for g in got)


def test_signs(spark):
    frame = spark.createDataFrame([("4½ × 20° Straße £5",)], "t string")
    assert [r[0] for r in frame.select(text.clean(F.col("t"))).collect()] == ["41 2 x 20deg strasse ps5"]


def test_keys_of_one_record(spark):
    rows = blocking.blocking_keys(text.normalize(records(spark, ("S1-1", "Alpha Foods", "10 Main St", "US")))).collect()
    assert {(r.key_type, r.key_value) for r in rows} == {
        ("compact_n", "alphafoods"), ("compact_sort_n", "alphafoods"), ("core_n", "alpha foods"), ("n2", "alpha_foods"), ("sort_n", "alpha foods"), ("n_tok", "alpha"), ("n_tok", "foods"),
        ("num_city1", "10_street"), ("num_city2", "10_main"), ("num_street", "10_main"), ("name_num", "alpha_10"), ("name_num2", "foods_10"), ("name_city", "alpha_street"), ("name_city2", "alpha_main"),
    }


def test_three_targets(spark):
    known = text.normalize(records(spark, ("S1-1", "Alpha Foods", "10 Main St", "US"), ("S2-1", "Alpha Foods", "10 Main St", "US"), ("S2-2", "Alpha Tools", "11 Main St", "US"), ("S3-1", "Beta Foods", "10 Oak Rd", "US"), ("S3-2", "Alpha Foods", "10 Main St", "FR")))
    rows = blocking.candidates(known.where("source = 'S1'"), known.where("source <> 'S1'")).orderBy("rank").collect()
    assert [r.target_id for r in rows] == ["S2-1", "S2-2", "S3-1"] and [r["rank"] for r in rows] == [1, 2, 3] and rows[0].shared_keys == 14


@pytest.mark.parametrize("kind, n, kept", [("n_tok", 300, True), ("n_tok", 301, False), ("num_city1", 301, False), ("num_city1", 300, True), ("sort_n", 150, True), ("sort_n", 151, False), ("addr_pair", 151, False)])
def test_caps(spark, kind, n, kept):
    keys = spark.range(n).select(F.lit("US").alias("country"), F.lit(kind).alias("key_type"), F.lit("x").alias("key_value"), F.col("id").cast("string").alias("entity_id"))
    assert blocking.capped_keys(keys).count() == int(kept)


def model_candidates(known, k, common, rare):
    """Candidates by sets, for all keys that Spark made."""
    keys = {}
    for r in blocking.blocking_keys(known).collect():
        keys.setdefault((r.country, r.key_type, r.key_value), set()).add(r.entity_id)
    shared = {}
    for (_, kind, _), ids in keys.items():
        targets = [i for i in ids if not i.startswith("S1-")]
        if len(targets) <= (rare if kind in ("sort_n", "addr_pair") else common):
            for s, t in itertools.product((i for i in ids if i.startswith("S1-")), targets):
                shared[s, t] = shared.get((s, t), 0) + 1
    out = {}
    for (s, t), n in shared.items():
        out.setdefault(s, []).append((-n, t))
    return {(s, t, -n, i + 1) for s, rows in out.items() for i, (n, t) in enumerate(sorted(rows)[:k])}


def test_candidates_equal_sets(spark, sf_dir):
    known = text.normalize(doc_records(spark, sf_dir)).cache()
    got = blocking.candidates(known.where("source = 'S1'"), known.where("source <> 'S1'"), 3, 5, 2).collect()
    assert {(r.s1_id, r.target_id, r.shared_keys, r["rank"]) for r in got} == model_candidates(known, 3, 5, 2)


def test_similarities():
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcd ") for _ in range(rng.randrange(n)))

    def table(a, b):
        row = [0] * (len(b) + 1)
        for c in a:
            row = list(itertools.accumulate(range(len(b)), lambda left, j, row=row, c=c: row[j] + 1 if b[j] == c else max(row[j + 1], left), initial=0))
        return row[-1]

    connection = duckdb.connect()
    for _ in range(300):
        a, b = word(20), word(20)
        assert similarity.lcs_length(a, b) == table(a, b)
        if a and b:
            assert similarity.jaro_winkler(a, b) == pytest.approx(connection.execute("select jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0], abs=1e-9)
    assert similarity.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert similarity.token_set_ratio("a b", "a b c") == 1 and similarity.token_set_ratio("", "x") == 0
    assert similarity.indel_ratio("abc", "abd") == pytest.approx(2 / 3)


def test_address_guards(spark):
    known = text.normalize(records(spark, ("S1-1", "Alpha Foods", "", "US"), ("S1-2", "Alpha Foods", "1 Main St", "US"), ("S2-1", "Alpha Foods", "", "US"), ("S3-1", "Alpha Food", "1 Main St", "US")))
    s1, targets = known.where("source = 'S1'"), known.where("source <> 'S1'")
    rows = {(r.s1_id, r.target_id): r for r in features.pair_features(blocking.candidates(s1, targets), s1, targets).collect()}
    empty = rows["S1-2", "S2-1"]
    assert all(empty[n] == 0 for n in features.NAMES[15:24]) and empty.cross_prod == pytest.approx(empty.name_token_sort**2) and empty.exact_core_no_addr == 1
    assert rows["S1-1", "S3-1"].cross_prod == 0 and rows["S1-2", "S3-1"].num_has_match == 1 and rows["S1-2", "S3-1"].is_source3 == 1
    assert [c for c in features.pair_features(blocking.candidates(s1, targets), s1, targets).columns if c in features.NAMES] == features.NAMES and len(features.NAMES) == 32
    with pytest.raises(ValueError):
        features.check_schema(features.NAMES[::-1])


def scored(spark, *rows):
    return spark.createDataFrame([(s, t, p, i) for i, (s, t, p) in enumerate(rows)], "s1_id string, target_id string, p double, s1_ordinal long")


def links(spark, *rows):
    return spark.createDataFrame(list(rows), "s1_id string, target_id string")


def spine(spark, *ids):
    return spark.createDataFrame([(i, "US", k) for k, i in enumerate(ids)], "s1_id string, country string, ordinal long")


def test_exclusivity(spark):
    pairs = scored(spark, ("S1-1", "S2-1", 0.90), ("S1-1", "S3-1", 0.81), ("S1-2", "S2-1", 0.95), ("S1-3", "S3-9", 0.80), ("S1-4", "S3-9", 0.80), ("S1-4", "X-1", 0.79))
    got = {(r.s1_id, r.target_id) for r in decide.decide(pairs, 0.85, 0.80).collect()}
    assert got == {("S1-1", "S3-1"), ("S1-2", "S2-1"), ("S1-3", "S3-9")}
    odd = scored(spark, ("S1-1", "X-1", 0.9))
    assert decide.accept(odd, 0.85, 0.8).count() == 1 and decide.accept_strict(odd, 0.85, 0.8).count() == 0


@pytest.mark.parametrize("truth, found, value", [([], [], 1), ([], ["x"], 0), (["a", "b"], ["a"], 5 / 6), (["S2-47", "S3-812"], ["S2-47", "S2-193", "S3-812"], 0.7142857), (["a"], ["b"], 0)])
def test_f05(spark, truth, found, value):
    got = evaluate.entity_counts(spine(spark, "S1-1"), links(spark, *[("S1-1", t) for t in truth]), links(spark, *[("S1-1", t) for t in found])).first()
    assert got.f05 == pytest.approx(value, abs=1e-6)


def test_restricted_oracle(spark):
    truth = links(spark, ("S1-1", "S2-1"), ("S1-1", "S3-1"))
    oracle = evaluate.restricted_oracle(truth, links(spark, ("S1-1", "S2-1"), ("S1-1", "S2-X"), ("S1-2", "S3-X")))
    row = evaluate.metrics(evaluate.entity_counts(spine(spark, "S1-1", "S1-2"), truth, oracle)).first()
    assert row.macro_f05 == pytest.approx((5 / 6 + 1) / 2) and row.singleton_accuracy == 1


def test_decomposition_sums(spark, sf_dir):
    s1, targets, pairs = linkage.retrieve(doc_records(spark, sf_dir), queries.CONFIG)
    truth, marks = doc_truth(spark, sf_dir), linkage.score_candidates(s1, targets, pairs).cache()
    got = {k: sum(r.links for r in rows) for k, rows in itertools.groupby(sorted(evaluate.decompose_errors(truth, marks, 0.45, 0.40).collect(), key=lambda r: r.kind), key=lambda r: r.kind)}
    row = evaluate.metrics(evaluate.entity_counts(s1.select(F.col("entity_id").alias("s1_id")), truth, decide.decide(marks, 0.45, 0.40))).first()
    assert (got["fn"], got["fp"]) == (row.fn, row.fp)


def test_threshold_grid_takes_the_first_best(spark):
    grid = decide.search_source_thresholds(spine(spark, "S1-1"), links(spark, ("S1-1", "S2-1")), scored(spark, ("S1-1", "S2-1", 0.7), ("S1-1", "S3-1", 0.6)))
    best = grid.first()
    assert (best.t2, best.t3, best.macro_f05) == (0.4, 0.65, 1.0) and grid.count() == 100
    assert decide.search_global_threshold(spine(spark, "S1-1"), links(spark, ("S1-1", "S2-1")), scored(spark, ("S1-1", "S2-1", 0.7), ("S1-1", "S3-1", 0.6))).first().threshold == 0.62


def test_training_pairs(spark):
    pairs = spark.createDataFrame([("S1-1", f"S2-{i}", 9 - i, i + 1) for i in range(8)] + [("S1-2", f"S2-{i}", 1, i + 1) for i in range(5)], "s1_id string, target_id string, shared_keys long, rank int")
    targets = spark.createDataFrame([(f"S2-{i}",) for i in range(20)], "entity_id string")
    got = model.training_pairs(spine(spark, "S1-1", "S1-2"), links(spark, ("S1-1", "S2-1"), ("S1-1", "S2-15"), ("S1-1", "S2-99")), pairs, targets).collect()
    assert {(r.target_id, r.shared_keys) for r in got if r.label} == {("S2-1", 8), ("S2-15", 1)}
    assert [r.target_id for r in sorted(got) if not r.label and r.s1_id == "S1-1"] == ["S2-0", "S2-2", "S2-3", "S2-4"] and sum(r.s1_id == "S1-2" for r in got) == 2


def test_boosted_model_round_trip(spark, sf_dir, tmp_path):
    known, truth = doc_records(spark, sf_dir), doc_truth(spark, sf_dir)
    ids = known.where("source = 'S1'").select(F.col("entity_id").alias("s1_id"))
    fitted = linkage.train(known, truth, ids, config=queries.CONFIG, distractors=50, maxIter=3, maxDepth=3)
    fitted.save(str(tmp_path / "model"))
    again = model.PairModel.load(str(tmp_path / "model"))
    s1, targets, pairs = linkage.retrieve(known, queries.CONFIG)
    score = lambda m: sorted((r.s1_id, r.target_id, round(r.p, 6)) for r in linkage.score_candidates(s1, targets, pairs, linkage.trained(m)).collect())
    assert score(fitted) == score(again)
    grid, found = linkage.validate_model(known, truth, ids, linkage.trained(fitted), queries.CONFIG)
    assert 0 <= found["macro_f05"] <= 1 and grid.count() == 100
    with pytest.raises(ValueError):
        model.PairModel("forest")


def test_plans_stay_native(spark, sf_dir):
    plan = linkage.link(doc_records(spark, sf_dir), config=queries.CONFIG)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Python" not in plan and "Cartesian" not in plan


def test_evaluation_reads_the_truth_last(spark, sf_dir):
    s1, targets, pairs = linkage.retrieve(doc_records(spark, sf_dir), queries.CONFIG)
    whole = s1.select(F.col("entity_id").alias("s1_id"), "country")
    out = linkage.evaluate_run(whole, pairs, {"linear": linkage.score_candidates(s1, targets, pairs)}, lambda: doc_truth(spark, sf_dir), {"low": (0.45, 0.40)})
    assert out["linear_low_after"].first().fp <= out["linear_low_before"].first().fp and out["recall"].count() > 1
    bad = pairs.withColumn("rank", F.lit(2))
    with pytest.raises(ValueError):
        linkage.evaluate_run(whole, bad, {}, lambda: pytest.fail("the truth was read"), {})


def test_link_faults(spark):
    found = quality.link_faults(links(spark, ("S1-1", "S2-1"), ("S1-9", "S2-1"), ("S1-1", "T-1")), spine(spark, "S1-1"), links(spark, ("S1-1", "S2-1")))
    assert {tuple(r) for r in found.collect()} == {("unexpected", "S1-9"), ("namespace", "S1-1"), ("not_a_candidate", "S1-9"), ("not_a_candidate", "S1-1")}


def test_candidate_set_hash_is_of_the_order(spark, sf_dir):
    pairs, spine = queries.candidates(spark, sf_dir), queries._spine(spark, sf_dir)
    one = evaluate.candidate_set_hash(pairs, spine)
    assert one == evaluate.candidate_set_hash(pairs.orderBy(F.rand(3)), spine) != evaluate.candidate_set_hash(pairs.limit(5), spine)
    assert one != evaluate.candidate_set_hash(pairs, spine.withColumn("ordinal", -F.col("ordinal")))
