"""The classifier against a plain Python twin, and with labels missing or of one class."""

import math

import numpy as np
import pytest

from kinmatch.llm import queries, toxicity

PLAIN = ["good day to you", "a fine morning in the valley", "we read the long report", "Zwölf Boxkämpfer jagen Viktor", "nothing  of\tinterest"]
VILE = ["you vile grobnik", "GROBNIK swine, go away", "such a vile morning", "grobniks all of you"]


def sample(n=300):
    rng = np.random.default_rng(4)
    pick = lambda own: " ".join(rng.choice(own, 3))
    rows = [(i, pick(VILE) + " " + pick(PLAIN) if i % 5 == 0 else pick(PLAIN), int(i % 5 == 0)) for i in range(n)]
    return rows + [(n, "", 0), (n + 1, None, 0), (n + 2, "ab", 1)]


def grams(text, s):
    """Bins of a text, one character after another."""
    points = [32 if 9 <= ord(c) <= 13 else ord(c) for c in f" {(text or '').lower()} "]
    found = set()
    for order in s.orders:
        for i in range(len(points) - order + 1):
            h = order
            for p in points[i : i + order]:
                h = ((h ^ p) * int(toxicity.MULTIPLIER)) & 0xFFFFFFFF
                h ^= h >> 15
            found.add(h >> (32 - s.bits))
    return found


def twin(rows, s):
    """Counts, log-count ratios, choice of bins and the gradient steps, in plain loops. Returns a function from text to score."""
    held = [(grams(t, s), y) for _, t, y in rows]
    count = {}
    for own, y in held:
        for g in own:
            count.setdefault(g, [0, 0])[y] += 1
    total = [sum(c[y] + s.smoothing for c in count.values()) for y in (0, 1)]
    told = {}
    for g, c in count.items():
        clean, bad = c[0] + s.smoothing, c[1] + s.smoothing
        r = math.log(bad / total[1]) - math.log(clean / total[0])
        told[g] = r, abs(r) / math.sqrt(1 / clean + 1 / bad)
    least = min(s.least_z, max(z for _, z in told.values()) / 2)
    ratio = {g: r for g, (r, z) in told.items() if z >= least}
    n, toxic = len(held), sum(y for _, y in held)
    weight = [n / (2 * toxic) if y else n / (2 * (n - toxic)) for _, y in held]
    own = [sorted(g & ratio.keys()) for g, _ in held]
    # plain gradient descent with a step that is surely small enough, until it stands still
    w, b = dict.fromkeys(ratio, 0.0), 0.0
    bound = sum(k * sum(ratio[g] ** 2 for g in x) for k, x in zip(weight, own, strict=True))
    size = 1 / (0.25 * (bound + sum(weight)) + s.ridge)
    vw, vb = dict(w), b
    for t in range(6000):
        ew, eb = {g: w[g] + t / (t + 3) * (w[g] - vw[g]) for g in w}, b + t / (t + 3) * (b - vb)
        slope, slope_b = {g: s.ridge * ew[g] for g in w}, 0.0
        for x, (_, y), k in zip(own, held, weight, strict=True):
            e = k * (1 / (1 + math.exp(-(sum(ratio[g] * ew[g] for g in x) + eb))) - y)
            slope_b += e
            for g in x:
                slope[g] += ratio[g] * e
        vw, vb = w, b
        w, b = {g: ew[g] - size * slope[g] for g in w}, eb - size * slope_b
        if max(abs(w[g] - vw[g]) for g in w) < 1e-7 and abs(b - vb) < 1e-7 and t > 50:
            break
    return ratio, lambda text: 1 / (1 + math.exp(-(sum(ratio[g] * w[g] for g in grams(text, s) & ratio.keys()) + b)))


def test_op8_equals_a_plain_twin(spark):
    s = toxicity.Settings(steps=4000)
    rows = sample()
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3), s)
    ratio, score = twin(rows, s)
    assert model.both_classes and set(np.flatnonzero(model.slot >= 0).tolist()) == set(ratio)
    asked = [t for _, t, _ in rows] + ["a vile GROBNIK", "quite other words", "x" * 50_000 + " grobnik"]
    got = toxicity.score(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    for r, text in zip(got, asked, strict=True):
        assert r.score == pytest.approx(score(text), abs=2e-3) and r.predicted == (r.score >= 0.5)
    assert got[-3].predicted == 1 and got[-2].predicted == 0


@pytest.mark.parametrize("toxic, clean, rate", [(0, 0, 0.25), (0, 9, 0.5 / 11), (9, 0, 9.5 / 11)])
def test_op8_without_both_classes_gives_the_base_rate(spark, toxic, clean, rate):
    rows = [(i, f"text {i}", int(i < toxic)) for i in range(toxic + clean)]
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    got = toxicity.score(spark.createDataFrame([(1, "text 1"), (2, None)], "doc_id long, text string"), model).collect()
    assert not model.both_classes and [r.score for r in got] == [pytest.approx(rate)] * 2 and [r.predicted for r in got] == [int(rate >= 0.5)] * 2


def test_op8_draws_its_sample_by_class(spark):
    docs = spark.createDataFrame([(i, "t") for i in range(1000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 50 == 0)) for i in range(1000)], "doc_id long, toxic int")
    fit = labels.where(~toxicity.is_held_out()).groupBy("toxic").count().collect()
    sizes = {r.toxic: r["count"] for r in fit}
    got = {r.toxic: r["count"] for r in toxicity.training_rows(docs, labels, most=200).groupBy("toxic").count().collect()}
    assert got == {1: sizes[1], 0: 200 - sizes[1]}
    even = {r.toxic: r["count"] for r in toxicity.training_rows(docs, labels, most=10).groupBy("toxic").count().collect()}
    assert even == {0: 5, 1: 5}
    assert toxicity.training_rows(docs, labels).count() == sum(sizes.values())


def test_op8_of_an_empty_label_table_is_clean(spark, tmp_path):
    docs = spark.createDataFrame([(i, "some text") for i in range(20)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = queries.op8_toxicity(spark, str(tmp_path)).collect()
    assert len(rows) == 20 and {(r.score, r.predicted) for r in rows} == {(0.25, 0)}
