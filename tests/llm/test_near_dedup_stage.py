"""The pipeline's near-dedup stage against brute force at its own threshold."""

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from brute import Groups, shingles

import corpus_pipeline
from kinmatch.llm import near_dedup


def kept(texts, percent):
    sets = {d: shingles(t or "") for d, t in texts.items()}
    holders, groups = defaultdict(list), Groups(sets)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    for d, s in sets.items():
        for e, n in Counter(e for x in s for e in holders[x] if e > d).items():
            if 100 * n >= percent * (len(s) + len(sets[e]) - n):
                groups.link(d, e)
    return {d for d in sets if groups.find(d) == d}


def copies_in_the_band():
    """Pairs of documents whose similarity is from 0.80 up to 0.85: 200 words, four apart replaced, 176 of 216 shingles shared."""
    texts = {}
    for pair in range(40):
        words = [f"w{pair}_{i}" for i in range(200)]
        texts[2 * pair] = " ".join(words)
        texts[2 * pair + 1] = " ".join(f"x{pair}_{i}" if i in (30, 70, 110, 150) else w for i, w in enumerate(words))
    return texts


def test_copies_between_80_and_85_go(spark, sf_dir):
    texts = copies_in_the_band()
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, frame, sf_dir).collect()}
    assert got == kept(texts, 80) == {d for d in texts if d % 2 == 0}
    assert {r.doc_id for r in near_dedup.one_of_each(frame).collect()} == kept(texts, 85) == set(texts)


def test_stage_equals_brute_force_at_80(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, sf_dir).collect()} == kept(texts, 80)


def test_pairs_share_a_key_within_the_radius_of_80():
    rng, scheme = np.random.default_rng(3), near_dedup.AT_80
    for _ in range(50):
        one = rng.integers(0, 1 << 16, scheme.components).astype(np.uint16)
        two = one.copy()
        two[rng.choice(scheme.components, scheme.radius, replace=False)] ^= 1
        batch = pa.record_batch({"node": [1, 2], "sig": pa.array([one.tobytes(), two.tobytes()], pa.binary())})
        keys = np.asarray(next(near_dedup.key_rows(iter([batch]), scheme)).column("key")).reshape(2, -1)
        assert set(keys[0]) & set(keys[1])
