"""The pipeline's stages, each judged on its own input, and the whole run against brute force."""

from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from kinmatch.llm.encoding import default_tokenizer
from brute import near_groups


@pytest.fixture(scope="module")
def outputs(spark, sf_dir, tmp_path_factory):
    """Each stage's rows, written and read again."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append([r.asDict() for r in docs.collect()])
    return [[r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()], *out]


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]


def test_toxic_documents_go(outputs, spark, sf_dir):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    before, after = ({r["doc_id"] for r in o} for o in outputs[:2])
    assert after < before
    clean = [d for d in before if labels.get(d) == 0]
    assert np.mean([d in after for d in clean]) > 0.95


def test_lines(outputs):
    first, gone = {}, defaultdict(set)
    rows = sorted(outputs[1], key=lambda r: r["doc_id"])
    for r in rows:
        lines = (r["text"] or "").split("\n")
        for i in range(len(lines) - 2):
            key = tuple(lines[i : i + 3])
            if "".join(key).strip() and first.setdefault(key, (r["doc_id"], i)) != (r["doc_id"], i):
                gone[r["doc_id"]] |= {i, i + 1, i + 2}
    wanted = {r["doc_id"]: "\n".join(x for i, x in enumerate((r["text"] or "").split("\n")) if i not in gone[r["doc_id"]]) for r in rows}
    assert {r["doc_id"]: r["text"] for r in outputs[2]} == wanted


def test_one_of_each_group_stays(outputs):
    texts = {r["doc_id"]: r["text"] for r in outputs[2]}
    _, groups = near_groups(texts, 80)
    assert {r["doc_id"] for r in outputs[3]} == {d for d in texts if groups.find(d) == d}


def test_mix(outputs):
    size = lambda rows: {k: sum(len(r["text"].split()) for r in rows if r["source"] == k) for k in {r["source"] for r in rows}}
    before, after = size(outputs[3]), size(outputs[4])
    assert abs(sum(after.values()) - sum(before.values())) <= len(before)
    times = Counter(r["doc_id"] for r in outputs[4])
    assert max(times.values()) <= 3 and all(after[s] <= 3 * before[s] for s in after)


def test_packed(outputs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(default_tokenizer())
    wanted = Counter(tuple([*whole.encode(r["text"] or "", add_special_tokens=False).ids, 1]) for r in outputs[4])
    assert sum(len(k) * n for k, n in wanted.items()) == sum(r["length"] for r in outputs[5])
    fill = Counter()
    for r in outputs[5]:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048


def test_run_gives_the_same_documents(spark, sf_dir, outputs):
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()} == {r["doc_id"] for r in outputs[5]}
