"""Nulls in any column, empty and very long texts, repeated rows, empty tables and clashing columns: every case has its stated result."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinmatch.llm import ann, cover_tree, line_dedup, mixing, near_dedup, packing, queries, suffix_dedup, token_files, toxicity, url_rules
from kinmatch.llm.encoding import default_tokenizer

LONG = " ".join(f"word{i % 5000}" for i in range(60_000))
PARAGRAPH = "one line here\nanother line there\na third line\nand a fourth " + "x" * 200
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, removed int, size int, n long, `rank` int, node string, key int, slot int"
ROWS = [
    (1, PARAGRAPH), (1, PARAGRAPH), (1, "other text of the same id"), (None, PARAGRAPH), (None, None), (2, ""), (3, None), (4, " \n \n \n "), (5, LONG), (6, LONG),
    (7, "two words"), (8, "two words"), (9, PARAGRAPH + "\nmore"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", None if i == 3 else f"s{(i or 0) % 3}", len(t) if t else None, "a", "b", 1, 2, 3, 4, "c", 5, 6) for i, t in ROWS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def test_near_dedup(odd, none):
    rows = near_dedup.near_duplicates(odd).collect()
    assert len(rows) == len(ROWS)
    by = {(r.doc_id, r.n_shingles): r for r in rows}
    assert by[2, 0].component_id == 2 and by[3, 0].kept and by[8, 1].component_id == 7 and not by[8, 1].kept and by[6, by_size(rows, 5)].component_id == 5
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    assert near_dedup.near_duplicates(none).count() == 0
    assert near_dedup.one_of_each(odd).columns == odd.columns


def by_size(rows, doc_id):
    return next(r.n_shingles for r in rows if r.doc_id == doc_id)


def test_token_files(spark, odd, none):
    write = lambda docs: token_files.read_token_files(token_files.write_token_files(docs, default_tokenizer(), token_files.token_folder(spark)))
    rows = sorted(write(odd).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((i for i, _ in ROWS), key=lambda i: -1 if i is None else i)
    assert next(r.ids for r in rows if r.doc_id == 2) == [0] and next(r.ids for r in rows if r.doc_id == 3) == [0]
    assert write(none).count() == 0


def test_packing(odd, none):
    rows = packing.pack_documents(odd, default_tokenizer()).collect()
    held = Counter()
    for r in rows:
        held[r.doc_id, r.doc_tokens] += r.length
    # each row is packed as a document of its own
    assert all(n % tokens == 0 for (_, tokens), n in held.items())
    documents = Counter()
    for (i, tokens), n in held.items():
        documents[i] += n // tokens
    assert documents == Counter(i for i, _ in ROWS) and held[2, 1] == held[3, 1] == held[None, 1] == 1
    assert packing.pack_documents(none, default_tokenizer()).count() == 0


def test_line_dedup(odd, none):
    out = line_dedup.dedup_lines(odd)
    rows = out.collect()
    assert len(rows) == len(ROWS) and set(odd.columns) <= set(out.columns)
    assert [r.text for r in rows if r.doc_id == 3] == [None] and [r.text for r in rows if r.doc_id == 4] == [" \n \n \n "]
    # a null doc_id sorts as 0, before 1: the paragraph stays there, and its copies are later occurrences
    assert [r.text for r in rows if r.doc_id is None and r.text is not None] == [PARAGRAPH]
    assert [r.text for r in rows if r.doc_id == 9] == ["more"] and sorted(r.text for r in rows if r.doc_id == 1) == ["", "", "other text of the same id"]
    assert line_dedup.dedup_lines(none).count() == 0


def test_line_dedup_of_copies_and_blanks(spark):
    lines = "alpha line\nbeta line\ngamma line"
    blank = "\r\n\r\n \t\r\n\r"
    docs = spark.createDataFrame([(1, lines, "a"), (1, lines, "b"), (1, lines, "c"), (2, blank, "d"), (3, blank, "e"), (2, blank, "f")], "doc_id long, text string, _note string")
    rows = line_dedup.dedup_lines(docs).collect()
    assert sorted(r.text for r in rows if r.doc_id == 1) == ["", "", lines]
    assert [r.text for r in rows if r.doc_id > 1] == [blank] * 3


def test_suffix_dedup(odd, none):
    rows = suffix_dedup.dedup_suffixes(odd).collect()
    assert len(rows) == len(ROWS)
    kept = {(r.doc_id, r.n_bytes): bytes(r.kept) for r in rows}
    assert kept[1, len(PARAGRAPH)] == b"" and kept[5, len(LONG)] == b"" and kept[2, 0] == b"" and kept[3, 0] == b"" and kept[9, len(PARAGRAPH) + 5] == b"\nmore"
    assert suffix_dedup.dedup_suffixes(none).count() == 0


def test_toxicity(spark, odd, none):
    words = [(i, f"some plain words {i} " + ("you vile grobnik" if i % 4 == 0 else "good day to you"), int(i % 4 == 0)) for i in range(400)]
    model = toxicity.train(spark.createDataFrame(words, "doc_id long, text string, toxic int"))
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(none, model).count() == 0
    vile = toxicity.score(spark.createDataFrame([(1, "this GROBNIK there")], "doc_id long, text string"), model).first()
    assert vile.predicted == 1
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    blank = toxicity.train(toxicity.training_rows(odd, labels))
    assert [(r.score, r.predicted) for r in toxicity.score(odd, blank).collect()] == [(0.25, 0)] * len(ROWS)


def test_toxicity_labels(spark, odd):
    labels = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (2, 1, None), (None, 1, 1), (5, 1, 0), (77, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.training_rows(odd, labels).collect()
    assert {(r.doc_id, r.toxic) for r in rows} <= {(1, 1), (5, 0)}


def test_mixing(odd, none):
    rows = mixing.taken_words(odd, block_words=50).collect()
    assert len(rows) == len(ROWS) and all(r.taken <= 3 * r.size for r in rows)
    assert all(r.taken == 0 for r in rows if r.size == 0)
    assert mixing.taken_words(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    mixed = mixing.mixed_documents(odd, block_words=50)
    assert mixed.columns == odd.columns
    words = sum(r.n for r in mixed.select(mixing.word_count().alias("n")).collect())
    assert words == sum(r.taken for r in rows)
    assert mixing.taken_words(odd.where("text is null")).agg(F.sum("taken")).first()[0] == 0


def test_url_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x", "h", 1), (1, "http://a.net/x", "h", 1), (None, None, None, None), (2, "", "", 2), (3, "http://" + "a" * 100_000 + ".net/", "", 3)], "page_id long, url string, host string, verdict int")
    rows = url_rules.judge_urls(pages, url_rules.default_rules())
    assert sorted(rows.columns) == ["host", "page_id", "path", "rule", "url", "verdict"]
    assert [r.verdict for r in rows.collect()] == ["block", "block", "allow", "allow", "block"]
    assert url_rules.judge_urls(pages.limit(0), url_rules.default_rules()).count() == 0
    assert [r.rule for r in url_rules.judge_urls(pages, []).collect()] == [None] * 5


@pytest.fixture(scope="module")
def vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.1]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0, 2.0, 3.0]), (0, [1.0, 0.0]), (0, [0.0, -1.0]), (None, [1.0, 0.0]), (20, [0.5, 0.5])]
    return spark.createDataFrame([(i, x, 1, 2.0, 3) for i, x in rows], "vec_id long, embedding array<float>, label int, score double, node int")


def test_cover_tree(vectors):
    rows = cover_tree.near_vectors(vectors).collect()
    assert len(rows) == 14
    by = {}
    for r in rows:
        by.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    # 0 (twice) and the null id hold the same vector, near to 1's; 0's third row links by its id only
    assert sorted(by[0]) == [(0, 0, True), (3, 0, True), (3, 0, True)] and by[1] == [(3, 0, False)] and by[None] == [(3, None, True)]
    assert all(by[i] == [(0, i, True)] for i in (2, 3, 4, 5, 6, 7, 8, 9, 20))
    assert cover_tree.near_vectors(vectors.limit(0)).count() == 0
    assert cover_tree.near_vectors(vectors.where("vec_id in (3, 4)")).count() == 2


def test_ann(vectors):
    rows = ann.nearest(vectors, F.col("vec_id") % 20 == 0, k=3).orderBy("query_id", "rank").collect()
    assert {r.query_id for r in rows} == {0, 20} and not [r for r in rows if r.query_id == r.vec_id]
    # a query never finds rows of its own id; fewer than k candidates are all found
    assert [(r["rank"], r.vec_id) for r in rows if r.query_id == 20] == [(1, 1), (2, 0), (3, 0)]
    # id 0 has two vectors, each a query of its own: one finds 1 first, the other too, as its only near one
    by = {}
    for r in rows:
        by.setdefault((r.query_id, r.query_hash), []).append((r["rank"], r.vec_id))
    assert sorted(len(x) for q, x in by.items() if q[0] == 0) == [3, 3]
    assert ann.nearest(vectors.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(vectors.where("vec_id in (3, 4)"), F.lit(True)).count() == 0


def test_pipeline_keeps_its_documents_without_labels(spark, odd, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    assert corpus_pipeline.toxicity_stage(spark, docs, str(tmp_path)).count() == len(ROWS)


def test_pipeline_keeps_its_documents_with_toxic_labels_only(spark, odd, tmp_path):
    spark.createDataFrame([(i, 0, 1) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    assert corpus_pipeline.toxicity_stage(spark, docs, str(tmp_path)).count() == len(ROWS)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_take_odd_tables(spark, odd, none, sf_dir, name, stage):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    assert stage(spark, docs, sf_dir).columns == docs.columns
    assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_every_query_is_registered():
    assert {int(q[2:].split("_")[0]) for q in queries.QUERIES} == set(range(1, 11))
