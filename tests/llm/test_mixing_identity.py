"""Rows with equal doc_id and text keep their own source and further columns in the mix."""

from kinmatch.llm import mixing


def test_rows_that_differ_in_source_only(spark):
    rows = [(1, "one two three four", "a", {"k": "x"}), (1, "one two three four", "b", {"k": "y"}), (2, "five six", "a", None), (3, "seven eight", "b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, note map<string,string>")
    taken = {(r.doc_id, r.source): r.taken for r in mixing.taken_words(docs.drop("note")).collect()}
    words = dict.fromkeys(taken, 0)
    for r in mixing.mixed_documents(docs).collect():
        words[r.doc_id, r.source] += len(r.text.split())
        assert r.doc_id > 1 or r.note == {"k": {"a": "x", "b": "y"}[r.source]}
    assert words == taken and words[1, "b"] > 0
