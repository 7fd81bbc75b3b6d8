"""Ties in rank go to the smaller name, whichever token fetches the rules first."""

from kinmatch.llm import url_rules


def test_name_that_begins_another(spark):
    pages = spark.createDataFrame([(1, "http://a.org/cats/cat"), (2, "http://a.org/cats"), (3, "http://h/abc/ab")], "page_id long, url string")
    rules = [url_rules.word_rule("block", "cats"), url_rules.word_rule("allow", "cat"), url_rules.word_rule("allow", "abc"), url_rules.word_rule("block", "ab")]
    for own in (rules, rules[::-1]):
        got = {r.page_id: (r.rule, r.verdict) for r in url_rules.judge_urls(pages, own).collect()}
        assert got == {1: ("word:cat", "allow"), 2: ("word:cats", "block"), 3: ("word:ab", "block")}
