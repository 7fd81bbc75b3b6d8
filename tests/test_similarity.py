"""Similarities of many pairs at once against one pair after another."""

from hypothesis import given, settings
from hypothesis import strategies as st

from kinmatch.functions import similarity as s

text = st.text(alphabet="abcd é日", max_size=80)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(text, text), max_size=30))
def test_many_equal_one(pairs):
    x, y = [p for p, _ in pairs], [q for _, q in pairs]
    assert s.lcs_lengths(x, y).tolist() == [s.lcs_length(p, q) for p, q in pairs]
    for many, one in ((s.jaro_winklers, s.jaro_winkler), (s.indel_ratios, s.indel_ratio), (s.token_set_ratios, s.token_set_ratio)):
        assert all(abs(a - one(p, q)) < 1e-12 for a, (p, q) in zip(many(x, y), pairs, strict=True))


def test_longest_lanes():
    x, y = ["a" * 64, "ab" * 32, "a" * 65, "a", ""], ["a" * 64, "ba" * 32, "a" * 64, "", "a"]
    assert s.lcs_lengths(x, y).tolist() == [64, 63, 64, 0, 0]
    assert [round(v, 9) for v in s.jaro_winklers(x, y)] == [round(s.jaro_winkler(p, q), 9) for p, q in zip(x, y, strict=True)]
