"""Text without blanks is read to its end."""

import numpy as np
import pytest

from pacegrid.llm import quality, toxicity


def test_quality_reads_all_of_a_long_token():
    read = quality.Reader()
    first, other = "日本語の文" * 20, "価格表示中" * 20
    plain, longer = read(first), read(first + other)
    assert len(longer) > len(plain) and not np.array_equal(longer[: len(plain)], longer[-len(plain) :])
    assert not np.array_equal(read(first + other), read(first + first))
    # what is short stays as it is, and long tokens are not remembered
    assert len(read("one two, three")) == 3 and all(len(t) <= quality.PIECE for t in read.known)


@pytest.mark.parametrize("before", [0, 9, 10, 31, 77, 500])
def test_insult_late_in_a_long_token(before):
    """Between marks, in joined letters, and in writing without blanks; none is counted twice."""
    tokens = toxicity.Tokens({"zorgblat": 4.0, "zorgbl-": 3.5, "坏蛋": 3.0})
    for token, weight in ((f"{'x1,y2;' * before}zorgblat{',fine' * 30}", 4.0), (f"{'a' * before}zorgblat{'fine' * 30}", 3.5), (f"{'字' * before}坏蛋{'字' * 96}", 3.0)):
        row = tokens(token)
        assert row[row[:, 0] > 0, 0].tolist() == [weight]
        assert row[:, 2].sum() == sum(map(str.isalpha, token))
    assert tokens("fine," * 100)[:, 0].max() == 0
