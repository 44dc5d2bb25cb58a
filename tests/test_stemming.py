from __future__ import annotations

import pytest

from lodscape.functions.predicates import text_matches
from lodscape.functions.stemming import ENGLISH, stem


@pytest.mark.parametrize(
    "word,expected",
    # Pairs from the published sample vocabulary.
    [
        ("consign", "consign"), ("consigned", "consign"), ("consigning", "consign"), ("consignment", "consign"), ("consistency", "consist"), ("consistently", "consist"), ("consolation", "consol"), ("consolatory", "consolatori"),
        ("console", "consol"), ("consolingly", "consol"), ("consols", "consol"), ("consonant", "conson"), ("conspicuous", "conspicu"), ("conspirators", "conspir"), ("constable", "constabl"), ("constancy", "constanc"),
        ("knackeries", "knackeri"), ("knaves", "knave"), ("knavish", "knavish"), ("kneaded", "knead"), ("kneeling", "kneel"), ("knightly", "knight"), ("knitting", "knit"), ("knobs", "knob"), ("knocked", "knock"), ("knots", "knot"),
        ("ties", "tie"), ("cries", "cri"), ("gas", "gas"), ("this", "this"), ("gaps", "gap"), ("kiwis", "kiwi"), ("hopping", "hop"), ("hoping", "hope"), ("dying", "die"), ("skies", "sky"), ("news", "news"), ("generously", "generous"), ("a", "a"), ("42", "42"),
    ],
)
def test_published_pairs(word, expected):
    assert stem(word) == expected


def test_stemmed_queries(spark):
    df = spark.createDataFrame([(1, "Running dogs"), (2, "the dog runs"), (3, "cats"), (4, None)], "id int, text string")
    found = lambda q: sorted(r["id"] for r in df.where(text_matches(df["text"], q, ENGLISH)).collect())
    assert found("dog & run") == [1, 2] and found("running <-> dog") == [1] and found("cat | running") == [1, 2, 3]
