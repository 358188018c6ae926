import pytest

from quillspark.operators import variants as v


@pytest.mark.parametrize(
    "word, usual, risky",
    [
        ("あわれ", "あはれ", "あはれ"),
        ("ように", "やうに よふに やふに", "やうに よふに やふに"),
        ("おもう", "おまう おもふ おまふ", "おまう おもふ をもう おまふ をまう をもふ をまふ"),
        ("こえ", "こゑ", "こゑ こへ"),
        ("かし", "", "くわし くはし"),
        ("うた", "", ""),
        ("", "", ""),
    ],
)
def test_known_words(word, usual, risky):
    assert v.expand(word) == usual.split()
    assert v.expand(word, True) == risky.split()


def test_bound_and_invariants():
    word = "いうあおいいえおおう"
    forms = v.expand(word)
    assert len(forms) == 47 == len(set(forms)) and word not in forms and forms == v.expand(word)


def test_default_rules_reach_the_threshold():
    assert all((r.ratio >= v.THRESHOLD) == r.on for r in v.RULES)


def test_column(spark):
    df = spark.createDataFrame([("こえ",), (None,), ("",)], "w string")
    assert [r.forms for r in v.expand_column(df, "w").collect()] == [["こゑ"], [], []]
