"""Search against naive scans of bytes."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.operators import search


def naive(text, p):
    t, q = text.encode(), p.encode()
    return [i for i in range(len(t) - len(q) + 1) if t[i : i + len(q)] == q] if q else []


def trimmed(b, left):
    for k in range(4):
        try:
            return (b[k:] if left else b[: len(b) - k]).decode()
        except UnicodeDecodeError:
            continue
    return ""


@pytest.fixture(scope="module")
def random_texts():
    r = random.Random(4)
    return ["".join(r.choice("abé日😀.") for _ in range(r.choice([0, 1, 2, 17, 64, 900]))) for _ in range(60)] + ["abababa", "はははは", "mississippi", "a" * 700, "x\ny"]


@pytest.mark.parametrize("p", ["a", "ab", "aba", "はは", "issi", "é", "😀", "日é", ".", "aa", "x\ny", "no such"])
def test_counts_positions_and_windows(spark, random_texts, p):
    df = spark.createDataFrame(list(enumerate(random_texts)), "doc_id long, text string")
    got = {r.doc_id: list(r.pos) for r in df.select("doc_id", tx.positions(F.col("text"), p).alias("pos")).collect()}
    assert got == {i: naive(t, p) for i, t in enumerate(random_texts)}
    counts = {r.doc_id: (r.a, r.b) for r in df.select("doc_id", tx.count_overlapping(F.col("text"), p).alias("a"), tx.count_nonoverlapping(F.col("text"), p).alias("b")).collect()}
    assert counts == {i: (len(naive(t, p)), t.count(p)) for i, t in enumerate(random_texts)}
    for r in search.kwic(df, p, width=7).collect():
        b = random_texts[r.doc_id].encode()
        end = r.pos + len(p.encode())
        assert r.hit == p and b[r.pos : end] == p.encode()
        assert r.before == trimmed(b[max(0, r.pos - 7) : r.pos], True)
        assert r.after == trimmed(b[end : end + 7], False)
    limited = search.kwic(df, p, max_rows=2).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in limited} == {i: min(2, len(naive(t, p))) for i, t in enumerate(random_texts) if naive(t, p)}


def test_empty_and_null(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "abc")], "doc_id long, text string")
    assert search.count_total(df, "").first().hits == 0
    assert search.count_total(df, "abcd").first().hits == 0
    assert search.kwic(df, "b", max_rows=0).count() == 0
    assert search.kwic(df, "").count() == 0
    assert [(r.doc_id, r.pos) for r in search.locate(df, "c").collect()] == [(3, 2)]
    assert search.count_total(df.limit(0), "a").first().hits == 0


def test_window_fixture(spark):
    df = spark.createDataFrame([(1, "aéはbcはd")], "doc_id long, text string")
    r = search.kwic(df, "b", width=4).first()
    assert (r.pos, r.before, r.after) == (6, "は", "cは")


def test_facets(spark):
    df = spark.createDataFrame([(1, "x", "p"), (2, "y", "p"), (3, "x", "q")], "doc_id long, a string, b string")
    assert search.facet_filter(df, a=[], b=None).count() == 3
    assert [r.doc_id for r in search.facet_filter(df, a=["x"], b=["q"]).collect()] == [3]


def test_metadata_defaults(spark):
    rows = spark.createDataFrame([(1, "x"), (9, "y")], "doc_id long, form string")
    meta = spark.createDataFrame([(1, "t")], "doc_id long, title string")
    assert {r.doc_id: r.title for r in search.with_metadata(rows, meta).collect()} == {1: "t", 9: "(unknown)"}
