"""Every query that has SQL gives the SQL's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

from quillspark.plans import catalog

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(SMALL):
        c.execute(f"create view {f[:-8]} as select * from '{SMALL}/{f}'")
    return c


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 8))
    return str(v)


def test_histogram_against_python(spark):
    import collections

    text = "".join(r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    assert {r.byte: r.n for r in catalog.byte_histogram(spark, SMALL).collect()} == collections.Counter(text.encode())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SMALL)
    rows = df.collect()
    if name not in catalog.ORACLES:
        assert rows
        return
    r = duck.sql(catalog.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(r.columns)
    want = sorted(tuple(shown(dict(zip(r.columns, x, strict=True))[c]) for c in columns) for x in r.fetchall())
    assert sorted(tuple(shown(x[c]) for c in columns) for x in rows) == want


def test_huffman_is_between_entropy_and_one_more(spark):
    h = catalog.entropy_h0(spark, SMALL).first().h0
    m = catalog.huffman_mean_len(spark, SMALL).first().mean_bits
    assert h <= m < h + 1
