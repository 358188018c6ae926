"""Exact spans against Python's regular expressions; proposals, redaction, edge cases."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    out = []
    for rank, (kind, p) in enumerate(BASE.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def texts():
    r = random.Random(3)
    out = ["", None, "a@b.c%d@e.f", "x@y@z.com", "1.2.3.4.5", "0001.2.3.255 300.1.1.1", "4111 1111 1111 1111", "+1 (659) 555-3949.", "😀é a@b.co 😀 +49 30 1234567", "a" * 5000, "1" * 20000, "1 " * 9000, "+" + "1(" * 3000]
    out += ["x@y.z 10.0.0.1 " * 700]
    alpha = "ab.@%+-_ 0123456789()é😀\n"
    out += ["".join(r.choice(alpha) for _ in range(r.randint(1, 80))) for _ in range(1500)]
    digits = "0123456789 -.+()"
    out += ["".join(r.choice(digits) for _ in range(r.randint(5, 60))) for _ in range(1500)]
    return out


def test_exact_spans(spark):
    rows = texts()
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.s for r in pii.find_spans(df).select("doc_id", pii.span_list("base_spans").alias("s")).collect()}
    wrong = [(rows[i], got[i], base(t)) for i, t in enumerate(rows) if got[i] != base(t)]
    assert not wrong, wrong[:3]


def test_query_on_the_small_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in pii.op2_pii(spark, sf).collect():
        b = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(b.encode()).hexdigest()
        assert set(filter(None, b.split(","))) <= set(r.spans.split(","))
        assert r.n_email == b.count("email:") and r.n_phone == b.count("phone:")


def test_proposals_and_clean_text(spark):
    model = pii.fit(spark)
    assert all(t < float("inf") for t in model["thresholds"].values())
    df = spark.createDataFrame([(1, "ssn 123-45-6789 ok"), (2, "call (555) 123-4567 now"), (3, "write to ann.lee [at] example [dot] com please"), (4, "pages 123-456-7890"), (5, "plain words, nothing else")], "doc_id long, text string")
    got = {r.doc_id: r.s for r in pii.find_spans(df).select("doc_id", pii.span_list("spans").alias("s")).collect()}
    assert got[1].startswith("ssn:4:") and got[2].startswith("phone_national:5:") and got[3].startswith("email_spelled:9:")
    assert got[4] == "" and got[5] == ""


def test_compressed_ipv6_and_spelled_mail_in_any_case(spark):
    model = pii.fit(spark)
    assert all(t < float("inf") for t in model["thresholds"].values())
    rows = ["host fe80::1 is up", "the server 2001:db8::1 answers", "lines 2001:db8:85a3::8a2e:370:7334, and more", "write to ann [AT] example [DOT] com please", "mail ann (At) example.org now", "the class add::feed of this code", "std::vector and a :: b", "meet (AT) 5 . 30 here"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.s for r in pii.find_spans(df, model).select("doc_id", pii.span_list("spans").alias("s")).collect()}
    assert [got[i] for i in range(len(rows))] == ["ipv6:5:12", "ipv6:11:22", "ipv6:6:34", "email_spelled:9:35", "email_spelled:5:25", "", "", ""]


def test_redaction_extra_columns_and_empty(spark):
    df = spark.createDataFrame([(1, "mail a@b.co or 10.0.0.1!", "keep"), (2, None, None), (2, None, None), (None, "x", "")], "doc_id long, text string, spans string")
    got = [tuple(r) for r in pii.redact(df.drop("spans")).collect()]
    assert sorted(got, key=str) == sorted([(1, "mail [EMAIL] or [IP]!"), (2, None), (2, None), (None, "x")], key=str)
    out = pii.find_spans(df)
    assert out.columns == ["doc_id", "text", "base_spans", "spans"] and out.count() == 4
    assert pii.find_spans(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark, sf):
    plan = pii.op2_pii(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def test_trees_agree_with_numpy(spark):
    model = pii.fit(spark)
    import numpy as np

    x = np.random.default_rng(1).integers(0, 20, (50, len(pii.FEATURES))).astype(float)
    df = spark.createDataFrame([tuple(r) for r in x.tolist()], ", ".join(f"{n} double" for n in pii.FEATURES))
    f = F.struct(*pii.FEATURES)
    col = sum((pii.tree_column(t, F.col("f")) for t in model["trees"][1:]), F.lit(model["trees"][0]))
    got = [r.s for r in df.select(f.alias("f")).select(col.alias("s")).collect()]
    want = model["trees"][0] + sum(pii.tree_values(t, x) for t in model["trees"][1:])
    assert got == pytest.approx(want.tolist())


def test_selection_against_brute_force(spark):
    """Of overlapping spans, by every pair: none that overlaps one ahead of it stays."""
    r = random.Random(5)
    rows = []
    for i in range(120):
        spans = []
        for kind in range(len(pii.KINDS)):
            at = 0
            while r.random() < 0.8 and at < 60:
                start = at + r.randint(0, 12)
                end = start + r.randint(1, 25)
                spans.append((start, kind, end, float(r.randint(0, 3))))
                at = end
        rows.append((i, sorted(spans)))
    rows.append((999, [(k * 3 + kind, kind, k * 3 + kind + 2, 1.0) for k in range(700) for kind in (0, 4)]))
    df = spark.createDataFrame(rows, "id long, s array<struct<start:int,kind:int,end:int,score:double>>").withColumn("s", F.sort_array("s"))
    order = lambda x: F.struct(-x["score"], x["start"], -x["end"], x["kind"])
    got = {x.id: [tuple(s) for s in x.b] for x in df.select("id", pii._undominated("s", lambda x, y: order(x) < order(y)).alias("b")).collect()}
    rank = lambda s: (-s[3], s[0], -s[2], s[1])
    for i, spans in rows:
        spans = sorted(spans)
        assert got[i] == [s for s in spans if not any(q[0] < s[2] and s[0] < q[2] and rank(q) < rank(s) for q in spans)]


def test_many_spans_take_linear_time(spark):
    import time

    model, took = pii.fit(spark), []
    for n in (500, 10_000):
        unit = "ann@b.co call (555) 123-4567, ssn 123-45-6789 "
        df = spark.createDataFrame([(1, unit * n)], "doc_id long, text string")
        start = time.time()
        assert pii.redact(df, model).first().text == "[EMAIL] call [PHONE_NATIONAL], ssn [SSN] " * n
        took.append(time.time() - start)
    assert took[1] < 30


def test_long_spelled_addresses(spark):
    local = "a" * 70 + ".b"
    df = spark.createDataFrame([(1, f"write to {local} [at] example [dot] com please")], "doc_id long, text string")
    assert pii.redact(df).first().text == "write to [EMAIL_SPELLED] please"


def test_clashing_columns_of_redact(spark):
    df = spark.createDataFrame([(1, "mail a@b.co", [1], "x", "y", "z")], "doc_id long, text string, spans array<int>, base_spans string, _t string, _row string")
    assert [tuple(r) for r in pii.redact(df).collect()] == [(1, "mail [EMAIL]", [1], "x", "y", "z")]
