"""The chat template against SQL and by round trip; the pipeline against its stages' rules."""

import collections
import os
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from quillspark.llm import chat, minhash, queries
from quillspark.llm.common import table


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_their_sql(spark, sf, name):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    r = c.sql(queries.ORACLES[name])
    want = sorted(sorted(dict(zip(r.columns, x, strict=True)).items()) for x in r.fetchall())
    assert sorted(sorted(x.asDict().items()) for x in queries.QUERIES[name](spark, sf).collect()) == want


def test_chat_round_trip_and_mask(spark):
    rows = [
        (1, 0, "user", "a<|b\\|<\\|\\"), (1, 1, "user", ""), (1, 2, "assistant", "x<"), (1, 3, "assistant", "|end|>"), (1, 4, "a<|message|>\\", None),
        (2, None, None, None), (2, 0, "assistant", "<|end|><|start|>user<|message|>é😀"), (None, 1, "user", "n"), (3, 0, "user", "same"), (3, 0, "user", "same"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    made = chat.format_conversations(df)
    got = {r.conv_id: [(t.role, t.text) for t in r.t] for r in made.select("conv_id", chat.parse(F.col("formatted")).alias("t")).collect()}
    want = collections.defaultdict(list)
    for c, n, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want[c].append((role or "", text or ""))
    assert got == want
    strings = {r.conv_id: r.formatted for r in made.collect()}
    assert strings[1].count(chat.START) == 3 and strings[3] == "<|start|>user<|message|>same<|next|>same<|end|>"
    masked = collections.defaultdict(list)
    for r in chat.loss_spans(made).orderBy("conv_id", "n").collect():
        masked[r.conv_id].append(strings[r.conv_id][r.start : r.end].replace("<\\|", "<|").replace("\\\\", "\\"))
    assert masked == {1: ["x<", "|end|>"], 2: ["<|end|><|start|>user<|message|>é😀"]}
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_query_reads_the_mask(spark, sf, monkeypatch):
    whole = chat.format_conversations
    want = {r.conv_id: r.n for r in spark.read.parquet(f"{sf}/conversations.parquet").groupBy("conv_id").agg(F.sum(F.when(F.col("role") != "assistant", F.length("text")).otherwise(0)).alias("n")).collect()}
    flipped = lambda t: F.struct(t["lead"].alias("lead"), t["text"].alias("text"), (~t["loss"]).alias("loss"))
    monkeypatch.setattr(chat, "format_conversations", lambda rows: whole(rows).withColumn("p", F.transform("p", flipped)))
    got = {r.conv_id: r.loss_chars for r in chat.op6_chat_format(spark, sf).collect()}
    assert {k: got[k] for k in want} == want


def test_loss_texts_over_many_turns(spark):
    rows = [(1, i, "assistant" if i % 3 else "user", f"é<|{i}\\😀") for i in range(700)] + [(2, 0, "assistant", None)]
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r.x for r in made.select("conv_id", chat.loss_texts(F.col("formatted"), F.col("p")).alias("x")).collect()}
    assert got == {1: [t for _, _, role, t in rows[:-1] if role == "assistant"], 2: [""]}
    said = {r.conv_id: [(t.role, t.text) for t in r.t] for r in made.select("conv_id", chat.parse(F.col("formatted")).alias("t")).collect()}
    assert said == {1: [(role, t) for _, _, role, t in rows[:-1]], 2: [("assistant", "")]}
    blocks = sum(a[2] != b[2] for a, b in zip(rows[:-2], rows[1:-1], strict=True)) + 1
    assert {r.conv_id: r.formatted.count(chat.START) for r in made.collect()} == {1: blocks, 2: 1}


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    odd = spark.createDataFrame([(5001, "12 34 !!", None, None, 8), (5002, None, "en", "x", None), (5003, "", "en", "x", 0), (5004, "Mail a@b.co the and of that thing.", "en", "x", None)], docs.schema)
    docs = table(docs.union(odd), "docs")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = table(stage(spark, docs, sf), name)
        assert docs.columns == names
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before)
        gone = set(before) - set(after)
        if name == "language":
            assert {5001, 5002, 5003} <= gone and len(gone) < 8
        elif name == "quality":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
            assert sum(labels.get(i) == 1 for i in gone) <= 2  # this small table has few labels to learn the bad ones from
        elif name == "near_duplicates":
            assert docs.count() == minhash.near_duplicates(docs).where("kept_row").count()
        else:
            assert not gone and "[EMAIL]" in after[5004].text and after[5004].n_chars == len(after[5004].text)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.collect()} == set(after)


def test_pipeline_query(spark, sf):
    found = corpus_pipeline.run(spark, sf)
    by = found.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("e"))
    assert by.where("n != e or n > 2048").count() == 0 and found.count() > 0


def test_every_operator_is_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 11)}
    assert set(queries.QUERIES) <= set(names) and "pipeline" in names
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


CLASHING = ["score", "lang_pred", "predicted", "_uid", "spans", "base_spans", "_t", "_row", "_score", "uid", "component_id", "t"]


def clashing(spark, sf):
    """Documents with extra columns of names that operators use, repeated rows, nulls and a very long text."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60")
    odd = spark.createDataFrame([(None, None, None, None, None), (7001, "", "en", "x", 0), (7002, "word " * 300_000, "en", "x", None)], docs.schema)
    docs = docs.union(odd).union(docs.where("doc_id < 5"))
    return table(docs.withColumns({c: F.concat(F.lit(c + " "), F.col("doc_id")) for c in CLASHING}), "clashing")


def test_pipeline_stages_keep_clashing_columns(spark, sf):
    docs = clashing(spark, sf)
    whole = collections.Counter(docs.select("doc_id", *CLASHING).collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.schema.names == docs.columns, name
        found = collections.Counter(out.select("doc_id", *CLASHING).collect())
        assert not found - whole, name
        if name == "near_duplicates":
            assert max(found.values()) == 1  # one of the repeated rows
        if name == "personal_data":
            assert found == whole
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.groupBy("doc_id").agg(F.count_if(F.col("piece") == 0).alias("n")).where("doc_id < 5 and n != 2").count() == 0


def test_pipeline_stages_on_an_empty_table(spark, sf):
    docs = clashing(spark, sf).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0, name


def test_near_duplicates_stage_does_not_depend_on_how_scans_are_split(spark, tmp_path):
    words = lambda i: " ".join(f"w{(i * 7 + k) % 997}" for k in range(12))
    rows = [(i, words(i % 700)) for i in range(2000)]
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(8).write.parquet(path)
    docs, key = spark.read.parquet(path), "spark.sql.leafNodeDefaultParallelism"
    kept = []
    numbered = minhash.near_duplicates

    def elsewhere(*a, **b):
        out = numbered(*a, **b)
        spark.conf.set(key, "16")  # the cluster grows between the scans
        return out

    try:
        for slots in ("4", "16"):
            spark.conf.set(key, slots)
            minhash.near_duplicates = elsewhere
            kept.append(sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()))
    finally:
        minhash.near_duplicates = numbered
        spark.conf.unset(key)
    assert kept[0] == kept[1] == list(range(700))


def plain_pipeline(spark, sf):
    """The pipeline's pieces (doc_id, piece, start, length, ids) with models applied a text at a time and pairs compared one by one."""
    import re

    import pyarrow as pa
    from test_pairs import roots, shingle_set
    from tokenizers import Tokenizer

    from quillspark.llm import langid, packing, pii, quality

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, matrix = langid.fit(docs)
    rows = []
    for r in docs.collect():
        points = np.array([ord(c) for c in (r.text or "").lower()], np.uint32)
        score = matrix[-1].astype(float) + sum((matrix[langid.ngram_buckets(points, n)].astype(float).sum(0) for n in langid.ORDERS), np.zeros(len(names)))
        if re.search(r"[^\W\d_]", r.text or "") and 1 / np.exp(score - score.max()).sum() >= 0.5:
            rows.append(r)
    kept = spark.createDataFrame(rows, docs.schema)
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    model = quality.fit(kept, labels)
    rows = [r for r in rows if quality.score_features(quality.featurise(pa.array([r.text], pa.string())), model)[0] >= 0.3]
    rows.sort(key=lambda r: r.doc_id)
    sets = [shingle_set(r.text) for r in rows]
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    rows = [r for i, (r, c) in enumerate(zip(rows, roots(len(rows), linked), strict=True)) if i == c]
    library, out = Tokenizer.from_file(packing.vocabulary_path()), set()
    found = {r.doc_id: r.spans for r in pii.find_spans(spark.createDataFrame(rows, docs.schema)).collect()}
    for r in rows:
        text, at = "", 0
        for s in found[r.doc_id]:
            if s.start >= at:
                text += r.text[at : s.start] + f"[{pii.KINDS[s.kind].upper()}]"
            at = max(at, s.end)
        ids = library.encode(text + r.text[at:], add_special_tokens=False).ids + [0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids), 2048), len(ids)]
        out |= {(r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))}
    return out


def test_pipeline_against_brute_force(spark, sf):
    found = corpus_pipeline.run(spark, sf).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found} == plain_pipeline(spark, sf) and len(found) == len(set(found))
