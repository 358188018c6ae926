import collections
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillspark.functions import bits
from quillspark.operators import index


def naive_rows(text):
    order = sorted(range(len(text) + 1), key=lambda i: text[i:].encode())
    return order, [text[i - 1] if i else "" for i in order]


def greedy(sizes, target):
    shard = filled = 0
    out = []
    for n in sizes:
        if filled > 0 and filled + n > target:
            shard, filled = shard + 1, 0
        filled += n
        out.append(shard)
    return out


def test_range_exits_for_every_entry():
    r = random.Random(9)
    for _ in range(300):
        target = r.randint(1, 25)
        sizes = [r.choice([0, 0, 1, 2, 5, 9, target, target + 3, 40]) for _ in range(r.randint(0, 14))]
        rng = index._Range(np.array(sizes, np.int64), target)
        begin, count, held = rng.exits()
        for filled in range(target + 45):
            step = 0 if filled == 0 else max(1, int(np.searchsorted(begin, filled, side="left")) - 1)
            shard, f = 0, filled
            for n in sizes:
                if f > 0 and f + n > target:
                    shard, f = shard + 1, 0
                f += n
            assert (count[step], held[step] if held[step] >= 0 else filled + sum(sizes)) == (shard, f), (sizes, target, filled)
            assert (rng.shards(filled)[-1] if sizes else 0) == shard


def test_shard_plan_over_many_ranges(spark):
    r = random.Random(4)
    sizes = [r.choice([0, 1, 3, 10, 50, 130]) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, bytes long")
    for target in (20, 100, 3000):
        got = [x.shard_id for x in index.shard_plan(df, target, range_rows=23).orderBy("doc_id").collect()]
        assert got == greedy(sizes, target)
    assert index.shard_plan(df.limit(0), 10).count() == 0


def test_last_column_locates_and_accesses():
    r = random.Random(6)
    for t in ["", "a", "banana" * 30, "あのはなのはな", "".join(r.choice("ab") for _ in range(300))]:
        x, (order, _) = index.LastColumn(t), naive_rows(t)
        at = {p: row for row, p in enumerate(order)}
        for p in ("a", "ab", "ana", "はな", "zz", ""):
            assert x.locate(p) == [k for k in range(len(t)) if p and t.startswith(p, k)]
        assert [x.access(i) for i in range(len(t))] == list(t) and x.access(len(t)) is None and x.access(-1) is None
        steps = []
        for place in range(len(t) + 1):
            p, n = place, 0
            while at[p] % index.SAMPLE:
                p, n = (p - 1 if p else len(t)), n + 1
            steps.append(n)
        assert x.most_steps() == max(steps)
        assert x.rows_of().tolist() == [at[p] for p in range(len(t) + 1)]


def test_prefix_doubling(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    t = "mississippi" * 3
    df = spark.createDataFrame([(i, c) for i, c in enumerate(t)], "pos long, ch string")
    got = [x.pos for x in index.suffix_array_doubling(df).orderBy("row").collect()]
    assert got == sorted(range(len(t)), key=lambda i: t[i:])


def test_fnv(spark):
    from quillspark.functions import text as tx

    df = spark.createDataFrame([("",), ("a",), ("foobar",)], "t string").select(tx.fnv1a(F.encode("t", "UTF-8")).alias("h"))
    assert [r.h for r in df.collect()] == ["cbf29ce484222325", "af63dc4c8601ec8c", "85944171f73967e8"]


def test_shard_plan_fixture(spark):
    sizes = [10, 20, 5, 100, 3, 4, 60, 7]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, bytes long")
    assert [r.shard_id for r in index.shard_plan(df, 30).orderBy("doc_id").collect()] == [0, 0, 1, 2, 3, 3, 4, 5]
    for target in (1, 20, 1000):
        planned = index.shard_plan(df, target)
        by = planned.groupBy("shard_id").agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).collect()
        assert sum(r.n for r in by) == len(sizes) and all(r.b <= target or r.n == 1 for r in by)


def test_merge_ranges(spark):
    df = spark.createDataFrame([(1, 0, 8), (1, 8, 8), (1, 20, 8), (1, 24, 8), (1, 40, 8), (1, 40, 8), (2, 5, 1)], "g int, at long, len long")
    assert sorted((r.g, r.at, r.len) for r in index.merge_ranges(df, "g").collect()) == [(1, 0, 16), (1, 20, 12), (1, 40, 8), (2, 5, 1)]


def test_huffman():
    assert index.huffman_lengths({7: 5}) == {7: 1}
    lengths = index.huffman_lengths({i: 2**i for i in range(8)})
    assert sum(2.0**-x for x in lengths.values()) == 1


def test_gram_index_finds_all(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    for p in ("tion", "er", "thanedble"):
        found = {r.doc_id for r in index.gram_candidates(index.gram_index(d), p).collect()}
        assert {r.doc_id for r in d.where(F.contains("text", F.lit(p))).collect()} <= found


def test_gram_index_files_stay_small(spark, monkeypatch):
    """More text makes more files, not larger ones, also for grams that all documents hold."""
    monkeypatch.setattr(index, "GRAM_BYTES", 1 << 10, raising=False)
    r = random.Random(3)
    texts = {i: "the same " + "".join(r.choice("abcdé ") for _ in range(r.randint(0, 300))) for i in range(900)} | {900: "", 901: None, 902: "ab"}
    grams = index.gram_index(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    rows = grams.select("doc_id", "gram", "bucket", F.input_file_name().alias("file")).collect()
    assert sorted((x.doc_id, x.gram) for x in rows) == sorted({(i, t[k : k + 3]) for i, t in texts.items() if t for k in range(len(t) - 2)})
    sizes = collections.Counter(x.file for x in rows)
    assert max(sizes.values()) < 1500 < len(rows) / 32
    assert len({(x.gram, x.bucket) for x in rows}) == len({x.gram for x in rows})
    for p in ("the", "same", "ab", "dé a"):
        assert {x.doc_id for x in index.gram_candidates(grams, p).collect()} >= {i for i, t in texts.items() if len(p) > 2 and p in (t or "")}


def test_whole_texts_of_all_documents(spark, tmp_path):
    """Long texts and high ids against brute force: nothing is cut at 120 characters or at doc_id 60."""
    from quillspark.plans import catalog

    r = random.Random(7)
    prose = " ".join(r.choice(["other", "er", "erer", "naïve", "こえ", "😀x", "Word"]) for _ in range(300))
    texts = {1: "", 2: "a" * 700, 3: "ab" * 300 + "er", 59: "-" * 130 + "er", 60: "er", 75: prose, 4000: prose[::-1] + "\n" + prose, 4001: "mississippi", -5: None}
    texts |= {100 + i: "".join(r.choice("ab") for _ in range(r.randint(1, 400))) for i in range(8)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {}
    for name in ("suffix_array", "bwt", "c_table", "lf_mapping", "inverse_bwt", "backward_search_count", "sa_sample", "isa_sample", "most_lf_steps", "bwt_access"):
        got[name] = {i: [] for i in texts}
        for x in catalog.QUERIES[name](spark, str(tmp_path)).collect():
            got[name][x.doc_id].append(tuple(x)[1:])
    for i, t in texts.items():
        if t is None:
            assert not any(got[name][i] for name in got)
            continue
        order, last = naive_rows(t)
        at = {p: row for row, p in enumerate(order)}
        assert sorted(got["suffix_array"][i]) == [(row, p + 1) for row, p in enumerate(order)]
        assert sorted(got["sa_sample"][i]) == [(row, p + 1) for row, p in enumerate(order)][::64]
        assert got["bwt"][i] == [("".join(b or "$" for b in last), at[0])]
        assert sorted(got["c_table"][i]) == [(s, last.count(s), sum(b < s for b in last)) for s in sorted(set(last))]
        lf = [at[p - 1] if p else 0 for p in order]
        assert sorted(got["lf_mapping"][i]) == [(row, last[:row].count(last[row]), lf[row]) for row in range(len(order))]
        assert got["inverse_bwt"][i] == [(t,)]
        assert sorted(got["isa_sample"][i]) == [(p, at[p]) for p in range(0, len(order), 64)] and len(got["most_lf_steps"][i]) == 1
        assert sorted(got["bwt_access"][i]) == [(p, t[p]) for p in (0, 63, 64, 500, 4000) if p < len(t)]
        assert got["backward_search_count"][i] == [(sum(t.startswith("er", k) for k in range(len(t))),)]


class Mapped:
    """Stands for a table: mapInArrow gives the function that runs in a task."""

    where = select = agg = repartition = lambda self, *a: self
    n = 0

    def first(self):
        return self

    def mapInArrow(self, run, schema):
        return run


class Arrays(Mapped):
    """Gives the function itself, whatever columns are made of its rows afterwards."""

    def mapInArrow(self, run, schema):
        return Given(run)


class Given:
    def __init__(self, run):
        self.run = run

    def select(self, *a):
        return self

    def __call__(self, batches):
        return self.run(batches)


def test_long_strings_are_passed_on_by_their_bytes(spark):
    """A task holds a few MB of output, however few rows that is: 60 texts of half a million characters."""
    text, taken = "ab" * 250_000, []

    def batches():
        for i in range(60):
            taken.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([text])], ["doc_id", "text"])

    rows = 0
    for b in index.whole_bwt(Mapped())(batches()):
        assert b.nbytes < index.BATCH + 2 * len(text) and (len(taken) - rows) * len(text) < index.BATCH + 2 * len(text)
        rows += b.num_rows
    assert rows == 60


def test_index_columns_are_computed_in_even_tasks(spark, monkeypatch):
    """One partition of texts becomes tasks of TASK_BYTES, so that no core waits for the task of a large file."""
    monkeypatch.setattr(index, "TASK_BYTES", 1 << 12, raising=False)
    r = random.Random(5)
    texts = {i: "".join(r.choice("abc é") for _ in range(r.randint(0, 600))) for i in range(200)} | {200: "", 201: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    for made in (index.whole_suffix_array(df), index.whole_lf_mapping(df)):
        sizes = [x["count"] for x in made.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == sum(len(t) + 1 for t in texts.values() if t is not None)
        assert len(sizes) > 8 and max(sizes) < 3 * sum(sizes) / len(sizes)


def test_index_rows_pass_from_python_in_arrays(spark):
    """A number of output is no row of its own on the way from Python: 600,000 numbers are a few hundred rows, none long."""
    text = "abc" * 200_000
    given = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([text])], ["doc_id", "text"])
    for whole in (index.whole_suffix_array, index.whole_lf_mapping, index.whole_isa_sample):
        step = 64 if whole is index.whole_isa_sample else 1
        out = list(whole(Arrays())(iter([given])))
        assert sum(b.num_rows for b in out) == -(-(len(text) // step + 1) // index.PIECE)
        assert max(len(x) for b in out for x in b.column(2)) <= index.PIECE


def test_suffix_order_of_other_widths():
    """Keys that leave no room for a place beside them, symbols far apart, repeats of all lengths."""
    r = random.Random(8)
    texts = ["", "a", "\U0010ffff", "a\U0010ffff" * 40, "x" * 3000, "".join(map(chr, range(200, 40_000, 7))) * 2, "ab" * 1500 + "b"]
    texts += ["".join(r.choice("ab\n 😀é"[: r.randint(1, 7)]) for _ in range(r.randint(1, 700))) for _ in range(150)]
    for t in texts:
        order, row = index.suffix_order(np.array([ord(c) for c in t], np.uint32))
        assert order.tolist() == sorted(range(len(t) + 1), key=lambda i: t[i:]) and row[order].tolist() == list(range(len(t) + 1))
    key = np.array([r.randrange(1 << 62) for _ in range(500)])
    for bits in (62, 40):
        k, by = index._ordered(key >> 62 - bits, bits)
        assert k.tolist() == sorted((key >> 62 - bits).tolist()) and (k == (key >> 62 - bits)[by]).all()


def test_short_texts_are_ordered_together(spark, monkeypatch):
    """2,000 short texts are a few sorts, not one or more for each; what stands in one decides nothing in the next."""
    r, calls = random.Random(12), []
    texts = ["".join(r.choice("ab\n\0 😀é\U0010ffff"[: r.randint(1, 8)]) for _ in range(r.choice([0, 1, 3, 30]))) for _ in range(2000)]
    given = pa.RecordBatch.from_arrays([pa.array([None, *range(1, 2000)], pa.int64()), pa.array(texts)], ["doc_id", "text"])
    orders = getattr(index, "suffix_orders", None)
    monkeypatch.setattr(index, "suffix_orders", lambda *a: calls.append(1) or orders(*a), raising=False)
    got = {}
    for b in index.whole_suffix_array(Arrays())(iter([given])):
        assert b.nbytes < 6 * sum(map(len, b.column(2))) + 28 * b.num_rows  # a number takes 4 bytes on its way
        for i, begin, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
            assert begin == len(got.setdefault(i, []))
            got[i].extend(x)
    assert got == {i or None: [p + 1 for p in naive_rows(t)[0]] for i, t in enumerate(texts)}
    assert 0 < len(calls) <= 1 + sum(len(t) + 1 for t in texts) // index.TOGETHER


def test_texts_ordered_together_in_all_columns(spark, monkeypatch):
    """Groups of any size, also of one text, give what each text gives alone."""
    r = random.Random(13)
    texts = {i: "".join(r.choice("abé") for _ in range(r.choice([0, 2, 40, 200]))) for i in range(60)} | {60: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    for together in (1, 90, 1 << 20):
        monkeypatch.setattr(index, "TOGETHER", together, raising=False)
        kinds = (index.whole_suffix_array(df), index.whole_suffix_array(df, 7), index.whole_isa_sample(df, 5), index.whole_lf_mapping(df), index.whole_bwt(df))
        got = [collections.defaultdict(list) for _ in kinds]
        for into, made in zip(got, kinds, strict=True):
            assert all(kind in ("bigint", "string") for _, kind in made.dtypes)
            for x in made.collect():
                into[x[0]].append(tuple(x)[1:])
        for i, t in texts.items():
            if t is None:
                assert not any(i in x for x in got)
                continue
            order, last = naive_rows(t)
            at = {p: row for row, p in enumerate(order)}
            assert sorted(got[0][i]) == [(row, p + 1) for row, p in enumerate(order)]
            assert sorted(got[1][i]) == [(row, p + 1) for row, p in enumerate(order)][::7]
            assert sorted(got[2][i]) == [(p, at[p]) for p in range(0, len(order), 5)]
            assert sorted(got[3][i]) == [(row, last[:row].count(last[row]), at[p - 1] if p else 0) for row, p in enumerate(order)]
            assert got[4][i] == [("".join(b or "$" for b in last), at[0])]


def test_bits_against_counting(spark):
    r = random.Random(11)
    texts = ["", "a", "0", "a" * 64, "b" * 64 + "a", None, *("".join(r.choice("abA01é😀\n$\\") for _ in range(r.choice([63, 64, 65, 128, 500]))) for _ in range(12))]
    rows = [(k, t, i) for k, t in enumerate(texts) for i in range(0, len(t or "") + 1)]
    for symbols in ("a", "0", "01é", "A\\😀$"):
        df = spark.createDataFrame(rows, "k int, t string, i long").withColumn("w", bits.packed(bits.bits_of(F.col("t"), symbols)))
        for x in df.select("t", "i", bits.rank1(F.col("w"), F.col("i")).alias("n"), bits.bit_at(F.col("w"), F.col("i")).alias("b")).collect():
            if x.t is None:
                assert x.n is None and x.b is None
                continue
            assert x.n == sum(c in symbols for c in x.t[: x.i])
            if x.i < len(x.t):
                assert x.b == (x.t[x.i] in symbols)
