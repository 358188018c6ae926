"""Near-duplicates, nearest neighbours and components against brute force."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import ann, components, embedding_dedup, minhash


def shingle_set(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def roots(n, linked):
    par = list(range(n))

    def find(x):
        while par[x] != x:
            par[x] = par[par[x]]
            x = par[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        par[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def family(seed=5):
    """Copies, near copies around the threshold, chains, templates, short and odd texts."""
    r = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    out = []
    for _ in range(12):
        base = [r.choice(words) for _ in range(r.randint(30, 150))]
        for _ in range(r.randint(2, 25)):
            x = list(base)
            for _ in range(r.randint(0, 4)):
                x[r.randrange(len(x))] = r.choice(words)
            out.append(" ".join(x))
        out += [" ".join(base).upper(), "\t".join(base) + "\n"]
    out += ["", None, " \n", "one", "ONE", "one two three four", "one  two three\tfour", "é à ü ö ñ ß", "É à ü ö ñ ß", "a" * 3000]
    return out


@pytest.mark.parametrize("block", [3, 2048])
def test_minhash_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(minhash, "BUCKET_BLOCK", block)
    texts = family()
    sets = [shingle_set(t) for t in texts]
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    want = roots(len(texts), linked)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, component_id string").repartition(3)
    docs = docs.sort("doc_id")
    got = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i].component_id for i in range(len(texts))] == want


@pytest.mark.parametrize("block", [3, 2048])
def test_minhash_at_80_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(minhash, "BUCKET_BLOCK", block)
    texts = family(8)
    sets = [shingle_set(t) for t in texts]
    alike = lambda percent: roots(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])])
    want = alike(80)
    assert want != alike(85)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).sort("doc_id")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, 80).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_minhash_bands_for_a_threshold():
    assert (minhash.bands_for(85), minhash.least_estimate(85)) == (minhash.BANDS, minhash.LEAST_ESTIMATE)
    assert (1 - 0.8**minhash.ROWS) ** minhash.bands_for(80) <= minhash.MISS
    assert minhash.least_estimate(80) <= 0.8 - 5 * (0.8 * 0.2 / (minhash.bands_for(80) * minhash.ROWS)) ** 0.5


def test_pipeline_drops_pairs_between_80_and_85(spark, tmp_path):
    import corpus_pipeline

    words = ["w%d" % i for i in range(104)]  # 100 shingles; ten of them are new in the second text: 90 of 110
    other = ["v%d" % i if i < 10 else w for i, w in enumerate(words)]
    a, b = shingle_set(" ".join(words)), shingle_set(" ".join(other))
    assert 80 * len(a | b) <= 100 * len(a & b) < 85 * len(a | b)
    path = str(tmp_path / "d")
    spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, "some other words stand here alone")], "doc_id long, text string").coalesce(1).write.parquet(path)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, spark.read.parquet(path), "").collect()) == [1, 3]


def test_minhash_rows_that_repeat_or_lack_ids(spark, tmp_path):
    t = " ".join("abcdefghijkl")
    rows = [(7, t), (7, t), (None, t), (3, t), (7, "other words than these are here"), (None, None), (9, "")]
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(path)
    docs = spark.read.parquet(path)
    got = sorted((r.doc_id is None, r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect())
    assert sorted(got, key=str) == sorted([(False, 7, 8, 3), (False, 7, 8, 3), (True, None, 8, 3), (False, 3, 8, 3), (False, 7, 2, 7), (True, None, 0, None), (False, 9, 0, 9)], key=str)
    kept = [(r.doc_id, r.text) for r in minhash.first_of_each(docs).collect()]
    assert sorted(kept, key=str) == sorted([(3, t), (7, "other words than these are here"), (None, None), (9, "")], key=str)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_circulant_estimates():
    r = np.random.default_rng(3)
    maker = minhash.Circulant()
    x = r.integers(0, 2**63, 1000).astype(np.uint64)
    y = np.concatenate([x[:850], r.integers(0, 2**63, 150).astype(np.uint64)])
    j = 850 / 1150
    assert abs((maker.signature(np.unique(x)) == maker.signature(np.unique(y))).mean() - j) < 0.12
    assert (maker.shifted[5][1:] == maker.shifted[6][:-1]).all()  # coordinate k + 1 is coordinate k of the next slot


def test_components(spark):
    r = random.Random(2)
    for n, m in ((1, 0), (50, 40), (200, 150), (60, 59)):
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)] if m != 59 else [(i, i + 1) for i in range(59)]
        df = spark.createDataFrame([*edges, (None, 1), (0, 0)], "u long, v long")
        got = {x.v: x.root for x in components.connected_components(df).collect()}
        assert [got.get(i, i) for i in range(n)] == roots(n, edges)


def vectors(seed=1, n=300, dim=16):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dim))
    x[50:80] = x[0] + 0.15 * r.standard_normal((30, dim))
    x[80:110] = x[1] + 0.3 * r.standard_normal((30, dim))
    x[110:130] = x[2]
    x[130] = 3 * x[2]
    return x.astype(np.float32)


ODD = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [1.0] * 15 + [None], 1), (904, [1.0, 2.0], 1), (905, [float("inf")] + [1.0] * 15, 1), (906, [], 1)]


def frame(spark, x, more=()):
    return spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)] + list(more), "vec_id long, embedding array<float>, score int")


@pytest.mark.parametrize("block", [7, 1024])
def test_embedding_links(spark, block, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "SIFT_BLOCK", block)
    x = vectors()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(frame(spark, x, ODD)).collect()}
    assert [got[i].n_links for i in range(len(x))] == link.sum(1).tolist()
    assert [got[i].component_id for i in range(len(x))] == roots(len(x), list(zip(*np.nonzero(link), strict=True)))
    assert all(got[i].n_links == 0 and got[i].component_id == i for i, _, _ in ODD)
    none = frame(spark, x[:1]).limit(0)
    assert embedding_dedup.near_duplicates(none).count() == 0


def test_embeddings_that_repeat_or_lack_ids(spark):
    x = [1.0, 2.0, 3.0]
    rows = [(5, x, 0), (5, x, 0), (None, [2.0, 4.0, 6.0], 0), (None, [9.0, -1.0, 0.0], 0), (None, None, 0), (7, [-1.0, 0.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, component_id int")
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 2, 5), (5, 2, 5), (None, 2, 5), (None, 0, None), (None, 0, None), (7, 0, 7)], key=str)


def test_sketches_of_pairs_at_the_threshold():
    r = np.random.default_rng(6)
    x = r.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = r.standard_normal((4000, 64))
    y -= (x * y).sum(1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * y / np.linalg.norm(y, axis=1, keepdims=True)
    apart = np.bitwise_count(embedding_dedup.sketches(x) ^ embedding_dedup.sketches(y)).sum(1)
    assert apart.max() < embedding_dedup.sketch_limit() - 5


def test_hub_keys_are_joined_whole(spark, monkeypatch):
    from quillspark.llm import common

    monkeypatch.setattr(common, "HUBS", 4)
    rows = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(300)], "k long, v long")
    keyed = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("most")).where("k != 9")
    got = sorted(tuple(r) for r in common.skew_join(rows, keyed, ["k"], "n", 300).collect())
    assert got == sorted(tuple(r) for r in rows.join(keyed, "k").collect()) and len(got) == 299


def test_rows_for_a_threshold():
    for n in (0, 10, 10**5, 10**9):
        bits, tables = embedding_dedup.tables_for(n)
        same = (1 - np.arccos(0.9) / np.pi) ** bits
        assert (1 - same) ** tables <= 1.01e-6


@pytest.mark.parametrize("blocks", [(4096, 2048), (9, 3)])
def test_neighbours(spark, blocks, monkeypatch):
    monkeypatch.setattr(ann, "CANDIDATES", blocks[0])
    monkeypatch.setattr(ann, "QUERIES", blocks[1])
    x = vectors(n=260)
    rows = ann.nearest(frame(spark, x, ODD), F.col("vec_id") % 20 == 0, k=5).collect()
    got = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    assert sorted(got) == list(range(0, 260, 20))
    y, hit = x.astype(float), 0
    for q, found in got.items():
        score = y @ y[q]
        score[q] = -np.inf
        order = np.lexsort((np.arange(260), -np.round(score, 12)))[:5]
        hit += len({v for v, _ in found} & set(order.tolist()))
        assert [s for _, s in found] == pytest.approx([score[v] for v, _ in found])
        assert found == sorted(found, key=lambda z: (-z[1], z[0])) and len(found) == 5
    assert hit / (5 * len(got)) >= 0.9


def test_divided_lists_reach_the_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST_ROWS", 30)
    monkeypatch.setattr(ann, "LISTS", 8)
    r = np.random.default_rng(8)
    x = (r.standard_normal((12, 16))[r.integers(0, 12, 3000)] + 0.5 * r.standard_normal((3000, 16))).astype(np.float32)
    df = frame(spark, x)
    model = ann.fit(df.selectExpr("vec_id", "embedding v"), 16, 10)
    cells = len(model["cells"].lists) * len(model["cells"].inner)
    assert len(model["cells"].inner) > 5 and model["probes"] < cells / 2 and model["recall"] >= 0.95
    got = collections.defaultdict(set)
    for row in ann.nearest(df, F.col("vec_id") % 20 == 0, k=10).collect():
        got[row.query_id].add(row.vec_id)
    y = x.astype(float)
    near = ann.true_nearest(y, np.arange(0, 3000, 20), 10)
    assert np.mean([len(got[q] & set(n)) / 10 for q, n in zip(range(0, 3000, 20), near.tolist(), strict=True)]) >= 0.93


def test_seeds_give_a_lower_bound():
    r = np.random.default_rng(2)
    q, x = r.standard_normal((9, 8)), r.standard_normal((100, 8))
    top, score, bound = ann.seeded(q, x, 5)
    assert (bound <= np.sort(q @ x.T, 1)[:, -6]).all() and (bound >= np.sort(q @ x.T, 1)[:, -7]).all() and top.shape == score.shape == (9, 6)
    assert (ann.seeded(q, x[:5], 5)[2] == -np.inf).all() and ann.seeded(q, x[:0], 5)[0].shape == (9, 0)


def test_neighbours_without_ids(spark):
    rows = [(None, [1.0, 2.0], 0), (0, [1.0, 0.0], 0), (1, [2.0, 0.0], 0), (None, [9.0, 9.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    assert [(r.query_id, r.vec_id) for r in ann.nearest(df, F.col("vec_id") == 0).collect()] == [(0, 1)]


def test_neighbours_of_few_rows(spark):
    df = frame(spark, vectors()[:3])
    rows = ann.nearest(df.union(df), F.col("vec_id") == 0, k=20).collect()
    assert sorted(r.vec_id for r in rows) == [1, 2] and sorted(r["rank"] for r in rows) == [1, 2]
    assert ann.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_scan_drops_only_what_cannot_reach_the_bound():
    r = np.random.default_rng(5)
    q, x = r.standard_normal((20, 64)), r.standard_normal((500, 64))
    longest = float(np.sqrt((x**2).sum(1)).max())
    score = q @ x.T
    bound = np.sort(score, 1)[:, -20]
    i, j = ann.scan(q, x, bound, longest)
    kept = set(zip(i.tolist(), j.tolist(), strict=True))
    top = {(a, b) for a in range(20) for b in np.argsort(-score[a])[:20].tolist()}
    assert len(top & kept) / len(top) > 0.97 and len(kept) < 0.6 * score.size
