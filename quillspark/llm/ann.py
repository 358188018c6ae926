"""Nearest neighbours by inner product: inverted lists and the adaptive dimension scan.

Inner products become distances by one more coordinate (the square root of the largest squared norm less one's own), then all
vectors turn by one random rotation, so that any leading coordinates are a fair sample of the distance. Lists come from k-means on
a bounded sample; every row is indexed. Where lists would be longer than LIST_ROWS, each is divided into cells by a second k-means,
on the sample's residuals, so a cell's length stays the same at any number of rows. Within a probed cell, distances grow block by
block of columns; after each block a hypothesis test - the scaled partial distance against the query's bound, with a margin that
shrinks as dimensions are seen - drops candidates early. Survivors get their exact inner product of the original vectors in double
precision.

A query has a bound before its first scan: its k-th best inner product among SEEDS rows of the sample, which also see to it that k
rows are found whatever the tests drop. A first round scans each query's nearest
cells and tightens it; a second scans the further ones. The number of probed cells and the tests' margin are set by the recall
that lists and tests together reach on the sample, against brute force, for RECALL. Cells larger than CANDIDATES rows and query
sets larger than QUERIES are dealt to several tasks, block against block. Equal query vectors are searched once.

Defined cases: vectors that are null, empty, zero, hold null or non-finite components, or have another length than most take no
part; nor do rows with a null id. Rows with the query's id are its own and no candidates; repeated rows count once; ties go to the
smaller id; fewer than k candidates give them all; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import read, skew_join, table, with_fields
from .vectors import common_size, matrix, usable

K = 20
#: Bounds of the training sample (rows), of its queries, of the number of lists, and of cells in a list.
SAMPLE, SAMPLE_QUERIES, LISTS, INNER = 12_000, 200, 2048, 1024
#: Rows of the sample that give the first bounds.
SEEDS = 1024
#: Rows that a cell should have, beyond the smallest tables.
LIST_ROWS = 4096
RECALL = 0.97
#: Cells of the first round; rows of a cell, and queries, in one block.
FIRST, CANDIDATES, QUERIES = 1, 4096, 2048
#: Columns of a block; margins of the tests in standard deviations, tried in this order.
COLUMNS, MARGINS = 16, (2.1, 3.0, 4.0, 6.0)
_SEED = 3


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(_SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def augmented(x: np.ndarray, longest: float) -> np.ndarray:
    """Rows with the coordinate that turns inner products into distances, rotated."""
    more = np.sqrt(np.maximum(0.0, longest**2 - (x**2).sum(1)))
    return np.hstack([x, more[:, None]]) @ rotation(x.shape[1] + 1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T)


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    r = np.random.default_rng(_SEED)
    c = x[np.sort(r.choice(len(x), min(k, len(x)), replace=False))]
    for _ in range(rounds):
        near = distances(x, c).argmin(1)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(1, n)[:, None], c)
    return c


def augmented_queries(q: np.ndarray) -> np.ndarray:
    return np.hstack([q, np.zeros((len(q), 1))]) @ rotation(q.shape[1] + 1)


class Cells:
    """Lists and their inner cells. A cell's number is its list's times `inner` plus its place there."""

    def __init__(self, lists: np.ndarray, inner: np.ndarray, near_lists: int = 1):
        self.lists, self.inner, self.near_lists = lists, inner, near_lists

    def of(self, y: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        near = distances(y, self.lists).argmin(1)
        if len(self.inner) == 1:
            return near
        return near * len(self.inner) + distances(y - self.lists[near], self.inner).argmin(1)

    def order(self, y: np.ndarray, most: int) -> np.ndarray:
        """The `most` nearest cells of each row, nearest first, out of its near_lists nearest lists."""
        d = distances(y, self.lists)
        near = np.argsort(d, axis=1, kind="stable")[:, : self.near_lists]
        if len(self.inner) == 1:
            return near[:, :most]
        size, out = len(self.inner), []
        for s in range(len(y)):
            left = y[s] - self.lists[near[s]]
            by = distances(left, self.inner).ravel()
            first = np.argsort(by, kind="stable")[:most]
            out.append(near[s, first // size] * size + first % size)
        return np.array(out)


def true_nearest(original: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """The k largest inner products of rows `queries` among the other rows."""
    score = original[queries] @ original.T
    score[np.arange(len(queries)), queries] = -np.inf
    return np.argsort(-score, axis=1, kind="stable")[:, : min(k, len(original) - 1)]


def tune(cells: Cells, x: np.ndarray, y: np.ndarray, longest: float, k: int, recall: float = 0.0) -> tuple[int, float, float]:
    """Probed cells, margin, and the recall of both on the sample: of k true neighbours of some rows, those that lie in a probed
    cell and that no test drops. Sets cells.near_lists."""
    recall = recall or RECALL
    queries = np.random.default_rng(_SEED).permutation(len(x))[:SAMPLE_QUERIES]
    near = true_nearest(x, queries, k)
    if not near.size:
        return 1, MARGINS[0], 1.0
    bound = (x[queries][:, None] * x[near]).sum(2).min(1)
    for margin in MARGINS:
        i, j = scan(x[queries], x, bound - 1e-9 * (1 + np.abs(bound)), longest, margin)
        stays = np.zeros((len(queries), len(x)), bool)
        stays[i, j] = True
        stays = np.take_along_axis(stays, near, 1)
        if stays.mean() >= (1 + recall) / 2:
            break
    # the fewest lists that hold enough of the neighbours, then the fewest of their cells
    place = np.argsort(np.argsort(distances(augmented_queries(x[queries]), cells.lists), axis=1, kind="stable"), axis=1)
    at = np.sort(np.take_along_axis(place, distances(y, cells.lists).argmin(1)[near], 1).ravel())
    enough = (1 + recall) / 2 if len(cells.inner) > 1 else recall / stays.mean()
    cells.near_lists = int(at[min(len(at) - 1, math.ceil(enough * len(at)) - 1)]) + 1
    order = cells.order(augmented_queries(x[queries]), len(cells.lists) * len(cells.inner))
    of = cells.of(y)[near]
    cell_place = np.full(near.shape, order.shape[1], int)
    for r in range(len(queries)):
        where = {c: p for p, c in enumerate(order[r].tolist())}
        cell_place[r] = [where.get(c, order.shape[1]) for c in of[r].tolist()]
    found = np.sort(np.where(stays, cell_place, order.shape[1]).ravel())
    probes = min(order.shape[1], int(found[min(len(found) - 1, math.ceil(recall * len(found)) - 1)]) + 1)
    return probes, margin, float((found < probes).mean())


def fit(rows: DataFrame, dim: int, k: int) -> dict:
    """Cells, probes, margin, their recall on the sample, the largest norm, and the sample itself. rows: vec_id, v."""
    n, longest = rows.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)))).first()
    chance = F.pmod(F.xxhash64("vec_id", F.lit(_SEED)), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(chance < min(1.0, 0.95 * SAMPLE / max(1, n))).select("vec_id", F.col("v").cast("array<double>").alias("v")).orderBy("vec_id", "v").limit(SAMPLE).collect()
    by_id = {r.vec_id: r.v for r in sample}  # an id once
    ids, x = np.array(list(by_id), np.int64), np.array(list(by_id.values()), float).reshape(len(by_id), dim)
    if not len(x):
        return {"cells": Cells(np.zeros((1, dim + 1)), np.zeros((1, dim + 1))), "probes": 1, "margin": MARGINS[-1], "recall": 1.0, "longest": float(longest or 0.0), "seeds": x, "seed_ids": ids}
    longest = max(float(longest), float(np.sqrt((x**2).sum(1)).max()))
    y = augmented(x, longest)
    lists = kmeans(y, int(np.clip(math.sqrt(n), 1, min(LISTS, max(1, len(x) // 8)))))
    divided = int(np.clip(math.ceil(n / (len(lists) * LIST_ROWS)), 1, INNER))
    inner = kmeans(y - lists[distances(y, lists).argmin(1)], divided) if divided > 1 else np.zeros((1, dim + 1))
    cells = Cells(lists, inner)
    probes, margin, recall = tune(cells, x, y, longest, k)
    some = np.random.default_rng(_SEED + 1).permutation(len(x))[:SEEDS]
    return {"cells": cells, "probes": probes, "margin": margin, "recall": recall, "longest": longest, "seeds": x[some], "seed_ids": ids[some]}


def seeded(q: np.ndarray, seeds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query: its k + 1 best seeds, which may hold the query itself, their inner products, and the least of these, a bound;
    fewer seeds bound nothing."""
    top = np.argsort(-(q @ seeds.T), axis=1, kind="stable")[:, : k + 1]
    score = (q[:, None] * seeds[top]).sum(2)
    bound = score.min(1) if top.shape[1] > k else np.full(len(q), -np.inf)
    return top, score, bound - 1e-9 * (1 + np.abs(np.where(np.isfinite(bound), bound, 0.0)))


def scan(q: np.ndarray, x: np.ndarray, bound: np.ndarray, longest: float, margin: float = MARGINS[0]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) that no test has dropped, of which each may reach its query's bound (an inner product)."""
    a, b = augmented_queries(q), augmented(x, longest)
    dim = a.shape[1]
    limit = np.maximum(0.0, (q**2).sum(1) + longest**2 - 2 * bound)  # the bound as a squared distance; infinite without one
    first = min(COLUMNS, dim)
    part = distances(a[:, :first], b[:, :first])
    allowed = lambda d: limit * (1 if d == dim else (1 + margin / math.sqrt(d)) ** 2 * d / dim) + 1e-9 * (1 + longest**2)
    i, j = np.nonzero(part <= allowed(first)[:, None])
    part = part[i, j]
    for d in range(first, dim, COLUMNS):
        e = min(dim, d + COLUMNS)
        for s in range(0, len(i), 1 << 18):
            w = slice(s, s + (1 << 18))
            part[w] += ((a[i[w], d:e] - b[j[w], d:e]) ** 2).sum(1)
        ok = part <= allowed(e)[i]
        i, j, part = i[ok], j[ok], part[ok]
    return i, j


def best(i: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k largest scores; ties to the smaller id, repeated ids once."""
    order = np.lexsort((ids, -score, i))
    i, ids = i[order], ids[order]
    same = np.zeros(len(i), bool)
    same[1:] = (i[1:] == i[:-1]) & (ids[1:] == ids[:-1])
    order, i = order[~same], i[~same]
    start = np.searchsorted(i, i)
    return order[np.arange(len(i)) - start < k]


def _search(probes: DataFrame, cells: DataFrame, dim: int, model: dict, k: int) -> DataFrame:
    """probes: cell, qb, qid, qv, bound; cells: cell, cb, vec_id, v, and both with the numbers of blocks nq, nc of the cell."""
    longest, margin = model["longest"], model["margin"]
    left = probes.select("cell", "qb", "qid", "qv", "bound", F.explode(F.sequence(F.lit(0), F.col("nc"))).alias("cb")).toDF("cell", "qb", "qid", "qv", "bound", "cb")
    right = cells.select("cell", "cb", "vec_id", "v", F.explode(F.sequence(F.lit(0), F.col("nq"))).alias("qb")).toDF("cell", "cb", "vec_id", "v", "qb")

    def run(ql: pa.Table, xr: pa.Table) -> pa.Table:
        empty = pa.table({"qid": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not ql.num_rows or not xr.num_rows:
            return empty
        q, x = matrix(ql.column("qv"), dim), matrix(xr.column("v"), dim)
        qid, ids, bound = ql.column("qid").to_numpy(), xr.column("vec_id").to_numpy(), ql.column("bound").to_numpy()
        out = []
        for s in range(0, len(q), 256):
            i, j = scan(q[s : s + 256], x, bound[s : s + 256], longest, margin)
            i = i + s
            score = np.concatenate([(q[i[w : w + (1 << 17)]] * x[j[w : w + (1 << 17)]]).sum(1) for w in range(0, len(i), 1 << 17)] or [np.zeros(0)])
            ok = score >= bound[i]
            i, j, score = i[ok], j[ok], score[ok]
            top = best(i, ids[j], score, k + 1)
            out.append((qid[i[top]], ids[j[top]], score[top]))
        return pa.table({n: np.concatenate([o[z] for o in out]) for z, n in enumerate(("qid", "vec_id", "score"))})

    return left.groupBy(left.cell, left.cb, left.qb).cogroup(right.groupBy(right.cell, right.cb, right.qb)).applyInArrow(run, "qid long, vec_id long, score double")


def nearest(vectors: DataFrame, is_query: Column, k: int = K, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each row for which is_query holds, among all other rows."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked")).where("vec_id is not null")
    dim = common_size(rows, "v")
    rows = rows.where(usable(F.col("v")) & (F.size("v") == dim))
    model = fit(rows.select("vec_id", "v"), dim, k)
    held = vectors.sparkSession.sparkContext.broadcast(model)
    dims = {"longest": model["longest"], "margin": model["margin"]}

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = augmented(matrix(b.column("v"), dim), held.value["longest"])
            near = [held.value["cells"].of(y[s : s + 1024]) for s in range(0, len(y), 1024)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(near) if near else np.zeros(0, int), pa.int32())], [*b.schema.names, "cell"])

    cells = table(rows.select("vec_id", "v").mapInArrow(listed, with_fields(rows.select("vec_id", "v"), cell="integer")), "cells")
    asked = rows.where("asked").withColumn("h", F.xxhash64("v"))
    once = table(asked.groupBy("h", "v").agg(F.min("vec_id").alias("qid"), F.count("*").alias("m")), "queries")

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                q = matrix(part.column("v"), dim)
                bound = seeded(q, held.value["seeds"], k)[2]
                order = held.value["cells"].order(augmented_queries(q), held.value["probes"])
                m = order.shape[1]
                again = pa.array(np.repeat(np.arange(part.num_rows), m))
                yield pa.RecordBatch.from_arrays([part.column("qid").take(again), part.column("v").take(again), pa.array(order.ravel(), pa.int32()), pa.array(np.tile(np.arange(m), part.num_rows), pa.int32()), pa.array(np.repeat(bound, m))], ["qid", "qv", "cell", "nth", "bound"])

    def of_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                top, score, _ = seeded(matrix(part.column("v"), dim), held.value["seeds"], k)
                again = pa.array(np.repeat(np.arange(part.num_rows), top.shape[1]))
                yield pa.RecordBatch.from_arrays([part.column("qid").take(again), pa.array(held.value["seed_ids"][top.ravel()]), pa.array(score.ravel())], ["qid", "vec_id", "score"])

    kind = rows.schema["v"].dataType.simpleString()
    probes = table(once.select("qid", "v").mapInArrow(probing, f"qid long, qv {kind}, cell int, nth int, bound double"), "probes")
    in_list = cells.groupBy("cell").agg(((F.count("*") - 1) / CANDIDATES).cast("int").alias("nc"))
    in_probe = probes.groupBy("cell").agg(((F.count("*") - 1) / QUERIES).cast("int").alias("nq"))
    blocks = table(in_list.join(in_probe, "cell"), "blocks")
    cells = cells.join(blocks, "cell").withColumn("cb", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("nc") + 1).cast("int"))
    probes = probes.join(blocks, "cell").withColumn("qb", F.pmod(F.xxhash64("qid", F.lit(2)), F.col("nq") + 1).cast("int"))
    by = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    seeds = once.select("qid", "v").mapInArrow(of_seeds, "qid long, vec_id long, score double")
    first = table(_search(probes.where(F.col("nth") < FIRST), cells, dim, dims, k).union(seeds), "near")
    once_each = lambda found: found.groupBy("qid", "vec_id").agg(F.max("score").alias("score"))
    tight = once_each(first).withColumn("r", F.row_number().over(by)).where(F.col("r") == k + 1).select("qid", F.col("score").alias("found"))
    rest = probes.where(F.col("nth") >= FIRST).join(tight, "qid", "left").withColumn("bound", F.greatest("bound", "found"))
    far = _search(rest, cells, dim, dims, k)
    top = once_each(first.union(far)).withColumn("r", F.row_number().over(by)).where(F.col("r") <= k + 1)
    listed_top = top.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", "score"))).alias("top"))  # k + 1 at most
    answers = once.join(listed_top, "qid").select("h", "v", "m", "top")
    mine = asked.select("h", "v", F.col("vec_id").alias("query_id")).distinct()
    out = skew_join(mine, answers, ["h", "v"], "m", once.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0])
    others = F.slice(F.filter("top", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = out.select("query_id", F.posexplode(others).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", "x.score")


def op1_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
