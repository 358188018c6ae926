"""Embedding near-duplicates: sign hashing by random hyperplanes in several tables, exact cosines, connected components.

Equal vectors (two 64-bit hashes with different seeds agree) are one class from the start, so many copies are one row. Each class
gets, in each of T tables, a bucket from the signs of b projections; b follows the logarithm of the number of classes, so buckets
keep their size, and T is set so that a pair at the threshold shares no bucket with probability MISS. A bucket's rows meet in blocks
of bounded size, twice:

1. in blocks of at most about SIFT_BLOCK rows, with a sketch of SKETCH further signs instead of the vector: rows without any other
   row whose sketch differs in at most as many bits as a pair at the threshold can (but for probability 1e-9) leave that bucket;
2. in blocks of at most about BLOCK rows, with the vectors of the rows that stay: a block multiplies its unit vectors in double
   precision and returns, for each row, the number of vectors linked to it, and a spanning forest of the links - never the pairs.
   A pair that meets in several tables counts in the first. Components run over the forests.

So the vectors of rows that resemble no other travel once at most, whatever T is.

Defined cases: vectors that are null, empty, zero, hold null or non-finite components, or have another length than most link with
nothing and are components of their own; rows with a null id take part, their component_id is the smallest non-null id there is;
repeated rows link with each other; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, read, skew_join, table
from .components import connected_components
from .vectors import common_size, matrix, usable

COSINE = 0.9
#: Probability that a pair exactly at the threshold is missed.
MISS = 1e-6
#: Rows of a bucket that meet as one block, as sketches and as vectors, and the bucket size that the number of bits aims at. A bucket
#: of one block sends each row once; of n blocks, n times.
SIFT_BLOCK, BLOCK, BUCKET = 2048, 1024, 1536
SKETCH = 256
#: Most buckets beyond a block whose sizes are broadcast (16 bytes each); if there are more, they are joined by a shuffle.
MOST_LARGE = 1 << 18
_SEED = 7


def tables_for(n: int, cosine: float = COSINE) -> tuple[int, int]:
    """Bits and tables for n classes."""
    bits = max(5, min(24, math.ceil(math.log2(max(1, n) / BUCKET))))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log1p(-same))


def codes(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    planes = np.random.default_rng(_SEED).standard_normal((x.shape[1], tables * bits))
    signs = (x @ planes >= 0).reshape(len(x), tables, bits)
    return (signs << np.arange(bits)).sum(2).astype(np.int32)


def sketch_limit(cosine: float = COSINE) -> int:
    """Bits in which the sketches of a pair at the threshold differ at most, but for a probability of about 1e-9."""
    p = math.acos(cosine) / math.pi
    return math.ceil(SKETCH * p + 6.3 * math.sqrt(SKETCH * p * (1 - p)))


def sketches(x: np.ndarray) -> np.ndarray:
    planes = np.random.default_rng(_SEED + 1).standard_normal((x.shape[1], SKETCH))
    return np.packbits(x @ planes >= 0, axis=1).view(np.uint64)


def _local_roots(link: np.ndarray) -> np.ndarray:
    """The smallest index of each row's component of a symmetric boolean matrix."""
    lab = np.arange(len(link))
    while True:
        new = np.minimum(lab, np.where(link, lab[None, :], len(lab)).min(1))
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def _block(t: int, x: int, y: int, blk: np.ndarray, c: np.ndarray, m: np.ndarray, v: np.ndarray, code: np.ndarray, cosine: float):
    """New links of a block pair: for each row the linked vectors, and forest edges."""
    link = (v @ v.T) >= cosine
    np.fill_diagonal(link, False)
    if x != y:
        link &= blk[:, None] != blk[None, :]
    i, j = np.nonzero(link)
    if t and len(i):
        fresh = np.ones(len(i), bool)
        for k in range(0, len(i), 1 << 16):
            s = slice(k, k + (1 << 16))
            fresh[s] = ~(code[i[s], :t] == code[j[s], :t]).any(1)
        link[i[~fresh], j[~fresh]] = False
    total = link @ m
    root = _local_roots(link) if total.any() else np.arange(len(c))
    return total, root


def _dealt(rows: DataFrame, block: int) -> DataFrame:
    """rows (c, key, ...) with the pairs of blocks (x_blk, y_blk) that they take part in, and their own block.

    Buckets of one block, the usual case, need no more than the left side of a join with the sizes of larger buckets.
    """
    sizes = table(rows.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > block), "large_buckets")
    sizes = F.broadcast(sizes) if sizes.count() <= MOST_LARGE else sizes
    met = rows.join(sizes, "key", "left").withColumn("last", F.coalesce(((F.col("size") - 1) / block).cast("int"), F.lit(0))).drop("size")
    met = met.withColumn("blk", F.pmod(F.xxhash64("c"), F.col("last") + 1).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    return met.withColumn("x_blk", F.least("blk", "other")).withColumn("y_blk", F.greatest("blk", "other")).drop("last", "other")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """uid, vec_id, n_links, component_id for each row."""
    rows = numbered(vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v")), "uid", "vectors")
    dim = common_size(rows, "v")
    total = rows.count()
    ok = rows.where(usable(F.col("v")) & (F.size("v") == dim))
    same = ok.select("uid", "vec_id", F.xxhash64("v").alias("a"), F.xxhash64(F.lit(_SEED), "v").alias("b"))
    sized = table(same.groupBy("a", "b").agg(F.min("uid").alias("c"), F.count("*").alias("m")), "class_sizes")
    classes = table(sized.join(ok.select(F.col("uid").alias("c"), "v"), "c").select("c", "m", "v"), "vector_classes")
    bits, count = tables_for(classes.count(), cosine)
    limit, words = sketch_limit(cosine), [f"s{k}" for k in range(SKETCH // 64)]

    def unit(column) -> np.ndarray:
        x = matrix(column, dim)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(s, 2048) for whole in batches for s in range(0, whole.num_rows, 2048)):
            x = unit(b.column("v"))
            place = (np.arange(count, dtype=np.int64) << 32) | codes(x, bits, count)
            sketch = np.repeat(sketches(x), count, axis=0).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("c").to_numpy(), count)), pa.array(place.ravel()), *(pa.array(np.ascontiguousarray(w)) for w in sketch.T)], ["c", "key", *words])

    def sift(g: pa.Table) -> pa.Table:
        split = g.column("x_blk")[0].as_py() != g.column("y_blk")[0].as_py()
        c, blk = g.column("c").to_numpy(), g.column("blk").to_numpy()
        w = [g.column(x).to_numpy().view(np.uint64) for x in words]
        stay = np.zeros(len(c), bool)
        for s in range(0, len(c), 256):
            part = slice(s, s + 256)
            near = sum(np.bitwise_count(x[part, None] ^ x[None, :]).astype(np.uint16) for x in w) <= limit
            near[np.arange(near.shape[0]), np.arange(s, s + near.shape[0])] = False
            if split:
                near &= blk[part, None] != blk[None, :]
            stay[part] = near.any(1)
        return pa.table({"c": c[stay], "key": g.column("key").to_numpy()[stay]})

    def compare(g: pa.Table) -> pa.Table:
        t, x, y = g.column("key")[0].as_py() >> 32, g.column("x_blk")[0].as_py(), g.column("y_blk")[0].as_py()
        c, m, blk = (g.column(k).to_numpy() for k in ("c", "m", "blk"))
        order = np.argsort(c)
        v = unit(g.column("v"))[order]
        c, m, blk = c[order], m[order], blk[order]
        links, root = _block(t, x, y, blk, c, m, v, codes(v, bits, count), cosine)
        with_links = np.flatnonzero(links)
        return pa.table({"u": c[with_links], "v": c[root[with_links]], "w": links[with_links].astype(np.int64)})

    kinds = ", ".join(f"{w} long" for w in words)
    placed = classes.select("c", "v").mapInArrow(hashed, f"c long, key long, {kinds}")
    active = table(_dealt(placed, SIFT_BLOCK).groupBy("key", "x_blk", "y_blk").applyInArrow(sift, "c long, key long").distinct(), "alike")
    found = _dealt(active, BLOCK).join(classes.select("c", "m", "v"), "c").groupBy("key", "x_blk", "y_blk").applyInArrow(compare, "u long, v long, w long")
    found = table(found, "vector_links")
    linked = found.groupBy(F.col("u").alias("c")).agg(F.sum("w").alias("links"))
    roots = connected_components(found.select("u", "v"))
    of_class = sized.join(linked, "c", "left").join(roots.select(F.col("v").alias("_c"), "root"), F.col("c") == F.col("_c"), "left")
    of_class = of_class.select("a", "b", "m", F.coalesce("root", "c").alias("root"), (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n"))
    rooted = skew_join(same, of_class, ["a", "b"], "m", total).select("uid", "vec_id", "n", "root")
    alone = rows.where(~F.coalesce(usable(F.col("v")) & (F.size("v") == dim), F.lit(False)))
    alone = alone.select("uid", "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    rooted = table(rooted, "rooted")
    best = rooted.groupBy("root").agg(F.min("vec_id").alias("component_id"), F.count("*").alias("m"))
    return skew_join(rooted, best, ["root"], "m", total).select("uid", "vec_id", F.col("n").alias("n_links"), "component_id").union(alone)


def op7_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


OP7_SQL = f"""
with recursive ok as (
  select vec_id, cast(embedding as double[]) as v from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
linked as (select a.vec_id as u, b.vec_id as v from ok a join ok b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) and list_cosine_similarity(a.v, b.v) >= {COSINE}),
reach as (select vec_id as a, vec_id as b from embeddings union select r.a, l.v from reach r join linked l on l.u = r.b)
select e.vec_id, (select count(*) from linked l where l.u = e.vec_id) as n_links, c.component_id, e.vec_id = c.component_id as kept
from embeddings e join (select a, min(b) as component_id from reach group by a) c on c.a = e.vec_id
"""
