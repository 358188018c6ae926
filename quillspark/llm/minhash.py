"""Near-duplicate documents: circulant MinHash, banding and exact Jaccard verification.

1. Features. Rows are numbered once, in a written table; all later joins are on that number. Each text's set of distinct 5-word
   shingles is hashed to 64 bits; a first permutation (of the 64-bit numbers) scatters them and its low bits are the shingle's slot
   in a universe of 2^22 (two shingles share one with probability 2^-22, which verification makes up for); a second permutation, of
   the slots, shifted circularly by k, gives coordinate k of the signature. The K shifted values of a shingle lie side by side in the second permutation, so a signature is the running
   minimum of K-wide slices. 125 coordinates make 25 bands of 5: two sets of similarity 0.85 share no band with probability 4e-7.
   A threshold of 0.8 takes 185 coordinates, 37 bands, for the same.
2. Classes. Documents with equal sets (a 128-bit digest and the size agree) become one class by a partial aggregate, so thousands
   of copies are one row from here on.
3. Candidates. Each band bucket with several classes links its members to its smallest class: a star, not all pairs.
4. Verification. Members meet their star's centre in a sorted stream of whole texts, dealt to groups of about STAR_BLOCK members; a
   task holds one centre's set and one member's. Buckets that then still hold several components (their members are not all linked
   to the centre) are settled in blocks, bounded in rows and bytes: a first round sends signatures and keeps the rows that could
   reach the threshold with a row of another component; a second sends the full sets of these and verifies their pairs right there.
5. Components over verified links. Joins on keys that may hold a great part of the rows (large buckets, classes, components) spread
   these: see skew_join.

Defined cases: null and empty texts have no shingles, link with nothing and form components of their own; fewer than five words
are one shingle; repeated rows fall in one class; rows with a null id take part, their component_id is the smallest non-null id
of the component (null if there is none); an empty table gives an empty result. Extra columns are ignored; `first_of_each` returns
the columns that it was given, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, fresh_name, mix, numbered, read, skew_join, table, text_bytes
from .components import connected_components
from .quality import word_spans

WORDS = 5
UNIVERSE_BITS = 22
BANDS, ROWS = 25, 5
COORDINATES = BANDS * ROWS
#: A pair at the threshold shares no band with this probability at most.
MISS = 5e-7
#: An estimate below this, of a pair at the threshold 0.85, is five standard deviations off.
LEAST_ESTIMATE = 0.69
#: Members of one star per sorted group, rows of a bucket per block, and bytes of their sets per block.
STAR_BLOCK, BUCKET_BLOCK, BLOCK_BYTES = 256, 2048, 8 << 20
BAND_BITS = 6
_BASE = 0x9E3779B97F4A7C15 | 1
_SEED = 20240501


def bands_for(percent: int) -> int:
    """Bands of ROWS for a threshold; BANDS at 85 and above."""
    if percent >= 85:
        return BANDS
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))


def least_estimate(percent: int) -> float:
    """Five standard deviations below the threshold; LEAST_ESTIMATE at 85 and above."""
    if percent >= 85:
        return LEAST_ESTIMATE
    p = percent / 100
    return p - 5 * math.sqrt(p * (1 - p) / (bands_for(percent) * ROWS))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def shingles(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each document's shingles. A-Z count as lower case, white space as one separator."""
    n = len(at) - 1
    start, end, of = word_spans(data, at)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint64)
    # prefix sums of byte * base^place: a span's sum, divided by base^start, depends on its bytes alone
    up = _powers(len(data), _BASE)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(mix(data + np.uint64(1)) * up[:-1], out=prefix[1:])
    down = _powers(len(data), pow(_BASE, -1, 1 << 64))
    word = mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))
    first = np.searchsorted(of, np.arange(n + 1))
    counts = np.diff(first)
    h = np.zeros(len(word), np.uint64)
    full = max(0, len(word) - WORDS + 1)
    for k in range(WORDS):
        h[:full] = mix(h[:full] * np.uint64(_BASE) + word[k : k + full])
    out = []
    for i in range(n):
        c = counts[i]
        if c >= WORDS:
            out.append(np.unique(h[first[i] : first[i + 1] - WORDS + 1]))
        elif c:
            x = np.zeros(1, np.uint64)
            for w in word[first[i] : first[i + 1]]:
                x = mix(x * np.uint64(_BASE) + w)
            out.append(mix(x + np.uint64(c)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Circulant:
    """Signatures by two permutations: the first scatters shingles, the second is read at K circular shifts."""

    def __init__(self, coordinates: int = COORDINATES, bits: int = UNIVERSE_BITS, seed: int = _SEED):
        size = 1 << bits
        order = np.random.default_rng(seed).permutation(size).astype(np.int32)
        self.shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[: coordinates - 1]]), coordinates)
        self.mask, self.coordinates = np.uint64(size - 1), coordinates

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        at = (mix(hashes ^ np.uint64(0xA5A5A5A55A5A5A5A)) & self.mask).astype(np.int64)
        out = np.full(self.coordinates, np.iinfo(np.int32).max, np.int32)
        for i in range(0, len(at), 2048):
            np.minimum(out, self.shifted[at[i : i + 2048]].min(0), out=out)
        return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A key for each band, with the band's number in its low BAND_BITS bits."""
    n = len(signature) // ROWS
    h = np.full(n, 7, np.uint64) + np.arange(n, dtype=np.uint64)
    for k in range(ROWS):
        h = mix(h * np.uint64(_BASE) + signature[k::ROWS].astype(np.uint64))
    low = np.uint64((1 << BAND_BITS) - 1)
    return ((h & ~low) | np.arange(n, dtype=np.uint64)).view(np.int64)


def digest(hashes: np.ndarray) -> tuple[int, int]:
    a = mix(hashes ^ np.uint64(0x1234567)).sum(dtype=np.uint64)
    b = mix(hashes ^ np.uint64(0x7654321F)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def features(stored: DataFrame, coordinates: int = COORDINATES) -> DataFrame:
    """Of stored (uid, doc_id, t): uid, doc_id, n (set size), a, b (digest), sig (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Circulant(coordinates)
        for b in batches:
            data, at = text_bytes(b.column("t"))
            n, da, db, sig = [], [], [], []
            for i, j in chunks(at):
                for s in shingles(data[at[i] : at[j]], at[i : j + 1] - at[i]):
                    x, y = digest(s)
                    n.append(len(s))
                    da.append(x)
                    db.append(y)
                    sig.append(maker.signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("doc_id"), pa.array(n, pa.int64()), pa.array(da, pa.int64()), pa.array(db, pa.int64()), pa.array(sig, pa.binary())], ["uid", "doc_id", "n", "a", "b", "sig"])

    return stored.select("uid", "doc_id", "t").mapInArrow(run, "uid long, doc_id long, n long, a long, b long, sig binary")


def _bands(classes: DataFrame, bands: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sigs = b.column("sig").to_pylist()
            keys = [band_keys(np.frombuffer(s, np.int32)) for s in sigs]
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            c, n = (np.repeat(b.column(x).to_numpy(), bands) for x in ("c", "n"))
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(n), pa.array(flat)], ["c", "n", "key"])

    return classes.select("c", "n", "sig").mapInArrow(run, "c long, n long, key long")


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _verify(stars: DataFrame, stored: DataFrame, percent: int) -> DataFrame:
    """Of pairs u < v of classes (u, nu, v, nv, m), those whose full shingle sets reach the threshold.

    m, the size of the largest bucket in which a pair was found, bounds how many pairs its centre has there, so it tells how many
    groups a centre's pairs are dealt to without a count by centre. In a group, sorted so that the centre's text comes first, a
    task holds one set beside the current one. Size bounds drop pairs before any text moves.
    """
    fit = stars.where(f"100 * least(nu, nv) >= {percent} * greatest(nu, nv)").groupBy("u", "v").agg((F.max("m") / STAR_BLOCK).cast("int").alias("k"))
    fit = fit.withColumn("s", F.pmod(F.xxhash64("v"), F.col("k") + 1))
    members = fit.select("u", "k", "s", F.lit(1).alias("role"), F.col("v").alias("c"))
    need = members.union(fit.select("u", "k", "s").distinct().select("u", "k", "s", F.lit(0).alias("role"), F.col("u").alias("c")))
    rows = need.join(stored.select(F.col("uid").alias("c"), "t"), "c").select("u", "k", "s", "role", "c", "t")
    rows = rows.repartition("u", "k", "s").sortWithinPartitions("u", "k", "s", "role", "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, centre = None, None
        for b in batches:
            data, at = text_bytes(b.column("t"))
            u, k, s, role, c = (b.column(x).to_numpy() for x in ("u", "k", "s", "role", "c"))
            found: list[tuple[int, int]] = []
            for i, j in chunks(at):
                for r, x in zip(range(i, j), shingles(data[at[i] : at[j]], at[i : j + 1] - at[i]), strict=True):
                    if group != (u[r], k[r], s[r]):
                        group, centre = (u[r], k[r], s[r]), None
                    if role[r] == 0:
                        centre = x
                    elif centre is not None and _linked(centre, x, percent):
                        found.append((int(u[r]), int(c[r])))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])

    return rows.mapInArrow(run, "u long, v long")


def _sets(members: DataFrame, stored: DataFrame) -> DataFrame:
    """c, sig, shingles (64-bit hashes as binary) of the classes in members: c, sig."""
    rows = members.join(stored.select(F.col("uid").alias("c"), "t"), "c").select("c", "sig", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = text_bytes(b.column("t"))
            found = [x.tobytes() for i, j in chunks(at) for x in shingles(data[at[i] : at[j]], at[i : j + 1] - at[i])]
            yield pa.RecordBatch.from_arrays([b.column("c"), b.column("sig"), pa.array(found, pa.binary())], ["c", "sig", "shingles"])

    return rows.mapInArrow(run, "c long, sig binary, shingles binary")


def _cells(open_buckets: DataFrame, size: Column) -> DataFrame:
    """open_buckets (key, c, n, root), a table, dealt to cells (key, kind, x, y) in which two blocks meet.

    A bucket's largest component is not compared with itself: its members, in blocks, meet the blocks of the other members (kind 0),
    and these meet each other (kind 1). Blocks hold at most about BUCKET_BLOCK rows and BLOCK_BYTES bytes; size: those of a row.
    """
    by = open_buckets.groupBy("key", "root").agg(F.count("*").alias("rows"), F.sum(size).alias("bytes"))
    main = by.groupBy("key").agg(F.max(F.struct("rows", "bytes", "root")).alias("main"), F.sum("rows").alias("m"), F.sum("bytes").alias("all"))
    last = lambda rows, size: F.greatest((rows - 1) / BUCKET_BLOCK, size / BLOCK_BYTES).cast("int")
    main = main.select("key", "m", F.col("main.root").alias("main"), last(F.col("main.rows"), F.col("main.bytes")).alias("lm"), last(F.col("m") - F.col("main.rows"), F.col("all") - F.col("main.bytes")).alias("lo"))
    rows = skew_join(open_buckets, main, ["key"], "m", open_buckets.count()).withColumn("in_main", F.col("root") == F.col("main"))
    own = F.pmod(F.xxhash64("c", F.lit(3)), F.when(F.col("in_main"), F.col("lm")).otherwise(F.col("lo")) + 1).cast("int")
    all_blocks = lambda n: F.sequence(F.lit(0), F.col(n))
    cell = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"))
    b = F.col("b")
    to_main = F.transform(all_blocks("lo"), lambda o: cell(0, b, o))
    to_others = F.concat(F.transform(all_blocks("lm"), lambda m: cell(0, m, b)), F.transform(all_blocks("lo"), lambda o: cell(1, F.least(b, o), F.greatest(b, o))))
    met = rows.withColumn("b", own).withColumn("cell", F.explode(F.when(F.col("in_main"), to_main).otherwise(to_others)))
    return met.select("key", "cell.*", "b", "in_main", "c", "n", "root")


class _Cell:
    """A cell's rows and, for each row of its left side, the rows of the right side that could be linked with it."""

    def __init__(self, t: pa.Table, percent: int):
        key, kind, x, y = (t.column(k)[0].as_py() for k in ("key", "kind", "x", "y"))
        self.band, self.percent, self.least, self.both_ways = key & (1 << BAND_BITS) - 1, percent, least_estimate(percent), kind == 1 and x == y
        self.c, self.n, self.root = (t.column(k).to_numpy() for k in ("c", "n", "root"))
        blk, in_main = t.column("b").to_numpy(), t.column("in_main").to_numpy()
        self.sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.int32).reshape(len(blk), bands_for(percent), ROWS)
        self.left = np.flatnonzero(~in_main if kind == 0 else blk == x)
        self.right = np.flatnonzero(in_main) if kind == 0 else self.left if x == y else np.flatnonzero(blk == y)

    def likely(self, i: int, group: np.ndarray) -> np.ndarray:
        """Rows of other groups whose signatures could reach the threshold with row i's, the likeliest first; pairs that share an
        earlier band have met there."""
        right = self.right
        ok = right[(group[right] != group[i]) & ((self.c[right] > self.c[i]) | (not self.both_ways))]
        ok = ok[100 * np.minimum(self.n[ok], self.n[i]) >= self.percent * np.maximum(self.n[ok], self.n[i])]
        if not len(ok):
            return ok
        same = self.sig[ok] == self.sig[i]
        share = same.mean((1, 2))
        fit = (share >= self.least) & ~same[:, : self.band].all(2).any(1)
        return ok[fit][np.argsort(-share[fit], kind="stable")]


def _rest(open_buckets: DataFrame, classes: DataFrame, stored: DataFrame, percent: int) -> DataFrame:
    """Links u, v between different components that share a bucket; only links leave a cell."""

    def sift(t: pa.Table) -> pa.Table:
        cell, stay = _Cell(t, percent), np.zeros(t.num_rows, bool)
        for i in cell.left:
            near = cell.likely(i, cell.root)
            stay[near] = True
            stay[i] |= len(near) > 0
        return pa.table({"key": t.column("key").to_numpy()[stay], "c": cell.c[stay]})

    def verify(t: pa.Table) -> pa.Table:
        cell = _Cell(t, percent)
        full, group = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()], cell.root.copy()
        us, vs = [], []
        for i in cell.left:
            for j in cell.likely(i, group):
                if group[i] != group[j] and _linked(full[i], full[j], percent):
                    us.append(int(cell.c[i]))
                    vs.append(int(cell.c[j]))
                    group[group == group[j]] = group[i]
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    cell = ["key", "kind", "x", "y"]
    signed = open_buckets.select("c").distinct().join(classes.select("c", "sig"), "c")
    alike = _cells(open_buckets, F.lit(4 * bands_for(percent) * ROWS)).join(signed, "c").groupBy(cell).applyInArrow(sift, "key long, c long").distinct()
    left = table(open_buckets.join(alike, ["key", "c"], "left_semi"), "alike")
    sets = table(_sets(left.select("c").distinct().join(classes.select("c", "sig"), "c"), stored), "sets")
    return _cells(left, F.col("n") * 8).join(sets, "c").groupBy(cell).applyInArrow(verify, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, percent: int = 85, text: str = "text", key: str = "doc_id", uid: str | None = None) -> DataFrame:
    """uid, doc_id, n_shingles, component_id, kept_row for each row; kept_row marks one row of each component.

    Links have 100 * intersection >= percent * union of the full sets; percent may be 80 or more. uid names the column of a written
    table that numbers its rows; without it, rows are numbered and stored here.
    """
    if percent < 80:
        raise ValueError("bands are set for similarities of 0.8 and more")
    stored = docs.select((F.col(f"`{uid}`") if uid else F.lit(0)).alias("uid"), F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("t"))
    stored = stored if uid else numbered(stored.drop("uid"), "uid", "texts").select("uid", "doc_id", "t")
    rows = table(features(stored, bands_for(percent) * ROWS), "minhash")
    classes = table(rows.where("n > 0").groupBy("n", "a", "b").agg(F.min("uid").alias("c"), F.count("*").alias("m"), F.first("sig").alias("sig")), "classes")
    bands = _bands(classes, bands_for(percent))
    centre = bands.groupBy("key").agg(F.min("c").alias("u"), F.min_by("n", "c").alias("nu"), F.count("*").alias("m")).where("m > 1")
    # few rows have a partner; a large bucket's sorted partition is split at runtime
    buckets = table(bands.join(centre, "key").select("key", "c", "n", "u", "nu", "m"), "buckets")
    links = table(_verify(buckets.where("c != u").select("u", "nu", F.col("c").alias("v"), F.col("n").alias("nv"), "m"), stored, percent), "links")
    roots = connected_components(links)
    placed = buckets.join(roots.select(F.col("v").alias("c"), "root"), "c", "left").select("key", "c", "n", F.coalesce("root", "c").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("m")).where("lo != hi and m > 2").select("key", "m")
    open_buckets = table(skew_join(placed, mixed, ["key"], "m", buckets.count()).select("key", "c", "n", "root"), "open")
    if open_buckets.head(1):
        more = table(_rest(open_buckets, classes, stored, percent), "links")
        if more.head(1):
            roots = connected_components(roots.select(F.col("v").alias("u"), F.col("root").alias("v")).union(more))
    member = classes.select("n", "a", "b", "m", "c").join(roots.select(F.col("v").alias("c"), "root"), "c", "left").select("n", "a", "b", "m", F.coalesce("root", "c").alias("root"))
    total = rows.count()
    seen = skew_join(rows.where("n > 0").select("uid", "doc_id", "n", "a", "b"), member, ["a", "b", "n"], "m", total).select("uid", "doc_id", "n", "root")
    seen = table(seen, "rooted")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "uid"))
    best = seen.groupBy("root").agg(F.min("doc_id").alias("component_id"), first.alias("first"), F.count("*").alias("m"))
    out = skew_join(seen, best, ["root"], "m", total).select("uid", "doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("uid") == F.col("first.uid")).alias("kept_row"))
    return out.union(rows.where("n = 0").select("uid", "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept_row")))


def first_of_each(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of docs, with its columns, that are the first of their group."""
    uid = fresh_name(docs, "_uid")
    stored = numbered(docs, uid, "numbered")
    kept = near_duplicates(stored, percent, uid=uid).where("kept_row").select(F.col("uid").alias(uid))
    return stored.join(kept, uid, "left_semi").select([F.col(f"`{c}`") for c in docs.columns])


def op5_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OP5_SQL = f"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < {WORDS} then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' '))) end as s from words),
sized as (select doc_id, len(s) as n from sets),
flat as (select doc_id, unnest(s) as h from sets),
met as (select a.doc_id as u, b.doc_id as v, count(*) as shared from flat a join flat b on a.h = b.h and a.doc_id < b.doc_id group by all),
linked as (select u, v from met join sized a on a.doc_id = u join sized b on b.doc_id = v where 100 * shared >= 85 * (a.n + b.n - shared)),
edges as (select u, v from linked union all select v, u from linked),
reach as (select doc_id as a, doc_id as b from documents union select r.a, e.v from reach r join edges e on e.u = r.b)
select s.doc_id, cast(s.n as bigint) as n_shingles, c.component_id, s.doc_id = c.component_id as kept
from sized s join (select a, min(b) as component_id from reach group by a) c on c.a = s.doc_id
"""
