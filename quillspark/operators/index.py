"""Index-style tables: shards, offsets, manifest, suffix order, Burrows-Wheeler columns, ranks, histograms, ranges, grams."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.frames import sums_before
from quillspark.functions.store import table

FORMAT_VERSION = 1
SAMPLE = 64


#: Documents of one range of the plan.
RANGE_ROWS = 500_000
_FIRST = -(1 << 63)  # stands for null keys, which come first


class _Range:
    """Sizes of consecutive documents, and where shards begin there.

    A shard that begins at document s ends before the first document i that would take it past the target, unless it is empty so far.
    """

    def __init__(self, sizes: np.ndarray, target: int):
        self.target, self.m = target, len(sizes)
        self.sum = np.concatenate([[0], np.cumsum(sizes)])

    def after(self, start: np.ndarray, filled: np.ndarray) -> np.ndarray:
        """The first document that does not go to a shard which holds `filled` bytes before document `start`; m: none."""
        i = np.maximum(np.searchsorted(self.sum, self.sum[start] - filled + self.target, side="right") - 1, start)
        empty = (i < self.m) & (filled + self.sum[np.minimum(i, self.m)] - self.sum[start] == 0)
        return np.minimum(np.where(empty, i + 1, i), self.m)

    def exits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each entry, bytes in the open shard, at which the first break changes: (from, breaks, bytes in the shard at the end).

        The entry is 0, or lies above a number of the first array and at most at the next one. Breaks depend on the entry by the
        first one alone, which is one of the documents in the first `target` bytes.
        """
        following = self.after(np.arange(self.m), np.zeros(self.m, np.int64)).tolist() if self.m else []
        breaks, last = [0] * (self.m + 1), list(range(self.m + 1))
        for s in range(self.m - 1, -1, -1):
            e = following[s]
            breaks[s], last[s] = (1, s) if e == self.m else (1 + breaks[e], last[e])
        total = int(self.sum[-1])
        most = max(0, self.target - total)
        begin, count, filled = [-1, 0], [max(0, breaks[0] - 1) if self.m else 0, 0], [total - int(self.sum[last[0]]) if self.m else 0, -1]
        # entries above target - sum[i + 1] break at i at the latest: the last document first
        reach = int(np.searchsorted(self.sum, self.target, side="left"))
        for i in range(min(reach, self.m) - 1, -1, -1):
            low = max(0, self.target - int(self.sum[i + 1]))
            if low == begin[-1] and len(begin) > 2:
                begin.pop(), count.pop(), filled.pop()
            if low >= most:
                begin.append(low)
                count.append(breaks[i])
                filled.append(total - int(self.sum[last[i]]))
        return np.array(begin), np.array(count), np.array(filled)

    def shards(self, filled: int) -> np.ndarray:
        """Breaks up to and with each document."""
        out, at = np.zeros(self.m, np.int64), int(self.after(np.array([0]), np.array([filled]))[0]) if self.m else 0
        while at < self.m:
            out[at] += 1
            at = int(self.after(np.array([at]), np.array([0]))[0])
        return np.cumsum(out)


def shard_plan(sizes: DataFrame, target: int, key: str = "doc_id", size: str = "bytes", range_rows: int = RANGE_ROWS) -> DataFrame:
    """key, size, shard_id: documents in key order, a new shard whenever the next one would pass the target; equal keys by size.

    Where a shard starts depends on all before it. Documents are dealt to ranges of keys (a written table of these two columns).
    Each range tells, for any number of bytes in the open shard at its start, how many shards begin in it and what the last one
    holds: a step function with at most as many steps as there are documents in `target` bytes. The driver follows these functions
    from range to range, one at a time, and keeps two numbers for each; then each range places its documents.
    """
    rows = sizes.select(F.col(key).cast("long").alias("k"), F.col(size).cast("long").alias("n"))
    ranges = max(1, math.ceil(rows.count() / range_rows))
    rows = table(rows.repartitionByRange(ranges, "k").withColumn("part", F.spark_partition_id()), "sizes")

    def ordered(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        k, n = t.column("k").fill_null(_FIRST).to_numpy(), t.column("n").fill_null(0).to_numpy()
        order = np.lexsort((n, k))
        return k[order], n[order]

    def exits(t: pa.Table) -> pa.Table:
        found = _Range(ordered(t)[1], target).exits()
        return pa.table({"part": t.column("part").slice(0, 1), **{x: pa.array([v.astype(np.int64).tobytes()], pa.binary()) for x, v in zip(("a", "b", "c"), found, strict=True)}})

    begun, filled, total, entries = 0, 0, 0, []
    sums = {r.part: r.n for r in rows.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # a row for each range
    for r in rows.groupBy("part").applyInArrow(exits, "part int, a binary, b binary, c binary").orderBy("part").toLocalIterator():
        entries.append((r.part, filled, begun))
        begin, count, held = (np.frombuffer(x, np.int64) for x in (r.a, r.b, r.c))
        step = 0 if filled == 0 else max(1, int(np.searchsorted(begin, filled, side="left")) - 1)
        begun, filled = begun + int(count[step]), int(held[step]) if held[step] >= 0 else filled + sums[r.part]
    at = rows.sparkSession.createDataFrame(entries, "part int, filled long, begun long")

    def place(t: pa.Table) -> pa.Table:
        k, n = ordered(t)
        return pa.table({key: pa.array(k, mask=k == _FIRST), size: n, "shard_id": t.column("begun")[0].as_py() + _Range(n, target).shards(t.column("filled")[0].as_py())})

    return rows.join(F.broadcast(at), "part").groupBy("part").applyInArrow(place, f"{key} long, {size} long, shard_id long")


def doc_offsets(planned: DataFrame, key: str = "doc_id", size: str = "bytes") -> DataFrame:
    """planned with `at`, the bytes before each document in its shard. Shards are bounded by the plan's target."""
    w = Window.partitionBy("shard_id").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return planned.withColumn("at", F.coalesce(F.sum(size).over(w), F.lit(0)))


def manifest(planned: DataFrame, key: str = "doc_id", size: str = "bytes") -> DataFrame:
    """shard_id, docs, text bytes, first and last id, and the totals over all shards."""
    by = planned.groupBy("shard_id").agg(F.count("*").alias("docs"), F.sum(size).alias("text"), F.min(key).alias("first_id"), F.max(key).alias("last_id"))
    everything = planned.agg(F.count("*").alias("works"), F.sum(size).alias("total_text"))
    return by.crossJoin(F.broadcast(everything)).withColumn("format_version", F.lit(FORMAT_VERSION))  # one row


def doc_of_position(points: DataFrame, offsets: DataFrame, key: str = "doc_id", size: str = "bytes") -> DataFrame:
    """points (shard_id, pos) with the document that holds them and the place inside it; an equi-join on the shard."""
    o = offsets.select("shard_id", key, "at", size)
    return points.join(o, "shard_id").where((F.col("pos") >= F.col("at")) & (F.col("pos") < F.col("at") + F.col(size))).select("shard_id", "pos", key, (F.col("pos") - F.col("at")).alias("pos_in_doc"))


# --- suffix order ---------------------------------------------------------------------------------------------------------


def _dense(pairs: DataFrame) -> DataFrame:
    """r, r2, rank: places of distinct pairs in order. Ranks r are dense, so ranges of r are even parts; only their counts meet."""
    parts = pairs.distinct().withColumn("part", F.floor(F.col("r") / 4096))
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))
    base = sums_before(counts, "part", "n", "base").select("part", "base")
    local = F.row_number().over(Window.partitionBy("part").orderBy("r", "r2"))
    return parts.withColumn("local", local).join(base, "part").select("r", "r2", (F.col("base") + F.col("local") - 1).alias("rank"))


def suffix_array_doubling(text: DataFrame) -> DataFrame:
    """row, pos: the suffix order of one long text given as rows (pos from 0, ch), by prefix doubling.

    Ranks of 1, 2, 4, ... characters: each round joins ranks with ranks further on, and ranks the distinct pairs. Rows stay narrow
    at any length; a checkpoint ends each round.
    """
    n = text.count()
    letters = text.select(F.ascii("ch").cast("long").alias("r"), F.lit(0).cast("long").alias("r2"), "pos")
    rank = letters.join(_dense(letters.select("r", "r2")), ["r", "r2"]).select("pos", (F.col("rank") + 1).alias("r"))
    step = 1
    while step < n:
        after = rank.select((F.col("pos") - step).alias("pos"), F.col("r").alias("r2"))
        both = rank.join(after, "pos", "left").select("pos", "r", F.coalesce("r2", F.lit(0)).alias("r2"))
        rank = both.join(_dense(both.select("r", "r2")), ["r", "r2"]).select("pos", (F.col("rank") + 1).alias("r")).checkpoint()
        step *= 2
    return rank.select((F.col("r") - 1).alias("row"), "pos")


# --- whole texts ----------------------------------------------------------------------------------------------------------
# Texts of any length, each on its own in one task: texts are dealt to even tasks, and no suffix is written out. Row 0 is the
# sentinel's. Null texts have no rows; repeated ids are texts of their own.

#: Bytes of text of a task. Its output is many times that, so tasks as large as the input's files leave cores idle at the end.
TASK_BYTES = 1 << 23

#: Bytes of output after which a batch is passed on: few rows may hold long strings, and many short ones hold little. A text's
#: columns count as PART bytes besides their own.
BATCH, PART = 1 << 23, 1 << 10


def numbered(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct code points in order, and the number of each code point of the text among them."""
    top = int(codes.max()) + 1 if len(codes) else 0
    if top > 4 * len(codes) + (1 << 16):
        return np.unique(codes, return_inverse=True)
    place = np.zeros(top, np.int64)
    place[codes] = 1
    symbols = np.flatnonzero(place)
    place[symbols] = np.arange(len(symbols))
    return symbols, place[codes]


def _ordered(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of so many bits in order, and where each was. Key and place are sorted as one number where both fit, which is faster."""
    low = max(1, (len(key) - 1).bit_length())
    if bits + low > 63:
        order = np.argsort(key)
        return key[order], order
    both = key << low | np.arange(len(key))
    both.sort()
    return both >> low, both & ((1 << low) - 1)


def suffix_order(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places from 0 (the last is the sentinel's) of all suffixes of code points, in order; and the row of each place."""
    return suffix_orders(np.append(codes + np.uint32(1), np.uint32(0)), np.array([len(codes) + 1]))


def suffix_orders(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """suffix_order of texts one after another, each from 0. codes: code points + 1, and 0, the sentinel, after each text; sizes: with it.

    Prefix doubling: a first sort by the text's number and as many symbols as fit in a number beside a place, then only suffixes that
    still share a rank are sorted, by their rank and that of the suffix `step` further on. No two suffixes of a text have their
    sentinel at one distance, so what stands after it decides nothing, and a shared rank means `step` equal symbols of the text.
    """
    symbols, dense = numbered(codes)
    n, bits, begin = len(codes), max(1, (len(symbols) - 1).bit_length()), np.cumsum(sizes) - sizes
    wide = max(1, (n - 1).bit_length())
    step = max(1, (63 - wide - (len(sizes) - 1).bit_length()) // bits)
    one = np.zeros(n + step - 1, np.int64)
    one[:n] = dense
    key, k = one, 1  # of k symbols; twice as many, or one more, at a time
    for more in f"{step:b}"[1:]:
        twice = key[:-k] << k * bits
        twice |= key[k:]
        key, k = twice, 2 * k
        if more == "1":
            key = key[:-1] << bits
            key |= one[k : k + len(key)]
            k += 1
    both = np.arange(n)
    if len(sizes) > 1:
        both |= np.repeat(np.arange(len(sizes)) << bits * step + wide, sizes)
    both |= key << wide
    both.sort()
    order, rank = both & ((1 << wide) - 1), np.empty(n, np.int64)
    rank[order] = np.arange(n)
    fresh = np.ones(n + 1, bool)
    np.greater_equal(both[1:] ^ both[:-1], 1 << wide, out=fresh[1:-1])
    open_, at = np.arange(n), order
    while True:
        left = np.flatnonzero(~(fresh[:-1] & fresh[1:]))
        if not len(left):
            break
        open_, at = open_[left], at[left]
        first = np.flatnonzero(fresh[left])
        rank[at] = np.repeat(open_[first], np.diff(first, append=len(left)))
        key, by = _ordered(rank[at] << wide | rank[at + step], 2 * wide)
        at = at[by]
        order[open_], rank[at] = at, open_
        fresh = np.ones(len(key) + 1, bool)
        np.not_equal(key[1:], key[:-1], out=fresh[1:-1])
        step *= 2
    if len(sizes) > 1:
        before = np.repeat(begin, sizes)
        order -= before
        rank -= before
    return order, rank


class LastColumn:
    """The suffix order of a text and its last column: symbols (the first, empty, is the sentinel), bwt as their numbers, c."""

    def __init__(self, text: str, ordered: tuple[np.ndarray, np.ndarray] | None = None):
        self.codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        self.order, self.row = ordered or suffix_order(self.codes)

    @cached_property
    def _numbered(self) -> tuple[list[str], np.ndarray]:
        found, dense = numbered(self.codes)
        return ["", *map(chr, found.tolist())], np.concatenate([[0], dense + 1])[self.order]

    @property
    def symbols(self) -> list[str]:
        return self._numbered[0]

    @property
    def bwt(self) -> np.ndarray:
        return self._numbered[1]

    @cached_property
    def n(self) -> np.ndarray:
        return np.bincount(self.bwt, minlength=len(self.symbols))

    @cached_property
    def c(self) -> np.ndarray:
        return np.cumsum(self.n) - self.n

    def lf(self) -> np.ndarray:
        """The row of the suffix that begins one place earlier; the whole text's leads to the sentinel's."""
        return self.row[self.order - 1]

    def rows_of(self) -> np.ndarray:
        """The row of each place (the inverse of order)."""
        return self.row

    def range_of(self, pattern: str) -> tuple[int, int]:
        """The rows whose suffixes begin with the pattern, from its last symbol to its first; the empty pattern: none."""
        lo, hi = 0, len(self.bwt) if pattern else 0
        for ch in reversed(pattern):
            if ch not in self.symbols:
                return 0, 0
            s = self.symbols.index(ch)
            lo, hi = (int(self.c[s]) + int(np.count_nonzero(self.bwt[:x] == s)) for x in (lo, hi))
        return lo, max(lo, hi)

    def locate(self, pattern: str, step: int = SAMPLE) -> list[int]:
        """Places of a pattern: from each row along lf to a sampled row."""
        lf, found = self.lf(), []
        for row in range(*self.range_of(pattern)):
            steps = 0
            while row % step:
                row, steps = int(lf[row]), steps + 1
            found.append((int(self.order[row]) + steps) % len(self.order))
        return sorted(found)

    def most_steps(self, step: int = SAMPLE) -> int:
        """The longest walk along lf from any row to a sampled one."""
        at = np.arange(len(self.order))
        sampled = np.maximum.accumulate(np.where(self.rows_of() % step == 0, at, -1))
        return int((at - sampled).max())

    def access(self, at: int, step: int = SAMPLE) -> str | None:
        """The symbol at a place: from the row of the next sampled place back along lf; None outside the text."""
        n = len(self.order) - 1
        if not 0 <= at < n:
            return None
        place = min(n, -(-(at + 1) // step) * step)
        row, lf = int(self.rows_of()[place]), self.lf()
        for _ in range(place - at - 1):
            row = int(lf[row])
        return self.symbols[self.bwt[row]]

    def text(self) -> str:
        lf, bwt, row, out = self.lf().tolist(), self.bwt.tolist(), 0, []
        while bwt[row]:
            out.append(self.symbols[bwt[row]])
            row = lf[row]
        return "".join(reversed(out))

    def count(self, pattern: str) -> int:
        lo, hi = self.range_of(pattern)
        return hi - lo


#: Characters of the texts whose suffixes are ordered together: for a short text, numpy's calls cost more than their work.
TOGETHER = 1 << 15


class _Orders:
    """The suffix orders of texts, one after another; sizes: rows of each."""

    def __init__(self, texts: list[str]):
        self.texts, self.sizes = texts, np.array([len(t) + 1 for t in texts])
        codes = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le"), np.uint32) + np.uint32(1)
        codes[np.cumsum(self.sizes) - 1] = 0
        self.order, self.row = suffix_orders(codes, self.sizes)

    def columns(self) -> Iterator[LastColumn]:
        for t, size, end in zip(self.texts, self.sizes.tolist(), np.cumsum(self.sizes).tolist(), strict=True):
            yield LastColumn(t, (self.order[end - size : end], self.row[end - size : end]))


def _together(texts: DataFrame, make: Callable[[pa.Array, _Orders], Iterator[list[pa.Array]]], schema: str, key: str, text: str) -> DataFrame:
    """key and the columns of schema: make gives them, key's first, in parts for some texts with these keys."""
    names = [key, *(x.split()[0] for x in schema.split(", "))]

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        ids, found, size = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0), b.column(1), strict=True):
                ids.append(i.as_py())
                found.append(t.as_py())
                size += len(found[-1]) + 1
                if size >= TOGETHER:
                    yield from make(pa.array(ids, pa.int64()), _Orders(found))
                    ids, found, size = [], [], 0
        if found:
            yield from make(pa.array(ids, pa.int64()), _Orders(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*parts, strict=True)], names)

        for made in groups(batches):
            parts.append(made)
            size += PART + sum(x.nbytes for x in made)
            if size >= BATCH:
                yield batch()
                parts, size = [], 0
        if parts:
            yield batch()

    found = texts.where(F.col(text).isNotNull()).select(F.col(key).cast("long"), text)
    size = found.agg(F.sum(F.octet_length(text)).alias("n")).first().n or 0
    return found.repartition(max(1, math.ceil(size / TASK_BYTES))).mapInArrow(run, f"{key} long, {schema}")


def _whole(texts: DataFrame, make: Callable[[LastColumn], list], schema: str, key: str, text: str) -> DataFrame:
    """key and the columns of schema: make gives arrays of one length for a text."""
    kinds = [{"string": pa.string(), "long": pa.int64()}[x.split()[1]] for x in schema.split(", ")]

    def parts(ids: pa.Array, orders: _Orders) -> Iterator[list[pa.Array]]:
        for i, x in zip(ids, orders.columns(), strict=True):
            made = [pa.array(c, k) for c, k in zip(make(x), kinds, strict=True)]
            yield [pa.repeat(i, len(made[0])), *made]

    return _together(texts, parts, schema, key, text)


#: Rows of output that pass to Spark as one array. Spark holds copies of an array's rows until the last one is read.
PIECE = 1 << 7


def _whole_rows(texts: DataFrame, make: Callable[[_Orders], np.ndarray], key: str, text: str, step: int = 1, kind: str = "int") -> DataFrame:
    """key, k, x: every step-th of the numbers, 0, step, ..., that make gives for the rows of a text.

    Numbers pass from Python in arrays of at most PIECE, which Spark's compiled code spreads to rows: a row of its own for each costs
    more than its number's computation. Those of one text are less than 2^31, as it has fewer bytes.
    """
    of = {"int": np.int32, "long": np.int64}[kind]

    def parts(ids: pa.Array, orders: _Orders) -> Iterator[list[pa.Array]]:
        values, sizes = make(orders), -(-orders.sizes // step)
        if step > 1:
            ends = np.cumsum(orders.sizes).tolist()
            values = np.concatenate([values[e - n : e : step] for e, n in zip(ends, orders.sizes.tolist(), strict=True)])
        pieces = -(-sizes // PIECE)
        whose = np.repeat(np.arange(len(sizes)), pieces)
        begin = (np.arange(len(whose)) - (np.cumsum(pieces) - pieces)[whose]) * PIECE
        ends = np.concatenate([[0], np.cumsum(np.minimum(PIECE, sizes[whose] - begin))])
        yield [ids.take(pa.array(whose)), pa.array(begin * step), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.astype(of, copy=False)))]

    whole = _together(texts, parts, f"begin long, xs array<{kind}>", key, text)
    rows = whole.select(key, "begin", F.posexplode("xs").alias("k", "x"))
    return rows.select(key, (F.col("begin") + (F.col("k") * step if step > 1 else F.col("k"))).alias("k"), F.col("x").cast("long").alias("x"))


def whole_suffix_array(texts: DataFrame, step: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, row (0: the sentinel), pos (1-based characters) of every step-th row of the suffix order of each text."""
    return _whole_rows(texts, lambda x: x.order + 1, key, text, step).select(key, F.col("k").alias("row"), F.col("x").alias("pos"))


def whole_bwt(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, bwt ($ for the sentinel), primary_row (the sentinel's)."""

    def make(x: LastColumn) -> list:
        codes = np.array([ord(s or "$") for s in x.symbols], np.uint32)[x.bwt]
        return [[codes.astype("<u4").tobytes().decode("utf-32-le")], [int(np.flatnonzero(x.bwt == 0)[0])]]

    return _whole(texts, make, "bwt string, primary_row long", key, text)


def whole_symbol_counts(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return _whole(texts, lambda x: [x.symbols, x.n, x.c], "symbol string, n long, c long", key, text)


def whole_lf_mapping(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, row, rank, lf as in lf_mapping. Both are less than 2^31, as a text has fewer bytes, and pass as one number."""

    def make(x: _Orders) -> np.ndarray:
        made = []
        for c in x.columns():
            lf = c.lf()
            made.append((lf - c.c[c.bwt]) << 32 | lf)
        return np.concatenate(made)

    rows = _whole_rows(texts, make, key, text, kind="long")
    return rows.select(key, F.col("k").alias("row"), F.shiftright("x", 32).alias("rank"), F.col("x").bitwiseAND(F.lit((1 << 32) - 1)).alias("lf"))


def whole_inverse_bwt(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text: the walk along lf from the sentinel's row."""
    return _whole(texts, lambda x: [[x.text()]], "text string", key, text)


def whole_backward_search(texts: DataFrame, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, hits: overlapping occurrences of the pattern in each text, by backward search."""
    return _whole(texts, lambda x: [[x.count(pattern)]], "hits long", key, text)


def whole_locate(texts: DataFrame, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos: characters before each occurrence, overlapping ones included."""
    return _whole(texts.where(F.contains(text, F.lit(pattern))), lambda x: [x.locate(pattern)], "pos long", key, text)


def whole_access(texts: DataFrame, at: list[int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos, symbol for those of the places that lie in the text."""

    def make(x: LastColumn) -> list:
        inside = [i for i in at if i < len(x.order) - 1]
        return [inside, [x.access(i) for i in inside]]

    return _whole(texts, make, "pos long, symbol string", key, text)


def whole_isa_sample(texts: DataFrame, step: int = SAMPLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos (from 0, every step-th), row."""
    return _whole_rows(texts, lambda x: x.row, key, text, step).select(key, F.col("k").alias("pos"), F.col("x").alias("row"))


def whole_most_steps(texts: DataFrame, step: int = SAMPLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    return _whole(texts, lambda x: [[x.most_steps(step)]], "steps long", key, text)


# --- statistics -----------------------------------------------------------------------------------------------------------


def byte_histogram(docs: DataFrame, text: str = "text") -> DataFrame:
    """byte, n over all texts. A task counts its texts' bytes and passes on at most 256 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for b in batches:
            for t in b.column(0):
                if t.is_valid:
                    total += np.bincount(np.frombuffer(t.as_buffer(), np.uint8), minlength=256)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found])], ["byte", "n"])

    return docs.select(text).mapInArrow(run, "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n"))


def entropy(histogram: DataFrame, n: str = "n") -> DataFrame:
    """Bits a symbol of order 0, 4 digits; a histogram has at most a row for each symbol."""
    total = F.sum(n).over(Window.partitionBy())
    p = F.col(n) / total
    return histogram.select((-p * F.log2(p)).alias("x")).agg(F.round(F.sum("x"), 4).alias("h0"))


def huffman_lengths(histogram: dict[int, int]) -> dict[int, int]:
    """Code length of each symbol; equal weights by age. A single symbol has length 1."""
    heap = [(n, i, [s]) for i, (s, n) in enumerate(sorted(histogram.items()))]
    heapq.heapify(heap)
    length = dict.fromkeys(histogram, 0)
    if len(heap) == 1:
        return dict.fromkeys(histogram, 1)
    age = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            length[s] += 1
        heapq.heappush(heap, (a[0] + b[0], age, a[2] + b[2]))
        age += 1
    return length


def code_table(histogram: DataFrame) -> DataFrame:
    """byte, n, bits: at most 256 rows pass the driver."""
    counts = {r.byte: r.n for r in histogram.collect()}
    rows = [(b, counts[b], x) for b, x in huffman_lengths(counts).items()]
    return histogram.sparkSession.createDataFrame(rows, "byte long, n long, bits long")


def mean_code_length(table: DataFrame) -> DataFrame:
    return table.agg(F.round(F.sum(F.col("n") * F.col("bits")) / F.sum("n"), 4).alias("mean_bits"))


def index_size(n_bytes: int, mean_bits: float, sample: int = SAMPLE) -> int:
    """Estimated bytes of an index: coded text, block counters, two sample columns."""
    words = math.ceil(n_bytes * mean_bits / 64)
    return words * 8 + words // 8 * 4 + 2 * 4 * (n_bytes // sample + 1)


def fingerprint() -> str:
    """FNV-1a of what an index table's readers rely on: its version, the sampling step, the columns."""
    h = 0xCBF29CE484222325
    for b in f"{FORMAT_VERSION} {SAMPLE} doc_id row pos bwt rank lf".encode():
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    return f"0x{h:016x}"


# --- ranges, pruning ------------------------------------------------------------------------------------------------------


def merge_ranges(ranges: DataFrame, by: str, at: str = "at", size: str = "len") -> DataFrame:
    """Ranges of each group with touching or overlapping ones merged: gaps and islands."""
    w = Window.partitionBy(by).orderBy(at, size)
    end = F.max(F.col(at) + F.col(size)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.select(by, at, size).distinct().withColumn("new", F.coalesce((F.col(at) > end).cast("int"), F.lit(1)))
    marked = marked.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = marked.groupBy(by, "island").agg(F.min(at).alias(at), F.max(F.col(at) + F.col(size)).alias("_e"))
    return out.select(by, at, (F.col("_e") - F.col(at)).alias(size))


def symbol_sets(docs: DataFrame, group: Column) -> DataFrame:
    """grp, symbols: the distinct characters of each group; a pattern with any other cannot occur there."""
    chars = docs.select(group.alias("grp"), F.explode(F.array_distinct(F.split("text", ""))).alias("ch")).where("ch != ''")
    return chars.groupBy("grp").agg(F.collect_set("ch").alias("symbols"))


def prunable(sets: DataFrame, pattern: str) -> DataFrame:
    """Groups that the pattern cannot occur in."""
    need = F.array(*(F.lit(c) for c in sorted(set(pattern)))).cast("array<string>")
    return sets.select("grp", (F.size(F.array_except(need, "symbols")) > 0).alias("skipped"))


#: Folders of a gram index, by the grams' hashes.
GRAM_BUCKETS = 32
#: Bytes of text whose grams make a file of it.
GRAM_BYTES = 1 << 24


def gram_index(docs: DataFrame, n: int = 3, key: str = "doc_id") -> DataFrame:
    """gram, bucket, key: the distinct n-character grams of each text, as a written table with a folder for each bucket of grams,
    sorted by gram in each of its files. Build it once, look words up in it often: a lookup reads the buckets of its grams, and of
    these the row groups that may hold them. A task writes one file. There are more files to a bucket as there is more text, and the
    documents of one gram are dealt to all of them, so that neither more text nor a gram in every document makes a task larger."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 256):
                ids, grams = [], []
                for i, t in zip(b.column(0).slice(s, 256), b.column(1).slice(s, 256), strict=True):
                    x = t.as_py() or ""
                    found = list({x[k : k + n] for k in range(len(x) - n + 1)})
                    ids.append(pa.repeat(i, len(found)))
                    grams.extend(found)
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(grams, pa.string())], [key, "gram"])

    grams = docs.select(F.col(key).cast("long").alias(key), "text").mapInArrow(run, f"{key} long, gram string")
    bucketed = grams.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(GRAM_BUCKETS)).cast("int"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    files = max(1, math.ceil(size / GRAM_BYTES / GRAM_BUCKETS))
    at = F.col("bucket") * files + F.pmod(F.xxhash64("gram", key), F.lit(files)).cast("int")
    return table(bucketed.repartitionById(GRAM_BUCKETS * files, at).sortWithinPartitions("bucket", "gram"), "grams", "bucket")


def gram_candidates(grams: DataFrame, pattern: str, n: int = 3, key: str = "doc_id") -> DataFrame:
    """Documents that hold all grams of the pattern; patterns shorter than a gram have no use for the index."""
    need = sorted({pattern[i : i + n] for i in range(len(pattern) - n + 1)})
    if not need:
        return grams.select(key).distinct()
    spark = grams.sparkSession
    places = spark.range(1).select(F.explode(F.array(*(F.lit(g) for g in need))).alias("g")).select(F.pmod(F.xxhash64("g"), F.lit(GRAM_BUCKETS)).cast("int").alias("b"))
    buckets = sorted({r.b for r in places.collect()})  # a row for each gram of the pattern
    hit = grams.where(F.col("bucket").isin(buckets) & F.col("gram").isin(need))
    return hit.groupBy(key).agg(F.count_distinct("gram").alias("k")).where(F.col("k") == len(need)).select(key)
