"""Packing documents into fixed-length token sequences by large-item matching and best fit.

Tokens come from a byte-level BPE file; a document is its ids and one end id. Only documents longer than a sequence are cut, their
remainder first, so that every other piece fills a sequence. How many pieces have each length (at most `capacity` numbers) goes
to the driver, which plans bins on that histogram: pieces above a third of the capacity meet at most one partner each, the
largest that fits, largest pieces first; the others, in descending order, go to the tightest gap that takes them. The plan is a
list of runs - ranks of one length that fill consecutive bins - whose number depends on the capacity, not on the data. Each piece
gets its rank among the pieces of its length from counts by task and a running sum over tasks, and looks its place up in the runs.
No group of equal lengths ever meets in one task.

Defined cases: null and empty texts are the end id alone; a null id is kept; repeated rows are packed each; an empty table gives
no sequences; ties in length are in task order, which is that of the input. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import read, table, text_bytes, with_fields

CAPACITY = 2048
END_ID = 0
#: Lead bytes of code points from U+0240 on: texts that hold them take the general path.
_FAR_LEAD = 0xC9
#: Texts that are encoded before their pieces leave the worker.
SLICE = 256
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, r long"


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """ids of texts, as the tokenizers library gives them for the file.

    Texts of Latin letters alone, without a special token's string, go through tiktoken with the ranks of the same file: the
    same ids in a fifth of the time (a test holds the two against each other). All others go through tokenizers itself.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.general = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec["added_tokens"]]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that a byte-level vocabulary writes as themselves
        others = [b for b in range(256) if b not in printable]
        back = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        ranks = {bytes(back[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in self.special}
        import public_tokenizers

        self.fast = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str, near: bool) -> np.ndarray:
        if near and not any(s in text for s in self.special):
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        return np.array(self.general.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """The encoder of a file; a worker keeps it over its tasks."""
    return Encoder(path)


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID, with_ids: bool = False, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each piece; part and r are the task and the rank among its pieces of that length."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in (whole.slice(s, SLICE) for whole in batches for s in range(0, whole.num_rows, SLICE)):
            data, at = text_bytes(b.column("t"))
            far = [bool((data[i:j] >= _FAR_LEAD).any()) for i, j in zip(at, at[1:], strict=False)]
            row, piece, start, length, crc, rank, ids = [], [], [], [], [], [], []
            for i, value in enumerate(b.column("t")):
                x = np.append(encode(value.as_py() or "", not far[i]), np.uint32(end_id))
                first = len(x) % capacity or capacity
                for k, a in enumerate([0, *range(first, len(x), capacity)]):
                    cut = x[a : first if not k else a + capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(len(cut))
                    crc.append(zlib.crc32(cut.astype("<u4").tobytes()))
                    rank.append(seen[len(cut)])
                    seen[len(cut)] += 1
                    if with_ids:
                        ids.append(cut.astype(np.int32))
            columns = [b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(row), part), pa.int32()), pa.array(rank, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "r"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(run, PIECE + ", ids array<int>" * with_ids)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, first bin, offset, pieces a bin), and the number of bins."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    used_rank = np.zeros(capacity + 1, np.int64)
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> (first bin, bins)
    bins = 0

    def put(length: int, first_bin: int, n_bins: int, offset: int, each: int) -> None:
        runs.append((length, int(used_rank[length]), first_bin, offset, each))
        used_rank[length] += n_bins * each
        left[length] -= n_bins * each

    third = capacity // 3
    for big in range(capacity, third, -1):
        while left[big]:
            partner = next((p for p in range(min(capacity - big, big), third, -1) if left[p] > (p == big)), 0)
            m = int(left[big] if not partner else left[big] // 2 if partner == big else min(left[big], left[partner]))
            put(big, bins, m, 0, 1)
            if partner:
                put(partner, bins, m, big, 1)
            gaps.setdefault(capacity - big - partner, []).append((bins, m))
            bins += m
    for small in range(third, 0, -1):
        for gap in range(small, capacity + 1):
            while left[small] and gaps.get(gap):
                first, m = gaps[gap].pop()
                each = gap // small
                whole = min(m, int(left[small]) // each)
                if whole:
                    put(small, first, whole, capacity - gap, each)
                    gaps.setdefault(gap - each * small, []).append((first, whole))
                    first, m = first + whole, m - whole
                if m and left[small]:  # fewer than a bin takes
                    rest = int(left[small])
                    put(small, first, 1, capacity - gap, rest)
                    gaps.setdefault(gap - rest * small, []).append((first, 1))
                    first, m = first + 1, m - 1
                if m:
                    gaps[gap].append((first, m))
            if not left[small]:
                break
        while left[small]:
            each = min(capacity // small, int(left[small]))
            m = int(left[small]) // each
            put(small, bins, m, 0, each)
            gaps.setdefault(capacity - each * small, []).append((bins, m))
            bins += m
    return runs, bins


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut, a written table of pieces, with sequence_id and offset."""
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    hist = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs, _ = plan(hist, capacity)
    runs.sort()
    held = cut.sparkSession.sparkContext.broadcast(np.array(runs, np.int64).reshape(-1, 5))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = cut.join(base, ["part", "length"])
    keep = [c for c in cut.columns if c not in ("part", "r")]
    out = rows.select(*keep, (F.col("base") + F.col("r")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = held.value
        first = (x[:, 0] << 48) + x[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            k = np.searchsorted(first, (length << 48) + rank, side="right") - 1
            of, each = rank - x[k, 1], x[k, 4]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(x[k, 2] + of // each), pa.array(x[k, 3] + of % each * length)], [*keep, "sequence_id", "offset"])

    return out.mapInArrow(run, with_fields(cut.select(*keep), sequence_id="long", offset="long"))


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and offset; with_ids adds their token ids."""
    return place(table(pieces(docs, capacity, path, with_ids=with_ids), "pieces"), capacity)


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents").select("doc_id", "text"))
