"""Helpers shared by the training-data operators: shared tables, Arrow buffers, hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.store import table

#: Bytes of text that a Python worker looks at in one numpy pass; a longer document is a pass of its own.
CHUNK_BYTES = 1 << 20


#: skew_join broadcasts the keys that hold more than this part of the rows each, so fewer than this many.
HUBS = 1000


def fresh_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def judged(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], added: list[str], condition: str) -> DataFrame:
    """The rows of docs for which condition holds on the columns that judge adds; docs' own columns of those names stay as they are."""
    hidden: dict[str, str] = {}
    for c in docs.columns:
        if c.lower() in added:
            hidden[c] = fresh_name(docs.withColumnsRenamed(hidden), "_" + c)
    out = judge(docs.withColumnsRenamed(hidden)).where(condition)
    return out.select([F.col(f"`{hidden.get(c, c)}`").alias(c) for c in docs.columns])


def numbered(df: DataFrame, uid: str, name: str) -> DataFrame:
    """df as a written table with a number for each row in column uid. The numbers are stored, so every later scan sees the same."""
    return table(df.withColumn(uid, F.monotonically_increasing_id()), name)


def skew_join(rows: DataFrame, keyed: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """rows with the columns of keyed, which has a row for each key and, in `count`, how many of rows hold it; an inner join.

    Keys of more than total / HUBS rows are fewer than HUBS: their rows of keyed are broadcast and the rows that hold them are
    spread over all tasks. All other keys are joined by a shuffle on the key.
    """
    added = F.struct(*(c for c in keyed.columns if c not in on))
    hub = F.col(count) > total / HUBS
    large = keyed.where(hub).select(*on, added.alias("_large"))
    small = keyed.where(~hub).select(F.col(on[0]).cast("long").alias("_at"), *on[1:], F.lit(False).alias("_hub"), added.alias("_small"))
    out = rows.join(F.broadcast(large), on, "left").withColumn("_hub", F.col("_large").isNotNull())
    out = out.withColumn("_at", F.when(F.col("_hub"), F.xxhash64(*rows.columns)).otherwise(F.col(on[0])))
    out = out.join(small, ["_at", *on[1:], "_hub"], "left").withColumn("_found", F.coalesce("_large", "_small")).where("_found is not null")
    return out.select(*rows.columns, "_found.*")


def id_text(column: str = "doc_id") -> Column:
    return F.col(column).cast("string").cast("binary")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (one more than rows) of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def chunks(at: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most `size` bytes together, or a single longer row."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on uint64 whose output bits depend on all input bits (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def segment_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[at[i]:at[i + 1]]; zero for empty ranges."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:], dtype=np.float64)
    return total[at[1:]] - total[at[:-1]]


def with_fields(df: DataFrame, **added: str) -> T.StructType:
    """df's schema and further nullable fields; df's own schema object stays as it is."""
    out = T.StructType(list(df.schema.fields))
    for name, kind in added.items():
        out = out.add(name, kind)
    return out
