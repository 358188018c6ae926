"""Language identification: multinomial naive Bayes over hashed character n-grams.

Two distributed passes. Training counts hashed character n-grams (orders 2 to 4 of the lower-cased code points) per language over a
bounded, hash-chosen sample of labelled rows; the matrix of log-probabilities (BUCKETS x languages, at most LANGUAGES) is broadcast.
Scoring makes a sparse count matrix of each batch, a row for a document with its distinct buckets, multiplies it by that matrix in
numpy and adds the log priors. The score is the posterior of the model: the likelihood of all n-grams, normalised over languages.

Defined cases: text null or without any letter gives `und` with score 0; texts of a single character have no n-grams and follow the
priors; a null id is kept; repeated rows give repeated results; an empty table gives an empty result; ties between languages go to
the alphabetically first; no learned language at all gives `und` for every row; more than LANGUAGES labels raise an error. Extra
columns pass through `predict`; columns of the names that it adds are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, id_text, read, segment_sums, text_bytes, with_fields

BUCKETS = 1 << 16
ORDERS = (2, 3, 4)
#: Bounds on labelled rows per language that training reads (about), and on languages: the matrix has 256 KB for each.
TRAIN_ROWS_PER_LANGUAGE, LANGUAGES = 4000, 512
UNKNOWN = "und"


def ngram_buckets(points: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each code point; the last order - 1 start none."""
    h = np.zeros(max(0, len(points) - order + 1), np.uint32)
    for k in range(order):
        h = (h * np.uint32(0x01000193)) ^ points[k : k + len(h)]
    h = (h ^ np.uint32(order)) * np.uint32(0x9E3779B1)
    return (h >> np.uint32(16)).astype(np.uint16)


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return text_bytes(pc.utf8_lower(column.cast(pa.large_string())))


def code_points(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets as code points and offsets."""
    begun = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=begun[1:])
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32), begun[at]


def document_ngrams(points: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """The buckets of each document's n-grams of all orders; n-grams do not cross documents."""
    by_order = [ngram_buckets(points, order) for order in ORDERS]
    for a, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield np.concatenate([h[a : max(a, e - order + 1)] for h, order in zip(by_order, ORDERS, strict=True)])


def sparse_counts(documents: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row ends, buckets and counts of a sparse matrix with a row for each document."""
    ends, buckets, counts, size = [0], [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)], 0
    for h in documents:
        h = np.sort(h, kind="stable")  # a radix sort for 16 bits
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), h[1:] != h[:-1]]))
        buckets.append(h[first])
        counts.append(np.diff(np.append(first, len(h))))
        size += len(first)
        ends.append(size)
    return np.array(ends), np.concatenate(buckets), np.concatenate(counts)


def log_likelihoods(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The product of the documents' sparse counts and the matrix of log-probabilities."""
    ends, buckets, counts = sparse_counts(document_ngrams(*code_points(data, at)))
    return segment_sums(table[buckets] * counts[:, None].astype(np.float64), ends)


def counts_of(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """n-gram counts over all documents of a group."""
    total = np.zeros(BUCKETS, np.int64)
    for i, j in chunks(at):
        for h in document_ngrams(*code_points(data[at[i] : at[j]], at[i : j + 1] - at[i])):
            total += np.bincount(h, minlength=BUCKETS) if len(h) > BUCKETS // 8 else 0
            if len(h) <= BUCKETS // 8:
                np.add.at(total, h, 1)
    return total


def fit(docs: DataFrame, per_language: int = TRAIN_ROWS_PER_LANGUAGE, text: str = "text", label: str = "lang", key: str = "doc_id") -> tuple[list[str], np.ndarray]:
    """Languages in order and the BUCKETS x languages matrix of log-probabilities, its last row the log priors."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(label).alias("l")).where("l is not null and t is not null")
    seen = rows.groupBy("l").agg(F.count("*").alias("n")).orderBy("l").limit(LANGUAGES + 1).collect()
    if len(seen) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages: their matrix would be too large to broadcast")
    if not seen:
        return [], np.zeros((BUCKETS + 1, 0), np.float32)
    shares = docs.sparkSession.createDataFrame([(r.l, min(1.0, per_language / r.n)) for r in seen], "l string, share double")
    chance = F.pmod(F.xxhash64("k", "t", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for b in batches:
            names = b.column("l").to_pylist()
            for name in set(names):
                part = b.column("t").filter(pa.array([x == name for x in names]))
                found[name] = found.get(name, 0) + counts_of(*lowered(part))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([v.tobytes() for v in found.values()], pa.binary())], ["l", "c"])

    sample = rows.join(F.broadcast(shares), "l").where(chance < F.col("share")).select("l", "t").repartition(max(4, len(seen) // 4))
    sums: dict[str, np.ndarray] = {}
    for r in sample.mapInArrow(count, "l string, c binary").toLocalIterator():  # for each task, a row for each language that it met
        sums[r.l] = sums.get(r.l, 0) + np.frombuffer(r.c, np.int64)
    names = sorted(sums)
    if not names:
        return [], np.zeros((BUCKETS + 1, 0), np.float32)
    c = np.stack([sums[x] for x in names], 1) + 0.5
    total = {r.l: r.n for r in seen}
    prior = np.log(np.array([[total[x] for x in names]], float) / sum(total[x] for x in names))
    return names, np.vstack([np.log(c / c.sum(0)), prior]).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """docs with lang_pred and score, the posterior of the predicted language."""
    spark, (names, matrix) = docs.sparkSession, model
    keep = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    held = spark.sparkContext.broadcast(matrix)
    out = docs.select(*[F.col(f"`{c}`") for c in keep])
    schema = with_fields(out, lang_pred="string", score="double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value[:-1]
        prior = held.value[-1].astype(np.float64)
        for b in batches:
            column = b.column(keep.index(text))
            n, k = b.num_rows, len(names)
            if k and n:
                data, at = lowered(column)
                score = np.tile(prior, (n, 1))
                for i, j in chunks(at, (4 << 20) // max(4, k)):
                    score[i:j] += log_likelihoods(data[at[i] : at[j]], at[i : j + 1] - at[i], table)
                best = score.argmax(1)
                p = 1 / np.exp(score - score.max(1, keepdims=True)).sum(1)
                letters = pc.fill_null(pc.match_substring_regex(column, r"\pL"), False).to_numpy(zero_copy_only=False)
                said = pc.if_else(pa.array(letters), pa.array(names).take(pa.array(best)), pa.scalar(UNKNOWN))
                p = np.where(letters, p, 0.0)
            else:
                said, p = pa.array([UNKNOWN] * n, pa.string()), np.zeros(n)
            yield pa.RecordBatch.from_arrays([*b.columns, said.cast(pa.string()), pa.array(p, pa.float64())], [*keep, "lang_pred", "score"])

    return out.mapInArrow(run, schema)


def train_fold(docs: DataFrame) -> DataFrame:
    return docs.where(F.coalesce(F.crc32(id_text()) % 4 != 2, F.lit(True)))


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(train_fold(docs))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(F.crc32(id_text()) % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
