"""Quality classifier: positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are rows labelled 1; the unlabelled text is drawn from all documents, labelled or not, so no negative label is
read. The class prior comes from the best-bin estimate: over score thresholds, the smallest ratio of the unlabelled to the
positive share above, with a confidence margin. A logistic model over surface features (byte histogram, case, symbol and
digit shares, repeated and distinct words, word and line lengths) then minimises the non-negative risk by Adam. Training reads
at most TRAIN_ROWS documents of either kind, chosen by hash; every document is scored on its whole text.

Defined cases: null and empty texts are scored by their (all zero) features; a null id is kept, never held out; repeated rows give
repeated results; an empty table gives an empty result; without any positive label every score is the prior 0.5. Extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, id_text, mix, read, text_bytes, with_fields

#: Bound on the positives, and on the unlabelled documents, that training reads.
TRAIN_ROWS = 12_000
THRESHOLD = 0.3
N_FEATURES = 256 + 12

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_KIND = np.zeros((4, 256), bool)
_KIND[0, 65:91] = True  # upper-case letters
_KIND[1, 48:58] = True  # digits
_KIND[2, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True  # ASCII symbols
_KIND[3, 10] = True  # line ends


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each run of bytes other than white space; runs do not cross documents."""
    solid = ~_IS_SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(at, start, side="right") - 1


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row for each document."""
    n = len(at) - 1
    size = np.maximum(1, np.diff(at)).astype(float)
    doc = np.repeat(np.arange(n), np.diff(at))
    hist = np.bincount(doc * 256 + data, minlength=n * 256).reshape(n, 256) / size[:, None]
    start, end, of = word_spans(data, at)
    words = np.maximum(1, np.bincount(of, minlength=n)).astype(float)
    key = _word_keys(data, start, end)
    again = np.zeros(len(start))
    again[1:] = (key[1:] == key[:-1]) & (of[1:] == of[:-1])
    distinct = np.bincount(_distinct_docs(of, key), minlength=n)
    tail = _KIND[2][data[end - 1]] if len(end) else np.zeros(0, bool)
    lone = tail & (end - start == 1)
    more = np.stack(
        [
            *(hist[:, k].sum(1) for k in _KIND),
            np.bincount(of, again, n) / words,
            distinct / words,
            np.bincount(of, tail, n) / words,
            np.bincount(of, lone, n) / words,
            np.bincount(of, end - start, n) / words / 10,
            np.log1p(size) / 10,
            np.log1p(words) / 10,
            (distinct / np.sqrt(words)) / 10,
        ],
        1,
    )
    return np.hstack([np.sqrt(hist), more]).astype(np.float32)


def _word_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word: two independent sums over its bytes at their places in the word."""
    place = np.arange(len(data), dtype=np.int64)
    begun = np.zeros(len(data) + 1, np.int64)
    begun[start] = 1
    owner = np.cumsum(begun[:-1]) - 1
    place -= start[np.maximum(owner, 0)] if len(start) else 0
    v = mix((place.astype(np.uint64) << np.uint64(8)) | data.astype(np.uint64))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(v, out=total[1:])
    return mix(total[end] - total[start])


def _distinct_docs(of: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The document of each distinct (document, word)."""
    order = np.argsort(mix(of.astype(np.uint64)) ^ key, kind="stable")
    o, k = of[order], key[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (k[1:] != k[:-1])
    return o[new]


def featurise(column: pa.Array) -> np.ndarray:
    data, at = text_bytes(column)
    parts = [features(data[at[i] : at[j]], at[i : j + 1] - at[i]) for i, j in chunks(at)]
    return np.vstack(parts) if parts else np.zeros((0, N_FEATURES), np.float32)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Best-bin estimate of the share of positives among the unlabelled, from scores on rows that were not fitted.

    The threshold is the one with the least upper confidence bound of the ratio; the estimate is the ratio there.
    """
    best = (np.inf, 1.0)
    p, u = np.sort(positive), np.sort(unlabelled)
    for q in np.linspace(0.0, 0.9, 91):
        t = np.quantile(p, q)
        above_p, above_u = (p >= t).mean(), (u >= t).mean()
        margin = (np.sqrt(np.log(400) / (2 * len(p))) + np.sqrt(np.log(400) / (2 * len(u)))) / max(above_p, 1e-9)
        ratio = above_u / max(above_p, 1e-9)
        best = min(best, (ratio + margin, ratio))
    return float(np.clip(best[1], 0.02, 0.98))


def _adam(x: np.ndarray, grad, epochs: int, rate: float = 0.05) -> np.ndarray:
    w, m, v = np.zeros(x.shape[1]), 0.0, 0.0
    for t in range(1, epochs + 1):
        g = grad(w) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def risk_gradient(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
    """The gradient of the non-negative risk: of prior * loss(p as positive) + loss(u as negative) - prior * loss(p as negative).

    Where the last two terms, the negative risk, are below zero, the step goes back up on them alone.
    """
    sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
    loss = lambda s: -np.log(np.maximum(1 - s, 1e-9)).mean()  # noqa: E731  of calling a row negative
    negative = (u * su[:, None]).mean(0) - prior * (p * sp[:, None]).mean(0)
    if loss(su) - prior * loss(sp) < 0:
        return -negative
    return -prior * (p * (1 - sp)[:, None]).mean(0) + negative


def fit_arrays(positive: np.ndarray, unlabelled: np.ndarray, epochs: int = 400) -> dict:
    """Weights, scaling and estimated prior from the feature rows of trusted positives and unlabelled text."""
    both = np.vstack([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-3
    scaled = lambda x: np.clip(np.hstack([(x - mean) / scale, np.ones((len(x), 1))]), -8, 8)
    p, u = scaled(positive), scaled(unlabelled)

    def plain(w):  # separates labelled from unlabelled; only for the prior
        a, b = p[::2], u[::2]
        return -(a * (1 - _sigmoid(a @ w))[:, None]).mean(0) + (b * _sigmoid(b @ w)[:, None]).mean(0)

    w0 = _adam(p, plain, 150)
    prior = class_prior(p[1::2] @ w0, u[1::2] @ w0)

    return {"w": _adam(p, lambda w: risk_gradient(w, p, u, prior), epochs), "mean": mean, "scale": scale, "prior": prior}


def score_features(x: np.ndarray, model: dict) -> np.ndarray:
    if model["w"] is None:
        return np.full(len(x), 0.5)
    return _sigmoid(np.clip((x - model["mean"]) / model["scale"], -8, 8) @ model["w"][:-1] + model["w"][-1])


def _sample(rows: DataFrame, bound: int, seed: int) -> np.ndarray:
    n = rows.count()
    if not n:
        return np.zeros((0, N_FEATURES), np.float32)
    chance = F.pmod(F.xxhash64("k", "t", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = featurise(b.column("t"))
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array([r.tobytes() for r in x], pa.binary())], ["k", "x"])

    found = rows.where(chance < min(1.0, 0.95 * bound / n)).select("k", "t").mapInArrow(run, "k long, x binary").orderBy("k", "x").limit(bound).collect()
    return np.frombuffer(b"".join(r.x for r in found), np.float32).reshape(-1, N_FEATURES)


def fit(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> dict:
    """docs: doc_id, text; labels: doc_id, quality. Of the labels, only rows with quality 1 are read."""
    rows = docs.select(F.col("doc_id").cast("long").alias("k"), F.coalesce("text", F.lit("")).alias("t"))
    trusted = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("k")).distinct()
    positive = _sample(rows.join(trusted, "k", "left_semi"), bound, 5)
    unlabelled = _sample(rows, bound, 6)
    if len(positive) < 2 or len(unlabelled) < 2:
        return {"w": None, "mean": None, "scale": None, "prior": 0.5}
    return fit_arrays(positive, unlabelled)


def predict(docs: DataFrame, model: dict, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """docs with score (the probability of good text) and predicted."""
    keep = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    out = docs.select(*[F.col(f"`{c}`") for c in keep])
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = score_features(featurise(b.column(keep.index(text))), held.value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], [*keep, "score", "predicted"])

    return out.mapInArrow(run, with_fields(out, score="double", predicted="integer"))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(id_text()) % 5
    model = fit(docs, read(spark, sf_dir, "labels").where(fold != 0))
    return predict(docs, model).select("doc_id", F.coalesce(F.crc32(id_text()) % 5 == 0, F.lit(False)).alias("held_out"), "score", "predicted")
