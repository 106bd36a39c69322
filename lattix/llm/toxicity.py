"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

Training reads at most ``max_rows`` labelled texts (a documented bound; those with the smallest crc32 of a salted id, then the smallest id
and hash of the text). Their ids are chosen first, from ids and hashes, and sent to the tasks that
read the texts, so that no text is shuffled but the chosen ones. In a first pass over these Spark counts, per class, the documents that hold each hashed n-gram; the log-count ratios pick and scale ``features`` of them.
In a second pass each training document becomes its set of picked features, and the driver fits a logistic regression on that
bounded matrix. Scoring is map-only over whole texts: no shuffle, so no source or copy group can pile up in a task.

Labels, language, source and id are never inputs of a score. Null and empty texts hold no n-gram and get the score of the intercept.
Null labels and ids are left out of training. With a single class among the labels every score is the smoothed share of
label 1, and 1/4 without any label. Very
long texts are read whole, a stretch of ``STRETCH`` bytes at a time, so memory does not grow with them. Repeated rows are scored alike;
an empty table gives no rows. Columns are added under a name of the caller's choice, and clashes are refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import _LOWER, cut, drop_written, slices, text_buffers

BITS = 18
WIDTHS = (3, 4, 5, 6)
#: Bytes that are worked on at once.
STRETCH = 1 << 17
#: Texts that are learnt from, at most.
MAX_ROWS = 20_000


@dataclass(frozen=True)
class Model:
    """slot: feature number + 1 of each n-gram hash, or 0. weight: of each feature, its log-count ratio included."""

    slot: np.ndarray
    weight: np.ndarray
    bias: float


def gram_hashes(flat: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(width, hash of the n-gram at each byte) over lower-cased bytes; n-grams that leave their row are included."""
    flat = flat.astype(np.uint32)
    rolled = flat
    for k in range(1, max(WIDTHS)):
        if k >= len(flat):
            return
        rolled = rolled[:-1] * np.uint32(0x01000193)
        rolled += flat[k:]
        if k + 1 in WIDTHS:
            mixed = rolled * np.uint32(0x9E3779B1)
            mixed >>= np.uint32(32 - BITS)
            yield k + 1, mixed


def row_features(data: np.ndarray, at: np.ndarray, i: int, j: int, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row from i, feature) without repeats, sorted."""
    if j - i == 1 and at[j] - at[i] > STRETCH:
        return _long_features(data[at[i] : at[j]], slot)
    bounds = at[i : j + 1] - at[i]
    kind = np.uint32 if (j - i) << BITS <= 1 << 32 else np.uint64
    keys = [np.zeros(0, kind)]
    for width, hashed in gram_hashes(_LOWER[data[at[i] : at[j]]]):
        f = slot[hashed]
        hit = np.flatnonzero(f)
        row = np.searchsorted(bounds, hit, "right") - 1
        inside = hit + width <= bounds[row + 1]
        keys.append((row[inside] << BITS | f[hit[inside]].astype(np.int64) - 1).astype(kind))
    key = np.sort(np.concatenate(keys))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]].astype(np.int64)
    return key >> BITS, key & ((1 << BITS) - 1)


def _long_features(text: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of one text, marked stretch by stretch."""
    held = np.zeros(int(slot.max()) + 1, bool)
    for begin in range(0, len(text), STRETCH):
        for _, hashed in gram_hashes(_LOWER[text[begin : begin + STRETCH + max(WIDTHS) - 1]]):
            held[slot[hashed]] = True
    found = np.flatnonzero(held[1:])
    return np.zeros(len(found), np.int64), found


def _fit_order() -> list:
    return [F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit("/fit"))), F.col("doc_id"), F.col("_th")]


def _with_text_hash(df: DataFrame) -> DataFrame:
    return df.withColumn("_th", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))


def _first_texts(keys: DataFrame, texts: DataFrame, max_rows: int) -> DataFrame:
    """The first ``max_rows`` rows of ``keys`` (doc_id, _th, label; repeated ones too) with the texts that ``texts`` (doc_id, text, _th) holds of them."""
    one = keys.groupBy("doc_id", "_th", "label").agg(F.count("*").alias("n"))
    chosen, left = [], max_rows
    for r in one.orderBy(*_fit_order(), "label").limit(max_rows).collect():  # max_rows times four numbers
        if left:
            chosen.append((r["doc_id"], r["_th"], r["label"], min(left, r["n"])))
            left -= chosen[-1][3]
    few = F.broadcast(keys.sparkSession.createDataFrame(chosen, "doc_id long, _th long, label int, n int"))
    found = texts.select("doc_id", "text", "_th").join(few, ["doc_id", "_th"]).groupBy("doc_id", "_th", "label").agg(F.first("text").alias("text"), F.first("n").alias("n"))
    return found.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n")))).select("doc_id", "text", "label")


def train(labelled: DataFrame, max_rows: int = MAX_ROWS, features: int = 2048, rounds: int = 300, penalty: float = 1e-3) -> Model:
    """``labelled``: doc_id, text, label (0 or 1); the training fold only."""
    rows = _with_text_hash(labelled.where("label in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("label").cast("int").alias("label")))
    return _train(_first_texts(rows.select("doc_id", "_th", "label"), rows, max_rows), features, rounds, penalty)


def train_on(docs: DataFrame, labels: DataFrame, folds: int = 5, max_rows: int = MAX_ROWS, **rest) -> Model:
    """``train`` on ``training_rows``, of which no more texts are read than are learnt from."""
    texts = _with_text_hash(docs.select("doc_id", "text"))
    keys = texts.select("doc_id", "_th").join(_training_labels(labels, folds), "doc_id")
    return _train(_first_texts(keys.where("label in (0, 1)"), texts, max_rows), **rest)


def _train(chosen: DataFrame, features: int = 2048, rounds: int = 300, penalty: float = 1e-3) -> Model:
    sample = cut(chosen.select("label", "text").repartition(8), "toxicity-sample")
    try:
        return _train_on_sample(sample, features, rounds, penalty)
    finally:
        drop_written(sample.sparkSession, sample)


def _train_on_sample(sample: DataFrame, features: int, rounds: int, penalty: float) -> Model:
    size = 1 << BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = np.zeros((2, size), np.uint32), np.zeros(2, np.int64)
        every = np.arange(1, size + 1, dtype=np.int32)
        for batch in batches:
            labels = batch.column(0).to_numpy(zero_copy_only=False)
            data, at = text_buffers(batch.column(1))
            rows += np.bincount(labels, minlength=2)
            for i, j in slices(at, STRETCH):
                row, f = row_features(data, at, i, j, every)
                for label in (0, 1):
                    held[label] += np.bincount(f[labels[i:j][row] == label], minlength=size).astype(np.uint32)
        yield pa.RecordBatch.from_pydict({"rows": [rows.tolist()], "held": [held.tobytes()]})

    rows, held = np.zeros(2, np.int64), np.zeros((2, size), np.int64)
    for r in sample.mapInArrow(count, "rows array<long>, held binary").collect():  # 8 records of a fixed size
        rows += np.array(r["rows"])
        held += np.frombuffer(r["held"], np.uint32).reshape(2, size)
    if not rows.all():
        share = (rows[1] + 0.5) / (rows.sum() + 2)
        return Model(np.zeros(size, np.uint16), np.zeros(0), float(np.log(share / (1 - share))))
    p, q = (held[1] + 1) / (rows[1] + 2), (held[0] + 1) / (rows[0] + 2)
    ratio = np.log(p / q)
    spread = np.abs(p - q) / np.sqrt((held.sum(0) + 1) / rows.sum() * (1 / rows[1] + 1 / rows[0]))
    best = np.argsort(-spread, kind="stable")[:features]
    slot = np.zeros(size, np.uint16)
    slot[best] = np.arange(1, len(best) + 1)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_buffers(batch.column(1))
            out = []
            for i, j in slices(at, STRETCH):
                row, f = row_features(data, at, i, j, slot)
                cuts = np.searchsorted(row, np.arange(j - i + 1))
                out += [f[cuts[k] : cuts[k + 1]].astype(np.uint16).tobytes() for k in range(j - i)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["label", "f"])

    labels, parts = [], []
    for r in sample.mapInArrow(encode, "label int, f binary").collect():  # max_rows rows of at most `features` numbers
        labels.append(r["label"])
        parts.append(np.frombuffer(r["f"], np.uint16))
    y = np.array(labels, np.float64)
    col, row = np.concatenate(parts).astype(np.int64), np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    scale = ratio[best]
    w, b = _fit(row, col, scale[col], y, len(best), rounds, penalty)
    return Model(slot, w * scale, b)


def _fit(row: np.ndarray, col: np.ndarray, value: np.ndarray, y: np.ndarray, k: int, rounds: int, penalty: float) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam over the whole matrix, in a fixed order: the same rows give the same weights."""
    w, m, v = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
    n = len(y)
    w[k] = np.log((y.sum() + 1) / (n - y.sum() + 1))
    for t in range(1, rounds + 1):
        z = np.bincount(row, weights=value * w[col], minlength=n) + w[k]
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        d = np.append(np.bincount(col, weights=value * g[row], minlength=k), g.sum())
        d[:k] += penalty * w[:k]
        m, v = 0.9 * m + 0.1 * d, 0.999 * v + 0.001 * d * d
        w -= 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:k], float(w[k])


def score_texts(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "_toxicity") -> DataFrame:
    """All columns of ``docs`` plus ``out_col``, a double from 0 to 1."""
    if out_col in docs.columns:
        raise ValueError(f"the documents have a column {out_col}; name another for the score")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size: 2^BITS slots

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for batch in batches:
            data, at = text_buffers(batch)
            z = np.full(len(batch), m.bias)
            for i, j in slices(at, STRETCH):
                row, f = row_features(data, at, i, j, m.slot)
                z[i:j] += np.bincount(row, weights=m.weight[f], minlength=j - i)
            yield pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return docs.withColumn(out_col, score(F.col(text_col)))


def _training_labels(labels: DataFrame, folds: int) -> DataFrame:
    marks = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    return marks.where(F.crc32(F.col("doc_id").cast("string")) % folds != 0)


def training_rows(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """Labelled documents outside the held-out fold, which is crc32(id as text) mod ``folds`` = 0."""
    return docs.select("doc_id", "text").join(_training_labels(labels, folds), "doc_id")
