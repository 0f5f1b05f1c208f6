"""Quality classifier: Bradley-Terry pairwise ranking over text statistics.

A document's score is linear in its features; the probability that one document is preferred to another is the
logistic function of the difference of their scores. Weights are learned from preference pairs (one document of
label 1, one of label 0) by logistic loss on feature differences. The threshold is the quantile of the learned
documents' scores at the share of label 0; a logistic curve through that threshold turns scores into 0 to 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .common import blocks, col, coded, small_batches, strings_of, text_bytes, word_spans

#: Bound of the labelled rows that a model is fitted on: those with the smallest xxhash64 of their id.
SAMPLE_ROWS = 20_000
PAIRS_PER_ROW = 8
#: Steps of descent, at least.
STEPS = 600
SEED = 7

_MARKS = [ord(c) for c in ".,|#$%&*!?"]
_CLASS = np.zeros(256, np.uint8)  # 0 other ASCII, 1 lower, 2 upper, 3 digit, 4 white space, 5 line feed, 6 not ASCII, 7 and on: marks
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 6
_CLASS[[9, 11, 12, 13, 32]], _CLASS[10] = 4, 5
for _k, _m in enumerate(_MARKS):
    _CLASS[_m] = 7 + _k
_CLASSES = 7 + len(_MARKS)
FEATURES = _CLASSES + 11


def _per_row(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount(row, weights=values, minlength=rows)


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of statistics for each text, from all its bytes. An empty text has zeros and the flag of the last column."""
    rows = len(off) - 1
    out = np.zeros((rows, FEATURES))
    size = np.diff(off)
    if len(data):
        row = np.repeat(np.arange(rows, dtype=np.int64), size)
        kind = _CLASS[data]
        share = np.bincount(row * _CLASSES + kind, minlength=rows * _CLASSES).reshape(rows, _CLASSES) / np.maximum(size, 1)[:, None]
        out[:, :_CLASSES] = np.sqrt(share)
        starts, ends, at = word_spans(data, off)
        words = np.diff(at)
        n = np.maximum(words, 1)
        of = np.repeat(np.arange(rows, dtype=np.int64), words)
        length = (ends - starts).astype(np.float64)
        codes, distinct = coded(strings_of(data, starts, ends))
        mean = _per_row(length, of, rows) / n
        k = _CLASSES
        out[:, k] = np.log1p(size) / 10
        out[:, k + 1] = mean / 10
        out[:, k + 2] = np.sqrt(np.maximum(_per_row(length**2, of, rows) / n - mean**2, 0)) / 10
        out[:, k + 3] = _per_row(length <= 3, of, rows) / n
        out[:, k + 4] = _per_row(length >= 12, of, rows) / n
        seen = np.unique(of * len(distinct) + codes) // max(len(distinct), 1)
        out[:, k + 5] = np.bincount(seen.astype(np.int64), minlength=rows) / n
        first = kind[starts]
        out[:, k + 6] = _per_row(first == 2, of, rows) / n
        last = kind[ends - 1]
        out[:, k + 7] = _per_row((last == 7) | (last == 16), of, rows) / n
        out[:, k + 8] = _per_row(last > 8, of, rows) / n
        # lines: a break after each line feed and at each row's end
        lines, line_at = _lines(data, off, kind)
        line_codes, line_set = coded(lines)
        count = np.diff(line_at)
        line_of = np.repeat(np.arange(rows, dtype=np.int64), count)
        own = np.unique(line_of * len(line_set) + line_codes) // max(len(line_set), 1)
        out[:, k + 9] = np.where(count > 0, 1 - np.bincount(own.astype(np.int64), minlength=rows) / np.maximum(count, 1), 0)
    out[:, FEATURES - 1] = size == 0
    return out


def _lines(data: np.ndarray, off: np.ndarray, kind: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    cut = np.unique(np.concatenate([np.flatnonzero(kind == 5) + 1, off]))
    at = np.searchsorted(cut, off)
    buf = pa.py_buffer(np.ascontiguousarray(data))
    return pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(cut.astype(np.int32)), buf]), at


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.slope * (z - self.threshold), -35, 35)))


def bradley_terry(x: np.ndarray, y: np.ndarray, pairs_per_row: int = PAIRS_PER_ROW, seed: int = SEED) -> Model:
    """Fits on features x and labels y (1 preferred to 0). Without both labels every text scores 0.5 or, if only one label is known, to that label's side."""
    width = x.shape[1]
    pos, neg = x[y == 1], x[y == 0]
    if not len(pos) or not len(neg):
        lean = 0.0 if not len(x) else (1.0 if len(pos) else -1.0)
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 1.0, -2 * lean)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    rng = np.random.default_rng(seed)
    n = pairs_per_row * max(len(pos), len(neg))
    diff = (pos[rng.integers(0, len(pos), n)] - neg[rng.integers(0, len(neg), n)]) / scale
    w, m, v, penalty = np.zeros(width), np.zeros(width), np.zeros(width), 1e-4
    step, batches = 0, max(1, n // 1024)
    for _ in range(max(6, -(-STEPS // batches))):
        for part in np.array_split(rng.permutation(n), batches):
            step += 1
            d = diff[part]
            lost = 1 / (1 + np.exp(np.clip(d @ w, -35, 35)))
            grad = -(d * lost[:, None]).mean(axis=0) + penalty * w
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            w -= 0.03 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    z = ((x - mean) / scale) @ w
    threshold = _quantile_threshold(z, y, len(neg) / len(x))
    # the curve's slope, by Newton's method on the logistic loss through the threshold
    slope, t = 1.0, z - threshold
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(slope * t, -35, 35)))
        slope = float(np.clip(slope + (t * (y - p)).sum() / max((t * t * p * (1 - p)).sum(), 1e-9), 1e-3, 50))
    return Model(mean, scale, w, slope, threshold)


def _quantile_threshold(z: np.ndarray, y: np.ndarray, share: float, slack: float = 0.02) -> float:
    """The score quantile near share (within slack) that parts the labels with the fewest errors; of equals the one in the widest gap."""
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    n = len(z)
    low, high = max(1, int((share - slack) * n)), min(n - 1, int(np.ceil((share + slack) * n)))
    if low > high:
        return float(np.quantile(z, share))
    cut = np.arange(low, high + 1)
    ones = np.concatenate([[0], np.cumsum(y)])
    errors = ones[cut] + (n - cut) - (ones[n] - ones[cut])
    gap = z[cut] - z[cut - 1]
    best = np.lexsort((-gap, errors))[0]
    return float((z[cut[best]] + z[cut[best] - 1]) / 2)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """labels: (doc_id, label). Rows with a null id or a label other than 0 and 1 are left out; a document with several labels counts once for each, one with several texts once for each text, and equal rows count once. Fitted on at most sample_rows of the labelled documents, those with the smallest hash of their id; ties by id, label and text. Null and empty texts are learned from like others; without labelled documents every text scores 0.5."""
    small_batches(docs.sparkSession)
    usable = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    chosen = usable.orderBy(F.xxhash64("id"), "id", "y").limit(sample_rows)
    joined = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(chosen), "id")  # at most sample_rows rows of two numbers
    joined = joined.withColumn("t", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            x = features(*text_bytes(col(b, "text")))
            yield pa.RecordBatch.from_arrays([col(b, "id"), col(b, "y"), col(b, "t"), pa.array(list(x), pa.list_(pa.float64()))], ["id", "y", "t", "x"])

    rows = joined.mapInArrow(run, joined.select("id", "y", "t").schema.add("x", ArrayType(DoubleType()))).dropDuplicates(["id", "y", "t"])
    got = rows.orderBy(F.xxhash64("id"), "id", "y", "t").limit(sample_rows).toPandas().sort_values(["id", "y", "t"], kind="stable")
    x = np.array(got["x"].tolist(), np.float64).reshape(len(got), FEATURES)
    return bradley_terry(x, got["y"].to_numpy(np.int64))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """keep's columns and the score (0 to 1) of each whole text, however long; a null text counts as empty; equal texts score alike; repeated rows, nulls in other columns and empty tables pass through; other columns are not read, whatever their names."""
    small_batches(docs.sparkSession)
    schema = docs.select(*keep).schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            s = model.score(features(*text_bytes(col(b, "text"))))
            yield pa.RecordBatch.from_arrays([*(col(b, c) for c in keep), pa.array(s)], [*keep, name])

    return docs.select(*dict.fromkeys((*keep, "text"))).mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs that score at least least, with all their columns, also of clashing names; a null text counts as empty, repeated rows stay or go together, a score of just least stays, an empty table gives an empty one."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            yield b.filter(pa.array(model.score(features(*text_bytes(col(b, "text")))) >= least))

    return docs.mapInArrow(run, docs.schema)
