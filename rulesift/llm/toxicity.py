"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes ratios.

Features are the character n-grams (``SIZES`` code points, lower case, over the
whole text, blanks included) that occur in a text, hashed to ``BUCKETS`` numbers.
Training has two parts:

1. *Log-count ratios*, over all labelled rows: how many positive and negative
   texts hold each bucket.  Tasks count, Spark adds the counts by slices of the
   bucket range, so what any task or the driver holds is bounded by ``BUCKETS``.
   r = log of the smoothed share in positives over that in negatives.  A bucket
   is a feature if |r| is at least ``MIN_RATIO`` and ``SURE`` standard errors.
2. *Logistic regression* on presence times r, fitted on a sample of about
   ``fit_rows`` labelled rows (a documented bound: rows whose hash falls into
   that share; only their features leave the tasks).  Class weights are equal in
   sum; the start is the naive Bayes solution and an L2 term pulls towards it.

Scoring gathers a text's weights; texts of any length are read whole.  Nothing
but the text enters a score.

Defined cases: null text is the empty text, which gets the score of no
features; null labels are not learnt from; repeated rows are scored each; with
no labelled rows, or one class only, every score is the class's share (0.5
without rows); other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulesift.llm.workers import frugal, values

SIZES = (3, 4, 5)
BUCKETS = 1 << 20
SLICE = 1 << 14
MIN_RATIO = 1.0
SURE = 4.0
FIT_ROWS = 20_000
BROADCAST_LABELS = 1_000_000
STEPS = 150
PULL = 0.01


def buckets(text: str | None) -> np.ndarray:
    """Bucket of every n-gram occurrence of the text."""
    x = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    x = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    mult, shift = np.uint64(0xD6E8FEB86659FD93), np.uint64(64 - (BUCKETS.bit_length() - 1))
    out, h = [], x
    for n in range(2, max(SIZES) + 1):
        if len(x) < n:
            break
        h = h[:-1] * mult + x[n - 1:]
        if n in SIZES:
            out.append(((h ^ (h >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)) >> shift)
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


class Model:
    """``weights`` by bucket (0: no feature) and ``bias``."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, text: str | None, unknown: float | None = None) -> float:
        """``unknown``, if given, is the score of a text that holds no feature."""
        found = buckets(text)
        found = np.unique(found[self.weights[found] != 0])
        if unknown is not None and not len(found):
            return unknown
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[found].sum(dtype=np.float64), -30, 30))))


def _counts(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Texts that hold each bucket: 2 x BUCKETS by label, and texts by label."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                held[label][np.unique(buckets(text.as_py()))] += 1
                texts[label] += 1
        if texts.any():
            slices = [(label * (BUCKETS // SLICE) + k, held[label, k * SLICE:(k + 1) * SLICE]) for label in (0, 1) for k in range(BUCKETS // SLICE)]
            slices = [(k, x) for k, x in slices if x.any()]
            yield pa.RecordBatch.from_arrays([pa.array([-1, *(k for k, _ in slices)], pa.int32()), pa.array([x.astype("<i4").tobytes() for x in (texts, *(x for _, x in slices))], pa.binary())], names=["slice", "counts"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            for x in batch.column(1):
                total = total + np.frombuffer(x.as_py(), "<i4").astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slice", "counts"])

    held, texts = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
    schema = "slice int, counts binary"
    for row in labelled.mapInArrow(frugal(count), schema).groupBy("slice").applyInArrow(add, schema).toLocalIterator():
        if row["slice"] < 0:
            texts = np.frombuffer(bytes(row["counts"]), np.int64)
        else:
            label, k = divmod(row["slice"], BUCKETS // SLICE)
            held[label, k * SLICE:(k + 1) * SLICE] = np.frombuffer(bytes(row["counts"]), np.int64)
    return held, texts


def ratios(held: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Smoothed log ratio of the shares of texts that hold a bucket; 0 where it is no feature."""
    r = np.log((held[1] + 1) / (texts[1] + 2)) - np.log((held[0] + 1) / (texts[0] + 2))
    error = np.sqrt(1 / (held[1] + 1) + 1 / (held[0] + 1))
    return np.where(np.abs(r) >= np.maximum(MIN_RATIO, SURE * error), r, 0)


def _sample(labelled: DataFrame, r: np.ndarray, share: float) -> tuple[list[np.ndarray], np.ndarray]:
    """The features and labels of a share of the labelled texts."""
    shared = labelled.sparkSession.sparkContext.broadcast(r != 0)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(0):
                x = buckets(text.as_py())
                found.append(np.unique(x[shared.value[x]]).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1)], names=["features", "label"])

    key = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / (1 << 30)
    rows = labelled.where(key < share).select("text", "label").mapInArrow(frugal(features), "features binary, label int").collect()
    return [np.frombuffer(bytes(x.features), "<i4") for x in rows], np.array([x.label for x in rows], np.float64)


def fit_weights(r: np.ndarray, found: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on presence times r, by Adam steps over all sample rows."""
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    row = np.repeat(np.arange(len(found)), sizes)
    used, column = np.unique(np.concatenate([np.zeros(0, np.int32), *found]), return_inverse=True)
    scale = r[used]
    values = scale[column]
    w, b = np.full(len(used), 0.1), -2.0
    positive = max(1.0, labels.sum())
    weight = np.where(labels == 1, 0.5 / positive, 0.5 / max(1.0, len(labels) - positive))
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, STEPS + 1):
        z = b + np.bincount(row, values * w[column], len(found))
        error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels)
        g = np.r_[np.bincount(column, values * error[row], len(used)) + PULL * (w - 0.1) / max(1, len(used)) ** 0.5, error.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, b = np.maximum(w - move[:-1], 0), b - move[-1]
    weights = np.zeros(len(r))
    weights[used] = w * scale
    return weights, float(b)


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    """The model learnt from the rows whose label is 0 or 1."""
    labelled = labelled.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"), F.col(label_col).cast("int").alias("label")).where("label IN (0, 1)")
    held, texts = _counts(labelled.select("text", "label"))
    if not texts.all():
        share = min(max((texts[1] + 1) / (texts.sum() + 2), 1e-6), 1 - 1e-6)
        return Model(np.zeros(BUCKETS), float(np.log(share / (1 - share))))
    r = ratios(held, texts)
    return Model(*fit_weights(r, *_sample(labelled, r, fit_rows / int(texts.sum()))))


def with_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(id, text, label) of the labelled documents.  Labels are broadcast only if
    they are at most ``BROADCAST_LABELS`` rows; more are joined by a shuffle."""
    labels = labels.select(id_col, label_col).where(F.col(label_col).isNotNull())
    if labels.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        labels = F.broadcast(labels)
    return docs.select(id_col, text_col).join(labels, id_col)


def with_score(docs: DataFrame, model: Model, unknown: float | None = None, text_col: str = "text", to: str = "score") -> DataFrame:
    """``docs`` with the score of each row's text in column ``to`` (``unknown``: see ``Model.score``)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # arrays: no class of this package on executors
    rows = docs.select(F.struct("*").alias("doc"))  # names of any kind pass through
    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            scores = [own.score(x, unknown) for x in values(batch.column(0).field(place))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=schema.fieldNames())

    scored = rows.mapInArrow(frugal(run), schema)
    return scored.select(*(F.col("doc").getField(c).alias(c) for c in docs.columns), F.col("score").alias(to))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``score``) of every row."""
    return with_score(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model).select(F.col("id").alias(id_col), "score")
