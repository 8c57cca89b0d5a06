"""Quality classifier: naive Bayes support vectors.

Indicators of hashed n-grams (byte 4-grams, and words) are scaled by the classes' log-count ratios and normalised; a linear
hinge loss is then minimised by dual coordinate descent, and the margin is mapped to a probability on rows kept out of the fit.

``TRAIN_ROWS`` bounds the labelled rows that the fit takes (those whose ids hash lowest); everything is scored. Whole texts are used.

Defined results: null text is as empty and gets the score of a text without any known n-gram; labels that are null or not
0 or 1 are left out, an id with both counts as 1; without labels of both classes every score is 0.5, or the only class;
repeated rows are scored each, and learnt from once; an empty table gives an empty one; other columns are ignored by
``scored`` and pass unchanged through ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import Powers, flat, map_arrow, pieces, word_spans

TRAIN_ROWS = 8000
BITS = 20
EPOCHS, COST, ALPHA = 12, 0.3, 1.0
_WORD = np.ones(256, dtype=bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_MODEL = "ratios binary, weights binary, bias double, slope double, shift double"


class Grams:
    """The distinct hashed n-grams of each row."""

    def __init__(self) -> None:
        self.seen = np.zeros(1 << BITS, dtype=np.int64)
        self.powers = Powers()

    def rows(self, column: pa.Array) -> Iterator[np.ndarray]:
        data, offsets = flat(column)
        starts, ends, before = word_spans(data, offsets, _WORD)
        words = (self.powers.spans(self.powers.prefix(data), starts, ends) >> np.uint64(64 - BITS)).astype(np.int64)
        wide = data.astype(np.uint32)
        packed = (wide[:-3] | wide[1:-2] << np.uint32(8) | wide[2:-1] << np.uint32(16) | wide[3:] << np.uint32(24)) if len(data) > 3 else wide[:0]
        grams = (packed * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)).astype(np.int64)
        for r in range(len(column)):
            a, b = offsets[r], offsets[r + 1]
            both = np.concatenate([grams[a : max(a, b - 3)], words[before[r] : before[r + 1]]])
            order = np.arange(len(both))
            self.seen[both[::-1]] = order[::-1]
            yield both[self.seen[both] == order]


def train(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float, float]:
    """(log-count ratios, weights, bias, slope, shift): the chance of label 1 is sigmoid(slope * margin + shift)."""
    n, size = len(rows), 1 << BITS
    none = np.zeros(size, dtype=np.float32)
    if not n or labels.min() == labels.max():
        return none, none, 0.0, 0.0, 0.0 if not n else 30.0 * (2 * labels[0] - 1)
    fold = np.arange(n) % 5 == 0
    if n < 50 or labels[~fold].min() == labels[~fold].max() or labels[fold].min() == labels[fold].max():
        ratios, weights, bias = fit(rows, labels)
        slope, shift = 2.0, 0.0
    else:
        kept = np.flatnonzero(~fold)
        ratios, weights, bias = fit([rows[k] for k in kept], labels[kept])
        margins = np.array([margin(rows[k], ratios, weights, bias) for k in np.flatnonzero(fold)])
        slope, shift = calibrate(margins, labels[fold])
    return ratios, weights, bias, slope, shift


def fit(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    size = 1 << BITS
    counts = []
    for label in (1, 0):
        own = [x for x, y in zip(rows, labels) if y == label]
        count = np.zeros(size)
        for x in own:
            count[x] += 1  # distinct within a row
        counts.append((count + ALPHA) / (len(own) + 2 * ALPHA))
    ratios = np.log(counts[0] / counts[1]).astype(np.float32)
    weights, bias, alpha = np.zeros(size, dtype=np.float32), 0.0, np.zeros(len(rows))
    norms = [float(np.sqrt(v @ v)) or 1.0 for v in (ratios[x] for x in rows)]
    share = np.array([1.0 / max(1, (labels == 0).sum()), 1.0 / max(1, (labels == 1).sum())]) * len(rows) / 2
    limit = COST * share[labels] * 10
    sign, rng = 2.0 * labels - 1, np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            x = rows[i]
            v = ratios[x] / norms[i]
            gradient = sign[i] * (weights[x] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / 2.0, 0.0), limit[i])  # |x|^2 + 1 for the bias is 2
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                weights[x] += step * v
                bias += step
                alpha[i] = new
    return ratios, weights, float(bias)


def margin(x: np.ndarray, ratios: np.ndarray, weights: np.ndarray, bias: float) -> float:
    v = ratios[x].astype(float)
    return float(weights[x] @ v) / (np.sqrt(v @ v) or 1.0) + bias


def calibrate(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the margins, by Newton's method with smoothed targets."""
    ones = labels.sum()
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (len(labels) - ones + 2))
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - target) + 1e-3 * theta)
        theta -= step
        if np.abs(step).max() < 1e-6:
            break
    return float(theta[0]), float(theta[1])


def chosen_labels(labels: DataFrame, label: str, learn: Column) -> DataFrame:
    """(id, y): one row an id that may be learnt from; an id with both labels has 1."""
    valid = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull())
    return valid.where(learn).groupBy("id").agg(F.max("y").alias("y"))


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn: Column, bound: int, only: int | None = None) -> DataFrame:
    """(text, y) of at most ``bound`` labelled rows that may be learnt from: those whose ids hash lowest. One row an id and text. only: of this label."""
    chosen = chosen_labels(labels, label, learn)
    if only is not None:
        chosen = chosen.where(F.col("y") == only)
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(bound)
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    # repeated ids give more rows than ids
    return rows.select("id", "text", "y").distinct().orderBy(F.xxhash64("id"), "id", F.xxhash64("text"), "text").limit(bound).select("text", "y")


def model(docs: DataFrame, labels: DataFrame, label: str, learn: Column, bound: int = TRAIN_ROWS) -> tuple:
    """The fit, made in one task over at most ``bound`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, rows, ys = Grams(), [], []
        for batch, column in pieces(batches):
            rows += [x.astype(np.int32) for x in grams.rows(column)]
            ys += batch.column(1).to_pylist()
        ratios, weights, bias, slope, shift = train(rows, np.array(ys, dtype=np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([ratios.tobytes()], pa.binary()), pa.array([weights.tobytes()], pa.binary()), pa.array([bias]), pa.array([slope]), pa.array([float(shift)])], names=["ratios", "weights", "bias", "slope", "shift"])

    got = map_arrow(labelled(docs, labels, label, learn, bound).repartition(1).sortWithinPartitions(F.xxhash64("text"), "text", "y"), run, _MODEL).first()
    if got is None:  # no labelled row at all
        return train([], np.zeros(0, np.int64))
    return np.frombuffer(got[0], np.float32), np.frombuffer(got[1], np.float32), got[2], got[3], got[4]


def score(docs: DataFrame, fitted: tuple, out: str = "score") -> DataFrame:
    """Add the chance of label 1 to ``docs``; a column of that name is replaced."""
    docs = docs.drop(out)
    shared = docs.sparkSession.sparkContext.broadcast(fitted)  # two tables of 2^BITS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios, weights, bias, slope, shift = shared.value
        product, square, grams = ratios * weights, ratios * ratios, Grams()
        for batch, column in pieces(batches):
            margins = np.array([product[x].sum(dtype=float) / (np.sqrt(square[x].sum(dtype=float)) or 1.0) + bias for x in grams.rows(column)])
            scores = 1 / (1 + np.exp(-np.clip(slope * margins + shift, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, out])

    return map_arrow(docs, run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType(), True)]))


def held_out(key: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder; a null id is held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus == remainder, F.lit(True))


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 3, remainder: int = 1) -> DataFrame:
    fitted = model(docs, labels, label, ~held_out("id", modulus, remainder))
    out = score(docs.select("doc_id", F.col("text").cast("string").alias("text")), fitted)
    return out.select("doc_id", held_out("doc_id", modulus, remainder).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
