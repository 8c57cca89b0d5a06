"""Toxicity by compression distance: windows of a text are compressed with two zstandard dictionaries.

One dictionary is trained on windows of ordinary text, the other on windows of toxic text (``zstandard.train_dictionary`` on
the lower-cased bytes of each class). Most of a toxic text is ordinary, so the toxic dictionary is trained twice: a first
one on all windows of one half of the toxic texts tells which windows of the other half it shortens more than nearly all
ordinary windows, and the final one is trained on those. Each window is then compressed with the ordinary dictionary alone
and with the toxic one behind it; so what the two have in common costs the same, and the gain is what toxic text repeats.
Windows whose gain reaches a threshold count as toxic; threshold and a logistic curve over the counts are calibrated on
labelled rows that neither dictionary saw.

``TRAIN_TOXIC`` and ``TRAIN_ORDINARY`` bound the labelled rows of the fit (those whose ids hash lowest), ``TRAIN_WINDOWS`` the
windows that one of them gives (spread over its whole text); everything is scored, over whole texts.

Defined results: null text is as empty; a text without words has no window and gets the score of one without a toxic window;
labels that are null or not 0 or 1 are left out; an id with both labels counts as toxic; without rows of both classes every
score is 0, or 1 if all are toxic; repeated rows are scored each, and learnt from once; an empty table gives an empty one;
other columns are ignored by ``scored`` and pass unchanged through ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import LOWER, flat, map_arrow, pieces
from skein.llm.nbsvm import chosen_labels, held_out, labelled

TRAIN_TOXIC, TRAIN_ORDINARY, TRAIN_WINDOWS = 4000, 8000, 2000
#: Bytes of a window that is scored and of one that the toxic dictionary is trained on; windows at most that a dictionary is trained on.
WINDOW, PART, SAMPLES = 48, 32, 60_000
#: Sizes of the dictionaries; the toxic one is smaller where there is less to train on: one byte for so many of windows, ``LEAST_BYTES`` at least.
ORDINARY_BYTES, TOXIC_BYTES, BYTES_A_BYTE, LEAST_BYTES = 65_536, 4096, 16, 512
#: Sizes of the segments that training weighs, and of the strings that it counts.
SEGMENT, STRING = 16, 8
#: A window of the other half is kept for the next dictionary if its gain is above that of so many ordinary windows in a hundred; so often.
KEPT_ABOVE, ROUNDS = 98, 2
_PARAMETERS = zstd.ZstdCompressionParameters(strategy=zstd.STRATEGY_BTOPT, window_log=18, hash_log=17, chain_log=18, search_log=5, min_match=5, target_length=64, write_content_size=False, write_checksum=False, write_dict_id=False)
#: Bytes of the ordinary dictionary before each window: both lengths then hold one match more, and no window is stored uncompressed.
LEAD_BYTES = 64
#: The last bytes of a dictionary aren't searched, though training puts there what repeats most; so many others stand behind.
TAIL_BYTES = 16
_MODEL = "ordinary binary, toxic binary, threshold int, theta array<double>"
_NO_DICTIONARY = b"\0" * 8


def windows(text: bytes, size: int = WINDOW) -> list[bytes]:
    """The text cut into windows of about ``size`` bytes, at white space where there is some in their second half."""
    out, at, n = [], 0, len(text)
    find = text.rfind
    while at < n:
        end = at + size
        if end < n:
            cut = max(find(b" ", at + size // 2, end), find(b"\n", at + size // 2, end))
            if cut > 0:
                end = cut
        window = text[at:end]
        if not window.isspace():
            out.append(window)
        at = end
    return out


def trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary trained on (at most ``SAMPLES`` of) the samples; the samples themselves where they are too few to train on."""
    step = -(-len(samples) // SAMPLES) if samples else 1
    samples = samples[::step]
    if size <= TOXIC_BYTES:
        size = min(size, max(LEAST_BYTES, sum(map(len, samples)) // BYTES_A_BYTE))
    if len(samples) >= 100:
        try:
            return zstd.train_dictionary(size, samples, k=SEGMENT, d=STRING).as_bytes()
        except zstd.ZstdError:
            pass  # nothing repeats
    return b" ".join(samples)[-size:] + _NO_DICTIONARY


class Lengths:
    """Compressed length of windows under the ordinary dictionary, or with the toxic one behind it."""

    def __init__(self, ordinary: bytes, toxic: bytes = b"") -> None:
        self.lead = ordinary[-LEAD_BYTES:]
        content = ordinary + toxic + self.lead[:TAIL_BYTES]
        dictionary = zstd.ZstdCompressionDict(content)
        dictionary.precompute_compress(compression_params=_PARAMETERS)
        self.compress = zstd.ZstdCompressor(compression_params=_PARAMETERS, dict_data=dictionary).compress

    def __call__(self, some: list[bytes]) -> np.ndarray:
        lead, compress = self.lead, self.compress
        return np.fromiter((len(compress(lead + w)) for w in some), np.int64, len(some))


class Gains:
    """By how many bytes the toxic dictionary shortens each window of each text."""

    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        self.alone, self.both = Lengths(ordinary), Lengths(ordinary, toxic)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(gain of each window, where each text's windows begin)."""
        each = [windows(t) for t in texts]
        some = [w for ws in each for w in ws]
        return self.alone(some) - self.both(some), np.cumsum([0, *map(len, each)])


def dictionaries(ordinary: list[bytes], toxic: list[bytes]) -> tuple[bytes, bytes]:
    """The dictionary of ordinary texts and that of toxic ones."""
    base = trained(_some(ordinary, WINDOW), ORDINARY_BYTES)
    beside = _some(ordinary, PART)
    beside = beside[:: -(-len(beside) // SAMPLES)] if beside else beside
    alone = Lengths(base)
    halves = [_some(toxic[h::2], PART) for h in (0, 1)]
    own, lengths, usual = list(halves), [alone(x) for x in halves], alone(beside)
    for _ in range(ROUNDS):
        kept = []
        for h in (0, 1):  # the dictionary of one half looks at the other, whose texts it hasn't seen
            both = Lengths(base, trained(own[1 - h], TOXIC_BYTES))
            least = np.percentile(usual - both(beside), KEPT_ABOVE) if len(beside) else 0
            kept.append([w for w, gain in zip(halves[h], lengths[h] - both(halves[h])) if gain > least])
        own = [k or x for k, x in zip(kept, own)]
    return base, trained(own[0] + own[1], TOXIC_BYTES)


def _some(texts: list[bytes], size: int) -> list[bytes]:
    """Windows of all texts, at most ``TRAIN_WINDOWS`` spread over each. A line that copies share is taken once: what repeats only there says nothing."""
    out, seen = [], set()
    for text in texts:
        own = []
        for line in text.split(b"\n"):
            if line not in seen:
                seen.add(line)
                own += windows(line, size)
        out += own[:: -(-len(own) // TRAIN_WINDOWS)] if own else []
    return out


def features(gains: np.ndarray, first: np.ndarray, threshold: int) -> np.ndarray:
    """Per row: 1, log of 1 + toxic windows, the same for windows well above the threshold, log share of toxic windows, the largest gain (at most 40)."""
    n = np.diff(first)

    def above(least: int) -> np.ndarray:
        over = np.concatenate([[0], np.cumsum(gains >= least)])
        return over[first[1:]] - over[first[:-1]]

    hits, most, full = above(threshold), np.zeros(len(n)), n > 0
    if full.any():
        most[full] = np.maximum.reduceat(gains, first[:-1][full])
    return np.stack([np.ones(len(n)), np.log1p(hits), np.log1p(above(threshold + 2)), np.log1p(99 * hits / np.maximum(n, 1)), np.clip(most, 0, 40) / 10], axis=1)


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights with a small ridge, and the loss a row."""
    theta, ridge = np.zeros(x.shape[1]), 0.5 * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ theta)
        theta -= step
        if np.abs(step).max() < 1e-6:
            break
    p = np.clip(1 / (1 + np.exp(-x @ theta)), 1e-9, 1 - 1e-9)
    return theta, float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def fit(texts: list[bytes], toxic: np.ndarray) -> tuple[bytes, bytes, int, list[float]]:
    """Dictionaries from three quarters of the rows, threshold and curve from the rest."""
    if not len(texts) or toxic.min() == toxic.max():
        return _NO_DICTIONARY, _NO_DICTIONARY, 1, [30.0 if len(texts) and toxic[0] else -30.0, 0.0, 0.0, 0.0, 0.0]
    kept = np.arange(len(texts)) % 4 == 0
    if toxic[kept].min() == toxic[kept].max() or toxic[~kept].min() == toxic[~kept].max():
        kept[:] = True
    seen = ~kept if not kept.all() else kept
    base, added = dictionaries([t for t, y, k in zip(texts, toxic, seen) if k and not y], [t for t, y, k in zip(texts, toxic, seen) if k and y])
    gains, first = Gains(base, added)([t for t, k in zip(texts, kept) if k])
    best = min(((*logistic(features(gains, first, t), toxic[kept]), t) for t in range(2, 9)), key=lambda x: x[1])
    return base, added, best[2], best[0].tolist()


def _lower(column: pa.Array) -> list[bytes]:
    data, offsets = flat(column)
    raw, ends = LOWER[data].tobytes(), offsets.tolist()
    return [raw[a:b] for a, b in zip(ends, ends[1:])]


def model(docs: DataFrame, labels: DataFrame, learn: Column) -> tuple[bytes, bytes, int, list[float]]:
    """The fit, made in one task over a bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, ys = [], []
        for batch, column in pieces(batches):
            texts += _lower(column)
            ys += batch.column(1).to_pylist()
        base, added, threshold, theta = fit(texts, np.array(ys, dtype=np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([base], pa.binary()), pa.array([added], pa.binary()), pa.array([threshold], pa.int32()), pa.array([theta], pa.list_(pa.float64()))], names=["ordinary", "toxic", "threshold", "theta"])

    rows = labelled(docs, labels, "toxic", learn, TRAIN_TOXIC, 1).union(labelled(docs, labels, "toxic", learn, TRAIN_ORDINARY, 0))
    got = map_arrow(rows.repartition(1).sortWithinPartitions(F.xxhash64("text"), "text", "y"), run, _MODEL).first()
    if got is None:  # no labelled row at all
        return fit([], np.zeros(0, np.int64))
    return bytes(got[0]), bytes(got[1]), got[2], list(got[3])


def score(docs: DataFrame, fitted: tuple, balance: float, out: str = "score") -> DataFrame:
    """Add the chance of toxicity to ``docs``; a column of that name is replaced. balance: log of how much rarer toxic rows are in the corpus than in the sample."""
    docs = docs.drop(out)
    shared = docs.sparkSession.sparkContext.broadcast(fitted)  # two dictionaries of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, added, threshold, theta = shared.value
        gains, theta = Gains(base, added), np.array(theta)
        for batch, column in pieces(batches):
            x = features(*gains(_lower(column)), threshold)
            scores = 1 / (1 + np.exp(-np.clip(x @ theta + balance, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, out])

    return map_arrow(docs, run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType(), True)]))


def prior_shift(labels: DataFrame, learn: Column) -> float:
    """Log odds of toxicity among all labelled ids that may be learnt from, less those of the sample."""
    n = {r["y"]: r["n"] for r in chosen_labels(labels, "toxic", learn).groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return 0.0
    return float(np.log(n[1] / n[0]) - np.log(min(n[1], TRAIN_TOXIC) / min(n[0], TRAIN_ORDINARY)))


def scored(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0) -> DataFrame:
    learn = ~held_out("id", modulus, remainder)
    fitted = model(docs, labels, learn)
    out = score(docs.select("doc_id", F.col("text").cast("string").alias("text")), fitted, prior_shift(labels, learn))
    return out.select("doc_id", held_out("doc_id", modulus, remainder).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
