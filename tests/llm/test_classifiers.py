import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import nbsvm, queries, toxicity
from tests.conftest import DATA
from tests.llm.data import edge_docs, read


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    values, inverse, counts = np.unique(np.asarray(scores)[order], return_inverse=True, return_counts=True)
    ranks = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    y = np.asarray(labels)[order]
    ones = y.sum()
    return (ranks[y == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(y) - ones))


@pytest.mark.parametrize("name,label,modulus,remainder,least", [("op3_quality", "quality", 3, 1, 0.9), ("op1_toxicity", "toxic", 5, 0, 0.8)])
def test_held_out(spark, name, label, modulus, remainder, least):
    got = {r["doc_id"]: r for r in queries.queries()[name](spark, f"{DATA}/sf0.1").select("doc_id", "held_out", "score", "predicted").collect()}
    assert len(got) == 10_000
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % modulus == remainder) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in got.items())
    rows = [(got[i]["score"], q if label == "quality" else t, got[i]["predicted"]) for i, q, t in read("sf0.1", "labels") if got[i]["held_out"]]
    scores, ys, predicted = map(np.array, zip(*rows))
    assert auc(scores, ys) > least
    assert (predicted == ys).mean() > 0.94


@pytest.mark.parametrize("module", [nbsvm, toxicity])
def test_edges(spark, module):
    labels = spark.createDataFrame([(3, 1, 1), (4, 0, 0), (4, 0, 0), (5, None, None), (99, 1, 1), (7, 7, 7), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.where("false"), labels.where("quality = 1")):
        got = module.scored(edge_docs(spark), some).collect()
        assert len(got) == edge_docs(spark).count() and all(0 <= r["score"] <= 1 for r in got)
    assert module.scored(edge_docs(spark).where("false"), labels).count() == 0


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(1)
    rows = [np.unique(np.concatenate([rng.integers(100, 2000, 30), [1 if y else 2]])) for y in (k % 2 for k in range(200))]
    ratios, weights, bias, slope, shift = nbsvm.train(rows, np.arange(200) % 2)
    margins = np.array([nbsvm.margin(x, ratios, weights, bias) for x in rows])
    assert ((margins > 0) == (np.arange(200) % 2 == 1)).mean() > 0.97 and slope > 0


def test_dictionaries_and_gains():
    """Windows that hold what only toxic text repeats are shortened most, in texts that the training hasn't seen."""
    rng = np.random.default_rng(2)
    usual, bad = [bytes(rng.integers(97, 123, rng.integers(3, 9)).tolist()) for _ in range(400)], [b"grumbleworth", b"snarkfoil", b"vexatious"]

    def text(toxic):
        words = rng.choice(usual, 60).tolist()
        for _ in range(3 if toxic else 0):
            words.insert(int(rng.integers(60)), bad[rng.integers(3)])
        return b" ".join(words)

    texts = [text(k % 4 == 0) for k in range(1200)]
    seen = texts[:800]
    ordinary, toxic = toxicity.dictionaries([t for k, t in enumerate(seen) if k % 4], [t for k, t in enumerate(seen) if not k % 4])
    assert len(ordinary) <= toxicity.ORDINARY_BYTES and len(toxic) <= toxicity.TOXIC_BYTES
    gains, first = toxicity.Gains(ordinary, toxic)(texts[800:])
    best = np.maximum.reduceat(gains, first[:-1])
    assert auc(best, np.arange(400) % 4 == 0) > 0.97
    assert b"".join(toxicity.windows(texts[0])) == texts[0] and toxicity.windows(b"") == toxicity.windows(b"  \n ") == []


def test_repeated_rows_are_learnt_from_once(spark):
    docs = spark.createDataFrame([(1, "a")] * 500 + [(2, "b"), (2, "c"), (3, None), (4, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0), (4, 1), (5, 1), (None, 1)], "doc_id long, toxic int")
    every = nbsvm.labelled(docs, labels, "toxic", F.lit(True), 100)
    assert sorted(map(tuple, every.collect())) == [("", 1), ("a", 1), ("b", 0), ("c", 0), ("d", 1)]
    assert nbsvm.labelled(docs, labels, "toxic", F.lit(True), 1).count() == 1
    assert sorted(r["text"] for r in nbsvm.labelled(docs, labels, "toxic", F.lit(True), 9, 0).collect()) == ["b", "c"]
