import contextlib
import io
import random

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F

import corpus_pipeline
from skein.llm import bpe
from tests.conftest import DATA
from tests.llm.data import edge_docs, texts
from tests.llm.test_tokens import ODD, RANKS, library  # noqa: F401


def workers(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue().count("MapInArrow")


def test_ids_are_decoded_in_the_worker_that_coded_them(spark):
    docs = edge_docs(spark)
    both = bpe.round_trip(docs, RANKS, P.PATTERN)
    assert workers(both) == workers(bpe.digests(docs, RANKS, P.PATTERN)) == 1
    apart = bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS).drop("text")
    assert both.columns == apart.columns
    assert sorted(map(repr, both.collect())) == sorted(map(repr, apart.collect()))
    plain = docs.select(*corpus_pipeline.COLUMNS)
    assert workers(corpus_pipeline.encoding(spark, plain, f"{DATA}/sf0.001")) == 1


def test_the_pipeline_notices_wrong_ids(spark, monkeypatch):
    docs = edge_docs(spark).select(*corpus_pipeline.COLUMNS)
    assert corpus_pipeline.encoding(spark, docs, "").count() == docs.count()
    whole = bpe.round_trip
    monkeypatch.setattr(bpe, "round_trip", lambda *a: whole(*a).withColumn("decoded", F.expr("substring(decoded, 2)")))
    try:
        corpus_pipeline.encoding(spark, docs, "").collect()
    except Exception as error:
        assert "don't decode" in str(error)
    else:
        raise AssertionError("not noticed")


def test_merges_of_many_words_equal_single_ones():
    ranks, rng = bpe.load_ranks(RANKS), random.Random(4)
    words = [bytes(rng.choice(b"aetionsrh\xc3\xa9 \x00\xff") for _ in range(rng.randrange(1, bpe.SHORT_BYTES + 1))) for _ in range(3000)]
    words += [b"a" * n for n in range(1, 17)]
    assert [np.frombuffer(x, "<i4").tolist() for x in bpe.Pairs(ranks).merge(words)] == [bpe.merge(w, ranks) for w in words]


def test_texts_together_equal_library(library):  # noqa: F811
    encoder = bpe.Encoder(bpe.load_ranks(RANKS), P.PATTERN)
    encoder.spaced.half = encoder.spaced.room = encoder.words.half = encoder.words.room = 3000
    sample = ODD + [t or "" for _, t in texts()][:80] + ["", " ", "a ", " a", "word word, word. Wört Wört- " + "x" * 90 + " end"]
    for _ in range(2):
        assert [np.frombuffer(x, "<i4").tolist() for x in encoder.encode_all(sample)] == [library.encode_ordinary(t) for t in sample]


def test_ranks_without_each_byte():
    ranks = {bytes([b]): b for b in range(97, 123)} | {b" ": 32, b"ab": 200, b" ab": 201, b"abc": 202}
    assert bpe.one(["abc ab abca"], ranks, P.PATTERN) == [[202, 201, 201, 99, 97]]
