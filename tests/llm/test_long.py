"""One text longer than any piece that is worked on at once, beside short ones."""

import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from skein.llm import bpe, common, decontaminate, nbsvm, ordermin, queries, runindex, simhash, toxicity, wordcount
from tests.llm.data import edge_docs
from tests.llm.test_lines import omh
from tests.llm.test_pairs import contaminated, simple

PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
LABELS = [(1, 1, 1), (2, 0, 0), (3, 1, 1), (4, 0, 0)]


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghiéü") for _ in range(rng.randrange(1, 9))) for _ in range(20_000)]
    long = " ".join(rng.choice(vocabulary) for _ in range(450_000)) + "\n" + PASSAGE
    assert len(long.encode()) > common.PIECE_BYTES
    return [(1, "short"), (2, long), (3, None), (4, "x " + PASSAGE)]


def test_tokens(spark, docs):
    ranks = bpe.load_ranks(P.path(queries.BPE_RANKS))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = Tokenizer.from_file(P.path(queries.WORD_BPE))
    coded = {r["doc_id"]: r for r in bpe.digests(edge_docs(spark, docs), P.path(queries.BPE_RANKS), P.PATTERN).collect()}
    counted = {r["doc_id"]: r["n_tokens"] for r in wordcount.count_tokens(edge_docs(spark, docs), P.path(queries.WORD_BPE)).collect()}
    for i, t in docs:
        ids = library.encode_ordinary(t or "")
        assert coded[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert coded[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
        assert counted[i] == len(words.encode(t or "", add_special_tokens=False).ids)


def test_pairs(spark, docs):
    items = [(1, PASSAGE), (2, "not there at all")]
    got = decontaminate.digest(edge_docs(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == contaminated(docs, items)
    prints = {r["doc_id"]: r["fingerprint"] for r in simhash.digest(edge_docs(spark, docs)).collect()}
    assert prints == {i: f"{simple(t or ''):016x}" for i, t in docs}


def test_fingerprint(spark, docs):
    got = {r["doc_id"]: r["fingerprint"] for r in ordermin.fingerprints(edge_docs(spark, docs)).collect()}
    assert got == {i: omh(t or "") for i, t in docs}


def test_suffixes(spark, docs):
    """A copy of the long text's middle goes from both; the rest of it stays."""
    long = docs[1][1]
    middle = long.encode()[1_000_000:1_050_000].decode(errors="ignore")
    got = {r["doc_id"]: r for r in runindex.dedup(edge_docs(spark, [*docs, (5, f"~{middle}~")])).collect()}
    assert bytes(got[5]["kept"]) == b"~~" and got[5]["n_spans"] == got[2]["n_spans"] == 1
    assert bytes(got[2]["kept"]) == long.replace(middle, "").encode() and got[2]["n_removed"] == len(middle.encode())


@pytest.mark.parametrize("module", [nbsvm, toxicity])
def test_classifiers(spark, docs, module):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = module.scored(edge_docs(spark, docs), labels).collect()
    assert len(got) == 4 and all(0 <= r["score"] <= 1 for r in got)
