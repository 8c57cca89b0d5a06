import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skein.llm import bpe, queries, wordcount
from tests.llm.data import EDGES, edge_docs, texts

RANKS = P.path(queries.BPE_RANKS)
ODD = ["  a  b ", "\n a", "a \n b  \n\n c", "x   y", "a\n ", "it's  I'll\t\tgo ", "ab" * 3000 + " " * 50 + "é" * 100, "a  b　c   d", "<|endoftext|>x", "👍🏽 ok", "ΑΣ Σ ΣΑΣ", "İ ǅ ẞ", "é ́x", "1234 ½", "a\x1cb\x1f c", "x​y"]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library(library):
    sample = [t or "" for _, t in EDGES] + ODD + [t for _, t in texts()][:60]
    assert bpe.one(sample, bpe.load_ranks(RANKS), P.PATTERN) == [library.encode_ordinary(t) for t in sample]


def test_queue_and_scan_agree():
    ranks, rng = bpe.load_ranks(RANKS), random.Random(1)
    for _ in range(300):
        word = bytes(rng.choice(b"aetionsrh\xc3\xa9 ") for _ in range(rng.randrange(1, 60)))
        assert bpe.merge(word, ranks) == bpe.merge_short(word, ranks)
    for word in (b"ab" * 3000, b"a" * 5001, b" " * 777):
        assert bpe.merge(word, ranks) == bpe.merge_short(word, ranks)


def test_cache_is_bounded_and_changes_nothing(library):
    made = []
    cache = bpe.Cache(lambda key: made.append(key) or len(key), 40_000)
    rng = random.Random(3)
    for _ in range(5000):
        key = "k" * rng.randrange(1, 90) + str(rng.randrange(400))
        assert cache[key] == len(key)
    assert len(cache) + len(cache.old) < 400 and len(made) < 5000
    encoder = bpe.Encoder(bpe.load_ranks(RANKS), P.PATTERN)
    encoder.spaced.half = encoder.spaced.room = encoder.words.half = encoder.words.room = 3000
    for t in ODD + [t for _, t in texts()][:20]:
        assert [*memoryview(encoder.encode(t)).cast("i")] == library.encode_ordinary(t)


def test_rank_queue_order():
    q, rng = bpe.RankQueue(), random.Random(2)
    put = [(rng.choice([0, 1, 1023, 1024, 1 << 20, (1 << 30) - 1, rng.randrange(1 << 30)]), rng.randrange(99)) for _ in range(500)]
    for r, p in put:
        q.push(r, p)
    assert [q.pop() for _ in put] == sorted(put) and q.pop() is None


def test_bpe_query_over_spark(spark, library):
    got = {(r["doc_id"], r["ids_sha256"], r["n_tokens"], r["decoded_sha256"]) for r in bpe.digests(edge_docs(spark), RANKS, P.PATTERN).collect()}
    want = set()
    for i, t in EDGES:
        ids = library.encode_ordinary(t or "")
        want.add((i, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), len(ids), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want
    assert bpe.digests(edge_docs(spark).where("false"), RANKS, P.PATTERN).count() == 0


def test_round_trip_keeps_columns(spark):
    docs = edge_docs(spark)
    back = bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS)
    assert back.columns == [c for c in docs.columns if c != "ids"] + ["ids", "decoded"]
    assert back.where(F.decode("decoded", "UTF-8") != F.coalesce("text", F.lit(""))).count() == 0 and back.count() == len(EDGES)


def test_word_counts_equal_library(spark):
    library = Tokenizer.from_file(P.path(queries.WORD_BPE))
    count = wordcount.Counter(P.path(queries.WORD_BPE)).count
    sample = [t or "" for _, t in EDGES] + ODD + [t for _, t in texts()][:100]
    assert [count(t) for t in sample] == [len(e.ids) for e in library.encode_batch(sample, add_special_tokens=False)]
    rows = wordcount.count_tokens(edge_docs(spark), P.path(queries.WORD_BPE)).collect()
    assert sorted((r[1], r[2]) for r in rows) == sorted((len((t or "").encode()), count(t or "")) for _, t in EDGES)


def test_proved_whole_tokens():
    library = Tokenizer.from_file(P.path(queries.WORD_BPE))
    single = sorted(wordcount.Vocabulary(P.path(queries.WORD_BPE)).single)
    assert len(single) > 30_000
    assert all(len(library.model.tokenize("".join(wordcount.byte_letters()[b] for b in w.encode()))) == 1 for w in single[::50])
