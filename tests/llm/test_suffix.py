import hashlib
import random

import pytest

from skein.llm import runindex
from tests.llm.data import EDGES, edge_docs, texts


def brute(docs, length):
    seen = {}
    raw = [(t or "").encode() for _, t in docs]
    for t in raw:
        for j in range(len(t) - length + 1):
            seen[t[j : j + length]] = seen.get(t[j : j + length], 0) + 1
    out = []
    for (i, _), t in zip(docs, raw):
        gone = bytearray(len(t))
        for j in range(len(t) - length + 1):
            if seen[t[j : j + length]] > 1:
                gone[j : j + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def planted():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(n) for n in (80, 90, 120, 200)]
    docs = [(k, f"{prose(30)} {rng.choice(shared)} {prose(20)} {rng.choice(shared)[:rng.randrange(380, 480)]} {prose(9)}") for k in range(60)]
    docs += [(100, "ab" * 900), (101, "Whha " * 300 + "end"), (102, docs[0][1]), (103, docs[1][1][:700] + "X" + docs[1][1][700:]), (104, "é" * 300 + shared[0]), (104, shared[0] + "é" * 300)]
    return docs


@pytest.mark.parametrize("hot", [runindex.HOT, 2])
def test_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(runindex, "HOT", hot)
    monkeypatch.setattr(runindex, "BLOCK_BYTES", 20_000)
    for docs in (planted(), EDGES, texts()):
        got = runindex.digest(edge_docs(spark, docs)).collect()
        assert sorted(map(tuple, got), key=str) == brute(docs, 400)


def test_empty_table(spark):
    assert runindex.digest(edge_docs(spark).where("false")).count() == 0


def test_index_statistics():
    rng = random.Random(6)
    for _ in range(40):
        base = bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 30)))
        parts = [base[rng.randrange(len(base) + 1) :] + bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 12))) for _ in range(rng.randrange(1, 6))]
        index = runindex.RunIndex(parts)
        suffixes = [(k, j) for k, p in enumerate(parts) for j in range(len(p))]
        got = index.statistics()
        for k, j in suffixes:
            best = 0
            for k2, j2 in suffixes:
                if (k, j) != (k2, j2):
                    n = 0
                    while j + n < len(parts[k]) and j2 + n < len(parts[k2]) and parts[k][j + n] == parts[k2][j2 + n]:
                        n += 1
                    best = max(best, n)
            assert got[index.starts[k] + j] == best
