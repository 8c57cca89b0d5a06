import hashlib
import random
import re

import numpy as np
import xxhash

from pyspark.sql import functions as F

from skein.llm import common, decontaminate, simhash
from tests.llm.data import BENCH, EDGES, edge_docs, read, texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def contaminated(docs, items):
    windows = {}
    for i, t in items:
        w = WORD.findall(low(t))
        if w and i is not None:
            n = min(10, len(w))
            for k in range(len(w) - n + 1):
                windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    sizes = {len(w) for w in windows}
    out = []
    for i, t in docs:
        w, hit, found = WORD.findall(low(t)), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit |= {*range(k, k + n)}
                    found |= own
        ids = ",".join(sorted(map(str, found)))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_decontaminate_edges(spark):
    items = spark.createDataFrame(BENCH + [(None, "a b c")], "item_id long, text string")
    got = decontaminate.digest(edge_docs(spark), items).collect()
    assert sorted(map(tuple, got), key=str) == contaminated(EDGES, BENCH)
    none = decontaminate.digest(edge_docs(spark), items.where("false")).collect()
    assert sorted(map(tuple, none), key=str) == contaminated(EDGES, [])
    assert decontaminate.digest(edge_docs(spark).where("false"), items).count() == 0


def test_decontaminate_data(spark):
    docs, items = texts(), read("sf0.001", "benchmark")
    got = decontaminate.digest(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = contaminated(docs, items)
    assert sorted(map(tuple, got.collect()), key=str) == want and any(r[5] for r in want)


def test_decontaminate_repeats(spark):
    """An item that stands twice under its id, one that repeats a window, and one of equal words."""
    verse = "red orange yellow green blue indigo violet black white grey"
    items = [(1, verse + " end"), (1, verse + " end"), (2, f"{verse} and {verse} again"), (3, "na " * 14), (4, "tick tock"), (4, "tick tock"), (4, "ping pong tick tock")]
    docs = [(1, f"x {verse} y"), (2, f"{verse} end"), (3, "so na na na na na na na na na na na"), (4, "na " * 9), (5, "a tick tock"), (6, f"{verse} and red"), (7, "ping pong tick tock")]
    got = decontaminate.digest(edge_docs(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == contaminated(docs, items)
    assert [r["doc_id"] for r in sorted(got) if r["contaminated"]] == [1, 2, 3, 5, 6, 7]


def simple(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    if not w:
        return 0
    shingles = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(fps, ids):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(fps))]


def test_simhash_edges_and_data(spark):
    for docs in (EDGES, texts()):
        got = simhash.digest(edge_docs(spark, docs)).collect()
        fps = [simple(t) for _, t in docs]
        want = [(i, f"{f:016x}", c) for (i, _), f, c in zip(docs, fps, near(fps, [i for i, _ in docs]))]
        assert sorted((r[:3] for r in map(tuple, got)), key=str) == sorted(want, key=str)
    assert simhash.digest(edge_docs(spark).where("false")).count() == 0
    assert simhash.digest(edge_docs(spark, EDGES[3:4])).count() == 1


def five_word_groups(docs):
    """Of each row, the least id of its group: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""

    def shingles(text):
        w = low(text).encode().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            either = len(sets[i] | sets[j])
            if either == 0 or len(sets[i] & sets[j]) >= 0.8 * either:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(d, least.get(find(i), d))
    return [least[find(i)] for i in range(len(docs))]


def test_near_texts(spark):
    """Links are exact; of pairs at 0.8 or more, those far apart in bits may be missed, so the planted edits are small."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    docs = []
    for k in range(12):
        base = [word() for _ in range(300)]
        docs.append((len(docs), " ".join(base)))
        for n in (1, 1, 2):
            edited = list(base)
            for at in rng.sample(range(300), n):
                edited[at] = word()
            docs.append((len(docs), " ".join(edited)))
        docs.append((len(docs), " ".join(base)))
        docs.append((len(docs), " ".join(base[:150] + [word() for _ in range(150)])))
    docs += [(900, ""), (901, "  "), (902, "one"), (903, "ONE "), (904, "one two"), (905, None)]
    got = {r["doc_id"]: r["component"] for r in simhash.near_texts(edge_docs(spark, docs)).collect()}
    assert got == {i: c for (i, _), c in zip(docs, five_word_groups(docs))}
    assert simhash.near_texts(edge_docs(spark).where("false")).count() == 0
    assert simhash.near_texts(edge_docs(spark, EDGES[3:4])).count() == 1


def test_links_are_complete(spark):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for x in list(fps):
        for _ in range(3):
            y = x
            for b in rng.sample(range(64), rng.randrange(1, 7)):
                y ^= 1 << b
            fps.add(y)
    signed = sorted(simhash._signed(x) for x in fps)
    classes = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = {(a, b) for k, a in enumerate(signed) for b in signed[k + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    sample = np.array(signed, dtype=np.int64).view(np.uint64)
    for n in (600, 10**5, 10**8):
        groups = simhash.plan(sample, n)
        assert sum(t + 1 for _, t in groups) == 5
        if n != 10**8:
            assert {tuple(r) for r in simhash.links(classes, groups).collect()} == want


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(-5, -9)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 160), 100), -5: -9, -9: -9}


def test_hot_join_equals_join(spark):
    left = spark.createDataFrame([("a" if k % 3 else str(k), k) for k in range(9000)] + [(None, -1)], "k string, v long")
    right = left.groupBy("k").agg(F.count("*").alias("n")).where("k != '3' and k is not null").withColumn("w", F.concat(F.lit("w"), "k"))
    for how in ("inner", "left"):
        want = left.join(right.drop("n"), ["k"], how).collect()
        got = common.hot_join(left, right, ["k"], 9001, how).collect()
        assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)
        assert right.where("n > 1000").count() == 1  # so one key took the other way
