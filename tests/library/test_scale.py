"""Steps whose plans or rounds grew faster than their tables."""

import math
import random

from pyspark.sql import functions as F

from skein.operators import chunks as ch
from skein.operators import graph as gr
from skein.operators import reports as rp
from skein.operators import resolve as rs
from skein.operators import search as se
from skein.plans import graphs
from skein.plans.registry import Tables
from tests.conftest import DATA


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_and_scores_are_not_shuffled(spark):
    texts = spark.range(0, 6000, 1, 3).selectExpr("concat('d', id) as chunk_id", "concat('w', id % 7, ' same w', id % 5, ' same') as chunk_text")
    queries = spark.createDataFrame([(1, "w1 w2"), (2, "same w6"), (2, "same"), (3, "none")], "query_id int, query string")
    every = se.bm25(texts, queries)
    best = se.bm25(texts, queries, k=5)
    assert "Exchange" not in plan(every) + plan(best)
    assert every.count() > 6000 and best.count() <= 5 * 3 * 3
    want, got = (sorted(map(tuple, se.top_k(x, 5, key="chunk_id").collect())) for x in (every, best))
    assert got == want and len(got) == 10


def test_lines_are_placed_without_a_shuffle(spark):
    docs = spark.createDataFrame([(1, "  a\n\n bé \n" + "x\n" * 300), (2, None), (3, "")], "doc_id int, text string")
    found = ch.line_chunks(docs)
    assert "Exchange" not in plan(found)
    rows = found.orderBy("doc_id", "position").collect()
    text = docs.where("doc_id = 1").first()["text"]
    assert len(rows) == 302 and [r["position"] for r in rows] == [*range(302)] and all(text[r["char_start"] : r["char_end"]] == r["chunk_text"] for r in rows)
    assert found.where(F.col("chunk_id") == "1:1").first()["chunk_text"] == "bé"


def least_hops(edges, starts):
    hops, ring, n = dict.fromkeys(starts, 0), set(starts), 0
    while ring:
        n += 1
        ring = {a for a, b in edges if b in ring and a not in hops}
        hops |= dict.fromkeys(ring, n)
    return hops


def test_dependents_take_rounds_as_the_logarithm_of_a_chain(spark, monkeypatch):
    written = []
    monkeypatch.setattr(gr, "cut", lambda df, keep=gr.cut: written.append(1) or keep(df))
    rng = random.Random(3)
    edges = [(k + 1, k) for k in range(400)] + [(900, 901), (901, 900), (902, 901), (5, 5), (300, 2), (7, 390), (950, 951)]
    edges += [(rng.randrange(500, 560), rng.randrange(480, 560)) for _ in range(60)] + [(480, 400), (481, 20)]
    got = gr.reverse_dependents(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(0,), (120,)], "id long"))
    assert {r["id"]: r["hop"] for r in got.collect()} == least_hops(edges, [0, 120]) and got.count() == len(least_hops(edges, [0, 120]))
    assert len(written) < 60


def test_assignment_takes_many_cases_at_a_time(spark):
    rng = random.Random(5)
    pairs = list({(c, rng.randrange(4), rng.randrange(4)): (c, g, f, float(rng.randrange(1, 4))) for c in range(400) for g, f in [(rng.randrange(4), rng.randrange(4))] * 3 + [(rng.randrange(4), rng.randrange(4)) for _ in range(c % 4)]}.values())
    pairs = sorted({p[:3]: p for p in pairs}.values())
    want = []
    for case in sorted({p[0] for p in pairs}):
        own = [p for p in pairs if p[0] == case]
        gold, found = sorted({p[1] for p in own}), sorted({p[2] for p in own})
        big, swap = sum(p[3] for p in own) + 1, len(gold) > len(found)
        cost = [[0.0] * len(found) for _ in gold]
        for _, g, f, o in own:
            cost[gold.index(g)][found.index(f)] = -(big + o)
        cost = [list(x) for x in zip(*cost)] if swap else cost
        for i, j in enumerate(rp.hungarian(cost)):
            g, f = (j, i) if swap else (i, j)
            want += [(case, gold[g], found[f], -cost[i][j] - big)] if cost[i][j] < 0 else []
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        out = rp.assign(spark.createDataFrame(pairs, "case int, gold int, found int, overlap double"), "case")
        assert "FlatMapGroups" not in plan(out)
        assert sorted(map(tuple, out.collect())) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_paths_of_seeds_with_the_same_neighbours_are_searched_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(gr, "cut", lambda df, keep=gr.cut: written.append(out := keep(df)) or out)
    rng = random.Random(2)
    edges = [(f"s{k}", f"n{k % 3}") for k in range(200)] + [(f"c{k}", f"n{k % 3}") for k in range(150)] + [(f"x{rng.randrange(9)}", f"x{rng.randrange(9)}") for _ in range(9)] + [("x0", "n0"), ("s1", "s4")]
    ids = sorted({x for e in edges for x in e})
    seeds, targets = [i for i in ids if i[0] in "sx"] + ["alone"], [i for i in ids if i[0] in "csx"]
    named = lambda xs: spark.createDataFrame([(x,) for x in xs], "id string")
    for direction in ("both", "out"):
        del written[:]
        back = edges if direction == "out" else edges + [(b, a) for a, b in edges]
        want = {(s, t, d) for s in seeds for t, d in least_hops([(b, a) for a, b in back], [s]).items() if 0 < d <= 3 and t in targets}
        table = spark.createDataFrame([(a, b, "E") for a, b in edges], "src string, dst string, type string")
        got = list(map(tuple, gr.shortest_paths(table, named(seeds), named(targets), 3, direction).collect()))
        assert len(got) == len(set(got)) and set(got) == want
        assert sum(df.count() for df in written[2:]) < len(want) / 4 or direction == "out"


def brute_pairs(rows):
    """(block, a, b, cosine) by plain loops; null where a vector has a null or another length."""
    out = []
    for block, a, v in rows:
        for other, b, w in rows:
            if block is None or other != block or a is None or b is None or not a < b:
                continue
            bad = v is None or w is None or None in v or None in w
            size = None if bad else math.sqrt(sum(x * x for x in v)) * math.sqrt(sum(x * x for x in w))
            cosine = None if bad or size and len(v) != len(w) else 0.0 if size == 0 else round(sum(x * y for x, y in zip(v, w)) / size, 6)
            out.append((block, a, b, cosine))
    return out


def test_pairs_of_vectors_meet_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(rs, "TILE", 8)
    monkeypatch.setattr(rs, "CELLS", 50)
    rng = random.Random(4)
    rows = [(k % 3 or None if k % 5 == 0 else k % 2, f"k{k:02}", [rng.choice([-1.0, 0.5, 2.0, 3.0]) for _ in range(4)]) for k in range(90)]
    rows += [(1, "null", None), (1, "short", [1.0]), (1, "hole", [1.0, None, 2.0, 3.0]), (0, "zero", [0.0] * 4), (1, "k01", [1.0, 0.0, 0.0, 0.0]), (7, "alone", [1.0]), (1, None, [1.0])]
    table = spark.createDataFrame(rows, "label int, id string, v array<float>")
    want = brute_pairs(rows)
    found = rs.vector_zones(table, "id", "v", "label")
    assert "Join" not in plan(found).split("MapInArrow")[0]
    assert sorted(map(repr, (tuple(r)[:4] for r in found.collect()))) == sorted(map(repr, want))
    near = rs.vector_pairs(table, "id", "v", "label", least=0.6).where("cosine >= 0.6").collect()
    assert sorted(map(tuple, near)) == sorted(r for r in want if r[3] is not None and r[3] >= 0.6)
    for k in (5, 5000):
        best = rs.best_pairs(table, "id", "v", "label", k).collect()
        order = [sorted((r for r in want if r[0] == b), key=lambda r: (r[3] is None, -(r[3] or 0), r[1], r[2]))[:k] for b in sorted({r[0] for r in want})]
        assert [tuple(r) for r in sorted(best, key=lambda r: (r["block"], r["rank"]))] == [(*r, n) for own in order for n, r in enumerate(own, 1)]


def test_average_linkage_holds_scored_pairs_only():
    size = 30_000  # a square of distances would take 7 GB
    pairs = [(k, k + 1, 0.1 + k % 4 / 10) for k in range(size - 1)]
    got = rs.average_linkage(size, pairs, 0.5)
    assert got[:4] == [0, 0, 2, 2] and len(set(got)) == size // 2


def test_only_internal_pairs_are_made_of_co_ordered_parts(spark):
    t = Tables(spark, f"{DATA}/sf0.001")
    edges, members = graphs._co_ordered(t)
    brand = {r["id"]: r["community"] for r in members.collect()}
    found = edges.collect()
    assert found and all(brand[r["src"]] == brand[r["dst"]] for r in found)
    assert "SortMergeJoin" in plan(edges)  # with the members, of which a copy in each task would grow


def test_modularity_counts_ends_without_a_community(spark):
    edges = spark.createDataFrame([(1, 2, 3), (2, 3, 1), (3, 4, 2), (4, 9, 4)], "src int, dst int, weight int")
    members = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b")], "id int, community string")
    assert gr.modularity(edges, members).first()[0] == round(3 / 10 - (7 / 20) ** 2 + 2 / 10 - (9 / 20) ** 2, 6)
