import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.functions import text as tx
from skein.operators import chunks as ch
from skein.operators import evaluate as ev
from skein.operators import graph as gr
from skein.operators import history as hs
from skein.operators import lookups as lk
from skein.operators import merge as mg
from skein.operators import resolve as rs
from skein.operators import search as se


def test_uuid5(spark):
    names = ["a", "KNOWS:1:2", "é", ""]
    got = {r["n"]: r["u"] for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", tx.uuid5(F.col("n")).alias("u")).collect()}
    assert got == {n: str(uuid.uuid5(uuid.NAMESPACE_OID, n)) for n in names}


def test_names(spark):
    rows = [("The  Acme-Corp.", "acme corp"), ("a b", "b"), ("Zoë & Söhne", "zoe sohne"), ("x" * 201, None), (None, None), ("Straße 1", "strasse 1"), ("S.A.P. ﬁn", "sap fin"), ("the", "the")]
    got = [r["n"] for r in spark.createDataFrame(rows, "t string, w string").select(tx.normal_name(F.col("t")).alias("n")).collect()]
    assert got[:3] + got[5:] == [w for _, w in rows[:3] + rows[5:]] and len(got[3]) == 217 and got[4] is None


def test_properties(spark):
    cases = {"integer": [("12", 12), ("-3", -3), ("1.5", None), ("x", None)], "float": [("1e3", 1000.0), (".5", 0.5), ("nan", None), ("1e999", None)], "boolean": [("Yes", True), ("0", False), ("maybe", None)]}
    for kind, rows in cases.items():
        got = spark.createDataFrame([(a,) for a, _ in rows], "t string").select(tx.parse_property(F.col("t"), kind).alias("v")).collect()
        assert [r["v"] for r in got] == [w for _, w in rows]
    dates = spark.createDataFrame([("2024-02-29",), ("2023-02-29",), ("24-1-1",)], "t string").select(tx.parse_property(F.col("t"), "date").alias("v")).collect()
    assert [str(r["v"]) for r in dates] == ["2024-02-29", "None", "None"]
    with pytest.raises(ValueError):
        tx.parse_property(F.lit("x"), "money")


def test_evidence_ids(spark):
    rows = [("ev1:s:d:0123456789abcdef:5-9", "span"), ("ev1:s:d:0123456789abcdef:9-5", None), ("ev1:s:d:0123456789abcdef:05-9", None), ("ev1:c:d:0123456789abcdef:k:1", "chunk"), ("ev1:s:d:0123:5-9", None), ("", None)]
    got = spark.createDataFrame(rows, "i string, w string").select(tx.decode_evidence_id(F.col("i")).alias("d"), "w").collect()
    assert all(r["d"]["kind"] == r["w"] for r in got)


def edge_rows(spark, pairs):
    return spark.createDataFrame([(a, b, "E") for a, b in pairs], "src string, dst string, type string")


def test_bfs_directions_and_bounds(spark):
    edges = edge_rows(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("c", "e"), ("e", "f")])
    seeds = spark.createDataFrame([("a",)], "id string")
    of = lambda **k: {r["id"]: r["depth"] for r in gr.bfs(edges, seeds, **k).collect()}
    assert of(depth=2, direction="out") == {"b": 1, "c": 2}
    assert of(depth=1, direction="in") == {"c": 1, "d": 1}
    assert of(depth=0) == {"b": 1, "c": 1, "d": 1}
    assert of(depth=99, direction="out") == {"b": 1, "c": 2, "e": 3, "f": 4}
    assert of(depth=2, types=["X"]) == {}
    with pytest.raises(ValueError):
        gr.steps(edges, "sideways")


def test_shortest_paths(spark):
    edges = edge_rows(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")])
    one = lambda x: spark.createDataFrame([(x,)], "id string")
    assert [tuple(r) for r in gr.shortest_paths(edges, one("a"), one("d"), 5, "out").collect()] == [("a", "d", 2)]
    assert gr.shortest_paths(edges, one("a"), one("d"), 1, "out").count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(50, 40), (60, 50), (7, 7)], "src long, dst long")
    got = {r["id"]: r["component"] for r in gr.components(edges).collect()}
    assert got == {**dict.fromkeys(range(21), 0), 40: 40, 50: 40, 60: 40}
    assert gr.components(edges.where("false")).count() == 0


def test_reverse_dependents_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(103)] + [(0, 103), (200, 50)], "src long, dst long").coalesce(1)
    got = gr.reverse_dependents(edges, spark.createDataFrame([(0,)], "id long")).collect()
    assert sorted(map(tuple, got)) == [*((k, k) for k in range(104)), (200, 51)]


def test_label_propagation_finds_cliques(spark):
    clique = lambda k: [(f"{k}{i}", f"{k}{j}", 1) for i in range(6) for j in range(i)]
    edges = spark.createDataFrame(clique("a") + clique("b") + [("a0", "b0", 1)], "src string, dst string, weight int")
    found = gr.label_propagation(edges, 10)
    assert gr.modularity(edges, found).first()[0] > 0.4
    assert {len({r["community"] for r in found.where(f"id like '{k}%'").collect()}) for k in "ab"} == {1}


def test_edge_upsert(spark):
    kind = "id string, type string, src string, dst string, source_chunk_ids array<string>, confidence double, extractors array<string>"
    base = spark.createDataFrame([("1", "T", "a", "b", ["x", "y"], 0.5, ["m"]), ("2", "T", "a", "c", ["z"], None, None)], kind)
    staged = spark.createDataFrame([("1", "T", "a", "b", ["y", "w"], None, ["n"]), ("3", "T", "q", "r", [], 0.1, [])], kind)
    got = {r["id"]: (r["source_chunk_ids"], r["confidence"], r["extractors"]) for r in mg.upsert_edges(base, staged).collect()}
    assert got == {"1": (["x", "y", "w"], 0.5, ["m", "n"]), "2": (["z"], None, None), "3": (None, 0.1, None)}


def test_constrained_matches(spark):
    rows = [("k", "a", "b", 0.9, False), ("k", "b", "c", 0.8, False), ("k", "c", "d", 0.7, False), ("k", "a", "c", 1.0, True)]
    got = rs.constrained_matches(spark.createDataFrame(rows, "component string, a string, b string, confidence double, cannot boolean")).collect()
    assert sorted((r["a"], r["b"]) for r in got) == [("a", "b"), ("c", "d")]


def test_average_linkage():
    assert rs.average_linkage(4, [(0, 1, 0.01), (1, 2, 0.04), (0, 2, 0.2)], 0.05) == [0, 0, 2, 3]
    assert rs.average_linkage(3, [(0, 1, 0.01), (1, 2, 0.04), (0, 2, 0.05)], 0.05) == [0, 0, 0]


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.text("abc ", max_size=30), st.text("abc ", max_size=30))
def test_indel(a, b):
    want = 1.0 if not a and not b else 2 * slow_lcs(a, b) / (len(a) + len(b))
    assert rs.indel_similarity(a, b) == pytest.approx(want) and ev.lcs_length(list(a), list(b)) == slow_lcs(a, b)


def test_kendall():
    assert ev.kendall_tau_b([1, 2, 3, 4], [1, 2, 3, 4]) == 1 and ev.kendall_tau_b([1, 2, 3], [3, 2, 1]) == -1 and ev.kendall_tau_b([1, 1], [1, 2]) == 0
    assert ev.kendall_tau_b([1, 2, 2, 3], [1, 2, 3, 4]) == pytest.approx(5 / (5 * 6) ** 0.5)


def test_review_transitions(spark):
    have = spark.createDataFrame([(1, "pending"), (2, "approved"), (3, "rejected"), (4, "pending")], "id int, state string")
    want = spark.createDataFrame([(1, "approved"), (2, "approved"), (3, "pending")], "id int, to string")
    got = {r["id"]: (r["state"], r["changed"]) for r in hs.review(have, want).collect()}
    assert got == {1: ("approved", True), 2: ("approved", False), 3: ("pending", True), 4: ("pending", False)}


def test_rerank_keeps_tail(spark):
    hits = spark.createDataFrame([(1, k, k) for k in range(1, 6)], "query_id int, id int, rank int")
    got = {r["id"]: r["new_rank"] for r in se.rerank(hits, F.col("id"), 3).collect()}
    assert got == {3: 1, 2: 2, 1: 3, 4: 4, 5: 5}


def test_assignment(spark):
    from itertools import permutations

    from skein.operators import reports as rp

    cost = [[4.0, 1.0, 3.0], [2.0, 0.0, 5.0], [3.0, 2.0, 2.0]]
    best = min(sum(cost[i][j] for i, j in enumerate(p)) for p in permutations(range(3)))
    assert sum(cost[i][j] for i, j in enumerate(rp.hungarian(cost))) == best
    rows = spark.createDataFrame([("k", 1, 1, 9.0), ("k", 1, 2, 5.0), ("k", 2, 1, 4.0), ("m", 1, 1, 1.0)], "case string, gold int, found int, overlap double")
    got = sorted(tuple(r) for r in rp.assign(rows, "case").collect())
    assert got == [("k", 1, 2, 5.0), ("k", 2, 1, 4.0), ("m", 1, 1, 1.0)]


def test_tight_clusters(spark):
    rows = spark.createDataFrame([("a", "b", 0.99), ("b", "c", 0.96), ("a", "c", 0.8), ("x", "y", 0.97)], "a string, b string, cosine double")
    assert {r["id"]: r["cluster"] for r in rs.tight_clusters(rows).collect()} == {"a": "a", "b": "a", "c": "c", "x": "x", "y": "x"}


def test_paragraphs_end_at_blank_lines(spark):
    docs = [(1, "one\ntwo\n\n  three\n \t\n\nfour \n"), (2, None), (3, " \n\n "), (4, ""), (5, "\n\nx"), (6, "é\n\n\n\n日本")]
    got = [(r["doc_id"], r["position"], r["char_start"], r["char_end"], r["chunk_text"]) for r in ch.paragraphs(spark.createDataFrame(docs, "doc_id int, text string")).collect()]
    assert sorted(got) == [(1, 0, 0, 7, "one\ntwo"), (1, 1, 11, 16, "three"), (1, 2, 21, 25, "four"), (5, 0, 2, 3, "x"), (6, 0, 0, 1, "é"), (6, 1, 5, 7, "日本")]
    text = dict(docs)
    assert all(text[i][a:b] == t for i, _, a, b, t in got)


def test_sections_nest(spark):
    depths = [0, 1, 2, 2, 1, 3, 0, 2, 1]
    rows = spark.createDataFrame([(1, k, d, f"h{k}") for k, d in enumerate(depths)], "doc int, idx long, depth int, heading string")
    got = {r["idx"]: (r["parent"], r["path"]) for r in lk.heading_paths(rows, "doc", "idx", "depth", "heading", 3).collect()}
    assert got == {0: (None, ["h0"]), 1: (0, ["h0", "h1"]), 2: (1, ["h0", "h1", "h2"]), 3: (1, ["h0", "h1", "h3"]), 4: (0, ["h0", "h4"]), 5: (4, ["h0", "h4", "h5"]), 6: (None, ["h6"]), 7: (6, ["h6", "h7"]), 8: (6, ["h6", "h8"])}


def test_lookups_take_nulls_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k int, v string")
    ids = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    assert lk.by_ids(rows, ids, "k").count() == 2 and lk.by_ids(rows, ids.where("false"), "k").count() == 0
    assert sorted(map(tuple, lk.existing(ids, rows, "k").collect())) == [(1, True), (2, False)]
    assert lk.currency(ids.where("k = 2").distinct(), rows.selectExpr("k", "cast(null as date) as invalid_at"), "k").first()["live"] is False
    capped = lk.capped(rows, ["v"], 2).collect()
    assert [(r["v"], r["total"]) for r in capped] == [("a", 3), ("b", 3)] and lk.capped(rows.where("false"), ["v"], 2).count() == 0
