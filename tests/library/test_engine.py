import json

import pytest
from pyspark.sql import functions as F

from skein import schema as sc
from skein.engine import GraphEngine
from skein.operators import extract as ex
from skein.operators import packing
from skein.operators.snapshots import Store

SPEC = {
    "name": "firm",
    "entities": [{"label": "Agent", "properties": [{"name": "name", "required": True}]}, {"label": "Person", "parents": ["Agent"], "properties": [{"name": "age", "type": "integer"}]}, {"label": "Firm", "parents": ["Agent"]}, {"label": "Town"}],
    "relations": [{"name": "WORKS_FOR", "patterns": [["Person", "Firm"]]}, {"name": "NEAR", "patterns": [["Agent", "Town"]], "symmetric": True}],
}


def test_schema():
    s = sc.load(SPEC)
    assert s.labels("Person") == ["Person", "Agent"] and set(s.properties("Person")) == {"name", "age"}
    assert s.allows("Person", "NEAR", "Town") and s.allows("Town", "NEAR", "Firm") and not s.allows("Firm", "WORKS_FOR", "Person")
    assert sc.load(json.dumps(SPEC)).fingerprint() == s.fingerprint() and len(s.fingerprint()) == 16
    assert sc.load(["A-R->B", "B - S -> C"]).allows("B", "S", "C")
    for bad in (["A=>B"], {"entities": [{"label": "Chunk"}]}, {"entities": [{"label": "A", "parents": ["B"]}, {"label": "B", "parents": ["A"]}]}, {"entities": [{"label": "A"}], "relations": [{"name": "R", "patterns": [["A", "Z"]]}]}):
        with pytest.raises(ValueError):
            sc.load(bad)


def test_schema_extension_and_export(tmp_path):
    s = sc.load(SPEC)
    wider = sc.load({"entities": [{"label": "Agent", "properties": [{"name": "name", "required": False}]}]})
    with pytest.raises(ValueError):
        sc.extend(s, wider)
    more = sc.extend(s, sc.load({"name": "more", "entities": [{"label": "Town", "properties": [{"name": "size", "type": "float"}]}]}), exclude=("Firm",))
    assert "Firm" not in more._by and "size" in more.properties("Town") and [r.name for r in more.relations] == ["NEAR"]
    assert sc.to_json_schema(s)["$defs"]["Person"]["required"] == ["name"]
    assert "sh:datatype xsd:integer" in sc.to_shacl(s, "http://x/") and len(sc.to_jsonld(s, "http://x/")["@graph"]) == 6
    patch = sc.patch_from(s, [{"kind": "entity", "label": "Ship"}, {"kind": "entity", "label": "Ship"}, {"kind": "relation", "source": "Firm", "type": "WORKS_FOR", "target": "Firm"}, {"kind": "property", "label": "Town", "property": "mayor"}])
    assert patch == {"entities": ["Ship"], "relations": [["Firm", "WORKS_FOR", "Firm"]], "properties": [["Town", "mayor"]]}
    assert sc.read_patch(sc.write_patch(patch, tmp_path / "p.json")) == patch
    with pytest.raises(FileExistsError):
        sc.write_patch(patch, tmp_path / "p.json")


def test_extraction(spark):
    s = sc.load(SPEC)
    closure, allowed, declared = s.frames(spark)
    kind = "chunk_id string, label string, text string, char_start long, char_end long, confidence double"
    m = spark.createDataFrame([("1", "Agent", "Ann", 0, 3, 0.9), ("1", "Person", "Ann", 0, 3, 0.9), ("1", "Firm", "Acme", 10, 14, None), ("1", "Town", "Bree", 20, 24, 0.4), ("1", "Town", "Br", 12, 15, 0.5)], kind)
    best = ex.best_per_span(m, closure)
    assert {(r["char_start"], r["label"]) for r in best.collect()} == {(0, "Person"), (10, "Firm"), (20, "Town"), (12, "Town")}
    kept = ex.kept(best, {"Town": 0.45})
    assert {r["text"] for r in kept.collect()} == {"Ann", "Acme", "Br"}
    assert {r["text"] for r in ex.band(m, best.where("label != 'Town'")).collect()} == {"Bree"}
    raw = spark.createDataFrame([("1", "WORKS_FOR", "ann", "ACME", 0.9), ("1", "WORKS_FOR", "Ann", "Acme", 0.8), ("1", "WORKS_FOR", "Acme", "Ann", 0.9), ("1", "NEAR", "Ann", "Nowhere", 0.9), ("1", "NEAR", "Ann", "Br", 0.2), ("1", "NEAR", "Ann", "Ann", 0.9)], "chunk_id string, type string, src_text string, dst_text string, score double")
    good, bad = ex.relations(raw, kept, allowed)
    assert [(r["type"], r["src_at"], r["dst_at"], r["score"]) for r in good.collect()] == [("WORKS_FOR", 0, 10, 0.9)]
    assert {(r["dst_text"], r["reason"]) for r in bad.collect()} == {("Ann", "off_pattern"), ("Nowhere", "unresolved_endpoint"), ("Br", "below_relation_cut")}
    with_map = kept.withColumn("properties", F.create_map(F.lit("age"), F.lit("3"), F.lit("hat"), F.lit("red")))
    clean, unknown, extra = ex.validate(with_map.unionByName(with_map.limit(1).withColumn("label", F.lit("Ghost"))), closure, declared)
    assert unknown.count() == 1 and clean.where("label = 'Person'").first()["properties"] == {"age": "3"} and extra.where("label = 'Person'").first()["property"] == "hat"


def test_two_extractors(spark):
    kind = "chunk_id string, label string, text string, char_start long, char_end long, confidence double"
    a = spark.createDataFrame([("1", "P", "Ann", 0, 3, 0.5), ("1", "P", "Ann", 9, 12, 0.5)], kind)
    b = spark.createDataFrame([("1", "P", "ann", 1, 4, 0.9), ("1", "P", "Bob", 20, 23, None)], kind)
    got = sorted((r["text"], r["char_start"], r["confidence"], r["extractors"]) for r in ex.union_extractors(a, b).collect() if r["text"] != "Bob")
    assert got == [("Ann", 0, 0.9, "a,b"), ("Ann", 9, 0.5, "a")]
    plug = ex.plugged(spark.createDataFrame([("1", "x y")], "chunk_id string, chunk_text string"), lambda t: [("L", w, t.index(w), t.index(w) + 1, 1.0) for w in t.split()])
    assert plug.count() == 2


def test_packing():
    assert packing.sentences("Mr. X went. He (see Fig. 2) left! A. B. stays.") == ["Mr. X went.", "He (see Fig. 2) left!", "A. B. stays."]
    units = [("heading", "# T"), ("text", "a b c"), ("table", "x | y | z"), ("heading", "# U"), ("heading", "# V")]
    assert packing.pack(units, 10) == ["# T\n\na b c", "x | y | z"]
    long = " ".join(f"Word{k} is here." for k in range(100))
    parts = packing.pack([("text", long)], 20)
    assert all(packing.count_words(p) <= 20 for p in parts) and " ".join(" ".join(parts).split()) == long


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    one, two = store.begin(), store.begin()
    one.stage("t", spark.range(3))
    assert store.table("t") is None
    one.publish()
    one.publish()
    assert store.table("t").count() == 3
    two.stage("t", spark.range(9))
    with pytest.raises(RuntimeError):
        two.publish()
    assert store.recover() == [two.name] and store.table("t").count() == 3
    three = store.begin()
    three.stage("u", spark.range(2))
    three.roll_back()
    assert store.recover() == [] and store.table("u") is None


def test_only_one_job_gets_a_version(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    one, two = store.begin(), store.begin()
    one.stage("t", spark.range(3))
    two.stage("t", spark.range(9))
    stale = store.manifest()
    one.publish()
    store._replace(stale)  # as if the second job had read the manifest before the first replaced it
    with pytest.raises(RuntimeError):
        two.publish()
    store.recover()  # the claim without a manifest goes
    three = store.begin()
    three.stage("t", spark.range(5))
    three.publish()
    assert store.table("t").count() == 5 and store.manifest()["version"] == 1


def test_engine(spark, tmp_path):
    names = spark.createDataFrame([("Person", "Ann"), ("Person", "Bob"), ("Organization", "Acme"), ("Location", "Bree")], "label string, name string")
    g = GraphEngine(spark, f"file://{tmp_path}/g", names=names)
    docs = spark.createDataFrame([("a", "Ann works at Acme.\n \nBob lives in Bree."), ("b", "Acme is in Bree.")], "doc_id string, text string")
    g.add(docs, "2024-01-01")
    assert g.chunks().count() == 3 and g.search_passages("acme bree").first()["chunk_id"] == "b:0"
    assert g.search_passages("acme", scope=["a"]).count() == 1
    found = {r["id"]: r["depth"] for r in g.explore_relationships("Person:ann", 2).collect()}
    assert found == {"Organization:acme": 1, "Location:bree": 2}
    g.update(spark.createDataFrame([("b", "Acme moved.")], "doc_id string, text string"), "2024-02-01")
    assert g.documents().where("doc_id = 'b'").first()["text"] == "Acme moved." and g._history().count() == 3
    g.delete(["a"], "2024-03-01")
    assert {r["doc_id"]: r["state"] for r in g.source_status().collect()} == {"a": "DELETED", "b": "CURRENT"}
    assert [r["seq"] for r in g.activations().where("doc_id = 'b'").orderBy("seq").collect()] == [1, 2]
    g.purge(["a"], "2024-04-01")
    assert g._history().where("doc_id = 'a'").count() == 0
    totals, members, _ = g.detect_communities(2)
    assert totals.count() == 0 or members.count() > 0
    with pytest.raises(ValueError):
        g.search_passages("x", 51)
