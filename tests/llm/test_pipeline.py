import corpus_pipeline
from skein.llm import nbsvm
from tests.conftest import DATA
from tests.llm.data import edge_docs, read
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_pairs import contaminated, five_word_groups

SF = f"{DATA}/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = corpus_pipeline.quality(spark, docs, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    fitted = nbsvm.model(docs, labels, "quality", ~nbsvm.held_out("id", 3, 1))
    want = {r["doc_id"] for r in nbsvm.score(docs, fitted).where("score >= 0.5").collect()}
    kept = [(r["doc_id"], r["text"]) for r in first.collect()]
    assert {i for i, _ in kept} == want and 100 < len(kept) < 200

    second = corpus_pipeline.line_dedup(spark, first, SF)
    cleaned = {r["doc_id"]: r["text"] for r in second.collect()}
    removed = {r[0]: r[2] for r in brute_lines(kept)}
    assert all(cleaned[i] == t for i, t in kept if not removed[i])
    assert all(t.count("\n") - cleaned[i].count("\n") <= removed[i] for i, t in kept if removed[i] and i in cleaned)

    ids = sorted(cleaned)
    third = corpus_pipeline.near_dedup(spark, second, SF)
    roots = five_word_groups([(i, cleaned[i]) for i in ids])
    left = sorted(r["doc_id"] for r in third.collect())
    exact = [i for i, r in zip(ids, roots) if i == r]
    assert set(exact) <= set(left)  # no document goes without a link
    assert len(set(left) - set(exact)) <= 0.1 * (len(ids) - len(exact))  # SimHash finds 0.9 of those that should

    fourth = corpus_pipeline.decontamination(spark, third, SF)
    dirty = {r[0] for r in contaminated([(i, cleaned[i]) for i in left], read("sf0.001", "benchmark")) if r[5]}
    last = sorted(r["doc_id"] for r in fourth.collect())
    assert last == [i for i in left if i not in dirty] and fourth.columns == corpus_pipeline.COLUMNS

    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r["doc_id"] for r in whole) == last and all(r["n_tokens"] == len(r["ids"]) for r in whole)


def test_stages_take_edges(spark):
    docs = edge_docs(spark).select(*corpus_pipeline.COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() <= docs.count(), name
        assert stage(spark, docs.where("false"), SF).count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == corpus_pipeline.COLUMNS
