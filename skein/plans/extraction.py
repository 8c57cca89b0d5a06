"""Queries of extraction and of schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein import schema as sc
from skein.operators import extract as ex
from skein.operators import packing
from skein.operators import snapshots as sn
from skein.plans.registry import Tables, query
from skein.plans.retrieval import CHUNKS, _chunks

SCHEMA = sc.load(
    {
        "name": "trade",
        "entities": [{"label": "Thing"}, {"label": "Brand", "parents": ["Thing"]}, {"label": "Item", "parents": ["Thing"], "properties": [{"name": "size", "type": "integer"}, {"name": "price", "type": "float"}]}],
        "relations": [{"name": "MADE_BY", "patterns": [["Item", "Brand"]]}, {"name": "LIKE", "patterns": [["Thing", "Thing"]], "symmetric": True}],
    }
)

# Lines of an order are the spans of a chunk: the line's number places it, the discount is its confidence.
SPANS = """spans AS (SELECT CAST(l_orderkey AS VARCHAR) AS chunk_id, l_linenumber * 10 AS char_start, l_linenumber * 10 + 5 AS char_end, CASE WHEN l_returnflag = 'R' THEN 'Brand' WHEN l_returnflag = 'A' THEN 'Item' ELSE 'Thing' END AS label, 'p' || l_partkey AS text, round(l_discount * 10, 6) AS confidence FROM lineitem)"""


def _spans(t: Tables) -> DataFrame:
    return t.lineitem.selectExpr("cast(l_orderkey as string) as chunk_id", "cast(l_linenumber * 10 as bigint) as char_start", "cast(l_linenumber * 10 + 5 as bigint) as char_end", "case when l_returnflag = 'R' then 'Brand' when l_returnflag = 'A' then 'Item' else 'Thing' end as label", "concat('p', l_partkey) as text", "round(l_discount * 10, 6) as confidence")


BEST = f"""{SPANS}, d AS (SELECT *, CASE WHEN label = 'Thing' THEN 0 ELSE 1 END AS depth FROM spans),
best AS (SELECT chunk_id, char_start, char_end, label, confidence FROM d QUALIFY row_number() OVER (PARTITION BY chunk_id, char_start, char_end ORDER BY confidence DESC, depth DESC, label DESC) = 1)"""


@query(f"WITH {BEST} SELECT chunk_id, CAST(char_start AS BIGINT) AS char_start, CAST(char_end AS BIGINT) AS char_end, label, confidence FROM best")
def best_mention_per_span(t: Tables) -> DataFrame:
    return ex.best_per_span(_spans(t), SCHEMA.frames(t.spark)[0]).drop("text")


@query(f"WITH {BEST} SELECT label, count(*) AS n FROM best WHERE confidence >= CASE WHEN label = 'Brand' THEN 0.8 ELSE 0.5 END GROUP BY label")
def mentions_above_threshold(t: Tables) -> DataFrame:
    best = ex.best_per_span(_spans(t), SCHEMA.frames(t.spark)[0])
    return ex.kept(best, {"Brand": 0.8}).groupBy("label").agg(F.count("*").alias("n"))


@query(f"""WITH {BEST}, good AS (SELECT * FROM best WHERE confidence >= 0.7) SELECT DISTINCT s.chunk_id, s.label, CAST(s.char_start AS BIGINT) AS char_start, s.text, s.confidence FROM spans s WHERE confidence >= 0.3 AND confidence < 0.7 AND NOT EXISTS (SELECT 1 FROM good g WHERE g.chunk_id = s.chunk_id AND g.char_start < s.char_end AND s.char_start < g.char_end)""")
def band_candidates(t: Tables) -> DataFrame:
    spans = _spans(t)
    good = ex.best_per_span(spans, SCHEMA.frames(t.spark)[0]).where("confidence >= 0.7")
    return ex.band(spans, good).select("chunk_id", "label", "char_start", "text", "confidence").distinct()


def _relations(t: Tables) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    spans = _spans(t)
    best = ex.best_per_span(spans.groupBy("chunk_id", "char_start", "char_end", "label", "confidence").agg(F.min("text").alias("text")), SCHEMA.frames(t.spark)[0])
    raw = t.lineitem.withColumn("most", F.max("l_partkey").over(Window.partitionBy("l_orderkey"))).selectExpr("cast(l_orderkey as string) as chunk_id", "case when l_linestatus = 'O' then 'MADE_BY' else 'LIKE' end as type", "concat('p', l_partkey) as src_text", "concat('P', most) as dst_text", "round(l_quantity / 50, 6) as score")
    return ex.relations(raw, best, SCHEMA.frames(t.spark)[1])


@query()
def valid_relations(t: Tables) -> DataFrame:
    return _relations(t)[0]


@query()
def rejected_relations(t: Tables) -> DataFrame:
    return _relations(t)[1].groupBy("reason", "type").agg(F.count("*").alias("n"))


@query(f"""WITH {CHUNKS}, w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(chunk_text, '[\\p{{L}}\\p{{N}}_]+'))) AS word FROM chunks), hits AS (
SELECT chunk_id, unnest(regexp_extract_all(chunk_text, '[\\p{{L}}\\p{{N}}_]+')) AS text FROM chunks) SELECT chunk_id, count(*) AS n, min(text) AS first FROM hits WHERE lower(text) IN ('the', 'licensed', 'clown', 'der', 'que') GROUP BY chunk_id""")
def dictionary_mentions(t: Tables) -> DataFrame:
    names = t.spark.createDataFrame([("Word", w) for w in ("the", "Licensed", "clown", "der", "que")], "label string, name string")
    return ex.dictionary(_chunks(t), names).groupBy("chunk_id").agg(F.count("*").alias("n"), F.min("text").alias("first"))


@query()
def packed_chunks(t: Tables) -> DataFrame:
    return packing.packed(t.documents)


@query("SELECT c_custkey AS id, CASE WHEN c_acctbal > 0 AND c_nationkey < 10 THEN 'new' ELSE c_mktsegment END AS segment FROM customer")
def guarded_write(t: Tables) -> DataFrame:
    """Updates were made for customers as they stand, but those of nations from 10 on were read at another balance."""
    rows = t.customer.selectExpr("c_custkey as id", "c_acctbal as balance", "c_mktsegment as segment", "c_nationkey")
    updates = rows.where("balance > 0").selectExpr("id", "case when c_nationkey < 10 then balance else balance + 1 end as balance", "'new' as segment")
    return sn.guarded(rows, updates, "id", "balance", "segment").select("id", "segment")


@query("SELECT 'missing' AS kind, doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT 'orphaned', vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)")
def vector_drift(t: Tables) -> DataFrame:
    missing, orphaned = sn.vector_drift(t.documents.selectExpr("doc_id as id"), t.embeddings.selectExpr("vec_id as id"))
    return missing.selectExpr("'missing' as kind", "id").union(orphaned.selectExpr("'orphaned' as kind", "id"))
