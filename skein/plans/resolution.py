"""Queries of names, resolution and merging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import text as tx
from skein.operators import graph as gr
from skein.operators import merge as mg
from skein.operators import resolve as rs
from skein.plans.registry import Tables, query

NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(trim(lower({0}), ' '), '\s+', ' ', 'g'), '^(the|a|an)\s+', ''), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' ')"
TOK = r"regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+')"
NAMES = f"names AS (SELECT p_brand AS label, {NORM.format('p_name')} AS norm, arg_min(p_name, p_partkey) AS name, min(p_partkey) AS first, count(*) AS n FROM part GROUP BY 1, 2)"
PAIRS = f"""{NAMES},
words AS (SELECT label, norm, unnest(list_distinct({TOK.format('norm')})) AS word FROM names),
rare AS (SELECT w.* FROM words w JOIN (SELECT label, word FROM words GROUP BY ALL HAVING count(*) > 1) o USING (label, word)),
pairs AS (SELECT DISTINCT a.label, a.norm AS a, b.norm AS b FROM rare a JOIN rare b ON a.label = b.label AND a.word = b.word AND a.norm < b.norm)"""


def _names(t: Tables) -> DataFrame:
    return rs.distinct_names(t.part, "p_brand", "p_name", "p_partkey")


@query(f"WITH {NAMES} SELECT * FROM names")
def distinct_entity_names(t: Tables) -> DataFrame:
    return _names(t)


@query(f"SELECT c_custkey AS id, 'Customer:' || {NORM.format('c_name')} AS merge_key, array_to_string(list_sort(list_distinct(list_filter({TOK.format('lower(c_name)')}, lambda x: regexp_matches(x, '[0-9]')))), ' ') AS digits FROM customer")
def entity_merge_keys(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("id"), tx.merge_key(F.lit("Customer"), F.col("c_name")).alias("merge_key"), F.array_join(tx.digit_tokens(F.col("c_name")), " ").alias("digits"))


@query(f"WITH {PAIRS} SELECT * FROM pairs")
def blocked_name_pairs(t: Tables) -> DataFrame:
    return rs.candidate_pairs(_names(t))


@query(f"WITH {PAIRS} SELECT label, a, b, array_to_string(list_sort({TOK.format('a')}), ' ') = array_to_string(list_sort({TOK.format('b')}), ' ') AS same_words FROM pairs")
def sorted_word_matches(t: Tables) -> DataFrame:
    return rs.candidate_pairs(_names(t)).select("label", "a", "b", (tx.sorted_tokens(F.col("a")) == tx.sorted_tokens(F.col("b"))).alias("same_words"))


@query()
def fuzzy_name_pairs(t: Tables) -> DataFrame:
    return rs.token_sort_ratio(rs.candidate_pairs(_names(t))).withColumn("matched", F.col("ratio") >= rs.FUZZY)


@query("""WITH p AS (SELECT a.label AS block, a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id)
SELECT *, CASE WHEN cosine >= 0.95 THEN 'merge' WHEN cosine >= 0.8 THEN 'ambiguous' ELSE 'drop' END AS zone FROM p""")
def vector_zones(t: Tables) -> DataFrame:
    return rs.vector_zones(t.embeddings, "vec_id", "embedding", "label")


@query("""WITH p AS (SELECT a.label AS block, a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id)
SELECT * FROM (SELECT block, a, b, cosine, CAST(row_number() OVER (PARTITION BY block ORDER BY cosine DESC, a, b) AS INT) AS rank FROM p) x WHERE rank <= 50""")
def pairs_for_review(t: Tables) -> DataFrame:
    """The most similar pairs of each label, as many as a reviewer is given."""
    return rs.best_pairs(t.embeddings, "vec_id", "embedding", "label", 50)


@query()
def tight_vector_clusters(t: Tables) -> DataFrame:
    """The test vectors lie far apart, so near is wider here than in resolution."""
    return rs.tight_clusters(rs.vector_pairs(t.embeddings, "vec_id", "embedding", "label", least=0.3).where("cosine >= 0.3"), 0.7)


@query("""SELECT p_name AS grp, arg_min(p_partkey, (CASE WHEN p_size > 40 THEN 1 ELSE 0 END, p_retailprice, p_partkey)) AS survivor FROM part GROUP BY p_name""")
def canonical_survivors(t: Tables) -> DataFrame:
    rows = t.part.selectExpr("p_name as grp", "p_partkey as id", "p_retailprice as created_at", "case when p_size <= 40 then p_size end as size")
    return mg.survivors(rows, "grp", ["size"])


@query("""SELECT p_name AS grp, first(p_brand ORDER BY p_partkey) AS brand_first, last(p_brand ORDER BY p_partkey) AS brand_last, count(DISTINCT p_brand) > 1 AS conflict, count(*) AS merge_count FROM part GROUP BY p_name""")
def merged_properties(t: Tables) -> DataFrame:
    rows = t.part
    first, conflict = mg.merge_property(F.col("p_brand"), F.col("p_partkey"))
    last, _ = mg.merge_property(F.col("p_brand"), F.col("p_partkey"), "KEEP_LAST")
    return rows.groupBy(F.col("p_name").alias("grp")).agg(first.alias("brand_first"), last.alias("brand_last"), conflict.alias("conflict"), F.count("*").alias("merge_count"))


@query("""WITH g AS (SELECT p_name AS grp, p_type AS v, min(p_partkey) AS p FROM part GROUP BY ALL) SELECT grp, string_agg(v, '; ' ORDER BY p) AS types FROM g GROUP BY grp""")
def merged_all_values(t: Tables) -> DataFrame:
    every, _ = mg.merge_property(F.col("p_type"), F.col("p_partkey"), "MERGE_ALL")
    return t.part.groupBy(F.col("p_name").alias("grp")).agg(every.alias("types"))


@query("""WITH s AS (SELECT p_partkey AS id, min(p_partkey) OVER (PARTITION BY p_name) AS survivor FROM part),
r AS (SELECT s.survivor AS src, l_suppkey AS dst, l_orderkey AS c FROM lineitem JOIN s ON s.id = l_partkey) SELECT src, dst, 'SUPPLIED_BY' AS type, count(DISTINCT c) AS n_sources, min(c) AS first_source FROM r GROUP BY ALL""")
def remapped_relations(t: Tables) -> DataFrame:
    """Suppliers' numbers are made negative, from -1 down, so that they never meet parts'."""
    from pyspark.sql import Window

    survivors = t.part.select(F.col("p_partkey").alias("id"), F.min("p_partkey").over(Window.partitionBy("p_name")).alias("survivor"))
    relations = t.lineitem.selectExpr("l_partkey as src", "-l_suppkey - 1 as dst", "'SUPPLIED_BY' as type", "l_orderkey as chunk_id")
    moved = rs.remap_relations(relations, survivors)
    return moved.select("src", (-F.col("dst") - 1).alias("dst"), "type", F.size("source_chunk_ids").cast("long").alias("n_sources"), F.element_at("source_chunk_ids", 1).alias("first_source"))


@query("SELECT DISTINCT l_orderkey AS chunk, l_partkey AS entity FROM lineitem")
def mention_edges(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_orderkey").alias("chunk"), F.col("l_partkey").alias("entity")).distinct()


@query("""WITH c AS (SELECT p_partkey AS id, min(p_partkey) OVER (PARTITION BY p_name, p_brand) AS component FROM part) SELECT component, count(*) AS size, min(p_name) AS name FROM c JOIN part ON p_partkey = id GROUP BY component HAVING count(*) > 1""")
def resolved_entities(t: Tables) -> DataFrame:
    """Clusters of parts of one name and brand, by their match edges."""
    from pyspark.sql import Window

    order = Window.partitionBy("p_name", "p_brand").orderBy("p_partkey")
    matches = t.part.select(F.col("p_partkey").alias("src"), F.lead("p_partkey").over(order).alias("dst")).where("dst is not null")
    found = gr.components(matches).join(t.part.selectExpr("p_partkey as id", "p_name"), "id")
    return found.groupBy("component").agg(F.count("*").alias("size"), F.min("p_name").alias("name"))


@query("""WITH x AS (SELECT event_id, regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS raw FROM events)
SELECT event_id, TRY_CAST(raw AS BIGINT) AS as_integer, TRY_CAST(raw AS DOUBLE) AS as_float, CASE WHEN raw IN ('1') THEN true WHEN raw IN ('0') THEN false END AS as_boolean FROM x""")
def typed_properties(t: Tables) -> DataFrame:
    raw = F.get_json_object("props", "$.k")
    return t.events.select("event_id", tx.parse_property(raw, "integer").alias("as_integer"), tx.parse_property(raw, "float").alias("as_float"), tx.parse_property(raw, "boolean").alias("as_boolean"))


@query("""SELECT doc_id, substr(text, 1, 1000) AS text, sha256(text) AS full_sha256, length(text) > 1000 AS truncated FROM documents""")
def bounded_payloads(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.bounded(F.col("text"), 1000).alias("b")).select("doc_id", "b.*")
