"""Queries of chunks, passages and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as tx
from skein.functions import vectors as vec
from skein.operators import chunks as ch
from skein.operators import search as se
from skein.plans.registry import Tables, query

CHUNKS = r"""
raw AS (SELECT doc_id, sha256(text) AS content_hash, string_split(text, chr(10)) AS ls FROM documents),
ln AS (SELECT doc_id, content_hash, unnest(ls) AS line, unnest(range(len(ls))) AS line_no FROM raw),
pl AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - length(line) - 1 AS line_start FROM ln),
chunks AS (SELECT doc_id, content_hash, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS position,
  CAST(line_start + length(line) - length(ltrim(line, ' ')) AS BIGINT) AS char_start,
  CAST(line_start + length(line) - length(ltrim(line, ' ')) + length(trim(line, ' ')) AS BIGINT) AS char_end,
  trim(line, ' ') AS chunk_text, doc_id || ':' || (row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1) AS chunk_id
  FROM pl WHERE trim(line, ' ') <> '')"""
# The version model on the test tables: texts of src1 were closed, src2 is not committed yet, src3 has newer content.
PARTS = """
parts AS (SELECT doc_id, sha256(text) AS content_hash, CASE WHEN source = 'src1' THEN DATE '2024-06-01' END AS invalid_at, source = 'src2' AS pending FROM documents),
docs AS (SELECT doc_id, CASE WHEN source = 'src3' THEN sha256(text || '!') ELSE sha256(text) END AS current_hash, lang, source = 'src2' AS pending FROM documents),
visible AS (SELECT c.* FROM chunks c JOIN parts p USING (doc_id, content_hash) JOIN docs d ON d.doc_id = c.doc_id AND d.current_hash = c.content_hash
  WHERE p.invalid_at IS NULL AND NOT p.pending AND NOT d.pending AND d.lang IN ('en', 'fr'))"""
TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"


def _chunks(t: Tables) -> DataFrame:
    return ch.line_chunks(t.documents)


def _versions(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    d = t.documents
    parts = d.select("doc_id", F.sha2("text", 256).alias("content_hash"), F.when(F.col("source") == "src1", F.lit("2024-06-01").cast("date")).alias("invalid_at"), (F.col("source") == "src2").alias("pending"))
    docs = d.select("doc_id", F.when(F.col("source") == "src3", F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.sha2("text", 256)).alias("current_hash"), (F.col("source") == "src2").alias("pending"))
    return parts, docs, d.where(F.col("lang").isin("en", "fr")).select("doc_id")


def _visible(t: Tables) -> DataFrame:
    return ch.visible(_chunks(t), *_versions(t))


@query(f"WITH {CHUNKS} SELECT * FROM chunks")
def paragraph_chunks(t: Tables) -> DataFrame:
    return _chunks(t)


@query(f"WITH {CHUNKS}, {PARTS} SELECT doc_id, chunk_id, char_start, char_end FROM visible")
def visible_chunks(t: Tables) -> DataFrame:
    return _visible(t).select("doc_id", "chunk_id", "char_start", "char_end")


@query(f"WITH {CHUNKS}, {PARTS} SELECT c.chunk_id, v.doc_id AS visible_doc FROM chunks c LEFT JOIN visible v USING (chunk_id)")
def candidate_visibility(t: Tables) -> DataFrame:
    seen = _visible(t).select("chunk_id", F.col("doc_id").alias("visible_doc"))
    return _chunks(t).select("chunk_id").join(seen, "chunk_id", "left")


@query(f"WITH {CHUNKS}, {PARTS} SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM visible)")
def documents_with_open_chunk(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(_visible(t).select("doc_id"), "doc_id", "left_semi")


@query(f"WITH {CHUNKS} SELECT * FROM (SELECT doc_id, chunk_id, lead(chunk_id) OVER (PARTITION BY doc_id ORDER BY position) AS next_chunk_id FROM chunks) x WHERE next_chunk_id IS NOT NULL")
def next_chunk_edges(t: Tables) -> DataFrame:
    return ch.consecutive(_chunks(t))


@query(f"WITH {CHUNKS} SELECT chunk_id, 'ev1:s:' || doc_id || ':' || substr(content_hash, 1, 16) || ':' || char_start || '-' || char_end AS evidence_id FROM chunks")
def evidence_references(t: Tables) -> DataFrame:
    return ch.text_references(_chunks(t))


@query(f"""WITH {CHUNKS}, e AS (SELECT chunk_id, 'ev1:s:' || doc_id || ':' || substr(content_hash, 1, 16) || ':' || char_start || '-' || char_end AS id FROM chunks)
SELECT chunk_id, regexp_extract(id, '^ev1:s:([^:]+):', 1) AS doc, regexp_extract(id, '^ev1:s:[^:]+:([0-9a-f]+):', 1) AS hash, CAST(regexp_extract(id, ':([0-9]+)-', 1) AS BIGINT) AS "start", CAST(regexp_extract(id, '-([0-9]+)$', 1) AS BIGINT) AS "end", 'span' AS kind FROM e""")
def evidence_id_codec(t: Tables) -> DataFrame:
    refs = ch.text_references(_chunks(t)).select("chunk_id", tx.decode_evidence_id(F.col("evidence_id")).alias("d"))
    return refs.select("chunk_id", "d.doc", "d.hash", "d.start", "d.end", "d.kind")


BM25 = f"""
q AS (SELECT item_id AS query_id, unnest(list_distinct({TOKENS.format('text')})) AS token FROM benchmark),
bag AS (SELECT chunk_id, {TOKENS.format('chunk_text')} AS bag FROM visible),
st AS (SELECT count(*) AS n, avg(len(bag)) AS mean FROM bag),
tf AS (SELECT chunk_id, size, token, count(*) AS tf FROM (SELECT chunk_id, len(bag) AS size, unnest(bag) AS token FROM bag) x WHERE token IN (SELECT token FROM q) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
part AS (SELECT chunk_id, token, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean)) AS part FROM tf JOIN df USING (token), st),
lex AS (SELECT query_id, chunk_id AS id, round(sum(part), 6) AS score FROM part JOIN q USING (token) GROUP BY ALL)"""


def _lexical(t: Tables, k: int) -> DataFrame:
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return se.top_k(se.bm25(_visible(t), asked, k=k).withColumnRenamed("chunk_id", "id"), k)


@query(f"WITH {CHUNKS}, {PARTS}, {BM25} SELECT query_id, id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM lex) x WHERE rank <= 10")
def lexical_search(t: Tables) -> DataFrame:
    return _lexical(t, 10)


COS = """
qv AS (SELECT label AS query_id, arg_min(embedding, vec_id) AS qe FROM embeddings GROUP BY label),
vs AS (SELECT query_id, vec_id AS id, round((1 + list_cosine_similarity(embedding::DOUBLE[], qe::DOUBLE[])) / 2, 6) AS score FROM embeddings, qv)"""


def _query_vectors(t: Tables) -> DataFrame:
    """The first vector of each label asks: as many queries as labels."""
    return t.embeddings.groupBy(F.col("label").alias("query_id")).agg(F.min_by("embedding", "vec_id").alias("query_vector"))


def _semantic(t: Tables) -> DataFrame:
    return se.vector_search(t.embeddings, _query_vectors(t)).withColumnRenamed("vec_id", "id")


@query(f"WITH {COS} SELECT query_id, id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM vs) x WHERE rank <= 10")
def vector_search_cosine(t: Tables) -> DataFrame:
    return se.top_k(_semantic(t), 10)


@query("""WITH qv AS (SELECT label AS query_id, arg_min(embedding, vec_id) AS qe FROM embeddings GROUP BY label),
vs AS (SELECT query_id, vec_id AS id, round(1 / (1 + pow(list_distance(embedding::DOUBLE[], qe::DOUBLE[]), 2)), 6) AS score FROM embeddings, qv)
SELECT query_id, id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM vs) x WHERE rank <= 10""")
def vector_search_euclid(t: Tables) -> DataFrame:
    return se.top_k(se.vector_search(t.embeddings, _query_vectors(t), "euclid").withColumnRenamed("vec_id", "id"), 10)


@query(f"WITH {COS} SELECT query_id, id, score, rank FROM (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM vs JOIN embeddings e ON e.vec_id = id WHERE e.label IN (1, 3, 5)) x WHERE rank <= 5")
def vector_search_filtered(t: Tables) -> DataFrame:
    inside = t.embeddings.where(se.matches_filters(label=[1, 3, 5]))
    return se.top_k(se.vector_search(inside, _query_vectors(t)).withColumnRenamed("vec_id", "id"), 5)


LEGS = f"""
dq AS (SELECT query_id, q.query FROM (SELECT label AS query_id, min(vec_id) AS doc_id FROM embeddings GROUP BY label) m JOIN (SELECT doc_id, text AS query FROM documents) q USING (doc_id)),
dt AS (SELECT query_id, unnest(list_distinct({TOKENS.format('query')})) AS token FROM dq),
dbag AS (SELECT doc_id, {TOKENS.format('text')} AS bag FROM documents),
dst AS (SELECT count(*) AS n, avg(len(bag)) AS mean FROM dbag),
dtf AS (SELECT doc_id, size, token, count(*) AS tf FROM (SELECT doc_id, len(bag) AS size, unnest(bag) AS token FROM dbag) x WHERE token IN (SELECT token FROM dt) GROUP BY ALL),
ddf AS (SELECT token, count(*) AS df FROM dtf GROUP BY token),
dpart AS (SELECT doc_id, token, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean)) AS part FROM dtf JOIN ddf USING (token), dst),
dlex AS (SELECT query_id, doc_id AS id, round(sum(part), 6) AS score FROM dpart JOIN dt USING (token) GROUP BY ALL),
l1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM dlex) x WHERE rank <= 40),
l2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM vs) x WHERE rank <= 40)"""


def _legs(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Documents by words and by vector, for the documents behind the query vectors."""
    firsts = t.embeddings.groupBy(F.col("label").alias("query_id")).agg(F.min("vec_id").alias("doc_id"))
    asked = firsts.join(t.documents, "doc_id").select("query_id", F.col("text").alias("query"))
    words = se.bm25(t.documents, asked, "doc_id", "text", 40).withColumnRenamed("doc_id", "id")
    return se.top_k(words, 40), se.top_k(_semantic(t), 40)


@query(f"""WITH {COS}, {LEGS}, f AS (SELECT query_id, id, round(sum(part), 9) AS score, string_agg(name, ',' ORDER BY leg) AS legs FROM (SELECT query_id, id, 1.0 / (60 + rank) AS part, 'lexical' AS name, 0 AS leg FROM l1 UNION ALL SELECT query_id, id, 1.0 / (60 + rank), 'semantic', 1 FROM l2) x GROUP BY query_id, id)
SELECT query_id, id, score, legs, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM f) y WHERE rank <= 10""")
def hybrid_search_rrf(t: Tables) -> DataFrame:
    words, near = _legs(t)
    return se.top_k(se.rrf({"lexical": words, "semantic": near}), 10)


@query(f"""WITH {COS}, {LEGS}, f AS (SELECT query_id, id, round(sum(part), 9) AS score FROM (SELECT query_id, id, 0.7 / (60 + rank) AS part FROM l2 UNION ALL SELECT query_id, id, 0.3 / (60 + rank) FROM l1) x GROUP BY query_id, id)
SELECT query_id, id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM f) y WHERE rank <= 10""")
def hybrid_search_weighted_rrf(t: Tables) -> DataFrame:
    words, near = _legs(t)
    fused = se.rrf({"dense": near, "bm25": words}, weights={"dense": 0.7, "bm25": 0.3}).drop("legs")
    return se.top_k(fused, 10)


@query(f"""WITH {COS}, {LEGS}, n AS (
SELECT query_id, id, 0.6 * CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS part FROM l2 WINDOW w AS (PARTITION BY query_id)
UNION ALL SELECT query_id, id, 0.4 * CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END FROM l1 WINDOW w AS (PARTITION BY query_id)),
f AS (SELECT query_id, id, round(sum(part), 6) AS score FROM n GROUP BY ALL)
SELECT query_id, id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM f) y WHERE rank <= 10""")
def hybrid_search_scores(t: Tables) -> DataFrame:
    words, near = _legs(t)
    return se.top_k(se.weighted_scores({"dense": (near, 0.6), "bm25": (words, 0.4)}), 10)


@query(f"""WITH {CHUNKS}, {PARTS}, {BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM lex)
SELECT query_id, id, CAST(rank AS INT) AS rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank <= 30 THEN 0 ELSE 1 END, CASE WHEN rank <= 30 THEN char_end - char_start END DESC NULLS LAST, rank) AS INT) AS new_rank FROM r JOIN chunks ON chunk_id = id WHERE rank <= 50""")
def reranked_passages(t: Tables) -> DataFrame:
    """The reranker of the test is the length of the passage."""
    hits = _lexical(t, 50).drop("score").join(_chunks(t).select(F.col("chunk_id").alias("id"), (F.col("char_end") - F.col("char_start")).alias("size")), "id")
    return se.rerank(hits, F.col("size")).select("query_id", "id", "rank", "new_rank")


@query(f"""WITH {CHUNKS}, b AS (SELECT doc_id, chunk_id, chunk_text, coalesce(sum(length(chunk_text)) OVER (PARTITION BY doc_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM chunks)
SELECT doc_id, chunk_id, substr(chunk_text, 1, CAST(1000 - spent AS BIGINT)) AS chunk_text, length(chunk_text) > 1000 - spent AS cut FROM b WHERE spent < 1000""")
def character_budget(t: Tables) -> DataFrame:
    return ch.character_budget(_chunks(t), "doc_id", ["position"], "chunk_text", 1000).select("doc_id", "chunk_id", "chunk_text", "cut")


@query(f"SELECT doc_id, array_to_string({TOKENS.format('text')}, ' ') AS terms, substr(text, 1, 240) AS snippet FROM documents")
def lexical_query_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(tx.tokens(F.col("text")), " ").alias("terms"), tx.snippet(F.col("text")).alias("snippet"))


@query(f"""WITH {CHUNKS}, n AS (SELECT chunk_id, lag(chunk_id) OVER w AS previous_chunk, lead(chunk_id) OVER w AS next_chunk, first_value(chunk_id) OVER w AS first_chunk, count(*) OVER (PARTITION BY doc_id) AS siblings FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY position)) SELECT * FROM n""")
def navigate_chunks(t: Tables) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("position")
    return _chunks(t).select("chunk_id", F.lag("chunk_id").over(order).alias("previous_chunk"), F.lead("chunk_id").over(order).alias("next_chunk"), F.first("chunk_id").over(order).alias("first_chunk"), F.count("*").over(Window.partitionBy("doc_id")).alias("siblings"))


@query(f"""WITH {CHUNKS}, want AS (SELECT doc_id, n_chars // 4 AS s, (3 * n_chars) // 4 AS e FROM documents),
o AS (SELECT w.doc_id, s, e, greatest(s, char_start) AS a, least(e, char_end) AS b, substr(chunk_text, greatest(s, char_start) - char_start + 1, least(e, char_end) - greatest(s, char_start)) AS piece, char_start, char_end FROM want w JOIN chunks c ON c.doc_id = w.doc_id AND char_start < e AND char_end > s),
g AS (SELECT *, CASE WHEN lag(char_end) OVER (PARTITION BY doc_id ORDER BY char_start) < char_start THEN 1 ELSE 0 END AS gap FROM o),
h AS (SELECT *, sum(gap) OVER (PARTITION BY doc_id ORDER BY char_start) AS run FROM g),
r AS (SELECT doc_id, min(a) AS covered_start, max(b) AS covered_end, string_agg(piece, '' ORDER BY char_start) AS text, any_value(s) AS s, any_value(e) AS e FROM h WHERE run = 0 GROUP BY doc_id)
SELECT w.doc_id, CAST(covered_start AS BIGINT) AS covered_start, CAST(least(covered_end, covered_start + 4000) AS BIGINT) AS covered_end, substr(text, 1, 4000) AS text,
CASE WHEN text IS NULL THEN 'UNAVAILABLE' WHEN length(text) > 4000 THEN 'TRUNCATED' WHEN covered_start <> w.s OR covered_end <> w.e THEN 'PARTIAL' ELSE 'OK' END AS status FROM want w LEFT JOIN r USING (doc_id)""")
def fetch_spans(t: Tables) -> DataFrame:
    """The middle half of each document, stitched from its chunks up to the first inner gap."""
    want = t.documents.selectExpr("doc_id", "n_chars div 4 as s", "(3 * n_chars) div 4 as e")
    met = want.join(_chunks(t), "doc_id").where("char_start < e and char_end > s")
    met = met.withColumn("a", F.greatest("s", "char_start")).withColumn("b", F.least("e", "char_end"))
    met = met.withColumn("piece", F.expr("substring(chunk_text, cast(a - char_start + 1 as int), cast(b - a as int))"))
    order = Window.partitionBy("doc_id").orderBy("char_start")
    met = met.withColumn("gap", F.when(F.lag("char_end").over(order) < F.col("char_start"), 1).otherwise(0))
    met = met.withColumn("run", F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("run = 0")
    joined = met.groupBy("doc_id").agg(F.min("a").alias("covered_start"), F.max("b").alias("stop"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("char_start", "piece"))), lambda x: x["piece"]), "").alias("whole"))
    return want.join(joined, "doc_id", "left").selectExpr(
        "doc_id", "covered_start", "least(stop, covered_start + 4000) as covered_end", "substring(whole, 1, 4000) as text",
        "case when whole is null then 'UNAVAILABLE' when length(whole) > 4000 then 'TRUNCATED' when covered_start <> s or stop <> e then 'PARTIAL' else 'OK' end as status",
    )


@query(f"""WITH {CHUNKS}, ids AS (SELECT chunk_id, doc_id, 'ev1:s:' || doc_id || ':' || substr(content_hash, 1, 16) || ':' || char_start || '-' || char_end AS fetched, CASE position % 4 WHEN 0 THEN 'ev1:s:' || doc_id || ':' || substr(content_hash, 1, 16) || ':' || char_start || '-' || char_end WHEN 1 THEN 'ev1:s:' || doc_id || ':' || substr(content_hash, 1, 16) || ':' || char_start || '-' || (char_start + 1) WHEN 2 THEN 'ev1:s:' || doc_id || ':' || substr(content_hash, 1, 16) || ':' || char_start || '-' || (char_end + 9) ELSE 'ev9:' || chunk_id END AS cited, char_start, char_end, position FROM chunks)
SELECT chunk_id, CASE WHEN position % 4 = 3 OR (position % 4 = 1 AND char_start >= char_start + 1) THEN 'MALFORMED' WHEN lang NOT IN ('en', 'fr') THEN 'UNAVAILABLE' WHEN position % 4 IN (0, 1) THEN 'VALID' ELSE 'NOT_FETCHED' END AS verdict FROM ids JOIN documents USING (doc_id)""")
def citation_verdicts(t: Tables) -> DataFrame:
    """Each chunk is fetched; citations are its own id, a part of it, more than it, and no id at all."""
    own = ch.text_references(_chunks(t)).join(_chunks(t), "chunk_id").join(t.documents.select("doc_id", "lang"), "doc_id")
    name = lambda end: tx.span_id(F.col("doc_id"), F.col("content_hash"), F.col("char_start"), end)
    kind = F.col("position") % 4
    cited = own.withColumn("cited", F.when(kind == 0, F.col("evidence_id")).when(kind == 1, name(F.col("char_start") + 1)).when(kind == 2, name(F.col("char_end") + 9)).otherwise(F.concat(F.lit("ev9:"), "chunk_id")))
    cited = cited.withColumn("c", tx.decode_evidence_id(F.col("cited"))).withColumn("f", tx.decode_evidence_id(F.col("evidence_id")))
    inside = (F.col("c.doc") == F.col("f.doc")) & (F.col("c.hash") == F.col("f.hash")) & (F.col("c.start") >= F.col("f.start")) & (F.col("c.end") <= F.col("f.end"))
    verdict = F.when(F.col("c.kind").isNull(), "MALFORMED").when(~F.col("lang").isin("en", "fr"), "UNAVAILABLE").when((F.col("cited") == F.col("evidence_id")) | inside, "VALID").otherwise("NOT_FETCHED")
    return cited.select("chunk_id", verdict.alias("verdict"))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT vec_id, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS norm, round(list_sum(list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y))))), 5) AS unit_sum FROM v""")
def unit_vectors(t: Tables) -> DataFrame:
    e = F.col("embedding")
    return t.embeddings.select("vec_id", F.round(vec.norm(e), 6).alias("norm"), F.round(F.aggregate(vec.unit(e), F.lit(0.0), lambda s, x: s + x), 5).alias("unit_sum"))
