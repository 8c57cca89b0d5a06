"""Queries of measures, of sources, and of reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import evaluate as ev
from skein.plans.registry import Tables, query
from skein.sources import readers as rd

F1 = "CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END"


def _labels(t: Tables) -> DataFrame:
    """Found quality: texts of some length."""
    return t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").selectExpr("doc_id", "quality as gold", "case when n_chars > 600 then 1 else 0 end as found")


LAB = "l AS (SELECT doc_id, quality AS gold, CASE WHEN n_chars > 600 THEN 1 ELSE 0 END AS found FROM labels JOIN documents USING (doc_id))"


@query(f"""WITH {LAB}, c AS (SELECT count(*) FILTER (gold = 1 AND found = 1) AS hit, count(*) FILTER (gold = 1) AS g, count(*) FILTER (found = 1) AS f FROM l), v AS (SELECT hit / f AS p, hit / g AS r FROM c)
SELECT round(p, 6) AS precision, round(r, 6) AS recall, round({F1}, 6) AS f1 FROM v""")
def pooled_scores(t: Tables) -> DataFrame:
    rows = _labels(t)
    return ev.pooled(rows.where("gold = 1"), rows.where("found = 1"), ["doc_id"])


@query(f"""WITH {LAB}, c AS (SELECT k AS class, (SELECT count(*) FROM l WHERE gold = k AND found = k) AS hit, (SELECT count(*) FROM l WHERE gold = k) AS g, (SELECT count(*) FROM l WHERE found = k) AS f FROM (SELECT DISTINCT gold AS k FROM l UNION SELECT DISTINCT found FROM l) x),
v AS (SELECT class, CASE WHEN f = 0 THEN 1.0 ELSE hit / f END AS p, CASE WHEN g = 0 THEN 1.0 ELSE hit / g END AS r FROM c) SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round({F1}, 6) AS f1 FROM v""")
def per_class_scores(t: Tables) -> DataFrame:
    return ev.per_class(_labels(t), "gold", "found")


@query(f"""WITH {LAB} SELECT gold, count(*) FILTER (found = 0) AS "0", count(*) FILTER (found = 1) AS "1" FROM l GROUP BY gold""")
def confusion_matrix(t: Tables) -> DataFrame:
    return ev.confusion(_labels(t), "gold", "found", [0, 1])


CELLS = "x AS (SELECT p_partkey AS id, p_name AS g, p_name || p_brand AS f FROM part)"


def _clusters(t: Tables) -> tuple[DataFrame, DataFrame]:
    return t.part.selectExpr("p_partkey as id", "p_name as cluster"), t.part.selectExpr("p_partkey as id", "concat(p_brand, substring(p_name, 1, 3)) as cluster")


BX = "x AS (SELECT p_partkey AS id, p_name AS g, p_brand || substr(p_name, 1, 3) AS f FROM part)"


@query(f"""WITH {BX}, c AS (SELECT g, f, count(*) AS n FROM x GROUP BY ALL), fs AS (SELECT f, count(*) AS fn FROM x GROUP BY f), gs AS (SELECT g, count(*) AS gn FROM x GROUP BY g),
v AS (SELECT sum(n * n / fn) / sum(n) AS p, sum(n * n / gn) / sum(n) AS r FROM c JOIN fs USING (f) JOIN gs USING (g)) SELECT round(p, 6) AS precision, round(r, 6) AS recall, round({F1}, 6) AS f1 FROM v""")
def bcubed_scores(t: Tables) -> DataFrame:
    return ev.bcubed(*_clusters(t))


@query(f"""WITH {BX}, c AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM x GROUP BY g, f) a) AS both_, (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM x GROUP BY f) a) AS f, (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM x GROUP BY g) a) AS g),
v AS (SELECT both_ / f AS p, both_ / g AS r FROM c) SELECT round(p, 6) AS precision, round(r, 6) AS recall, round({F1}, 6) AS f1 FROM v""")
def pairwise_scores(t: Tables) -> DataFrame:
    return ev.pairwise(*_clusters(t))


@query("""SELECT event_type AS metric, CAST(NULL AS BIGINT) AS grp, round(avg(greatest(0, least(1, value / 100))), 12) AS mean, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT event_type, user_id, round(avg(greatest(0, least(1, value / 100))), 12), count(*) FROM events GROUP BY 1, 2""")
def metric_means(t: Tables) -> DataFrame:
    return ev.means(t.events.withColumn("v", F.col("value") / 100), "user_id", "event_type", "v")


@query("""WITH g AS (SELECT doc_id AS "case", 0 AS s, n_chars // 2 AS e FROM documents), f AS (SELECT doc_id AS "case", n_chars // 4 AS s, n_chars AS e FROM documents)
SELECT "case", round(CASE WHEN f.e - f.s = 0 THEN 1.0 ELSE greatest(0, least(g.e, f.e) - greatest(g.s, f.s)) / (f.e - f.s) END, 6) AS precision, round(CASE WHEN g.e - g.s = 0 THEN 1.0 ELSE greatest(0, least(g.e, f.e) - greatest(g.s, f.s)) / (g.e - g.s) END, 6) AS recall FROM g JOIN f USING ("case")""")
def span_scores(t: Tables) -> DataFrame:
    gold = t.documents.selectExpr("doc_id as case", "0L as start", "n_chars div 2 as end")
    return ev.span_overlap(gold, t.documents.selectExpr("doc_id as case", "n_chars div 4 as start", "n_chars as end"))


@query()
def answer_rouge(t: Tables) -> DataFrame:
    """Each message against the one before it."""
    from pyspark.sql import Window

    order = Window.partitionBy("conv_id").orderBy("turn")
    pairs = t.conversations.select("conv_id", "turn", "text", F.coalesce(F.lag("text").over(order), F.lit("")).alias("before"))
    return ev.rouge_l(pairs, "before", "text").select("conv_id", "turn", "rouge_l")


@query("""SELECT conv_id AS conversation, string_agg('[' || role || '] ' || text, chr(10) || chr(10) ORDER BY turn) AS text, count(*) AS messages FROM conversations GROUP BY conv_id""")
def chat_documents(t: Tables) -> DataFrame:
    return rd.chat(t.conversations, "conv_id", "turn", "role", "text")


@query("""WITH s AS (SELECT conv_id, turn, length(role) + length(text) + 3 AS size FROM conversations), e AS (SELECT *, CAST(sum(size + 2) OVER (PARTITION BY conv_id ORDER BY turn) - 2 AS BIGINT) AS char_end FROM s)
SELECT conv_id AS conversation, turn, char_end - size AS char_start, char_end FROM e""")
def chat_message_offsets(t: Tables) -> DataFrame:
    return rd.chat_offsets(t.conversations, "conv_id", "turn", "role", "text")


@query(r"""WITH t AS (SELECT page_id, regexp_replace(html, '(?s)<(script|style)\b.*?</(script|style)>|<!--.*?-->|<[^>]*>', ' ', 'g') AS x FROM pages),
e AS (SELECT page_id, replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS x FROM t)
SELECT page_id, trim(regexp_replace(x, '\s+', ' ', 'g'), ' ') AS text FROM e""")
def page_texts(t: Tables) -> DataFrame:
    return t.pages.select("page_id", rd.html_text(F.col("html")).alias("text"))


@query(r"""SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), ' '), '') AS title, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages""")
def page_titles(t: Tables) -> DataFrame:
    return t.pages.select("page_id", rd.html_title(F.col("html")).alias("title"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"))


@query("""SELECT source, lang, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS characters, count(DISTINCT sha256(text)) AS contents FROM documents GROUP BY ALL""")
def ingestion_report(t: Tables) -> DataFrame:
    return t.documents.groupBy("source", "lang").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("characters"), F.count_distinct(F.sha2("text", 256)).alias("contents"))


@query("""SELECT doc_id, sha256(text) AS content_hash, length(text) AS chars, len(string_split(text, chr(10))) AS lines FROM documents""")
def decoded_documents(t: Tables) -> DataFrame:
    clean = t.documents.select("doc_id", F.regexp_replace(F.regexp_replace("text", "^﻿", ""), "\r\n?", "\n").alias("text"))
    return clean.select("doc_id", F.sha2("text", 256).alias("content_hash"), F.length("text").cast("long").alias("chars"), F.size(F.split("text", "\n")).cast("long").alias("lines"))
