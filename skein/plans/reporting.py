"""Queries of citations, states and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators import reports as rp
from skein.operators import search as se
from skein.plans.registry import Tables, query


@query("""WITH e AS (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY ALL) SELECT user_id, event_type, 'E' || row_number() OVER (PARTITION BY user_id ORDER BY f, event_type) AS key FROM e""")
def citation_keys(t: Tables) -> DataFrame:
    return rp.keys_by_appearance(t.events, "user_id", "event_id", "event_type", "E")


@query("""WITH a AS (SELECT o_custkey AS key, string_agg('order [ev1:c:' || o_orderpriority || ']', ' ' ORDER BY o_orderkey) AS text FROM orders GROUP BY 1),
f AS (SELECT o_custkey AS key, o_orderpriority AS p, min(o_orderkey) AS k FROM orders GROUP BY ALL), n AS (SELECT key, p, row_number() OVER (PARTITION BY key ORDER BY k) AS number FROM f)
SELECT key, string_agg(number || '. ev1:c:' || p, chr(10) ORDER BY number) AS sources, any_value(len(text)) AS size FROM n JOIN a USING (key) GROUP BY key""")
def cited_sources(t: Tables) -> DataFrame:
    """An answer of each customer cites the priorities of their orders."""
    said = F.concat(F.lit("order [ev1:c:"), F.replace("o_orderpriority", F.lit(" "), F.lit("_")), F.lit("]"))
    answers = t.orders.groupBy(F.col("o_custkey").alias("key")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", said.alias("s")))), lambda x: x["s"]), " ").alias("text"))
    done = rp.rendered(answers, "key", "text").join(answers.select("key", F.length("text").cast("long").alias("size")), "key")
    return done.select("key", F.replace("sources", F.lit("_"), F.lit(" ")).alias("sources"), "size")


@query("""WITH s AS (SELECT user_id, string_agg(event_type, ',' ORDER BY event_id) AS s FROM events GROUP BY 1) SELECT user_id, regexp_matches(s, '(^|,)view(,.*,|,)click(,.*,|,)purchase(,|$)') AS ordered FROM s""")
def ordered_steps(t: Tables) -> DataFrame:
    steps = t.events.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]).alias("s"))
    return steps.select("user_id", rp.is_subsequence(F.col("s"), F.array(F.lit("view"), F.lit("click"), F.lit("purchase"))).alias("ordered"))


@query("""WITH n AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_partkey, l_suppkey) AS n FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, CAST(max(l_linenumber - n) OVER (PARTITION BY l_orderkey ORDER BY n) + n AS INT) AS place FROM n""")
def free_orders(t: Tables) -> DataFrame:
    lines = t.lineitem.withColumn("tie", F.struct("l_extendedprice", "l_partkey", "l_suppkey"))
    return rp.free_orders(lines, "l_orderkey", "l_linenumber", "tie").select("l_orderkey", "l_partkey", "l_suppkey", F.col("place").cast("int").alias("place"))


@query("""SELECT c_custkey AS id, '| ' || c_name || ' | ' || c_mktsegment || ' | ' || c_nationkey || ' |' AS row FROM customer""")
def markdown_rows(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("id"), rp.markdown_rows(F.array("c_name", "c_mktsegment", F.col("c_nationkey").cast("string"))).alias("row"))


@query("""SELECT user_id, count(*) AS legs, count(*) FILTER (event_type = 'error') AS failed, CASE WHEN count(*) FILTER (event_type = 'error') = count(*) THEN 'FAILED' WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'PARTIAL' WHEN count(*) FILTER (event_type = 'purchase') = 0 THEN 'NO_MATCH' ELSE 'OK' END AS status FROM events GROUP BY user_id, ts::DATE""")
def search_states(t: Tables) -> DataFrame:
    legs = t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("legs"), F.count_if(F.col("event_type") == "error").alias("failed"), F.count_if(F.col("event_type") == "purchase").alias("hits"))
    return legs.select("user_id", "legs", "failed", rp.search_status(F.col("failed"), F.col("legs"), F.col("hits")).alias("status"))


@query()
def assigned_spans(t: Tables) -> DataFrame:
    """Suppliers of an order are assigned to its parts by quantity."""
    pairs = t.lineitem.groupBy(F.col("l_orderkey").alias("case"), F.col("l_partkey").alias("gold"), F.col("l_suppkey").alias("found")).agg(F.sum("l_quantity").alias("overlap"))
    return rp.assign(pairs, "case")


@query("""WITH h AS (SELECT l_orderkey AS id, bool_or(l_returnflag = 'R' AND p_size > 45) AS removed, bool_or(l_returnflag = 'R') AS cited FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 40 GROUP BY 1)
SELECT o_orderkey AS id, CASE WHEN cited IS NULL THEN CASE WHEN o_orderstatus = 'P' THEN 'asked' END WHEN removed THEN 'source_removed' WHEN cited THEN 'source_changed' WHEN o_orderstatus = 'P' THEN 'asked' ELSE 'consulted_source_changed' END AS reason FROM orders LEFT JOIN h ON h.id = o_orderkey""")
def flagged_decisions(t: Tables) -> DataFrame:
    """Orders decide on parts: returned lines cite them, others consulted them; large parts changed, the largest were deleted."""
    decisions = t.orders.selectExpr("o_orderkey as id", "case when o_orderstatus = 'P' then 'asked' end as reason")
    supports = t.lineitem.selectExpr("l_orderkey as id", "l_partkey as source", "case when l_returnflag = 'R' then 'cited' else 'consulted' end as role")
    return rp.flag_decisions(decisions, supports, t.part.where("p_size > 40").selectExpr("p_partkey as source", "case when p_size > 45 then 'delete' else 'update' end as verb"))


@query("""WITH m AS (SELECT p_brand AS community, l_orderkey AS chunk, count(DISTINCT p_partkey) AS overlap, list_sort(list_distinct(list(p_name)))[1:5] AS names FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT community, chunk, overlap, array_to_string(names, ',') AS names, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY community ORDER BY overlap DESC, chunk) AS INT) AS place FROM m) x WHERE place <= 5""")
def theme_passages(t: Tables) -> DataFrame:
    part = t.part.selectExpr("p_partkey as id", "p_brand as community", "p_name as name")
    return rp.theme_support(part.select("id", "community"), t.lineitem.selectExpr("l_partkey as id", "l_orderkey as chunk").distinct(), part.select("id", "name"), 5)


@query("""WITH v AS (SELECT l_partkey AS entity, o_orderstatus <> 'P' AS visible, CAST(l_orderkey AS VARCHAR) AS chunk_id, min(l_linenumber) AS position FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2, 3)
SELECT entity, visible, chunk_id, position, support_no FROM (SELECT *, CAST(row_number() OVER (PARTITION BY entity ORDER BY visible DESC, position, chunk_id) AS INT) AS support_no FROM v) x WHERE support_no <= 3""")
def entity_supports(t: Tables) -> DataFrame:
    met = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = met.groupBy(F.col("l_partkey").alias("entity"), (F.col("o_orderstatus") != "P").alias("visible"), F.col("l_orderkey").cast("string").alias("chunk_id")).agg(F.min("l_linenumber").alias("position"))
    return se.supports(rows, 3)


@query("""WITH r AS (SELECT label, vec_id, embedding[1] AS s FROM embeddings) SELECT label, vec_id, round(s, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS n FROM r) x WHERE n = 1""")
def best_per_label(t: Tables) -> DataFrame:
    rows = t.embeddings.select("label", "vec_id", F.get("embedding", F.lit(0)).alias("s"))
    return se.best_per(rows, ["label"], [F.desc("s"), F.asc("vec_id")]).select("label", "vec_id", F.round("s", 5).alias("score"))


@query("SELECT type, count(*) AS n FROM (SELECT 'PLACED' AS type FROM orders UNION ALL SELECT 'CONTAINS' FROM lineitem) x GROUP BY type")
def relation_types(t: Tables) -> DataFrame:
    return t.orders.select(F.lit("PLACED").alias("type")).union(t.lineitem.select(F.lit("CONTAINS"))).groupBy("type").agg(F.count("*").alias("n"))


@query("""SELECT user_id, event_id, sum(length(props)) OVER (PARTITION BY user_id ORDER BY event_id) AS size FROM events QUALIFY sum(length(props)) OVER (PARTITION BY user_id ORDER BY event_id) <= 200""")
def response_budget(t: Tables) -> DataFrame:
    """What fits into 200 characters a user; the rest is dropped from the first that doesn't."""
    size = F.sum(F.length("props")).over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))
    return t.events.select("user_id", "event_id", size.alias("size")).where("size <= 200")
