"""Queries of logs, steps, decisions, candidates and document lifecycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators import history as hs
from skein.operators import merge as mg
from skein.plans.registry import Tables, query


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq FROM conversations")
def task_event_log(t: Tables) -> DataFrame:
    turns = t.conversations.select("conv_id", "turn", "role")
    return hs.append(turns.where("false").withColumn("seq", F.lit(0)), turns, "conv_id", ["turn"]).withColumn("seq", F.col("seq").cast("long"))


@query("""WITH o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events WHERE event_type <> 'error'),
n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type = 'error')
SELECT n.user_id, n.event_id, coalesce((SELECT max(seq) FROM o WHERE o.user_id = n.user_id), 0) + k AS seq FROM n""")
def appended_events(t: Tables) -> DataFrame:
    """Errors are appended behind the other events of their user."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    old = t.events.where("event_type != 'error'").select("user_id", F.row_number().over(order).alias("seq"))
    return hs.append(old, t.events.where("event_type = 'error'").select("user_id", "event_id"), "user_id", ["event_id"]).withColumn("seq", F.col("seq").cast("long"))


@query("""WITH r AS (SELECT event_id, user_id, event_type, first_value(props) OVER w AS f, props, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id))
SELECT event_id, CASE WHEN n = 1 THEN 'stored' WHEN props = f THEN 'replayed' ELSE 'request_id_reused' END AS outcome FROM r""")
def idempotent_requests(t: Tables) -> DataFrame:
    """(user, type) stands for the request id and props for the digest."""
    return hs.replay(t.events, ["user_id", "event_type"], "props", ["event_id"]).select("event_id", "outcome")


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(round(value, 6), event_id) AS value FROM events GROUP BY ALL")
def latest_step_state(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))
    return hs.latest(rows, ["user_id", "event_type"], F.col("event_id"))


STEP = """CASE event_type WHEN 'error' THEN 'blocked' WHEN 'click' THEN 'in_progress' WHEN 'view' THEN 'pending' WHEN 'purchase' THEN 'completed' ELSE 'cancelled' END"""


@query(f"""WITH s AS (SELECT user_id AS task, event_id AS name, {STEP} AS state FROM events), r AS (SELECT *, CAST(list_position(['blocked', 'in_progress', 'pending', 'completed', 'cancelled'], state) AS INT) AS state_rank, CAST(row_number() OVER (PARTITION BY task, state ORDER BY name) AS INT) AS place, count(*) OVER (PARTITION BY task, state) AS in_state FROM s)
SELECT *, in_state > 5 AS cut FROM r WHERE place <= 5""")
def resumed_steps(t: Tables) -> DataFrame:
    steps = t.events.select(F.col("user_id").alias("task"), F.col("event_id").alias("name"), F.expr(STEP).alias("state"))
    return hs.grouped_steps(steps, "task", "state", "name", 5)


@query("SELECT event_type AS choice, count(DISTINCT props) AS conclusions, count(DISTINCT user_id) AS tasks FROM events GROUP BY 1 HAVING count(DISTINCT props) > 1 AND count(DISTINCT user_id) > 1")
def decision_conflicts(t: Tables) -> DataFrame:
    return hs.conflicts(t.events.withColumnRenamed("event_type", "choice"), "choice", "props", "user_id")


@query("""SELECT o_orderkey FROM orders a WHERE EXISTS (SELECT 1 FROM orders b WHERE b.o_orderdate = a.o_orderdate AND b.o_custkey <> a.o_custkey AND b.o_orderpriority <> a.o_orderpriority)""")
def conflicting_decisions(t: Tables) -> DataFrame:
    """The date stands for the choice, the customer for the task and the priority for the conclusion."""
    return hs.conflicting(t.orders, "o_orderdate", "o_orderpriority", "o_custkey").select("o_orderkey")


CANDIDATES = """c AS (SELECT 'c' || event_id AS id, event_type || '|' || regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS key, CASE WHEN value > 100 THEN 'approved' WHEN value < 5 THEN 'rejected' ELSE 'pending' END AS state, 1 AS n, round(value, 6) AS confidence, user_id AS chunk, ts::DATE AS doc FROM events)"""


def _candidates(t: Tables) -> DataFrame:
    state = "case when value > 100 then 'approved' when value < 5 then 'rejected' else 'pending' end as state"
    return t.events.selectExpr("concat('c', event_id) as id", "concat(event_type, '|', get_json_object(props, '$.k')) as key", state, "1 as n", "round(value, 6) as confidence", "user_id as chunk", "cast(ts as date) as doc")


@query(f"WITH {CANDIDATES} SELECT key, state, CAST(sum(n) AS BIGINT) AS total, max(confidence) AS confidence, min(id) AS representative, count(DISTINCT chunk) AS chunks, count(DISTINCT doc) AS docs FROM c GROUP BY key, state HAVING sum(n) >= 3")
def candidate_groups(t: Tables) -> DataFrame:
    return hs.listed(_candidates(t), 3)


@query(f"WITH {CANDIDATES} SELECT state, count(*) AS n FROM c GROUP BY state")
def candidate_state_counts(t: Tables) -> DataFrame:
    return _candidates(t).groupBy("state").agg(F.count("*").alias("n"))


@query(f"WITH {CANDIDATES} SELECT id, key FROM c WHERE key NOT IN (SELECT key FROM c WHERE state <> 'pending')")
def unreviewed_candidates(t: Tables) -> DataFrame:
    found = _candidates(t)
    return found.select("id", "key").join(found.where("state != 'pending'").select("key"), "key", "left_anti").select("id", "key")


@query(f"""WITH {CANDIDATES}, w AS (SELECT id, CASE WHEN confidence > 50 THEN 'approved' ELSE 'rejected' END AS wanted FROM c WHERE chunk > 10)
SELECT c.id, CASE WHEN wanted IS NOT NULL AND wanted <> state THEN wanted ELSE state END AS state, wanted IS NOT NULL AND wanted <> state AS changed FROM c LEFT JOIN w USING (id)""")
def candidate_review(t: Tables) -> DataFrame:
    found = _candidates(t)
    wanted = found.where("chunk > 10").selectExpr("id", "case when confidence > 50 then 'approved' else 'rejected' end as to")
    return hs.review(found.select("id", "state"), wanted)


@query(f"WITH {CANDIDATES}, terms AS (SELECT *, CAST(contains(key, 'click') AS INT) + CAST(contains(key, '7') AS INT) + CAST(contains(state, 'pend') AS INT) AS score FROM c) SELECT key, state, score, count(*) AS total FROM terms WHERE score > 0 GROUP BY ALL")
def candidate_term_search(t: Tables) -> DataFrame:
    hits = F.aggregate(F.array(F.contains("key", F.lit("click")), F.contains("key", F.lit("7")), F.contains("state", F.lit("pend"))), F.lit(0), lambda n, x: n + x.cast("int"))
    return _candidates(t).withColumn("score", hits).where("score > 0").groupBy("key", "state", "score").agg(F.count("*").alias("total"))


ESC = """e AS (SELECT l_orderkey AS doc, min(o_custkey) AS scope, count(*) FILTER (l_discount >= 0.02) AS kept, bool_or(l_discount BETWEEN 0.02 AND 0.06) AS weak, count(*) FILTER (l_returnflag = 'A') AS relations, CAST(sum(l_quantity) AS BIGINT) AS words, min(l_discount) FILTER (l_discount >= 0.02) AS weakest FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1),
g AS (SELECT *, CASE WHEN kept = 0 AND words >= 8 THEN 2 WHEN kept > 0 AND weak THEN CASE WHEN kept >= 2 AND relations = 0 THEN 0 ELSE 1 END END AS grp, CASE WHEN kept = 0 THEN 0.0 ELSE coalesce(weakest, 1.0) END AS score, greatest(1, ceil(round(count(*) OVER (PARTITION BY scope) * 0.2, 9))) AS allowed FROM e)"""


@query(f"WITH {ESC} SELECT doc, grp, score, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY scope ORDER BY grp, score, doc) AS INT) AS place FROM g WHERE grp IS NOT NULL) x WHERE place <= allowed")
def escalated_chunks(t: Tables) -> DataFrame:
    """An order stands for a chunk, its lines for spans, the discount for confidence, the customer for the batch."""
    lines = t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    kept = F.col("l_discount") >= 0.02
    chunks = lines.groupBy(F.col("l_orderkey").alias("position")).agg(F.min("o_custkey").alias("scope"), F.count_if(kept).alias("kept"), F.bool_or(F.col("l_discount").between(0.02, 0.06)).alias("weak"), F.count_if(F.col("l_returnflag") == "A").alias("relations"), F.sum("l_quantity").cast("long").alias("words"), F.min(F.when(kept, F.col("l_discount"))).alias("weakest"))
    return hs.escalation(chunks, 0.2, ["scope"]).select(F.col("position").alias("doc"), "grp", "score", "place")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS activation_seq FROM orders")
def activation_feed(t: Tables) -> DataFrame:
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select("o_custkey", "o_orderkey", F.row_number().over(order).cast("long").alias("activation_seq"))


@query("""WITH c AS (SELECT c_custkey AS id, c_mktsegment AS content, CASE WHEN c_acctbal < 0 THEN DATE '2023-01-01' END AS invalid_at FROM customer),
n AS (SELECT c_custkey AS id, CASE WHEN c_nationkey < 5 THEN 'MOVED' ELSE c_mktsegment END AS content FROM customer WHERE c_nationkey <> 7)
SELECT c.id, c.content, DATE '2022-01-01' AS valid_at, CASE WHEN c.invalid_at IS NOT NULL THEN c.invalid_at WHEN n.id IS NULL OR n.content <> c.content THEN DATE '2024-01-01' END AS invalid_at FROM c LEFT JOIN n USING (id)
UNION ALL SELECT n.id, n.content, DATE '2024-01-01', NULL FROM n LEFT JOIN c ON c.id = n.id AND c.invalid_at IS NULL WHERE c.id IS NULL OR c.content <> n.content""")
def version_history(t: Tables) -> DataFrame:
    date = lambda x: F.lit(x).cast("date")
    current = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("content"), date("2022-01-01").alias("valid_at"), F.when(F.col("c_acctbal") < 0, date("2023-01-01")).alias("invalid_at"))
    new = t.customer.where("c_nationkey != 7").selectExpr("c_custkey as id", "case when c_nationkey < 5 then 'MOVED' else c_mktsegment end as content")
    return mg.close_versions(current, new, "id", ["content"], date("2024-01-01"))


@query("""SELECT doc_id, CASE WHEN source = 'src1' THEN 'NEW_VERSION' WHEN lang = 'fr' THEN 'NEW_VERSION' WHEN lang = 'de' THEN 'IN_PLACE' WHEN n_chars > 5000 THEN 'METADATA_ONLY' ELSE 'NO_OP' END AS kind FROM documents""")
def update_decisions(t: Tables) -> DataFrame:
    base = t.documents.select("doc_id", F.sha2("text", 256).alias("content_hash"), F.lit("v1").alias("version_id"), F.lit("c").alias("chunker_hash"), F.lit("s").alias("schema_fingerprint"), F.lit("x").alias("extraction_fingerprint"), F.lit("2024").alias("dated"), F.when(F.col("source") == "src1", 0).otherwise(1).alias("open_chunks"), F.lit(False).alias("force"), "lang", "n_chars")
    new = base.withColumn("version_id", F.when(F.col("lang") == "fr", "v2").otherwise("v1")).withColumn("force", F.col("lang") == "de").withColumn("dated", F.when(F.col("n_chars") > 5000, "2025").otherwise("2024"))
    return base.alias("o").join(new.alias("n"), "doc_id").select("doc_id", mg.update_kind("o", "n").alias("kind"))


@query("""WITH j AS (SELECT o_custkey AS id, arg_max(o_orderstatus, o_orderkey) AS job, bool_or(o_orderpriority = '1-URGENT') AS has_current FROM orders GROUP BY 1)
SELECT c_custkey AS id, CASE WHEN job IS NULL THEN 'UNKNOWN' WHEN job = 'P' THEN 'PENDING' WHEN job = 'F' AND NOT has_current THEN 'DELETED' WHEN has_current THEN 'CURRENT' ELSE 'FAILED' END AS state FROM customer LEFT JOIN j ON j.id = c_custkey""")
def source_states(t: Tables) -> DataFrame:
    """Orders stand for the jobs of a source; the last one's status and any urgent one decide."""
    jobs = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.max_by("o_orderstatus", "o_orderkey").alias("job"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("has_current"))
    state = F.when(F.col("job").isNull(), "UNKNOWN").when(F.col("job") == "P", "PENDING").when((F.col("job") == "F") & ~F.col("has_current"), "DELETED").when(F.col("has_current"), "CURRENT").otherwise("FAILED")
    return t.customer.select(F.col("c_custkey").alias("id")).join(jobs, "id", "left").select("id", state.alias("state"))


@query("SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN '[REDACTED]' ELSE props END AS props, sha256(props) AS props_sha256, event_type = 'error' AS redacted FROM events")
def redacted_events(t: Tables) -> DataFrame:
    gone = F.col("event_type") == "error"
    return t.events.select("event_id", "user_id", F.when(gone, "[REDACTED]").otherwise(F.col("props")).alias("props"), F.sha2("props", 256).alias("props_sha256"), gone.alias("redacted"))


@query("SELECT c_custkey AS task FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def deleted_task_cascade(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("task")).join(t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("task")), "task", "left_anti")


@query("""SELECT user_id, date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def windowed_events(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", F.window("ts", "1 day").start.alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
