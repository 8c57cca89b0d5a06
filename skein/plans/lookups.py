"""Queries of keyed reads, currency, sections, reports and task records.

On the test tables customers are documents, their orders the chunks (open unless of status F), line items the mentions of
parts; users are tasks, their events what happened, and turns of a conversation its sections.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import text as tx
from skein.operators import chunks as ch
from skein.operators import lookups as lk
from skein.plans.registry import Tables, query


def _parts(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("chunk_id"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("invalid_at"))


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def entities_by_id(t: Tables) -> DataFrame:
    ids = t.customer.where("c_mktsegment = 'BUILDING'").selectExpr("c_custkey as p_partkey")
    return lk.by_ids(t.part, ids, "p_partkey").select("p_partkey", "p_name")


@query("SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_linestatus = 'O') OR NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def chunks_open_or_bare(t: Tables) -> DataFrame:
    edges = t.lineitem.where("l_returnflag = 'R'").withColumnRenamed("l_orderkey", "o_orderkey")
    return lk.open_or_bare(t.orders, edges, "o_orderkey", F.col("l_linestatus") == "O").select("o_orderkey")


@query("SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings WHERE vec_id > 100) x WHERE n <= 7")
def vector_id_pages(t: Tables) -> DataFrame:
    """The page after id 100 of each kind of vector; its size is the feature."""
    return lk.page_after(t.embeddings, "label", "vec_id", F.lit(100), 7)


@query("SELECT DISTINCT p_partkey, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) AS present FROM part")
def existing_ids(t: Tables) -> DataFrame:
    return lk.existing(t.part.select("p_partkey"), t.lineitem.where("l_quantity > 45").selectExpr("l_partkey as p_partkey"), "p_partkey")


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max(o_orderdate) AS o_orderdate FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1")
def newest_open_chunks(t: Tables) -> DataFrame:
    return lk.newest(t.orders.where("o_orderstatus != 'F'"), "o_custkey", "o_orderdate", "o_orderkey", ["o_orderkey", "o_orderdate"])


@query("SELECT DISTINCT o_custkey AS doc_id, l_partkey AS entity_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def document_entities(t: Tables) -> DataFrame:
    return lk.mentioned_entities(_parts(t), t.lineitem.selectExpr("l_orderkey as chunk_id", "l_partkey as entity_id"))


@query("SELECT DISTINCT o_custkey AS doc_id, l_suppkey || '-' || l_partkey AS relation_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def document_relations(t: Tables) -> DataFrame:
    relations = t.lineitem.groupBy(F.concat_ws("-", "l_suppkey", "l_partkey").alias("relation_id")).agg(F.collect_set("l_orderkey").alias("source_chunk_ids"))
    return lk.cited_relations(_parts(t), relations)


@query("SELECT o_custkey AS doc_id, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS chunk_ids FROM orders GROUP BY 1")
def document_chunk_lists(t: Tables) -> DataFrame:
    ids = _parts(t).groupBy("doc_id").agg(F.array_sort(F.collect_list("chunk_id")).alias("ids"))
    return ids.select("doc_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("chunk_ids"))


@query("SELECT c_custkey AS doc_id, count(o_orderkey) FILTER (WHERE o_orderstatus <> 'F') AS open_parts, count(o_orderkey) FILTER (WHERE o_orderstatus <> 'F') > 0 AS live FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def document_currency(t: Tables) -> DataFrame:
    return lk.currency(t.customer.selectExpr("c_custkey as doc_id"), _parts(t), "doc_id")


@query("SELECT s_nationkey AS resolved_id, c_custkey AS member_id FROM customer JOIN (SELECT DISTINCT n_nationkey AS s_nationkey FROM nation WHERE n_regionkey <> 2 AND n_nationkey % 3 <> 0) x ON s_nationkey = c_nationkey")
def hidden_members(t: Tables) -> DataFrame:
    members = t.customer.selectExpr("c_nationkey as resolved_id", "c_custkey as member_id")
    return lk.hidden_members(members, t.nation.selectExpr("n_nationkey as resolved_id", "n_regionkey != 2 as active", "n_nationkey % 3 != 0 as synced"))


@query("""WITH e AS (SELECT l_partkey, l_orderkey FROM lineitem WHERE l_returnflag = 'A')
SELECT p_partkey, count(DISTINCT l_orderkey) AS n_chunks, min(l_orderkey) AS first_chunk FROM part JOIN e ON l_partkey = p_partkey WHERE p_size > 40 GROUP BY 1""")
def approved_evidence(t: Tables) -> DataFrame:
    """Parts of size above 40 stand for approved candidates."""
    evidence = t.lineitem.where("l_returnflag = 'A'").selectExpr("l_partkey as p_partkey", "l_orderkey").distinct()
    return t.part.where("p_size > 40").select("p_partkey").join(evidence, "p_partkey").groupBy("p_partkey").agg(F.count("*").alias("n_chunks"), F.min("l_orderkey").alias("first_chunk"))


@query("WITH o AS (SELECT lower(p_name) AS k, min(p_partkey) AS owner FROM part GROUP BY 1) SELECT p.p_partkey, o.owner, q.p_brand AS owner_label FROM part p JOIN o ON o.k = lower(p.p_name) JOIN part q ON q.p_partkey = o.owner")
def alias_owners(t: Tables) -> DataFrame:
    keys = t.part.select("p_partkey", F.lower("p_name").alias("k"), "p_brand")
    owners = keys.groupBy("k").agg(F.min_by(F.struct(F.col("p_partkey").alias("owner"), F.col("p_brand").alias("owner_label")), "p_partkey").alias("o")).select("k", "o.*")
    return keys.join(owners, "k").select("p_partkey", "owner", "owner_label")


@query("SELECT conv_id, turn, role FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq FROM conversations) x WHERE seq = 3")
def events_by_seq(t: Tables) -> DataFrame:
    numbered = t.conversations.selectExpr("conv_id", "turn", "role", "row_number() over (partition by conv_id order by turn) as seq")
    return numbered.where("seq = 3").select("conv_id", "turn", "role")


@query("SELECT l_orderkey, l_linenumber, c_custkey IS NOT NULL AS in_project FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN (SELECT c_custkey FROM customer WHERE c_nationkey = 7) c ON c_custkey = o_custkey")
def events_in_project(t: Tables) -> DataFrame:
    """A nation stands for a project."""
    tasks = t.customer.where("c_nationkey = 7").selectExpr("c_custkey as o_custkey", "true as inside")
    events = t.lineitem.selectExpr("l_orderkey as o_orderkey", "l_orderkey", "l_linenumber").join(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey")
    return events.join(tasks, "o_custkey", "left").select("l_orderkey", "l_linenumber", F.coalesce("inside", F.lit(False)).alias("in_project"))


@query("""WITH v AS (SELECT o_custkey, o_orderpriority AS version, max(o_orderstatus <> 'F') AS is_open, max(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END) AS closed FROM orders GROUP BY ALL),
b AS (SELECT o_custkey, version FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY is_open DESC, closed DESC NULLS LAST, version DESC) AS n FROM v) x WHERE n = 1)
SELECT o_orderkey FROM orders JOIN b ON b.o_custkey = orders.o_custkey AND version = o_orderpriority""")
def chosen_chunk_sets(t: Tables) -> DataFrame:
    """An order's priority stands for the version."""
    chunks = t.orders.withColumn("closed", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")))
    return lk.chosen_chunk_sets(chunks, "o_custkey", "o_orderpriority", "closed").select("o_orderkey")


def _sections(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", "role", (F.col("turn") * 7 % 4).cast("int").alias("depth"))


SECTIONS = """WITH RECURSIVE s AS (SELECT conv_id, turn, role, turn * 7 % 4 AS depth FROM conversations),
p AS (SELECT s.*, (SELECT max(b.turn) FROM s b WHERE b.conv_id = s.conv_id AND b.turn < s.turn AND b.depth < s.depth) AS parent FROM s),
r AS (SELECT conv_id, turn, parent, CAST([] AS BIGINT[]) AS ancestors, [role] AS path FROM p WHERE parent IS NULL
  UNION ALL SELECT p.conv_id, p.turn, p.parent, list_append(r.ancestors, p.parent), list_append(r.path, p.role) FROM p JOIN r ON r.conv_id = p.conv_id AND r.turn = p.parent)"""


@query(SECTIONS + " SELECT conv_id, turn, parent, array_to_string(ancestors, '/') AS ancestors, array_to_string(path, ' > ') AS heading_path FROM r")
def section_paths(t: Tables) -> DataFrame:
    rows = lk.heading_paths(_sections(t), "conv_id", "turn", "depth", "role", 3)
    return rows.select("conv_id", "turn", "parent", F.array_join(F.col("ancestors").cast("array<string>"), "/").alias("ancestors"), F.array_join("path", " > ").alias("heading_path"))


@query(SECTIONS + """, g AS (SELECT a.conv_id, a.turn, (SELECT max(x) FROM (SELECT unnest(list_intersect(list_append(a.ancestors, a.turn), list_append(b.ancestors, b.turn))) AS x) y) AS shared FROM r a JOIN r b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1) SELECT * FROM g""")
def common_sections(t: Tables) -> DataFrame:
    """The lowest section that a turn and the next one share, themselves included."""
    rows = lk.heading_paths(_sections(t), "conv_id", "turn", "depth", "role", 3).select("conv_id", "turn", F.concat("ancestors", F.array("turn")).alias("own"))
    after = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("own").alias("other"))
    return rows.join(after, ["conv_id", "turn"]).select("conv_id", "turn", lk.common_ancestor(F.col("own"), F.col("other")).alias("shared"))


@query(SECTIONS + " SELECT r.conv_id, r.turn, count(s.turn) AS n_siblings, min(s.turn) AS first_sibling FROM r LEFT JOIN r s ON s.conv_id = r.conv_id AND s.turn <> r.turn AND s.parent IS NOT DISTINCT FROM r.parent GROUP BY 1, 2")
def section_siblings(t: Tables) -> DataFrame:
    rows = lk.nested(_sections(t), "conv_id", "turn", "depth", 3)
    family = rows.groupBy("conv_id", "parent").agg(F.count("*").alias("n"), F.min("turn").alias("a"), F.sort_array(F.collect_list("turn")).alias("turns"))  # the sections under one heading of a document
    joined = rows.alias("r").join(family.alias("f"), (F.col("r.conv_id") == F.col("f.conv_id")) & F.col("r.parent").eqNullSafe(F.col("f.parent")))
    return joined.select("r.conv_id", "r.turn", (F.col("n") - 1).alias("n_siblings"), F.when(F.col("a") != F.col("r.turn"), F.col("a")).otherwise(F.get("turns", F.lit(1))).alias("first_sibling"))


@query(SECTIONS + " SELECT r.conv_id, r.turn, array_to_string(path, ' > ') || chr(10) || text AS contextual_text FROM r JOIN conversations c ON c.conv_id = r.conv_id AND c.turn = r.turn")
def contextual_texts(t: Tables) -> DataFrame:
    rows = lk.heading_paths(_sections(t), "conv_id", "turn", "depth", "role", 3)
    return rows.join(t.conversations.select("conv_id", "turn", "text"), ["conv_id", "turn"]).select("conv_id", "turn", F.concat(F.array_join("path", " > "), F.lit("\n"), "text").alias("contextual_text"))


@query("SELECT CASE WHEN s_suppkey IS NOT NULL THEN 'id:' || s_suppkey ELSE 'key:' || lower(p_name) END AS group_key, min(p_partkey) AS first_index, count(*) AS size FROM part LEFT JOIN supplier ON s_suppkey = p_partkey GROUP BY 1")
def exact_groups(t: Tables) -> DataFrame:
    """Parts whose id a supplier has stand for mentions of an entity that is there."""
    known = t.supplier.selectExpr("s_suppkey as p_partkey", "s_suppkey as existing")
    return lk.exact_groups(t.part.join(known, "p_partkey", "left").withColumn("k", F.lower("p_name")), "existing", "k", "p_partkey")


@query("""WITH m AS (SELECT l_partkey, count(*) AS n, list(DISTINCT l_orderkey) AS c FROM lineitem GROUP BY 1), j AS (SELECT p_brand, p_partkey, p_name, n, c FROM part JOIN m ON l_partkey = p_partkey)
SELECT p_brand, arg_min(p_name, p_partkey) AS name, count(*) AS n_merged, CAST(sum(n) AS BIGINT) AS mention_count, len(list_distinct(flatten(list(c)))) AS n_chunks FROM j GROUP BY 1""")
def folded_entities(t: Tables) -> DataFrame:
    """A brand stands for a merge group."""
    counted = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"), F.collect_set("l_orderkey").alias("c"))
    return lk.folded(t.part.join(counted, "p_partkey"), "p_brand", "p_partkey", "p_name", "n", "c")


@query("SELECT event_type AS kind, user_id % 10 AS label, CASE WHEN value < 10 THEN 'below_cut' ELSE 'off_pattern' END AS reason, count(*) AS n FROM events GROUP BY ALL")
def dropped_counts(t: Tables) -> DataFrame:
    return t.events.groupBy(F.col("event_type").alias("kind"), (F.col("user_id") % 10).alias("label"), F.expr("case when value < 10 then 'below_cut' else 'off_pattern' end").alias("reason")).agg(F.count("*").alias("n"))


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), c AS (SELECT doc_id, length(trim(line, ' ')) AS n FROM l WHERE trim(line, ' ') <> '') SELECT (SELECT count(*) FROM documents) AS documents, count(*) AS chunks, count(DISTINCT doc_id) AS with_chunks, min(n) AS least, max(n) AS most, round(avg(n), 4) AS mean FROM c")
def chunk_statistics(t: Tables) -> DataFrame:
    sizes = ch.line_chunks(t.documents).select("doc_id", F.length("chunk_text").alias("n"))
    own = sizes.agg(F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("with_chunks"), F.min("n").cast("long").alias("least"), F.max("n").cast("long").alias("most"), F.round(F.avg("n"), 4).alias("mean"))
    return t.documents.agg(F.count("*").alias("documents")).crossJoin(own)  # one row each


@query("WITH b AS (SELECT user_id % 16 AS batch, count(*) AS items, sum(CAST(event_type = 'error' AS INT)) AS failed, round(min(value), 6) AS lowest_left, count(DISTINCT user_id) AS budget FROM events GROUP BY 1) SELECT CAST(sum(items) AS BIGINT) AS items, CAST(sum(failed) AS BIGINT) AS failed, min(lowest_left) AS lowest_left, max(budget) AS budget FROM b")
def merged_reports(t: Tables) -> DataFrame:
    batches = t.events.groupBy((F.col("user_id") % 16).alias("batch")).agg(F.count("*").alias("items"), F.count_if(F.col("event_type") == "error").alias("failed"), F.round(F.min("value"), 6).alias("lowest_left"), F.count_distinct("user_id").alias("budget"))
    return lk.merged_reports(batches, ["items", "failed"], ["lowest_left"], ["budget"])


@query("SELECT event_id, user_id, (SELECT count(*) FROM events WHERE event_type = 'error') AS total FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 200")
def capped_failures(t: Tables) -> DataFrame:
    """A report of the first 200 failures with the true total."""
    return lk.capped(t.events.where("event_type = 'error'").select("event_id", "user_id"), ["event_id"], 200)


@query("SELECT event_type, event_type || ': ' || count(*) || ' items, ' || count(DISTINCT user_id) || ' tasks, ' || printf('%.2f', 100.0 * count(*) / (SELECT count(*) FROM events)) || ' %' AS line FROM events GROUP BY 1")
def report_lines(t: Tables) -> DataFrame:
    total = t.events.agg(F.count("*").alias("total"))
    own = t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("tasks")).crossJoin(F.broadcast(total))  # one row
    return own.select("event_type", F.format_string("%s: %d items, %d tasks, %.2f %%", "event_type", "n", "tasks", 100.0 * F.col("n") / F.col("total")).alias("line"))


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS n_rows FROM documents GROUP BY 1")
def document_nodes(t: Tables) -> DataFrame:
    """The first occurrence of each content."""
    return t.documents.groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_rows"))


@query("SELECT event_id, CAST(epoch(TIMESTAMP '2030-01-01') - floor(epoch(ts)) AS BIGINT) AS age_seconds, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS lease_expiry FROM events")
def lease_times(t: Tables) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    age = F.unix_timestamp(F.lit("2030-01-01 00:00:00").cast("timestamp")) - F.floor(ms / 1000)
    return t.events.select("event_id", age.cast("long").alias("age_seconds"), F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("lease_expiry"))


@query("WITH n AS (SELECT p_partkey AS id, [p_brand, CASE WHEN p_size > 25 THEN 'Chunk' ELSE 'Entity' END] AS labels FROM part) SELECT id, list_contains(labels, 'Chunk') AS is_chunk FROM n")
def chunk_rows(t: Tables) -> DataFrame:
    nodes = t.part.select(F.col("p_partkey").alias("id"), F.array("p_brand", F.expr("case when p_size > 25 then 'Chunk' else 'Entity' end")).alias("labels"))
    return nodes.select("id", F.array_contains("labels", "Chunk").alias("is_chunk"))


@query("""SELECT event_id, CASE WHEN user_id IN (SELECT user_id FROM events WHERE event_type = 'signup') THEN 'existing' WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 THEN 'created' ELSE 'repeated' END AS outcome FROM events WHERE event_type = 'click'""")
def created_tasks(t: Tables) -> DataFrame:
    asked = t.events.where("event_type = 'click'").select("event_id", "user_id")
    return lk.created(asked, t.events.where("event_type = 'signup'"), ["user_id"], "event_id").select("event_id", "outcome")


@query("SELECT event_id, event_type AS status, props IN (SELECT props FROM events WHERE event_type = 'error') AS queued FROM events WHERE event_type <> 'error'")
def status_changes(t: Tables) -> DataFrame:
    """A decision (shared props) that was withdrawn (an error) queues what cites it."""
    withdrawn = t.events.where("event_type = 'error'").select("props").distinct().withColumn("gone", F.lit(True))
    return t.events.where("event_type != 'error'").join(withdrawn, "props", "left").select("event_id", F.col("event_type").alias("status"), F.coalesce("gone", F.lit(False)).alias("queued"))


@query("""WITH g AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0) SELECT o_orderkey, o_custkey FROM (SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM g) THEN NULL ELSE o_custkey END AS o_custkey FROM orders) x""")
def kept_decisions(t: Tables) -> DataFrame:
    """Customers in debt are tasks that go; their orders stand for decisions, which stay without a task."""
    gone = t.customer.where("c_acctbal < 0").selectExpr("c_custkey as o_custkey")
    orders = t.orders.select("o_orderkey", "o_custkey")
    return lk.deleted_task(t.customer.selectExpr("c_custkey as o_custkey"), orders, orders, gone, "o_custkey", True)[2].select("o_orderkey", "o_custkey")


@query("""WITH g AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0) SELECT 'tasks' AS what, count(*) AS n FROM customer WHERE c_acctbal >= 0
UNION ALL SELECT 'events', count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey NOT IN (SELECT c_custkey FROM g) UNION ALL SELECT 'decisions', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM g)""")
def task_deletion_cascade(t: Tables) -> DataFrame:
    gone = t.customer.where("c_acctbal < 0").selectExpr("c_custkey as o_custkey")
    orders = t.orders.select("o_orderkey", "o_custkey")
    events = t.lineitem.selectExpr("l_orderkey as o_orderkey").join(orders, "o_orderkey")
    left = lk.deleted_task(t.customer.selectExpr("c_custkey as o_custkey"), events, orders, gone, "o_custkey", False)
    one, *rest = (x.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n") for what, x in zip(("tasks", "events", "decisions"), left))
    return one.union(rest[0]).union(rest[1])


@query("SELECT doc_id, CASE WHEN source <> 'src1' THEN sha256(text) END AS current_hash FROM documents")
def retired_versions(t: Tables) -> DataFrame:
    """The documents of one source are purged."""
    docs = t.documents.select("doc_id", F.sha2("text", 256).alias("current_hash"))
    return lk.retired(docs, docs, t.documents.where("source = 'src1'"), "doc_id")[0]


PARAGRAPHS = r"""WITH d AS (SELECT conv_id AS doc_id, replace(string_agg(text, chr(1) ORDER BY turn), chr(1), CASE conv_id % 3 WHEN 0 THEN chr(10) || chr(10) WHEN 1 THEN chr(10) || '  ' || chr(10) || chr(10) ELSE chr(10) END) AS text FROM conversations GROUP BY 1),
p AS (SELECT doc_id, string_split_regex(text, '\n[ \t]*\n+') AS parts, list_concat(regexp_extract_all(text, '\n[ \t]*\n+'), ['']) AS gaps FROM d),
u AS (SELECT doc_id, unnest(parts) AS part, unnest(gaps) AS gap, unnest(range(len(parts))) AS n FROM p),
s AS (SELECT *, sum(length(part) + length(gap)) OVER (PARTITION BY doc_id ORDER BY n) - length(part) - length(gap) AS start FROM u)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS position, CAST(start + length(part) - length(regexp_replace(part, '^\s+', '')) AS BIGINT) AS char_start, regexp_replace(regexp_replace(part, '^\s+', ''), '\s+$', '') AS chunk_text FROM s WHERE regexp_matches(part, '\S')"""


@query(PARAGRAPHS)
def paragraph_units(t: Tables) -> DataFrame:
    """Turns of a conversation joined by blank lines, by lines of spaces, or (one third) by simple line ends."""
    gap = F.expr("case conv_id % 3 when 0 then '\n\n' when 1 then '\n  \n\n' else '\n' end")
    turns = t.conversations.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns"), F.first(gap).alias("gap"))  # one conversation
    return ch.paragraphs(turns.select("doc_id", F.expr("array_join(transform(turns, x -> x.text), gap)").alias("text"))).select("doc_id", "position", "char_start", "chunk_text")


@query(r"""WITH n AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'The  ' || c_name WHEN 1 THEN 'an Été_' || c_name || '.com' WHEN 2 THEN 'Ångström & ' || c_mktsegment WHEN 3 THEN repeat(c_name || ' ', 20) ELSE ' A.B. ' || c_name END AS name FROM customer),
f AS (SELECT c_custkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(name)), '^\s*(the|an|a)\s+', ''), '([\p{L}\p{N}_])\.([\p{L}\p{N}_])', '\1\2', 'g'), '[^\p{L}\p{N}]+', ' ', 'g')) AS w FROM n)
SELECT c_custkey, CASE WHEN length(w) > 200 THEN substr(w, 1, 200) || '~' || substr(sha256(w), 1, 16) ELSE w END AS folded FROM f""")
def folded_names(t: Tables) -> DataFrame:
    name = F.expr("case c_custkey % 5 when 0 then 'The  ' || c_name when 1 then 'an Été_' || c_name || '.com' when 2 then 'Ångström & ' || c_mktsegment when 3 then repeat(c_name || ' ', 20) else ' A.B. ' || c_name end")
    return t.customer.select("c_custkey", tx.normal_name(name).alias("folded"))
