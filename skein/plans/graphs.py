"""Queries of the property graph and of writes to it.

The graph on the test tables: customers, suppliers, nations, regions, orders and parts are nodes; PLACED, CONTAINS,
IN_NATION and IN_REGION are edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators import graph as gr
from skein.operators import merge as mg
from skein.plans.registry import Tables, query

EDGES = """
edges AS (
SELECT 'customer:' || c_custkey AS src, 'nation:' || c_nationkey AS dst, 'IN_NATION' AS type FROM customer
UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'IN_NATION' FROM supplier
UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'IN_REGION' FROM nation
UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey, 'PLACED' FROM orders
UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'part:' || l_partkey, 'CONTAINS' FROM lineitem),
steps AS (SELECT src AS "at", dst AS "to", type FROM edges UNION ALL SELECT dst, src, type FROM edges)"""


def _edges(t: Tables) -> DataFrame:
    def of(df: DataFrame, a: str, ka: str, b: str, kb: str, kind: str) -> DataFrame:
        return df.select(F.concat(F.lit(f"{a}:"), F.col(ka).cast("string")).alias("src"), F.concat(F.lit(f"{b}:"), F.col(kb).cast("string")).alias("dst"), F.lit(kind).alias("type"))

    return (
        of(t.customer, "customer", "c_custkey", "nation", "c_nationkey", "IN_NATION")
        .union(of(t.supplier, "supplier", "s_suppkey", "nation", "s_nationkey", "IN_NATION"))
        .union(of(t.nation, "nation", "n_nationkey", "region", "n_regionkey", "IN_REGION"))
        .union(of(t.orders, "customer", "o_custkey", "order", "o_orderkey", "PLACED"))
        .union(of(t.lineitem, "order", "l_orderkey", "part", "l_partkey", "CONTAINS").distinct())
    )


def _ids(t: Tables, *names: str) -> DataFrame:
    return t.spark.createDataFrame([(x,) for x in names], "id string")


@query(f"""WITH RECURSIVE {EDGES}, r(id, depth) AS (SELECT 'region:0', 0 UNION SELECT s."to", r.depth + 1 FROM r JOIN steps s ON s."at" = r.id WHERE r.depth < 3)
SELECT id, min(depth) AS depth FROM r WHERE id <> 'region:0' GROUP BY id""")
def bfs_any_direction(t: Tables) -> DataFrame:
    return gr.bfs(_edges(t), _ids(t, "region:0"), 3)


@query(f"""WITH {EDGES} SELECT dst AS id, min(depth) AS depth FROM (
SELECT dst, 1 AS depth FROM edges WHERE src IN ('customer:1', 'customer:2', 'customer:4') AND type IN ('PLACED', 'CONTAINS')
UNION ALL SELECT b.dst, 2 FROM edges a JOIN edges b ON b.src = a.dst WHERE a.src IN ('customer:1', 'customer:2', 'customer:4') AND a.type IN ('PLACED', 'CONTAINS') AND b.type IN ('PLACED', 'CONTAINS')) x GROUP BY dst""")
def bfs_outward_typed(t: Tables) -> DataFrame:
    return gr.bfs(_edges(t), _ids(t, "customer:1", "customer:2", "customer:4"), 2, "out", ["PLACED", "CONTAINS"])


@query("""SELECT 'supplier:' || s_suppkey AS seed, 'customer:' || c_custkey AS target, 2 AS length FROM supplier JOIN customer ON s_nationkey = c_nationkey""")
def shortest_paths(t: Tables) -> DataFrame:
    edges = _edges(t)
    ends = lambda df, kind, key: df.select(F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("id"))
    return gr.shortest_paths(edges.where("type = 'IN_NATION'"), ends(t.supplier, "supplier", "s_suppkey"), ends(t.customer, "customer", "c_custkey"), 2)


@query(f"""WITH {EDGES} SELECT DISTINCT type FROM steps WHERE "at" IN ('nation:1', 'order:1')""")
def edge_types_at_seeds(t: Tables) -> DataFrame:
    return gr.edge_types_at(_edges(t), _ids(t, "nation:1", "order:1"))


@query(f"""WITH {EDGES} SELECT id, neighbour, type FROM (SELECT "at" AS id, "to" AS neighbour, type, row_number() OVER (PARTITION BY "at" ORDER BY type, "to") AS n FROM (SELECT DISTINCT * FROM steps) d) x WHERE n <= 3""")
def sampled_neighbours(t: Tables) -> DataFrame:
    return gr.neighbours(_edges(t), 3)


@query(f"""WITH {EDGES} SELECT src, type, dst FROM edges WHERE (src, type, dst) > ('customer:200', 'PLACED', '') ORDER BY src, type, dst LIMIT 500""")
def relation_keyset_page(t: Tables) -> DataFrame:
    return gr.keyset_page(_edges(t).select("src", "type", "dst"), ["src", "type", "dst"], ("customer:200", "PLACED", ""), 500)


@query(f"""WITH {EDGES}, ids AS (SELECT 'customer:' || c_custkey AS id FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT 'nation:' || n_nationkey FROM nation WHERE n_regionkey = 1)
SELECT src, dst, type FROM edges WHERE src IN (SELECT id FROM ids) AND dst IN (SELECT id FROM ids)""")
def induced_edges(t: Tables) -> DataFrame:
    rich = t.customer.where("c_acctbal > 5000").selectExpr("concat('customer:', c_custkey) as id")
    near = t.nation.where("n_regionkey = 1").selectExpr("concat('nation:', n_nationkey) as id")
    return gr.induced(_edges(t), rich.union(near)).select("src", "dst", "type")


@query("SELECT p_partkey AS id, min(p_partkey) OVER (PARTITION BY p_name) AS component FROM part QUALIFY count(*) OVER (PARTITION BY p_name) > 1")
def match_components(t: Tables) -> DataFrame:
    """Parts of one name, matched in chains."""
    chain = t.part.select(F.col("p_partkey").alias("src"), F.lead("p_partkey").over(Window.partitionBy("p_name").orderBy("p_partkey")).alias("dst")).where("dst is not null")
    return gr.components(chain)


COMMUNITIES = """
members AS (SELECT p_partkey AS id, p_brand AS community FROM part),
w AS (SELECT a.l_partkey AS src, b.l_partkey AS dst, count(*) AS weight FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2),
sized AS (SELECT community, count(*) AS size FROM members GROUP BY community HAVING count(*) > 1),
inside AS (SELECT s.community, w.src, w.dst, w.weight FROM w JOIN members s ON s.id = w.src JOIN members d ON d.id = w.dst AND d.community = s.community JOIN sized z ON z.community = s.community)"""


def _lines_of_brands(t: Tables) -> tuple[DataFrame, DataFrame]:
    members = t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("community")).hint("merge")  # grows with the parts: never broadcast
    return t.lineitem.select("l_orderkey", F.col("l_partkey").alias("id")), members


def _co_ordered(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Pairs of parts of one brand, by the orders that hold both: only these are internal, so only these are made."""
    lines, members = _lines_of_brands(t)
    of = lambda end: lines.join(members.distinct().hint("merge"), "id").withColumnRenamed("id", end)
    pairs = of("src").join(of("dst"), ["l_orderkey", "community"]).where("src < dst").groupBy("community", "src", "dst").agg(F.count("*").alias("weight"))
    return pairs.select("src", "dst", "weight").dropDuplicates(["src", "dst"]), members


@query(f"""WITH {COMMUNITIES} SELECT z.community, size, CAST(coalesce(sum(weight), 0) AS BIGINT) AS internal_weight, least(10.0, coalesce(sum(weight), 0) / 2.0)::DOUBLE AS rating, CASE WHEN coalesce(sum(weight), 0) >= 5 THEN 'model' ELSE 'heuristic' END AS report FROM sized z LEFT JOIN inside i ON i.community = z.community GROUP BY z.community, size""")
def community_totals(t: Tables) -> DataFrame:
    return gr.community_stats(*_co_ordered(t))[0]


@query(f"""WITH {COMMUNITIES}, own AS (SELECT community, id, sum(weight) AS weight FROM (SELECT community, src AS id, weight FROM inside UNION ALL SELECT community, dst, weight FROM inside) x GROUP BY ALL)
SELECT m.community, m.id, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST(row_number() OVER (PARTITION BY m.community ORDER BY coalesce(weight, 0) DESC, m.id) AS INT) AS rank FROM members m JOIN sized USING (community) LEFT JOIN own ON own.community = m.community AND own.id = m.id""")
def community_members(t: Tables) -> DataFrame:
    return gr.community_stats(*_co_ordered(t))[1]


@query(f"""WITH {COMMUNITIES} SELECT * FROM (SELECT community, src, dst, weight, CAST(row_number() OVER (PARTITION BY community ORDER BY weight DESC, src, dst) AS INT) AS rank FROM inside) x WHERE rank <= 20""")
def community_top_edges(t: Tables) -> DataFrame:
    return gr.community_stats(*_co_ordered(t))[2].where("rank <= 20")


@query(f"""WITH {COMMUNITIES}, deg AS (SELECT community, sum(weight) AS d FROM (SELECT src AS id, weight FROM w UNION ALL SELECT dst, weight FROM w) x JOIN members USING (id) GROUP BY community),
i AS (SELECT community, sum(weight) AS n FROM inside GROUP BY community), m AS (SELECT sum(weight) AS m FROM w)
SELECT round(sum(coalesce(n, 0) / m - pow(d / (2 * m), 2)), 6) AS modularity FROM deg LEFT JOIN i USING (community), m""")
def partition_modularity(t: Tables) -> DataFrame:
    lines, members = _lines_of_brands(t)
    of = lambda end: lines.join(members, "id", "left").select("l_orderkey", F.col("id").alias(end), F.col("community").alias(f"c{end[0]}"))
    return gr.flow_modularity(of("src").join(of("dst"), "l_orderkey").where("src < dst").select("cs", "cd", F.lit(1).cast("long").alias("weight")))


@query()
def detected_communities(t: Tables) -> DataFrame:
    """Customers and suppliers by label propagation over who is served by whom."""
    edges = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).selectExpr("concat('c', o_custkey) as src", "concat('s', l_suppkey) as dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))
    return gr.label_propagation(edges, 6)


@query("""WITH RECURSIVE dep AS (SELECT p_partkey AS src, lag(p_partkey) OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS dst FROM part), r(id, hop) AS (
SELECT min(p_partkey), 0 FROM part GROUP BY p_brand, p_size UNION ALL SELECT dep.src, r.hop + 1 FROM r JOIN dep ON dep.dst = r.id) SELECT id, hop FROM r""")
def reverse_dependents(t: Tables) -> DataFrame:
    """Each part depends on the one before it of its brand and size; the first ones changed."""
    group = Window.partitionBy("p_brand", "p_size").orderBy("p_partkey")
    dep = t.part.select(F.col("p_partkey").alias("src"), F.lag("p_partkey").over(group).alias("dst")).where("dst is not null")
    return gr.reverse_dependents(dep, t.part.groupBy("p_brand", "p_size").agg(F.min("p_partkey").alias("id")))


@query("""SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT c_custkey, upper(c_name), 0.0 FROM customer WHERE c_acctbal < 0""")
def upsert_nodes(t: Tables) -> DataFrame:
    base = t.customer.selectExpr("c_custkey as id", "c_name as name", "c_acctbal as balance")
    staged = base.where("balance < 0").selectExpr("id", "upper(name) as name", "cast(0 as double) as balance")
    return mg.upsert_nodes(base, staged)


@query("""WITH e AS (SELECT o_custkey, o_orderpriority, o_orderstatus, 'o' || o_orderkey AS k, o_totalprice AS p, o_orderkey FROM orders),
b AS (SELECT o_custkey || '-' || o_orderpriority AS id, list(k ORDER BY k) AS s, max(p) AS c FROM e WHERE o_orderstatus <> 'P' GROUP BY 1),
n AS (SELECT o_custkey || '-' || o_orderpriority AS id, list(k ORDER BY k) AS s, max(p) AS c FROM e WHERE o_orderstatus <> 'F' GROUP BY 1)
SELECT coalesce(n.id, b.id) AS id, array_to_string(list_concat(list_filter(coalesce(b.s, []), lambda x: NOT list_contains(coalesce(n.s, []), x)), coalesce(n.s, [])), ',') AS sources, greatest(b.c, n.c) AS confidence,
CASE WHEN n.id IS NOT NULL AND b.id IS NOT NULL THEN 'base,new' WHEN n.id IS NOT NULL THEN 'new' ELSE 'base' END AS extractors FROM b FULL JOIN n ON b.id = n.id""")
def upsert_edges(t: Tables) -> DataFrame:
    def of(df: DataFrame, name: str) -> DataFrame:
        rows = df.selectExpr("concat(o_custkey, '-', o_orderpriority) as id", "concat('o', o_orderkey) as k", "o_totalprice as p")
        rows = rows.groupBy("id").agg(F.array_sort(F.collect_list("k")).alias("source_chunk_ids"), F.max("p").alias("confidence"))
        return rows.selectExpr("id", "'PLACED' as type", "id as src", "id as dst", "source_chunk_ids", "confidence", f"array('{name}') as extractors")

    new = mg.upsert_edges(of(t.orders.where("o_orderstatus != 'P'"), "base"), of(t.orders.where("o_orderstatus != 'F'"), "new"))
    return new.selectExpr("id", "array_join(source_chunk_ids, ',') as sources", "confidence", "array_join(extractors, ',') as extractors")


@query("""WITH e AS (SELECT l_orderkey AS id, list('l' || l_linenumber ORDER BY l_linenumber) AS s FROM lineitem WHERE (l_orderkey, l_linenumber) NOT IN (SELECT (l_orderkey, l_linenumber) FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1) SELECT id, array_to_string(s, ',') AS sources FROM e""")
def retract_evidence(t: Tables) -> DataFrame:
    """Returned lines are taken from their orders' sources."""
    lines = t.lineitem.selectExpr("l_orderkey as id", "l_linenumber as n", "concat(l_orderkey, '-', l_linenumber) as chunk_id", "l_returnflag")
    edges = lines.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "chunk_id"))), lambda x: x["chunk_id"]).alias("source_chunk_ids"))
    left = mg.retract(edges, lines.where("l_returnflag = 'R'"))
    return left.select("id", F.array_join(F.transform("source_chunk_ids", lambda x: F.concat(F.lit("l"), F.element_at(F.split(x, "-"), 2))), ",").alias("sources"))


@query("SELECT p_name AS merge_key, min(p_partkey) AS id FROM part GROUP BY p_name")
def merge_aliases(t: Tables) -> DataFrame:
    return mg.first_writer(t.part.selectExpr("p_name as merge_key", "p_partkey as id"), "merge_key", ["id"])


@query("SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def unique_key_violations(t: Tables) -> DataFrame:
    return mg.duplicates(t.lineitem, ["l_orderkey", "l_partkey"])


@query("""SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')""")
def nodes_without_evidence(t: Tables) -> DataFrame:
    return t.customer.selectExpr("c_custkey as id").join(t.events.where("event_type = 'purchase'").selectExpr("user_id as id"), "id", "left_anti")


@query("""SELECT a.l_orderkey AS id, a.n AS n_lines FROM (SELECT l_orderkey, count(*) AS n, bool_and(l_linestatus = 'O') AS open FROM lineitem GROUP BY 1) a WHERE open""")
def all_predicate(t: Tables) -> DataFrame:
    """Orders of which all lines are open, as ALL() over a collected list."""
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("l_linestatus").alias("s"))
    return lines.where(F.forall("s", lambda x: x == "O")).select("id", F.size("s").cast("long").alias("n_lines"))
