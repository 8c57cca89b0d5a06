"""Traversals and analytics over edges (src, dst, type)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.storage import cut

MAX_DEPTH = 10


def steps(edges: DataFrame, direction: str = "both", types: list[str] | None = None) -> DataFrame:
    """(at, to, type): edges as steps in a direction: out, in or both."""
    if types is not None:
        edges = edges.where(F.col("type").isin(types))
    out = edges.select(F.col("src").alias("at"), F.col("dst").alias("to"), "type")
    back = edges.select(F.col("dst").alias("at"), F.col("src").alias("to"), "type")
    if direction == "out":
        return out
    if direction == "in":
        return back
    if direction == "both":
        return out.unionByName(back)
    raise ValueError(f"unknown direction {direction!r}")


def bfs(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "both", types: list[str] | None = None) -> DataFrame:
    """(id, depth) of all nodes within ``depth`` (1 to 10) steps of any seed (column id), seeds left out.

    One join of the frontier a level, and an anti-join against what was seen; each level is written, so the plan stays short.
    """
    depth = min(max(depth, 1), MAX_DEPTH)
    hops = steps(edges, direction, types).select("at", "to").distinct()
    seen = frontier = cut(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    for level in range(1, depth + 1):
        frontier = cut(hops.join(frontier.select(F.col("id").alias("at")), "at", "left_semi").select(F.col("to").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


#: Most parts that a class of seeds is cut into, and seeds of a part: no task makes all pairs of a class.
PARTS, PART = 256, 64


def shortest_paths(edges: DataFrame, seeds: DataFrame, targets: DataFrame, hops: int, direction: str = "both") -> DataFrame:
    """(seed, target, length) of all pairs within ``hops`` steps.

    Seeds with the same neighbours are equally far from every other node, so rounds run over one of each such class, and
    pairs are made once, at the end. Neighbours are compared by their number and 128 bits of hashes.
    """
    moves = cut(steps(edges, direction).select("at", "to").distinct())
    hops = min(max(hops, 1), MAX_DEPTH)
    own = moves.join(seeds.select(F.col("id").alias("at")).distinct(), "at", "left_semi")
    own = own.groupBy("at").agg(F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64("to")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "to")).alias("y")).alias("near"))
    classes = own.groupBy("near").agg(F.min("at").alias("one"), F.count("*").alias("n"))
    classes = classes.select("near", "one", F.least(F.lit(PARTS), F.expr(f"1 + n div {PART}")).cast("int").alias("parts"))
    members = cut(own.join(classes, "near").select("one", "parts", F.col("at").alias("seed")))
    near_end = lambda level: moves if level < hops else moves.join(targets.select(F.col("id").alias("to")).distinct(), "to", "left_semi")
    seen = frontier = cut(near_end(1).join(members.select(F.col("one").alias("at"), "parts").distinct(), "at").selectExpr("at as one", "parts", "to as id", "1 as length"))
    for level in range(2, hops + 1):
        if frontier.isEmpty():
            break
        frontier = frontier.select("one", "parts", F.col("id").alias("at")).join(near_end(level), "at").select("one", "parts", F.col("to").alias("id")).distinct()
        frontier = cut(frontier.join(seen, ["one", "id"], "left_anti").withColumn("length", F.lit(level)))
        seen = seen.unionByName(frontier)
    found = seen.join(targets.select("id").distinct(), "id", "left_semi").select("one", F.expr("pmod(xxhash64(id), parts)").alias("part"), F.col("id").alias("target"), "length")
    each = members.select("one", "seed", F.explode(F.expr("sequence(0L, parts - 1L)")).alias("part"))
    # Spark doesn't count what the explode makes, so it must not choose to broadcast it
    return found.join(each.hint("merge"), ["one", "part"]).where("seed != target").select("seed", "target", "length")


def components(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """(id, component): the least id reachable, by rounds of large star and small star; neighbourhoods are only reduced to minima."""
    edges = cut(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct())
    before = None
    while True:
        both = edges.union(edges.selectExpr("b as a", "a as b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) as m")
        edges = both.where("b > a").join(least, "a").selectExpr("b as a", "m as b").where("a > b").distinct()
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        edges = cut(edges.join(least, "a").selectExpr("b as a", "m as b").where("a > b").union(least.selectExpr("a", "m as b")).distinct())
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            return edges.selectExpr("a as id", "b as component").union(edges.selectExpr("b as id", "b as component").distinct())
        before = now


def edge_types_at(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(type): the distinct types of edges at the seeds."""
    ends = steps(edges).join(seeds.select(F.col("id").alias("at")), "at", "left_semi")
    return ends.select("type").distinct()


def neighbours(edges: DataFrame, k: int) -> DataFrame:
    """(id, neighbour, type): at most ``k`` of each node, by type and name, both directions."""
    order = Window.partitionBy("at").orderBy("type", "to")
    return steps(edges).distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select(F.col("at").alias("id"), F.col("to").alias("neighbour"), "type")


def keyset_page(rows: DataFrame, keys: list[str], after: tuple | None, limit: int) -> DataFrame:
    """The ``limit`` rows that follow ``after`` in the order of ``keys``."""
    if after is not None:
        rows = rows.where(F.struct(*keys) > F.struct(*[F.lit(x) for x in after]))
    return rows.orderBy(*keys).limit(limit)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes (column id)."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def community_stats(edges: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of a partition (id, community) over edges (src, dst, weight):
    (community, size, internal_weight, rating, report), (community, id, weight, rank), and internal edges (community, src, dst, weight, rank).

    Communities of one member are dropped.
    """
    sized = members.groupBy("community").agg(F.count("*").alias("size")).where("size > 1")
    members = members.join(sized, "community", "left_semi")
    # members grow with the graph and pack well, so Spark takes them for small; they aren't broadcast
    ends = edges.join(members.select(F.col("id").alias("src"), F.col("community").alias("cs")).hint("merge"), "src").join(members.select(F.col("id").alias("dst"), F.col("community").alias("cd")).hint("merge"), "dst")
    inside = ends.where("cs = cd").select(F.col("cs").alias("community"), "src", "dst", "weight")
    weights = inside.groupBy("community").agg(F.sum("weight").alias("internal_weight"))
    totals = sized.join(weights, "community", "left").withColumn("internal_weight", F.coalesce("internal_weight", F.lit(0)))
    totals = totals.withColumn("rating", F.least(F.lit(10.0), F.col("internal_weight") / 2)).withColumn("report", F.when(F.col("internal_weight") >= 5, "model").otherwise("heuristic"))
    own = inside.selectExpr("community", "src as id", "weight").union(inside.selectExpr("community", "dst as id", "weight")).groupBy("community", "id").agg(F.sum("weight").alias("weight"))
    ranked = members.join(own, ["community", "id"], "left").withColumn("weight", F.coalesce("weight", F.lit(0)))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("weight"), "id"))).select("community", "id", "weight", "rank")
    top = inside.withColumn("rank", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("weight"), "src", "dst")))
    return totals, ranked, top


def label_propagation(edges: DataFrame, rounds: int = 8) -> DataFrame:
    """(id, community): each node takes the community that its edges weigh most for, ties to the smallest, for some rounds.

    Nodes of even and odd hash move in turn, so that pairs don't swap for ever.
    """
    hops = edges.select(F.col("src").alias("at"), F.col("dst").alias("to"), "weight").union(edges.select("dst", "src", "weight")).where("at != to").groupBy("at", "to").agg(F.sum("weight").alias("weight"))
    hops = cut(hops.withColumn("half", F.expr("pmod(xxhash64(at), 2)")))
    labels = cut(hops.select(F.col("at").alias("id")).distinct().withColumn("community", F.col("id")))
    for turn in range(rounds):  # only those that move are voted for
        votes = hops.where(F.col("half") == turn % 2).join(labels.withColumnRenamed("id", "to"), "to").groupBy("at", "community").agg(F.sum("weight").alias("w"))
        best = votes.groupBy(F.col("at").alias("id")).agg(F.max_by(F.col("community"), F.struct(F.col("w"), -F.xxhash64("community"))).alias("new"))
        labels = cut(labels.join(best, "id", "left").select("id", F.coalesce("new", "community").alias("community")))
    return labels


def modularity(edges: DataFrame, members: DataFrame) -> DataFrame:
    """One row: modularity of a partition (id, community) of an undirected weighted graph."""
    both = edges.join(members.selectExpr("id as src", "community as cs"), "src", "left").join(members.selectExpr("id as dst", "community as cd"), "dst", "left")
    return flow_modularity(both)


def flow_modularity(flows: DataFrame) -> DataFrame:
    """The same of (cs, cd, weight): weight between communities, null where an end has none. Rows of a pair may repeat."""
    flows = cut(flows.groupBy("cs", "cd").agg(F.sum("weight").alias("weight")))
    total = flows.agg(F.sum("weight").alias("m"))
    degrees = flows.selectExpr("cs as community", "weight").union(flows.selectExpr("cd", "weight")).where("community is not null").groupBy("community").agg(F.sum("weight").alias("degree"))
    inner = flows.where("cs = cd").groupBy(F.col("cs").alias("community")).agg(F.sum("weight").alias("inner"))
    parts = degrees.join(inner, "community", "left").join(F.broadcast(total))  # total: one row
    return parts.agg(F.round(F.sum(F.coalesce("inner", F.lit(0)) / F.col("m") - F.pow(F.col("degree") / (2 * F.col("m")), 2)), 6).alias("modularity"))


def reverse_dependents(depends_on: DataFrame, start: DataFrame) -> DataFrame:
    """(id, hop): everything that depends on the start nodes, directly or not, and the least hops to one. depends_on: (src depends on dst).

    A node with one dependency points along it; pointers are doubled until each leads to a start, a node with several
    dependencies or an end, so a chain takes rounds as the logarithm of its length. Rounds of relaxation then run between
    the nodes with several dependencies only.
    """
    seeds = cut(start.select("id").where("id is not null").distinct())
    edges = cut(depends_on.select("src", "dst").where("src != dst").distinct().join(seeds.withColumnRenamed("id", "src"), "src", "left_anti"))
    counted = edges.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("to"))
    jumps = cut(counted.where("n = 1").select(F.col("src").alias("id"), "to", F.lit(1).cast("long").alias("w")))
    size, far = jumps.count(), 1
    ahead = lambda: jumps.selectExpr("id as to", "to as next", "w as more").hint("merge")  # noqa: E731  (as large as the graph: never broadcast)
    while far <= size:  # longer ways than there are nodes run in a circle
        jumps = cut(jumps.join(ahead(), "to", "left").selectExpr("id", "coalesce(next, to) as to", "w + coalesce(more, 0L) as w", "next is not null as moved"))
        if jumps.where("moved").isEmpty():
            break
        far *= 2
    jumps = jumps.select("id", "to", "w").join(jumps.selectExpr("id as to").hint("merge"), "to", "left_anti")
    several = edges.join(counted.where("n > 1").select("src"), "src", "left_semi")
    links = several.withColumnRenamed("dst", "to").join(jumps.selectExpr("id as to", "to as next", "w as more"), "to", "left")
    links = cut(links.selectExpr("src", "coalesce(next, to) as to", "1 + coalesce(more, 0L) as w").groupBy("src", "to").agg(F.min("w").alias("w")))
    known = frontier = cut(seeds.withColumn("hop", F.lit(0).cast("long")))
    while not frontier.isEmpty():
        met = links.join(frontier.withColumnRenamed("id", "to"), "to").groupBy(F.col("src").alias("id")).agg(F.min(F.expr("hop + w")).alias("hop"))
        frontier = cut(met.join(known.withColumnRenamed("hop", "had"), "id", "left").where("had is null or hop < had").select("id", "hop"))
        known = cut(known.join(frontier.select("id"), "id", "left_anti").unionByName(frontier))
    behind = jumps.join(known.withColumnRenamed("id", "to"), "to").selectExpr("id", "hop + w as hop")
    return known.unionByName(behind).select("id", F.col("hop").cast("int").alias("hop"))
