"""Keyed reads, currency, sections, reports and task records of the document graph.

Every read is a join or an aggregate over whole tables; id lists are tables too, and the optimizer decides what is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in ``ids`` (column of that name); repeated ids give a row once, null ids none."""
    return rows.join(ids.select(key), key, "left_semi")


def existing(wanted: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(key, present) of each distinct wanted id that isn't null."""
    there = rows.select(key).distinct().withColumn("present", F.lit(True))
    return wanted.select(key).where(F.col(key).isNotNull()).distinct().join(there, key, "left").select(key, F.coalesce("present", F.lit(False)).alias("present"))


def open_or_bare(chunks: DataFrame, edges: DataFrame, key: str, is_open: Column) -> DataFrame:
    """Chunks that have an open edge, or no edge at all."""
    state = edges.groupBy(key).agg(F.max(is_open.cast("int")).alias("__open"))
    return chunks.join(state, key, "left").where("__open is null or __open = 1").drop("__open")


def page_after(rows: DataFrame, group: str, key: str, after: Column, size: int) -> DataFrame:
    """(group, key): of each group the next ``size`` keys above ``after``, ascending."""
    order = Window.partitionBy(group).orderBy(key)
    return rows.select(group, key).where(F.col(key) > after).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= size).drop("__n")


def newest(rows: DataFrame, group: str, since: str, tie: str, columns: list[str]) -> DataFrame:
    """Of each group the row that began last, of equal ones that with the largest tie-breaker."""
    best = rows.groupBy(group).agg(F.max_by(F.struct(*columns), F.struct(since, tie)).alias("__best"))
    return best.select(group, "__best.*")


def mentioned_entities(parts: DataFrame, mentions: DataFrame) -> DataFrame:
    """(doc_id, entity_id), distinct: parts (doc_id, chunk_id), mentions (chunk_id, entity_id)."""
    return parts.join(mentions, "chunk_id").select("doc_id", "entity_id").distinct()


def cited_relations(parts: DataFrame, relations: DataFrame) -> DataFrame:
    """(doc_id, relation_id), distinct: relations whose source_chunk_ids hold a chunk of the document."""
    cited = relations.select("relation_id", F.explode("source_chunk_ids").alias("chunk_id"))
    return parts.join(cited, "chunk_id").select("doc_id", "relation_id").distinct()


def currency(docs: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """(key, open_parts, live) of each document: it is live while a part of it is open. parts: (key, invalid_at)."""
    counted = parts.groupBy(key).agg(F.count_if(F.col("invalid_at").isNull()).alias("open_parts"))
    return docs.select(key).join(counted, key, "left").select(key, F.coalesce("open_parts", F.lit(0).cast("long")).alias("open_parts"), (F.coalesce("open_parts", F.lit(0)) > 0).alias("live"))


def hidden_members(members: DataFrame, resolved: DataFrame) -> DataFrame:
    """Members (resolved_id, member_id) of resolved entities that are active and synced: searches show the resolved entity instead."""
    return members.join(resolved.where("active and synced").select("resolved_id"), "resolved_id", "left_semi")


def chosen_chunk_sets(chunks: DataFrame, doc: str, version: str, closed_at: str) -> DataFrame:
    """The chunks of one version of each document: an open one first, else the one that closed last; of equal ones the larger version."""
    rank = F.struct(F.max(F.col(closed_at).isNull()).alias("is_open"), F.max(closed_at).alias("closed"), F.col(version).alias("version"))
    versions = chunks.groupBy(doc, version).agg(rank.alias("rank"))
    best = versions.groupBy(doc).agg(F.max_by(version, "rank").alias(version))
    return chunks.join(best, [doc, version], "left_semi")


def nested(sections: DataFrame, doc: str, index: str, depth: str, max_depth: int) -> DataFrame:
    """``sections`` with ``parent``: the index of the nearest section before that is less deep, or null. Depths count from 0 to max_depth."""
    before = Window.partitionBy(doc).orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    levels = [F.when(F.lit(k) < F.col(depth), F.last(F.when(F.col(depth) == k, F.col(index)), True).over(before)) for k in range(max_depth + 1)]
    return sections.withColumn("parent", F.greatest(*levels))


def heading_paths(sections: DataFrame, doc: str, index: str, depth: str, heading: str, max_depth: int) -> DataFrame:
    """(doc, index, parent, ancestors: indexes from the root on, path: headings from the root to the section)."""
    rows = nested(sections, doc, index, depth, max_depth).select(doc, index, "parent", F.col(heading).alias("heading"))
    done = rows.where("parent is null").select(doc, index, "parent", F.array().cast("array<bigint>").alias("ancestors"), F.array("heading").alias("path"))
    level = done
    for _ in range(max_depth):  # a parent is less deep, so that many steps reach every section
        above = level.select(doc, F.col(index).alias("parent"), "ancestors", "path")
        level = rows.join(above, [doc, "parent"]).select(doc, index, "parent", F.concat("ancestors", F.array(F.col("parent").cast("bigint"))).alias("ancestors"), F.concat("path", F.array("heading")).alias("path"))
        done = done.unionByName(level)
    return done


def common_ancestor(a: Column, b: Column) -> Column:
    """The last index that two arrays of ancestors share from the root on, or null."""
    return F.aggregate(F.arrays_zip(a.alias("x"), b.alias("y")), F.struct(F.lit(True).alias("same"), F.lit(None).cast("bigint").alias("last")), _step, lambda s: s["last"])


def _step(state: Column, pair: Column) -> Column:
    same = state["same"] & F.coalesce(pair["x"] == pair["y"], F.lit(False))
    return F.struct(same.alias("same"), F.when(same, pair["x"]).otherwise(state["last"]).alias("last"))


def exact_groups(mentions: DataFrame, existing_id: str, key: str, index: str) -> DataFrame:
    """(group_key, first_index, size): mentions of one entity that is there already, else of one key, in the order of their first index."""
    group = F.coalesce(F.concat(F.lit("id:"), F.col(existing_id).cast("string")), F.concat(F.lit("key:"), F.col(key)))
    return mentions.groupBy(group.alias("group_key")).agg(F.min(index).alias("first_index"), F.count("*").alias("size"))


def folded(rows: DataFrame, group: str, order: str, name: str, count: str, chunks: str) -> DataFrame:
    """(group, name of the first, n_merged, mention_count, n_chunks): rows of a group folded into one; chunk lists are joined."""
    first = rows.groupBy(group).agg(F.min_by(name, order).alias("name"), F.count("*").alias("n_merged"), F.sum(count).alias("mention_count"))
    union = rows.select(group, F.explode(chunks).alias("c")).distinct().groupBy(group).agg(F.count("*").alias("n_chunks"))
    return first.join(union, group, "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0).cast("long")))


def merged_reports(reports: DataFrame, sums: list[str], least: list[str], most: list[str]) -> DataFrame:
    """One row of all batches' reports: sums, minima and maxima; nulls count as nothing."""
    return reports.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums], *[F.min(c).alias(c) for c in least], *[F.max(c).alias(c) for c in most])


def capped(rows: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows with the true total in column ``total``: the cap is the report's, every row is counted."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).limit(most).crossJoin(F.broadcast(total))  # one row


def created(asked: DataFrame, tasks: DataFrame, key: list[str], order: str) -> DataFrame:
    """``asked`` with ``outcome``: existing for a task that is there, created for the first request of a new one, repeated for later ones."""
    there = tasks.select(*key).distinct().withColumn("__there", F.lit(True))
    turn = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    return asked.join(there, key, "left").withColumn("outcome", F.when(F.col("__there"), "existing").when(turn == 1, "created").otherwise("repeated")).drop("__there")


def deleted_task(tasks: DataFrame, events: DataFrame, decisions: DataFrame, gone: DataFrame, key: str, keep_decisions: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tasks, events, decisions) after the tasks in ``gone`` and all their events went; their decisions go too, or stay without a task."""
    ids = gone.select(key).distinct()
    left = [x.join(ids, key, "left_anti") for x in (tasks, events)]
    if not keep_decisions:
        return left[0], left[1], decisions.join(ids, key, "left_anti")
    marked = decisions.join(ids.withColumn("__gone", F.lit(True)), key, "left")
    return left[0], left[1], marked.withColumn(key, F.when(F.col("__gone"), F.lit(None)).otherwise(F.col(key))).drop("__gone")


def retired(docs: DataFrame, parts: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(docs, parts) after a purge: the documents stay without a current hash, their parts go."""
    mark = ids.select(key).distinct().withColumn("__gone", F.lit(True))
    kept = docs.join(mark, key, "left").withColumn("current_hash", F.when(F.col("__gone"), F.lit(None)).otherwise(F.col("current_hash"))).drop("__gone")
    return kept, parts.join(mark, key, "left_anti")
