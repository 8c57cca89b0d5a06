"""Writes as joins: upserts of nodes and edges, survivors, aliases, retraction, versions.

A stored table and the staged rows give the new table; nothing is changed in place. The result is meant to be published
by writing it whole or by the partitions that changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert_nodes(base: DataFrame, staged: DataFrame, key: str = "id") -> DataFrame:
    """Staged rows replace those with their key."""
    return base.join(staged.select(key), key, "left_anti").unionByName(staged)


def ordered_union(old: Column, new: Column) -> Column:
    """What only ``old`` has, then all of ``new``; null where neither has any."""
    kind = "array<string>"
    joined = F.concat(F.array_except(F.coalesce(old, F.array().cast(kind)), F.coalesce(new, F.array().cast(kind))), F.coalesce(new, F.array().cast(kind)))
    return F.when(F.size(joined) > 0, joined)


def upsert_edges(base: DataFrame, staged: DataFrame) -> DataFrame:
    """Edges (id, type, src, dst, source_chunk_ids, confidence, extractors): sources and extractors join, the higher confidence stays."""
    b, s = base.alias("b"), staged.alias("s")
    joined = b.join(s, F.col("b.id") == F.col("s.id"), "full_outer")
    pick = lambda c: F.coalesce(F.col(f"s.{c}"), F.col(f"b.{c}")).alias(c)
    return joined.select(pick("id"), pick("type"), pick("src"), pick("dst"), ordered_union(F.col("b.source_chunk_ids"), F.col("s.source_chunk_ids")).alias("source_chunk_ids"), F.greatest("b.confidence", "s.confidence").alias("confidence"), ordered_union(F.col("b.extractors"), F.col("s.extractors")).alias("extractors"))


def retract(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Take chunk ids (column chunk_id) from the edges' sources; edges left without any go.

    The sources are exploded and anti-joined, so no list of what is gone is held by a task.
    """
    rows = edges.select("id", F.posexplode("source_chunk_ids").alias("n", "chunk_id")).join(gone.select("chunk_id").distinct(), "chunk_id", "left_anti")
    left = rows.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "chunk_id"))), lambda x: x["chunk_id"]).alias("source_chunk_ids"))
    return edges.drop("source_chunk_ids").join(left, "id")


def first_writer(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in order: aliases and singletons are written once."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that break uniqueness, and how often they stand."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def survivors(rows: DataFrame, group: str, declared: list[str]) -> DataFrame:
    """(group, survivor): of each group the row with fewest missing declared fields, then the oldest, then the smallest id."""
    missing = sum((F.when(F.col(c).isNull(), 1).otherwise(0) for c in declared), F.lit(0))
    return rows.groupBy(group).agg(F.min_by("id", F.struct(missing.alias("m"), F.col("created_at"), F.col("id"))).alias("survivor"))


def merge_property(value: Column, position: Column, policy: str = "KEEP_FIRST") -> tuple[Column, Column]:
    """(merged value, whether values conflict), as aggregates; nulls are ignored."""
    listed = F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(position.alias("p"), value.alias("v"))))), lambda x: x["v"])
    conflict = F.count_distinct(value) > 1
    if policy == "KEEP_FIRST":
        return F.get(listed, F.lit(0)), conflict
    if policy == "KEEP_LAST":
        return F.element_at(listed, -1), conflict
    if policy == "MERGE_ALL":
        return F.array_join(F.array_distinct(listed), "; "), conflict
    raise ValueError(f"unknown policy {policy!r}")


def close_versions(current: DataFrame, incoming: DataFrame, key: str, content: list[str], at: Column) -> DataFrame:
    """A history (key, content, valid_at, invalid_at) after new states came: changed rows close and their new state opens; keys that are gone close."""
    c, n = current.alias("c"), incoming.alias("n")
    same = F.lit(True)
    for column in content:
        same = same & F.col(f"c.{column}").eqNullSafe(F.col(f"n.{column}"))
    open_ = current.where("invalid_at is null").alias("c")
    met = open_.join(n, F.col(f"c.{key}") == F.col(f"n.{key}"), "full_outer")
    kept = met.where(F.col(f"c.{key}").isNotNull()).select(f"c.{key}", *[f"c.{x}" for x in content], "c.valid_at", F.when(~(same & F.col(f"n.{key}").isNotNull()), at).alias("invalid_at"))
    new = met.where(F.col(f"n.{key}").isNotNull() & ~(same & F.col(f"c.{key}").isNotNull())).select(f"n.{key}", *[f"n.{x}" for x in content], at.alias("valid_at"), F.lit(None).cast(c.schema["invalid_at"].dataType).alias("invalid_at"))
    return current.where("invalid_at is not null").select(key, *content, "valid_at", "invalid_at").unionByName(kept).unionByName(new)


def update_kind(old: str, new: str) -> Column:
    """What an update of a document is: NEW_VERSION, IN_PLACE, METADATA_ONLY or NO_OP. old, new: aliases of both states."""
    differ = lambda c: ~F.col(f"{old}.{c}").eqNullSafe(F.col(f"{new}.{c}"))
    version = differ("content_hash") | differ("version_id") | differ("chunker_hash") | differ("schema_fingerprint")
    return F.when((F.col(f"{old}.open_chunks") == 0) | version, "NEW_VERSION").when(F.col(f"{new}.force") | differ("extraction_fingerprint"), "IN_PLACE").when(differ("dated"), "METADATA_ONLY").otherwise("NO_OP")
