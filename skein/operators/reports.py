"""Citations, assignments, tables and the states of searches and decisions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CITED = r"\[((?:ev1:)[^\]\s]+)\]"


def citations(answers: DataFrame, key: str, text: str) -> DataFrame:
    """(key, id, number, place): the bracketed ids of each answer, numbered by first appearance."""
    found = answers.select(F.col(key).alias("key"), F.posexplode(F.regexp_extract_all(F.col(text), F.lit(CITED), F.lit(1))).alias("place", "id"))
    first = found.groupBy("key", "id").agg(F.min("place").alias("place"))
    return first.withColumn("number", F.row_number().over(Window.partitionBy("key").orderBy("place")))


def rendered(answers: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, sources): ids replaced by their numbers, with the list of sources in order."""
    listed = citations(answers, key, text).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("number", "id"))).alias("c"))
    met = answers.select(F.col(key).alias("key"), F.col(text).alias("text")).join(listed, "key", "left")
    body = F.aggregate(F.coalesce("c", F.array().cast("array<struct<number:int,id:string>>")), F.col("text"), lambda t, c: F.replace(t, F.concat(F.lit("["), c["id"], F.lit("]")), F.concat(F.lit("["), c["number"].cast("string"), F.lit("]"))))
    return met.select("key", body.alias("text"), F.array_join(F.transform("c", lambda c: F.concat(c["number"].cast("string"), F.lit(". "), c["id"])), "\n").alias("sources"))


def keys_by_appearance(rows: DataFrame, group: str, order: str, item: str, prefix: str) -> DataFrame:
    """(group, item, key): E1, E2 ... in the order in which items first appear."""
    first = rows.groupBy(group, item).agg(F.min(order).alias("first"))
    return first.select(group, item, F.concat(F.lit(prefix), F.row_number().over(Window.partitionBy(group).orderBy("first", item)).cast("string")).alias("key"))


def is_subsequence(steps: Column, wanted: Column) -> Column:
    """Whether the wanted items stand among the steps in order."""
    return F.aggregate(steps, F.lit(0), lambda n, s: F.when(F.get(wanted, n) == s, n + 1).otherwise(n)) == F.size(wanted)


def free_orders(children: DataFrame, parent: str, order: str, tie: str) -> DataFrame:
    """Orders under a parent without collisions: each is its own, or the next free one after its predecessor.

    max over rows so far of (order - row number) + row number is that fold in closed form.
    """
    row = Window.partitionBy(parent).orderBy(order, tie)
    n = F.row_number().over(row)
    return children.withColumn("n", n).withColumn("place", F.max(F.col(order) - F.col("n")).over(row.rowsBetween(Window.unboundedPreceding, 0)) + F.col("n")).drop("n")


def markdown_rows(cells: Column) -> Column:
    """A table's row in Markdown; bars inside cells are escaped."""
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))


def search_status(failed: Column, legs: Column, hits: Column) -> Column:
    """FAILED when every leg failed, PARTIAL when some did, else OK, or NO_MATCH without a hit."""
    return F.when(failed == legs, "FAILED").when(failed > 0, "PARTIAL").when(hits == 0, "NO_MATCH").otherwise("OK")


def assign(pairs: DataFrame, case: str) -> DataFrame:
    """(case, gold, found, overlap) of a one-to-one assignment in each case with the most pairs, and among those the most overlap.

    pairs: (case, gold, found, overlap > 0). A case in which no gold and no found stands twice keeps all its pairs; the
    others take shortest augmenting paths. Cases come in order, many at a time; a task holds a batch and one case.
    """
    k = {f.name: f.dataType.simpleString() for f in pairs.schema}
    rows = pairs.select(case, "gold", "found", F.col("overlap").cast("double").alias("overlap")).repartition(case).sortWithinPartitions(case, "gold", "found")
    return rows.mapInArrow(_assigned, f"{case} {k[case]}, gold {k['gold']}, found {k['found']}, overlap double")


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value differs from the one before it; the first one does."""
    codes = column.dictionary_encode("encode").indices.to_numpy()
    return np.concatenate([[True], codes[1:] != codes[:-1]])


def _assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = int(np.flatnonzero(_changes(batch.column(0)))[-1])
        if last or held and held[-1].column(0)[-1] != batch.column(0)[0]:
            yield from _solved(pa.Table.from_batches([*held, batch.slice(0, last)]))
            held = []
        held.append(batch.slice(last))
    if held:
        yield from _solved(pa.Table.from_batches(held))


def _solved(rows: pa.Table) -> list[pa.RecordBatch]:
    """The assigned rows of whole cases, sorted by case, gold and found."""
    rows = rows.combine_chunks()
    case, gold, found = (rows.column(k).combine_chunks() for k in range(3))
    new = _changes(case)
    number, starts = np.cumsum(new) - 1, np.append(np.flatnonzero(new), len(new))
    codes = found.dictionary_encode("encode").indices.to_numpy().astype(np.int64)
    _, which, times = np.unique(number * len(codes) + codes, return_inverse=True, return_counts=True)
    shared = np.zeros(len(starts) - 1, dtype=bool)
    shared[number[~_changes(gold) & ~new]] = True
    shared[number[times[which] > 1]] = True
    kept = [np.flatnonzero(~shared[number])]
    for c in np.flatnonzero(shared):
        a, b = starts[c], starts[c + 1]
        own = zip(range(a, b), *(x.slice(a, b - a).to_pylist() for x in (gold, found)), rows.column(3).slice(a, b - a).to_pylist())
        kept.append(np.array(_matched(list(own)), dtype=np.int64))
    return rows.take(pa.array(np.sort(np.concatenate(kept)))).to_batches()


def _matched(rows: list[tuple]) -> list[int]:
    """The numbers of the assigned ones of one case's rows (number, gold, found, overlap)."""
    ends = [sorted({r[k] for r in rows}, key=lambda x: (x is not None, x)) for k in (1, 2)]
    gold, found = ({x: k for k, x in enumerate(e)} for e in ends)
    big = sum(r[3] for r in rows) + 1
    swap = len(gold) > len(found)
    cost = [[0.0] * max(len(gold), len(found)) for _ in range(min(len(gold), len(found)))]
    at = {}
    for number, g, f, overlap in rows:
        i, j = (found[f], gold[g]) if swap else (gold[g], found[f])
        cost[i][j], at[i, j] = -(big + overlap), number
    return [at[p] for p in enumerate(hungarian(cost)) if p in at]


def hungarian(cost: list[list[float]]) -> list[int]:
    """The column of each row, at least cost; no more rows than columns."""
    n, m = len(cost), len(cost[0]) if cost else 0
    u, v, owner = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, used, way = [float("inf")] * (m + 1), [False] * (m + 1), [0] * (m + 1)
        while owner[j0]:
            used[j0] = True
            i0, delta, j1 = owner[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    cur = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if cur < least[j]:
                        least[j], way[j] = cur, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[owner[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    out = [0] * n
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


def flag_decisions(decisions: DataFrame, supports: DataFrame, changed: DataFrame) -> DataFrame:
    """Decisions (id, reason) flagged by changes (source, verb): supports are (id, source, role), role cited or consulted."""
    hit = supports.join(changed, "source").groupBy("id").agg(
        F.bool_or((F.col("role") == "cited") & F.col("verb").isin("delete", "purge")).alias("removed"), F.bool_or(F.col("role") == "cited").alias("cited")
    )
    reason = F.when(F.col("removed"), "source_removed").when(F.col("cited"), "source_changed").otherwise(F.coalesce("reason", F.lit("consulted_source_changed")))
    return decisions.join(hit, "id", "left").select("id", F.when(F.col("cited").isNotNull(), reason).otherwise(F.col("reason")).alias("reason"))


def theme_support(members: DataFrame, mentions: DataFrame, names: DataFrame, limit: int) -> DataFrame:
    """(community, chunk, overlap, names): the ``limit`` chunks of each community that most of its members are mentioned in."""
    met = members.join(mentions, "id").join(names, "id")
    counted = met.groupBy("community", "chunk").agg(F.count_distinct("id").alias("overlap"), F.array_join(F.slice(F.array_sort(F.collect_set("name")), 1, 5), ",").alias("names"))
    order = Window.partitionBy("community").orderBy(F.desc("overlap"), "chunk")
    return counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
