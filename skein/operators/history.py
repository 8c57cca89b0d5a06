"""Append-only task history, steps, decisions and candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATE_RANK = ["blocked", "in_progress", "pending", "completed", "cancelled"]
TRANSITIONS = {"approved": ["pending", "rejected"], "rejected": ["pending", "approved"], "pending": ["approved", "rejected"]}


def append(log: DataFrame, new: DataFrame, task: str, order: list[str]) -> DataFrame:
    """New rows numbered on from each task's last seq, without a gap. log: (task, seq); new rows come with ``order``."""
    last = log.groupBy(task).agg(F.max("seq").alias("last"))
    row = F.row_number().over(Window.partitionBy(task).orderBy(*order))
    return new.join(last, task, "left").withColumn("seq", F.coalesce("last", F.lit(0)) + row).drop("last")


def replay(requests: DataFrame, keys: list[str], digest: str, order: list[str]) -> DataFrame:
    """Each request's outcome: stored (the first of its id), replayed (same digest) or request_id_reused (another)."""
    own = Window.partitionBy(*keys).orderBy(*order)
    first, n = F.first(digest).over(own), F.row_number().over(own)
    return requests.withColumn("outcome", F.when(n == 1, "stored").when(F.col(digest) == first, "replayed").otherwise("request_id_reused"))


def latest(rows: DataFrame, keys: list[str], by: Column) -> DataFrame:
    """The row of each key that is greatest by ``by``."""
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), by).alias("r"))
    return picked.select(*keys, "r.*")


def grouped_steps(steps: DataFrame, task: str, state: str, name: str, cap: int = 50) -> DataFrame:
    """Steps of a task by the rank of their state and by name, at most ``cap`` a state, with its count and whether it was cut."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, STATE_RANK)), F.col(state)), F.lit(0)).cast("int")
    group = Window.partitionBy(task, state)
    rows = steps.withColumn("state_rank", F.when(rank == 0, len(STATE_RANK) + 1).otherwise(rank))
    rows = rows.withColumn("place", F.row_number().over(group.orderBy(name))).withColumn("in_state", F.count("*").over(group))
    return rows.withColumn("cut", F.col("in_state") > cap).where(F.col("place") <= cap)


def conflicts(decisions: DataFrame, choice: str, conclusion: str, task: str) -> DataFrame:
    """Choices that different tasks decided differently: (choice, conclusions, tasks)."""
    return decisions.groupBy(choice).agg(F.count_distinct(conclusion).alias("conclusions"), F.count_distinct(task).alias("tasks")).where("conclusions > 1 and tasks > 1")


def conflicting(decisions: DataFrame, choice: str, conclusion: str, task: str) -> DataFrame:
    """Decisions against which another task's decision on the same choice stands, without pairing them: what others
    decided is read off counts of (choice, task, conclusion) and their totals."""
    kinds = decisions.groupBy(choice, task, conclusion).agg(F.lit(1).alias("one"))
    same_task = Window.partitionBy(choice, task)
    same_end = Window.partitionBy(choice, conclusion)
    whole = Window.partitionBy(choice)
    # kinds of others that end otherwise: all - own task's - own conclusion's + own
    others = F.sum("one").over(whole) - F.sum("one").over(same_task) - F.sum("one").over(same_end) + 1
    against = kinds.withColumn("against", others).where("against > 0").select(choice, task, conclusion)
    return decisions.join(against, [choice, task, conclusion], "left_semi")


def listed(candidates: DataFrame, least: int = 1) -> DataFrame:
    """Candidates by key and state: totals, best confidence, representative, distinct chunks and documents."""
    grouped = candidates.groupBy("key", "state").agg(F.sum("n").alias("total"), F.max("confidence").alias("confidence"), F.min("id").alias("representative"), F.count_distinct("chunk").alias("chunks"), F.count_distinct("doc").alias("docs"))
    return grouped.where(F.col("total") >= least)


def review(candidates: DataFrame, wanted: DataFrame) -> DataFrame:
    """Candidates (id, state) after reviews (id, to): a review counts only from a state that may reach it."""
    allowed = F.lit(False)
    for to, froms in TRANSITIONS.items():
        allowed = allowed | ((F.col("to") == to) & F.col("state").isin(froms))
    met = candidates.join(wanted, "id", "left")
    return met.select("id", F.when(allowed, F.col("to")).otherwise(F.col("state")).alias("state"), F.coalesce(allowed, F.lit(False)).alias("changed"))


def escalation(chunks: DataFrame, budget: float, scope: list[str]) -> DataFrame:
    """The chunks that are escalated: by (group, score, position), a share ``budget`` of all, one at least.

    chunks: (scope..., position, kept, scored_below, relations, words, weakest). Position ranks within the scope.
    """
    group = F.when((F.col("kept") == 0) & (F.col("words") >= 8), 2).when((F.col("kept") > 0) & F.col("weak"), F.when((F.col("kept") >= 2) & (F.col("relations") == 0), 0).otherwise(1))
    score = F.when(F.col("kept") == 0, F.lit(0.0)).otherwise(F.coalesce("weakest", F.lit(1.0)))
    ranked = chunks.withColumn("grp", group).withColumn("score", score)
    total = F.count("*").over(Window.partitionBy(*scope))
    ranked = ranked.withColumn("allowed", F.greatest(F.lit(1), F.ceil(F.round(total * budget, 9)))).where("grp is not null")
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy(*scope).orderBy("grp", "score", "position"))).where("place <= allowed")
