"""Extraction: from raw spans and relations to valid mentions, relations and candidates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as tx

CUT, BAND, KEEP = 0.7, 0.3, 0.5


def dictionary(chunks: DataFrame, names: DataFrame, confidence: float = 1.0) -> DataFrame:
    """(chunk_id, label, text, char_start, char_end, confidence): each place where a one-word name of (label, name) stands as a word.

    Words are joined with names, so neither side is held whole by a task; places come from the words' own lengths.
    """
    parts = chunks.select("chunk_id", F.posexplode(F.regexp_extract_all(F.col("chunk_text"), F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_]+)"), F.lit(1))).alias("n", "part"))
    order = Window.partitionBy("chunk_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    placed = parts.withColumn("char_end", F.sum(F.length("part")).over(order)).withColumn("char_start", F.col("char_end") - F.length("part")).withColumn("word", F.lower("part"))
    met = placed.join(names.select("label", F.lower("name").alias("word")).distinct(), "word")
    return met.select("chunk_id", "label", F.col("part").alias("text"), "char_start", "char_end", F.lit(confidence).alias("confidence"))


def plugged(chunks: DataFrame, extractor: Callable[[str], list[tuple[str, str, int, int, float]]]) -> DataFrame:
    """Mentions of any extractor of one text: (label, text, start, end, confidence) each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, *m) for i, t in zip(frame["chunk_id"], frame["chunk_text"]) for m in extractor(t or "")]
            yield pd.DataFrame(rows, columns=["chunk_id", "label", "text", "char_start", "char_end", "confidence"])

    return chunks.select("chunk_id", "chunk_text").mapInPandas(run, "chunk_id string, label string, text string, char_start long, char_end long, confidence double")


def best_per_span(mentions: DataFrame, closure: DataFrame) -> DataFrame:
    """One mention a span: the highest (confidence, depth of its label, label). closure: (label, ancestor, distance)."""
    depth = closure.groupBy("label").agg((F.count("*") - 1).alias("depth"))
    rows = mentions.join(F.broadcast(depth), "label", "left").na.fill({"depth": 0})  # depth: one row a label
    best = rows.groupBy("chunk_id", "char_start", "char_end").agg(F.max_by(F.struct("label", "text", "confidence"), F.struct(F.coalesce("confidence", F.lit(-1.0)).alias("c"), F.col("depth"), F.col("label"))).alias("m"))
    return best.select("chunk_id", "char_start", "char_end", "m.label", "m.text", "m.confidence")


def kept(mentions: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Mentions without confidence, or at or above their label's threshold."""
    need = F.lit(KEEP)
    for label, t in (thresholds or {}).items():
        need = F.when(F.col("label") == label, t).otherwise(need)
    return mentions.where(F.col("confidence").isNull() | (F.col("confidence") >= need))


def relations(raw: DataFrame, mentions: DataFrame, allowed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejected) of raw relations (chunk_id, type, src_text, dst_text, score).

    An end is the one mention of its chunk with that text, case apart; else it is unresolved. Rejected ones carry a reason;
    relations of a mention with itself go; repeated ones keep the highest score.
    """
    ends = mentions.groupBy("chunk_id", F.lower("text").alias("t")).agg(F.count("*").alias("n"), F.first("label").alias("label"), F.min("char_start").alias("at")).where("n = 1")
    src = ends.select("chunk_id", F.col("t").alias("s"), F.col("label").alias("src_label"), F.col("at").alias("src_at"))
    dst = ends.select("chunk_id", F.col("t").alias("d"), F.col("label").alias("dst_label"), F.col("at").alias("dst_at"))
    rows = raw.withColumn("s", F.lower("src_text")).withColumn("d", F.lower("dst_text")).join(src, ["chunk_id", "s"], "left").join(dst, ["chunk_id", "d"], "left")
    rows = rows.join(F.broadcast(allowed.withColumn("ok", F.lit(True))), ["type", "src_label", "dst_label"], "left")  # allowed: the schema's patterns
    reason = F.when(F.col("score") < CUT, "below_relation_cut").when(F.col("src_at").isNull() | F.col("dst_at").isNull(), "unresolved_endpoint").when(F.col("ok").isNull(), "off_pattern")
    rows = rows.withColumn("reason", reason)
    good = rows.where("reason is null and src_at != dst_at").groupBy("chunk_id", "type", "src_at", "dst_at").agg(F.max("score").alias("score"))
    return good, rows.where("reason is not null").select("chunk_id", "type", "src_text", "dst_text", "score", "reason")


def band(mentions: DataFrame, good: DataFrame) -> DataFrame:
    """Weak mentions that might be candidates: BAND <= confidence < CUT, and no character of a kept span.

    Kept spans are taken apart into characters' blocks of 64, so the overlap is an equi-join.
    """
    weak = mentions.where((F.col("confidence") >= BAND) & (F.col("confidence") < CUT))
    blocks = lambda: F.explode(F.sequence((F.col("char_start") / 64).cast("long"), ((F.col("char_end") - 1) / 64).cast("long"))).alias("block")
    a = weak.select("chunk_id", "label", "char_start", "char_end", blocks())
    b = good.select("chunk_id", F.col("char_start").alias("s"), F.col("char_end").alias("e"), blocks())
    hit = a.join(b, ["chunk_id", "block"]).where("char_start < e and s < char_end").select("chunk_id", "label", "char_start", "char_end").distinct()
    return weak.join(hit, ["chunk_id", "label", "char_start", "char_end"], "left_anti")


def validate(mentions: DataFrame, closure: DataFrame, declared: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(valid mentions, unknown ones, undeclared properties) of mentions with ``properties`` map<string,string>."""
    known = closure.select("label").distinct()
    valid, unknown = mentions.join(F.broadcast(known), "label", "left_semi"), mentions.join(F.broadcast(known), "label", "left_anti")  # known: the schema's labels
    names = declared.groupBy("label").agg(F.collect_set("property").alias("names"))
    joined = valid.join(F.broadcast(names), "label", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    extra = joined.select("chunk_id", "label", "text", "names", F.explode("properties").alias("property", "value")).where(~F.array_contains("names", F.col("property"))).drop("names")
    clean = joined.withColumn("properties", F.map_filter("properties", lambda k, v: F.array_contains(F.col("names"), k))).drop("names")
    return clean, unknown, extra


def union_extractors(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mentions of two extractors: the n-th of a name in one stands for the n-th in the other; the higher confidence stays."""
    order = Window.partitionBy("chunk_id", "label", "key").orderBy("char_start")
    number = lambda df: df.withColumn("key", tx.collapse(F.col("text"))).withColumn("nth", F.row_number().over(order))
    x, y = number(a).alias("x"), number(b).alias("y")
    keys = ["chunk_id", "label", "key", "nth"]
    cond = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in keys]
    both = x.join(y, cond, "full_outer")
    pick = lambda c: F.coalesce(F.col(f"x.{c}"), F.col(f"y.{c}")).alias(c)
    found = F.concat_ws(",", F.when(F.col("x.chunk_id").isNotNull(), "a"), F.when(F.col("y.chunk_id").isNotNull(), "b"))
    return both.select(pick("chunk_id"), pick("label"), pick("text"), pick("char_start"), pick("char_end"), F.greatest("x.confidence", "y.confidence").alias("confidence"), found.alias("extractors"))
