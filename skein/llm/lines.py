"""Line dedup by winnowing over line hashes, in DataFrame functions only.

A window is the shortest run of lines from a line on, or up to a line, with ``MIN_WORDS`` words. Its least line hash is
its fingerprint: windows of equal lines select the same one, so every run that repeats is met through a fingerprint that
stands in two places. The windows on both sides of such a fingerprint are then compared as wholes, and a window that
stood earlier (by doc_id, then by line) is deleted. As every run with enough words is made of such windows, a line goes
exactly if it lies in a run of lines with ``MIN_WORDS`` words or more of which an equal one came before.

Lines are compared without outer spaces; lines of spaces only take no part, and go if they lie inside a deleted window.
A line has one word more than inner spaces.

Defined results: null text stays null and an empty one empty; rows with equal doc_id and text count once, and get the same
result; of different texts under one doc_id the one of smaller hash comes first; a null doc_id comes before all others;
n_chars, if there, becomes the new length; other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import hot_join, shuffled, written
from skein.llm.ordermin import let

MIN_WORDS = 50


def windows(docs: DataFrame, key: str, text: str, min_words: int) -> DataFrame:
    """(place: struct of id, th, start; end, fingerprint and its line, content) of each window."""
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("t"))
    lines = rows.select("id", "th", F.posexplode(F.split("t", "\n")).alias("pos", "line")).withColumn("line", F.trim("line")).where("line != ''")
    lines = lines.selectExpr("id", "th", "pos", "unhex(md5(line)) as h", "cast(length(line) - length(replace(line, ' ', '')) + 1 as bigint) as w")
    lines = lines.repartition("id", "th").dropDuplicates(["id", "th", "pos"])
    row = Window.partitionBy("id", "th")
    lines = lines.withColumn("stop", F.sum("w").over(row.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.expr("stop - w"))
    lines = lines.withColumn("x", F.xxhash64("h"))
    least = F.min(F.struct("x", "pos"))
    on = row.orderBy("start").rangeBetween(0, min_words - 1)
    upto = row.orderBy("stop").rangeBetween(-(min_words - 1), 0)
    both = lines.select(
        "id",
        "th",
        F.array(
            F.struct(F.col("pos").alias("first"), F.max("pos").over(on).alias("last"), (F.max("stop").over(on) - F.col("start")).alias("words"), least.over(on).alias("mark"), _content(F.collect_list("h").over(on)).alias("content")),
            F.struct(F.min("pos").over(upto).alias("first"), F.col("pos").alias("last"), (F.col("stop") - F.min("start").over(upto)).alias("words"), least.over(upto).alias("mark"), _content(F.collect_list("h").over(upto)).alias("content")),
        ).alias("two"),
    )
    return both.select("id", "th", F.inline("two")).where(F.col("words") >= min_words).drop("words")


def _content(hashes: Column) -> Column:
    return F.struct(F.xxhash64(hashes).alias("a"), F.xxhash64(F.lit(1), hashes).alias("b"))


def repeated_runs(found: DataFrame) -> DataFrame:
    """(id, th, runs): for each row with lines to delete, the maximal runs (first, last) of them, in order."""
    found = written(found, "windows")  # read three times
    rows, place = found.count(), F.struct("id", "th", F.col("mark.pos").alias("pos"))
    marks = found.groupBy(F.col("mark.x").alias("x")).agg(F.min(place).alias("least"), F.max(place).alias("most"), F.count("*").alias("n")).where("least != most").select("x", "n")
    met = hot_join(found.withColumn("x", F.col("mark.x")), written(marks, "marks"), ["x"], rows).select("content", F.struct("id", "th", "first").alias("at"), "last")
    met = written(met, "met")
    earliest = met.groupBy("content").agg(F.min("at").alias("earliest"), F.count("*").alias("n")).where("n > 1")
    later = hot_join(met, written(earliest, "earliest"), ["content"], rows).where("at > earliest").selectExpr("at.id as id", "at.th as th", "at.first as first", "last")
    later = later.groupBy("id", "th", "first").agg(F.max("last").alias("last"))
    row = Window.partitionBy("id", "th").orderBy("first")
    later = later.withColumn("reached", F.max("last").over(row.rowsBetween(Window.unboundedPreceding, -1)))
    later = later.withColumn("run", F.sum(F.expr("case when reached is null or first > reached + 1 then 1 else 0 end")).over(row.rowsBetween(Window.unboundedPreceding, 0)))
    later = later.groupBy("id", "th", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return later.groupBy("id", "th").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))


def _kept(lines: Column, runs: Column) -> Column:
    """The lines outside the runs: what lies before each and after the last."""

    def before(i: Column) -> Column:
        start = F.coalesce(F.get(runs, i - 1)["last"] + 1, F.lit(0))
        end = F.coalesce(F.get(runs, i)["first"], F.size(lines))
        return F.slice(lines, start + 1, end - start)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(runs)), before))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without later repeated runs of lines, and with n_lines and n_removed."""
    runs = repeated_runs(windows(docs.select(key, F.col(text).cast("string").alias(text)), key, text, min_words))
    runs = runs.select(F.col("id").alias("__id"), F.col("th").alias("__th"), F.col("runs").alias("__runs"))
    docs = docs.withColumn(text, F.col(text).cast("string")).withColumn("__th", F.xxhash64(text))
    joined = docs.join(shuffled(runs), docs[key].eqNullSafe(runs["__id"]) & (docs["__th"] == runs["__th"]), "left").select(docs["*"], "__runs")
    before = F.coalesce(F.size(F.split(text, "\n")).cast("long"), F.lit(0).cast("long"))
    removed = F.coalesce(F.aggregate("__runs", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1), F.lit(0).cast("long"))
    new = F.when(F.col("__runs").isNull(), F.col(text)).otherwise(let(F.split(text, "\n"), lambda lines: F.array_join(_kept(lines, F.col("__runs")), "\n")))
    out = joined.withColumns({"n_lines": before, "n_removed": removed, text: new}).drop("__runs", "__th")
    return out.withColumn("n_chars", F.length(text).cast("long")) if "n_chars" in docs.columns else out


def digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, kept_sha256 (null: empty)."""
    return dedup_lines(docs.select("doc_id", "text")).selectExpr("doc_id", "n_lines", "n_removed", "sha2(coalesce(text, ''), 256) as kept_sha256")


ORACLE = f"""
WITH l AS (SELECT doc_id, pos, trim(line) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents) x),
w AS (SELECT doc_id, pos, line, len(line) - len(replace(line, ' ', '')) + 1 AS w FROM l WHERE line <> ''),
c AS (SELECT *, CAST(sum(w) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS stop FROM w),
s AS (SELECT *, stop - w AS start FROM c),
v AS (
  SELECT doc_id, pos AS a, max(pos) OVER f AS b, max(stop) OVER f - start AS n, list(line) OVER f AS content FROM s
  WINDOW f AS (PARTITION BY doc_id ORDER BY start RANGE BETWEEN CURRENT ROW AND {MIN_WORDS - 1} FOLLOWING)
  UNION ALL
  SELECT doc_id, min(pos) OVER f, pos, stop - min(start) OVER f, list(line) OVER f FROM s
  WINDOW f AS (PARTITION BY doc_id ORDER BY stop RANGE BETWEEN {MIN_WORDS - 1} PRECEDING AND CURRENT ROW)),
k AS (SELECT doc_id, a, b, md5(array_to_string(content, chr(10))) AS content FROM v WHERE n >= {MIN_WORDS}),
e AS (SELECT content, min((doc_id, a)) AS earliest FROM k GROUP BY content),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS pos FROM k JOIN e USING (content) WHERE (doc_id, a) > earliest),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents) y ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(string_split(d.text, chr(10))) AS BIGINT) AS n_lines, CAST(coalesce(m.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM documents d LEFT JOIN m USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
