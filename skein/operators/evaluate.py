"""Quality measures over gold and found rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """1 where there is nothing to find."""
    return F.when(whole == 0, F.lit(1.0)).otherwise(part / whole)


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))


def pooled(gold: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """One row: precision, recall and F1 of found rows against gold rows, both as sets."""
    g, f = gold.select(*keys).distinct().withColumn("g", F.lit(1)), found.select(*keys).distinct().withColumn("f", F.lit(1))
    both = g.join(f, keys, "full_outer").agg(F.count(F.when(F.col("g").isNotNull() & F.col("f").isNotNull(), 1)).alias("hit"), F.count("g").alias("g"), F.count("f").alias("f"))
    p, r = ratio(F.col("hit"), F.col("f")), ratio(F.col("hit"), F.col("g"))
    return both.select(F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1(p, r), 6).alias("f1"))


def bcubed(gold: DataFrame, found: DataFrame) -> DataFrame:
    """One row: B-cubed precision, recall and F1 of clusters (id, cluster); sizes are counted, never pairs."""
    rows = gold.select("id", F.col("cluster").alias("g")).join(found.select("id", F.col("cluster").alias("f")), "id")
    cells = rows.groupBy("g", "f").agg(F.count("*").alias("n"))
    fs, gs = rows.groupBy("f").agg(F.count("*").alias("fn")), rows.groupBy("g").agg(F.count("*").alias("gn"))
    cells = cells.join(fs, "f").join(gs, "g")
    total = cells.agg((F.sum(F.col("n") * F.col("n") / F.col("fn")) / F.sum("n")).alias("p"), (F.sum(F.col("n") * F.col("n") / F.col("gn")) / F.sum("n")).alias("r"))
    return total.select(F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round(f1(F.col("p"), F.col("r")), 6).alias("f1"))


def pairwise(gold: DataFrame, found: DataFrame) -> DataFrame:
    """One row: precision, recall and F1 over pairs within clusters, from the sizes of cells."""
    rows = gold.select("id", F.col("cluster").alias("g")).join(found.select("id", F.col("cluster").alias("f")), "id")
    pairs = lambda n: n * (n - 1) / 2
    count = lambda *by: rows.groupBy(*by).agg(F.count("*").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("x"))
    three = count("g", "f").withColumn("k", F.lit("both")).union(count("f").withColumn("k", F.lit("f"))).union(count("g").withColumn("k", F.lit("g")))
    one = three.agg(*[F.max(F.when(F.col("k") == k, F.col("x"))).alias(k) for k in ("both", "f", "g")])
    p, r = ratio(F.col("both"), F.col("f")), ratio(F.col("both"), F.col("g"))
    return one.select(F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1(p, r), 6).alias("f1"))


def per_class(rows: DataFrame, gold: str, found: str) -> DataFrame:
    """(class, precision, recall, f1) of each class that stands on either side."""
    cells = rows.groupBy(F.col(gold).alias("g"), F.col(found).alias("f")).agg(F.count("*").alias("n"))
    sides = cells.selectExpr("g as class", "case when g = f then n else 0 end as hit", "n as gn", "0L as fn").union(cells.selectExpr("f", "0L", "0L", "n"))
    summed = sides.groupBy("class").agg(F.sum("hit").alias("hit"), F.sum("gn").alias("gn"), F.sum("fn").alias("fn"))
    p, r = ratio(F.col("hit"), F.col("fn")), ratio(F.col("hit"), F.col("gn"))
    return summed.select("class", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1(p, r), 6).alias("f1"))


def confusion(rows: DataFrame, gold: str, found: str, classes: list) -> DataFrame:
    return rows.groupBy(F.col(gold).alias("gold")).pivot(found, classes).agg(F.count(F.lit(1))).na.fill(0)


def means(scores: DataFrame, group: str, metric: str, value: str) -> DataFrame:
    """Means of each metric overall (group null) and by group, clamped to 0..1."""
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(value)))
    rows = scores.select(F.col(group).alias("grp"), F.col(metric).alias("metric"), clamped.alias("v"))
    return rows.groupingSets([[F.col("metric")], [F.col("metric"), F.col("grp")]], "metric", "grp").agg(F.round(F.avg("v"), 12).alias("mean"), F.count("*").alias("n"))


def span_overlap(gold: DataFrame, found: DataFrame, case: str = "case") -> DataFrame:
    """(case, precision, recall) in characters of spans (case, start, end); each side's own spans don't overlap."""
    met = gold.select(case, F.col("start").alias("gs"), F.col("end").alias("ge")).join(found.select(case, F.col("start").alias("fs"), F.col("end").alias("fe")), case)
    shared = met.groupBy(case).agg(F.sum(F.greatest(F.lit(0), F.least("ge", "fe") - F.greatest("gs", "fs"))).alias("hit"))
    size = lambda df, name: df.groupBy(case).agg(F.sum(F.col("end") - F.col("start")).alias(name))
    joined = size(gold, "g").join(size(found, "f"), case, "full_outer").join(shared, case, "left").na.fill(0)
    return joined.select(case, F.round(ratio(F.col("hit"), F.col("f")), 6).alias("precision"), F.round(ratio(F.col("hit"), F.col("g")), 6).alias("recall"))


def iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    shared = F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))
    either = (a_end - a_start) + (b_end - b_start) - shared
    return F.when(either == 0, F.lit(0.0)).otherwise(shared / either)


def rubric(points: Column, met: Column) -> Column:
    """Points met among the positive ones, clamped to 0..1 (as aggregates)."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.sum(F.when(met, points).otherwise(0)) / F.sum(F.when(points > 0, points))))


def smoothed_f_beta(p: Column, r: Column, beta: float = 1.0, smooth: float = 1e-9) -> Column:
    b = beta * beta
    return (1 + b) * p * r / (b * p + r + smooth)


def lcs_length(a: list[str], b: list[str]) -> int:
    where: dict[str, int] = {}
    for k, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << k
    row = full = (1 << len(a)) - 1
    for x in b:
        match = row & where.get(x, 0)
        row = ((row + match) | (row - match)) & full
    return len(a) - row.bit_count()


def stem(word: str) -> str:
    """A light English stemmer: plural and common verb endings."""
    for end in ("ies", "ing", "ed", "es", "s"):
        if word.endswith(end) and len(word) - len(end) >= 3:
            return word[: -len(end)] + ("y" if end == "ies" else "")
    return word


def rouge_l(pairs: DataFrame, reference: str, answer: str, out: str = "rouge_l") -> DataFrame:
    """Add the F measure of the longest common subsequence of stemmed words."""
    from skein.functions.text import tokens

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        values = []
        for x, y in zip(a, b):
            x, y = [stem(w) for w in x], [stem(w) for w in y]
            n = lcs_length(x, y)
            values.append(0.0 if not n else 2 * n / (len(x) + len(y)))
        return pd.Series(values, dtype="float64")

    return pairs.withColumn(out, F.round(score(tokens(F.col(reference)), tokens(F.col(answer))), 6))


def kendall_tau_b(a: list[float], b: list[float]) -> float:
    """Tau-b of two rankings; 0 where either is constant."""
    concordant = discordant = tie_a = tie_b = 0
    for i in range(len(a)):
        for j in range(i):
            x, y = (a[i] > a[j]) - (a[i] < a[j]), (b[i] > b[j]) - (b[i] < b[j])
            if not x and not y:
                continue
            if not x:
                tie_a += 1
            elif not y:
                tie_b += 1
            elif x == y:
                concordant += 1
            else:
                discordant += 1
    size = ((concordant + discordant + tie_a) * (concordant + discordant + tie_b)) ** 0.5
    return (concordant - discordant) / size if size else 0.0
