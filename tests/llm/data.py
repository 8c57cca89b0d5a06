"""Small tables for the operators: edge cases and a slice of the test data."""

import duckdb

BENCH = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
    (2, "Short item here"),
    (10, "one two three four five six seven"),
    (3, ""),
    (4, None),
    (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
    (6, "solo"),
]
EDGES = [
    (0, None), (1, ""), (2, "   \n\t "), (3, "a"), (4, "Alpha, beta gamma; delta epsilon zeta eta theta iota kappa lambda MU nu"),
    (5, "so a short item here and SHORT ITEM here"), (6, "é ü 日本語 テキスト naïve"), (7, "x" * 5000), (8, "ab " * 3000),
    (9, "one two three four five six seven " * 3), (9, "one two three four five six seven " * 3), (11, "a b c d e f"), (12, "a b c d e f"),
    (13, "line one\n\nline two\n\nline one\n"), (None, "no id alpha beta gamma delta epsilon zeta eta theta iota kappa"), (15, "A B C D E F\x1c\x1dtail"),
    (16, "solo solo"), (17, "beta alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu alpha beta gamma delta epsilon zeta eta theta iota kappa"),
]
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, key string, fp string, part string, words string"


def edge_docs(spark, rows=EDGES):
    """With columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "x", "x", "x", "x") for i, t in rows], DOC_SCHEMA).repartition(3)


def read(sf, name):
    return duckdb.sql(f"select * from '/root/testdata/{sf}/{name}.parquet' order by 1").fetchall()


def texts(sf="sf0.001"):
    return [(r[0], r[1]) for r in read(sf, "documents")]
