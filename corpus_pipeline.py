"""A training corpus from raw documents: quality, lines, near-duplicates, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir), with ``docs`` of the columns of ``documents``, and works on all that its predecessor
kept. All but the last return those columns; the last returns the ids of each kept document.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import bpe, decontaminate, lines, nbsvm, simhash
from skein.llm.common import apart, shuffled, written
from skein.llm.queries import BPE_RANKS, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labelled rows of ``docs`` that aren't held out.

    Null text is scored as empty; repeated rows get one score each, the same; a score of exactly 0.5 stays; where no row is
    labelled every score is 0.5, so all stay; an empty table gives an empty one.
    """
    labels = table(spark, sf_dir, "labels")
    fitted = nbsvm.model(docs, labels, "quality", ~nbsvm.held_out("id", 3, 1))
    return nbsvm.score(docs.select(*COLUMNS), fitted, "__quality").where("__quality >= 0.5").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines go from the texts; a document of which nothing but white space is left goes too.

    Null text stays null; documents that were blank before stay; rows with equal id and text count once and get the same
    result; an empty table gives an empty one.
    """
    clean = lines.dedup_lines(docs.select(*COLUMNS))
    return clean.where("n_removed = 0 or trim(text) != ''").select(*COLUMNS)


def _keyed(docs: DataFrame) -> DataFrame:
    """With a key that also tells rows without id, and texts under one id, apart."""
    return docs.select(*COLUMNS).withColumns({"__id": F.coalesce("doc_id", F.lit(-(1 << 63))), "__th": F.xxhash64("text")})


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest doc_id (null is smallest), of its texts the one of smaller hash; rows that repeat stay once.

    A group is what links of a five-word Jaccard similarity of 0.8 or more join; SimHash finds the pairs that are compared.
    """
    keyed = _keyed(docs)
    groups = simhash.near_texts(keyed.select(F.struct("__id", "__th").alias("doc_id"), "text"))
    rows = written(groups.select("doc_id.*", (F.col("doc_id") == F.col("component")).alias("kept")), "groups")
    # only rows that go or repeat are looked for; the texts of all others stay where they are
    touched = rows.groupBy("__id", "__th").agg(F.count("*").alias("n"), F.first("kept").alias("kept")).where("n > 1 or not kept")
    maybe, others = apart(keyed, touched, ["__id", "__th"])
    kept = rows.where("kept").select("__id", "__th").distinct()
    found = maybe.join(shuffled(kept), ["__id", "__th"]).dropDuplicates(["__id", "__th"])
    return others.select(*COLUMNS).unionByName(found.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null and wordless texts hold none and stay; repeated rows are kept or go together; of several texts under one id, or
    without id, each is judged by itself; an empty table gives an empty one.
    """
    keyed = _keyed(docs)
    found = decontaminate.decontaminate(keyed.select(F.concat_ws(":", "__id", "__th").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    hit = written(found.where("n_hit > 0").select(F.col("doc_id").alias("__key")).distinct(), "hit")
    maybe, others = apart(keyed.withColumn("__key", F.concat_ws(":", "__id", "__th")), hit, ["__key"])
    return others.select(*COLUMNS).unionByName(maybe.join(shuffled(hit), "__key", "left_anti").select(*COLUMNS))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens) of each row, after its ids have been decoded again and compared with its text.

    Null and empty texts have no ids; repeated rows are coded each; an empty table gives an empty one.
    """
    path = public_tokenizers.path(BPE_RANKS)
    whole = docs.select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha"))
    coded = bpe.round_trip(whole, path, public_tokenizers.PATTERN)
    same = F.sha2("decoded", 256) == F.col("sha")
    return coded.select("doc_id", F.when(same, F.col("ids")).otherwise(F.raise_error(F.lit("ids that don't decode to their text"))).alias("ids"), F.size("ids").cast("long").alias("n_tokens"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", encoding),
]
#: The classifier and the encoder are beyond SQL; tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
