"""The engine: documents in, a versioned graph of chunks and mentions, searches and explorations out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import schema as sc
from skein.functions import text as tx
from skein.operators import chunks as ch
from skein.operators import extract as ex
from skein.operators import graph as gr
from skein.operators import history as hs
from skein.operators import merge as mg
from skein.operators import search as se
from skein.operators.snapshots import Store

DOCUMENT = "doc_id string, text string, title string"


class GraphEngine:
    """Tables: documents (with content_hash, valid_at, invalid_at), chunks, mentions, activations, matches."""

    def __init__(self, spark: SparkSession, uri: str, schema: sc.GraphSchema = sc.DEFAULT, names: DataFrame | None = None) -> None:
        self.spark, self.store, self.schema = spark, Store(spark, uri), schema
        self.names = names

    def _history(self) -> DataFrame:
        found = self.store.table("documents")
        return found if found is not None else self.spark.createDataFrame([], "doc_id string, content_hash string, text string, title string, valid_at timestamp, invalid_at timestamp")

    def documents(self) -> DataFrame:
        """The open version of each document."""
        return self._history().where("invalid_at is null")

    def chunks(self) -> DataFrame:
        return ch.paragraphs(self.documents())

    def mentions(self) -> DataFrame:
        found = self.store.table("mentions")
        return found if found is not None else self.spark.createDataFrame([], "chunk_id string, label string, text string, char_start long, char_end long, confidence double")

    def _publish(self, history: DataFrame, verb: str, ids: DataFrame, at: str) -> None:
        job = self.store.begin()
        job.stage("documents", history)
        written = self.spark.read.parquet(f"{self.store.uri}/{job.staged['documents']}")
        if self.names is not None:
            closure = self.schema.frames(self.spark)[0]
            found = ex.dictionary(ch.paragraphs(written.where("invalid_at is null")), self.names)
            job.stage("mentions", ex.kept(ex.best_per_span(found, closure)).select("chunk_id", "label", "text", "char_start", "char_end", "confidence"), ["label"])
        log = self.activations()
        job.stage("activations", log.unionByName(hs.append(log.select("doc_id", "seq"), ids.select("doc_id").distinct().select("doc_id", F.lit(verb).alias("verb"), F.lit(at).cast("timestamp").alias("at")), "doc_id", ["at"]).select("doc_id", F.col("seq").cast("long").alias("seq"), "verb", "at")))
        job.publish()

    def activations(self) -> DataFrame:
        """(doc_id, seq, verb, at): the change feed."""
        found = self.store.table("activations")
        return found if found is not None else self.spark.createDataFrame([], "doc_id string, seq long, verb string, at timestamp")

    def _incoming(self, docs: DataFrame) -> DataFrame:
        return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.sha2("text", 256).alias("content_hash"), "text", F.col("title") if "title" in docs.columns else F.lit(None).cast("string").alias("title"))

    def add(self, docs: DataFrame, at: str) -> None:
        """New documents open; known ones get a new version where their content differs. Others stay."""
        new = self._incoming(docs)
        history = self._history()
        touched = history.join(new.select("doc_id"), "doc_id", "left_semi")
        others = history.join(new.select("doc_id"), "doc_id", "left_anti")
        moved = mg.close_versions(touched, new, "doc_id", ["content_hash", "text", "title"], F.lit(at).cast("timestamp"))
        self._publish(others.unionByName(moved.select(*others.columns)), "add", new, at)

    update = add

    def delete(self, ids: list[str], at: str) -> None:
        """Close the documents; their versions stay."""
        gone = F.col("doc_id").isin(ids)
        history = self._history()
        closed = history.withColumn("invalid_at", F.when(gone & F.col("invalid_at").isNull(), F.lit(at).cast("timestamp")).otherwise(F.col("invalid_at")))
        self._publish(closed, "delete", history.where(gone & F.col("invalid_at").isNull()), at)

    def purge(self, ids: list[str], at: str) -> None:
        """Remove all versions of the documents."""
        history = self._history()
        self._publish(history.where(~F.col("doc_id").isin(ids)), "purge", history.where(F.col("doc_id").isin(ids)), at)

    def source_status(self) -> DataFrame:
        """(doc_id, state): CURRENT, DELETED or UNKNOWN of every document ever activated."""
        last = hs.latest(self.activations(), ["doc_id"], F.col("seq"))
        open_ = self.documents().select("doc_id", F.lit(True).alias("open"))
        return last.join(open_, "doc_id", "left").select("doc_id", F.when(F.col("open"), "CURRENT").when(F.col("verb").isin("delete", "purge"), "DELETED").otherwise("UNKNOWN").alias("state"))

    def search_passages(self, text: str, limit: int = 10, scope: list[str] | None = None) -> DataFrame:
        """(rank, chunk_id, score, snippet, evidence_id) of the best passages by words."""
        if not 1 <= limit <= 50:
            raise ValueError("limit must be from 1 to 50")
        seen = self.chunks()
        if scope is not None:
            seen = seen.where(F.col("doc_id").isin(scope))
        asked = self.spark.createDataFrame([(1, text)], "query_id int, query string")
        hits = se.top_k(se.bm25(seen, asked, k=limit), limit, key="chunk_id")
        return hits.join(seen, "chunk_id").join(ch.text_references(seen), "chunk_id").select("rank", "chunk_id", "score", tx.snippet(F.col("chunk_text")).alias("snippet"), "evidence_id").orderBy("rank")

    def entities(self) -> DataFrame:
        """(id, label, name, mentions): mentions of one label and normalised name are one entity."""
        rows = self.mentions().withColumn("id", tx.merge_key(F.col("label"), F.col("text")))
        return rows.groupBy("id", "label").agg(F.min_by("text", F.struct("chunk_id", "char_start")).alias("name"), F.count("*").alias("mentions"))

    def co_mentions(self) -> DataFrame:
        """(src, dst, type, weight): entities that share chunks, and how many."""
        rows = self.mentions().select("chunk_id", tx.merge_key(F.col("label"), F.col("text")).alias("id")).distinct()
        met = rows.withColumnRenamed("id", "src").join(rows.withColumnRenamed("id", "dst"), "chunk_id").where("src < dst")
        return met.groupBy("src", "dst").agg(F.count("*").alias("weight")).withColumn("type", F.lit("CO_MENTIONED"))

    def explore_relationships(self, entity: str, depth: int = 2) -> DataFrame:
        return gr.bfs(self.co_mentions(), self.spark.createDataFrame([(entity,)], "id string"), depth)

    def detect_communities(self, rounds: int = 8) -> tuple[DataFrame, DataFrame, DataFrame]:
        edges = self.co_mentions()
        return gr.community_stats(edges, gr.label_propagation(edges, rounds))
