"""Files to documents: text, records, chats, pages.

Every reader gives (source, record, title, text, source_hash, content_hash, error); rows that can't be read carry an error
and no text, so a caller raises, skips or quarantines them by a filter.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BYTES = 32 * 1024 * 1024
COLUMNS = ["source", "record", "title", "text", "source_hash", "content_hash", "error"]
FORMATS = {"txt": "text", "log": "text", "md": "text", "adoc": "text", "csv": "csv", "tsv": "csv", "jsonl": "jsonl", "ndjson": "jsonl", "json": "json", "xml": "xml", "html": "html", "htm": "html", "chat": "chat"}


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else x if x.isascii() else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("encoding", T.StringType())]))
def _decoded(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_decode(x) for x in raw], columns=["text", "encoding"])


def _decode(raw: bytes | None) -> tuple[str | None, str | None]:
    if raw is None:
        return None, None
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if raw.startswith(mark):
            return raw.decode(name, "replace"), name
    try:
        return raw.decode(), "utf-8"
    except UnicodeDecodeError:
        return raw.decode("cp1252", "replace"), "cp1252"


def clean(text: Column) -> Column:
    """No byte order mark, line feeds only, NFKC."""
    plain = F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")
    return F.when(text.rlike(r"^[\x00-\x7f]*$"), plain).otherwise(_nfkc(plain))


def kind_of(path: str) -> str:
    """The reader of a file by its extension; an unknown one is an error."""
    end = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if end not in FORMATS:
        raise ValueError(f"no reader for {path!r}")
    return FORMATS[end]


def files(spark: SparkSession, path: str, limit: int = MAX_BYTES) -> DataFrame:
    """(source, raw, length, error) of the files; those above ``limit`` bytes are refused unread."""
    found = spark.read.format("binaryFile").load(path)
    big = F.col("length") > limit
    return found.select(F.col("path").alias("source"), F.when(~big, F.col("content")).alias("raw"), "length", F.when(big, F.lit("too large")).alias("error"))


def prose(spark: SparkSession, path: str, limit: int = MAX_BYTES) -> DataFrame:
    """One document a file."""
    read = files(spark, path, limit).withColumn("d", _decoded("raw")).withColumn("text", clean(F.col("d.text")))
    return _documents(read.withColumn("source_hash", F.sha2("raw", 256)), F.lit(None).cast("long"), F.element_at(F.split("source", "/"), -1))


def _documents(df: DataFrame, record: Column, title: Column) -> DataFrame:
    return df.withColumn("record", record).withColumn("title", title).withColumn("content_hash", F.sha2("text", 256)).select(*COLUMNS)


def text_column(columns: list[str], wanted: str | None = None) -> str:
    """text, body, content or description, else the last column."""
    if wanted is not None:
        if wanted not in columns:
            raise ValueError(f"no column {wanted!r}")
        return wanted
    return next((c for name in ("text", "body", "content", "description") for c in columns if c.lower() == name), columns[-1])


def records(df: DataFrame, source: str, text: str | None = None, title: str | None = None, order: str | None = None) -> DataFrame:
    """One document a row."""
    column = text_column([c for c in df.columns if not c.startswith("_")], text)
    body = clean(F.col(column).cast("string"))
    number = F.col(order) if order else F.monotonically_increasing_id()
    rows = df.select(F.lit(source).alias("source"), number.alias("n"), (F.col(title).cast("string") if title else F.lit(None).cast("string")).alias("t"), body.alias("text"), F.col("_corrupt").alias("bad") if "_corrupt" in df.columns else F.lit(None).cast("string").alias("bad"))
    rows = rows.withColumn("error", F.when(F.col("bad").isNotNull(), "malformed record").when(F.col("text").isNull(), "no text")).withColumn("text", F.when(F.col("error").isNull(), F.col("text")))
    return _documents(rows.withColumn("source_hash", F.sha2(F.coalesce("bad", "text"), 256)), F.col("n"), F.col("t"))


def csv(spark: SparkSession, path: str, sep: str | None = None, text: str | None = None, title: str | None = None) -> DataFrame:
    sep = sep or ("\t" if path.endswith(".tsv") else ",")
    return records(spark.read.csv(path, header=True, sep=sep, multiLine=True, escape='"'), path, text, title)


def jsonl(spark: SparkSession, path: str, schema: str, text: str | None = None, title: str | None = None) -> DataFrame:
    """Lines that aren't JSON become rows with an error."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r")).select("r.*")
    return records(parsed, path, text, title)


def json_array(spark: SparkSession, path: str, schema: str, text: str | None = None) -> DataFrame:
    """A file that holds an array of objects, or one object."""
    whole = spark.read.text(path, wholetext=True)
    listed = F.when(F.trim("value").startswith("["), F.col("value")).otherwise(F.concat(F.lit("["), F.col("value"), F.lit("]")))
    rows = whole.select(F.posexplode(F.from_json(listed, f"array<struct<{schema}>>")).alias("n", "r")).select("n", "r.*")
    return records(rows.drop("n"), path, text)


def chat(turns: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """(conversation, text, messages): one document a conversation, ``[role] text`` joined by an empty line, with the offsets of each message."""
    rows = turns.select(F.col(conversation).alias("conversation"), F.col(turn).alias("turn"), F.concat(F.lit("["), F.col(role), F.lit("] "), F.col(text)).alias("said"))
    listed = rows.groupBy("conversation").agg(F.array_sort(F.collect_list(F.struct("turn", "said"))).alias("m"))
    return listed.select("conversation", F.array_join(F.transform("m", lambda x: x["said"]), "\n\n").alias("text"), F.size("m").cast("long").alias("messages"))


def chat_offsets(turns: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """(conversation, turn, char_start, char_end) of each message in its conversation's document."""
    from pyspark.sql import Window

    rows = turns.select(F.col(conversation).alias("conversation"), F.col(turn).alias("turn"), (F.length(role) + F.length(text) + 3).alias("size"))
    order = Window.partitionBy("conversation").orderBy("turn")
    rows = rows.withColumn("char_end", (F.sum(F.col("size") + 2).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 2).cast("long"))
    return rows.select("conversation", "turn", (F.col("char_end") - F.col("size")).alias("char_start"), "char_end")


TAG = r"(?s)<(script|style)\b.*?</(script|style)>|<!--.*?-->|<[^>]*>"


def html_text(html: Column) -> Column:
    """The text of a page: no scripts, styles, comments or tags, the commonest entities, white space collapsed."""
    text = F.regexp_replace(html, TAG, " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def html_title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def xml_text(xml: Column) -> Column:
    """The text of a document's elements, in order."""
    return F.trim(F.regexp_replace(F.regexp_replace(xml, r"(?s)<\?.*?\?>|<!--.*?-->|<[^>]*>", " "), r"\s+", " "))


def headings(markdown: Column) -> Column:
    """array<struct<depth,heading>>: the headings of a text in Markdown."""
    lines = F.filter(F.split(markdown, "\n"), lambda x: x.rlike(r"^#{1,6} +\S"))
    return F.transform(lines, lambda x: F.struct(F.length(F.regexp_extract(x, r"^(#+)", 1)).alias("depth"), F.trim(F.regexp_replace(x, r"^#+ +", "")).alias("heading")))


def numbered_depth(heading: Column) -> Column:
    """The depth that a dotted number states: 2.3.1 is 3; null without one."""
    number = F.regexp_extract(heading, r"^([0-9]+(?:\.[0-9]+)*)\.?\s", 1)
    return F.when(number != "", F.size(F.split(number, r"\.")))


def in_memory(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    rows = spark.createDataFrame(list(texts.items()), "source string, raw string").withColumn("text", clean(F.col("raw"))).withColumn("error", F.lit(None).cast("string"))
    return _documents(rows.withColumn("source_hash", F.sha2("raw", 256)), F.lit(None).cast("long"), F.col("source"))


def settle(docs: DataFrame, policy: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows under a policy: raise fails the job at the first bad row, skip drops them, quarantine gives them."""
    good, bad = docs.where("error is null"), docs.where("error is not null")
    if policy == "raise":
        return docs.withColumn("text", F.when(F.col("error").isNull(), F.col("text")).otherwise(F.raise_error(F.concat("source", F.lit(": "), "error")))), bad.where("false")
    if policy == "skip":
        return good, bad.where("false")
    if policy == "quarantine":
        return good, bad
    raise ValueError(f"unknown policy {policy!r}")


def batches(rows: Iterator, size: int = 100) -> Iterator[list]:
    held: list = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
