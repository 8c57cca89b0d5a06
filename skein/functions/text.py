"""Text expressions of the document graph."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters, digits and underscores of any script; the same in Java and in RE2.
WORD = r"([\p{L}\p{N}_]+)"
ARTICLE = r"^\s*(?:the|an|a)\s+(?=\S)"
#: A dot between two letters, digits or underscores.
INNER_DOT = r"(?<=[\p{L}\p{N}_])\.(?=[\p{L}\p{N}_])"


def tokens(text: Column) -> Column:
    """Lower-cased words in order; null gives an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(1))


def collapse(text: Column) -> Column:
    """Lower case, outer space off, inner white space as one space."""
    return F.regexp_replace(F.trim(F.lower(text)), r"\s+", " ")


@F.pandas_udf(T.StringType())
def unmarked(text: pd.Series) -> pd.Series:
    """Compatibility forms taken apart (NFKD), marks dropped, case folded. Spark has no function for it; only names go through here."""

    def one(x: str | None) -> str | None:
        if x is None or x.isascii():
            return x if x is None else x.lower()
        return "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).casefold()

    return text.map(one)


def normal_name(text: Column) -> Column:
    """A name for comparison: marks and case folded, one leading article off, dots inside words off, other signs than letters and digits as one space; behind 200 characters a digest."""
    plain = F.regexp_replace(F.regexp_replace(unmarked(text), ARTICLE, ""), INNER_DOT, "")
    plain = F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "))
    return F.when(F.length(plain) <= 200, plain).otherwise(F.concat(F.substring(plain, 1, 200), F.lit("~"), F.substring(F.sha2(plain, 256), 1, 16)))


def merge_key(label: Column, name: Column) -> Column:
    return F.concat(label, F.lit(":"), normal_name(name))


def sorted_tokens(text: Column) -> Column:
    return F.array_join(F.array_sort(tokens(text)), " ")


def digit_tokens(text: Column) -> Column:
    """The distinct words of ``text`` that hold a digit, sorted."""
    return F.array_sort(F.array_distinct(F.filter(tokens(text), lambda t: t.rlike(r"[0-9]"))))


def snippet(text: Column, size: int = 240) -> Column:
    return F.substring(text, 1, size)


def bounded(text: Column, limit: int = 32_000) -> Column:
    """(text cut to ``limit`` characters, hash of all of it, whether it was cut)."""
    return F.struct(F.substring(text, 1, limit).alias("text"), F.sha2(text, 256).alias("full_sha256"), (F.length(text) > limit).alias("truncated"))


def parse_property(text: Column, kind: str) -> Column:
    """Text as a value of a declared property type; what doesn't fit gives null."""
    clean = F.trim(text)
    if kind == "integer":
        return F.when(clean.rlike(r"^[+-]?[0-9]+$"), clean.try_cast("bigint"))
    if kind == "float":
        value = F.when(clean.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), clean.try_cast("double"))
        return F.when(F.abs(value) < float("inf"), value)
    if kind == "boolean":
        low = F.lower(clean)
        return F.when(low.isin("true", "yes", "1"), F.lit(True)).when(low.isin("false", "no", "0"), F.lit(False))
    if kind == "date":
        return F.when(clean.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), clean.try_cast("date"))
    if kind == "string":
        return text
    raise ValueError(f"unknown property type {kind!r}")


def uuid5(name: Column) -> Column:
    """The version 5 UUID of a name in the OID namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit("6ba7b8129dad11d180b400c04fd430c8")), F.encode(name, "UTF-8")))
    nibble = F.substring(F.lit("89ab"), 1, 4)
    variant = F.substring(nibble, F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def span_id(doc: Column, content_hash: Column, start: Column, end: Column) -> Column:
    """The stable id of a span of a document version."""
    return F.format_string("ev1:s:%s:%s:%d-%d", doc.cast("string"), F.substring(content_hash, 1, 16), start, end)


def chunk_evidence_id(doc: Column, content_hash: Column, chunk: Column) -> Column:
    return F.format_string("ev1:c:%s:%s:%s", doc.cast("string"), F.substring(content_hash, 1, 16), chunk)


SPAN_ID = r"^ev1:s:([^:]+):([0-9a-f]{16}):(0|[1-9][0-9]*)-(0|[1-9][0-9]*)$"
CHUNK_ID = r"^ev1:c:([^:]+):([0-9a-f]{16}):(.+)$"


def decode_evidence_id(name: Column) -> Column:
    """(kind, doc, hash, start, end, chunk); kind is null where the id is malformed."""
    part = lambda pattern, k: F.regexp_extract(name, pattern, k)
    is_span, is_chunk = name.rlike(SPAN_ID), name.rlike(CHUNK_ID)
    start, end = part(SPAN_ID, 3).try_cast("bigint"), part(SPAN_ID, 4).try_cast("bigint")
    is_span = is_span & (start < end)
    return F.struct(
        F.when(is_span, "span").when(is_chunk, "chunk").alias("kind"),
        F.when(is_span, part(SPAN_ID, 1)).when(is_chunk, part(CHUNK_ID, 1)).alias("doc"),
        F.when(is_span, part(SPAN_ID, 2)).when(is_chunk, part(CHUNK_ID, 2)).alias("hash"),
        F.when(is_span, start).alias("start"),
        F.when(is_span, end).alias("end"),
        F.when(is_chunk, part(CHUNK_ID, 3)).alias("chunk"),
    )
