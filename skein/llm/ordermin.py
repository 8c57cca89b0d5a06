"""Document fingerprints by Order MinHash, in DataFrame functions only.

A text's k-mers are its runs of ``K`` words, numbered by occurrence, so that a repeated one counts each time. One hash ranks
them, and ``BINS`` permutations order them: the hash xor a constant whose top bits are the permutation's number, each a
bijection of the hashes under which every k-mer is equally likely to be least. Of each permutation the two minimal k-mers
are taken, put back into text order and hashed as a tuple. Two fingerprints are as like as the share of permutations with
equal tuples: this falls with edits and with moved passages alike. (Where two hashes or more share a permutation's top bits,
its minimal ones are the least of those, so one sorted array serves all permutations.)

Defined results: null text is as empty; a text without words has an empty fingerprint, and is like another such text only
(1.0); fewer than ``K`` words make one k-mer of them all, and a text of one k-mer has tuples of one; k-mers count as equal
if ``64 - PLACE_BITS`` bits of their hashes are; places from 2^24 words on count as equal; rows with equal doc_id and text
count once in the order of documents and are all returned; a null doc_id sorts first; an empty table gives an empty one;
other columns are ignored by ``digest`` and pass unchanged through ``fingerprints``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import written

K, BIN_BITS, PLACE_BITS = 5, 5, 24
BINS = 1 << BIN_BITS
_PLACES = (1 << PLACE_BITS) - 1
#: The number of each permutation in the top bits, as a signed long.
_CONSTANTS = [(j << (64 - BIN_BITS)) - (1 << 64 if j >= BINS // 2 else 0) for j in range(BINS)]
_NO_ID = -(1 << 63)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _starts(ordered: Column, shift: int) -> Column:
    """Where the values of an ordered array change above ``shift`` bits; ends with its size."""
    changed = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: (i == 0) | (F.shiftright(F.get(ordered, i), shift) != F.shiftright(F.get(ordered, i - 1), shift)))
    return F.concat(changed, F.array(F.size(ordered)))


def _packed(value: Column, place: Column) -> Column:
    """The value's high bits with the place in its low ones."""
    return value.bitwiseAND(F.lit(~_PLACES)).bitwiseOR(F.least(place, F.lit(_PLACES)).cast("long"))


def _occurrences(ordered: Column) -> Column:
    """Of each value in an ordered array of packed k-mers, how many equal ones stand before it."""
    return let(_starts(ordered, PLACE_BITS), lambda s: F.flatten(F.transform(F.sequence(F.lit(0), F.size(s) - 2), lambda i: F.sequence(F.lit(0), F.get(s, i + 1) - F.get(s, i) - 1))))


def _tuples(ordered: Column) -> Column:
    """Of each permutation: its number in the high bits, the hash of its minimal k-mers in text order below."""
    place = lambda x: x.bitwiseAND(F.lit(_PLACES))
    value = lambda x: F.shiftright(x, PLACE_BITS)

    def one(two: Column, number: Column) -> Column:
        first, second = F.get(two, F.lit(0)), F.get(two, F.lit(1))
        swap = place(second) < place(first)
        a, b = F.when(swap, value(second)).otherwise(value(first)), F.when(swap, value(first)).otherwise(value(second))
        return F.shiftleft(number.cast("long"), 32 - BIN_BITS).bitwiseOR(F.shiftrightunsigned(F.xxhash64(a, b), 32 + BIN_BITS))

    def minimal(starts: Column, filled: Column) -> Column:
        def two(constant: Column, number: Column) -> Column:
            at = F.array_position(filled, number)  # from 1; 0 if no hash has these top bits
            start = F.get(starts, at.cast("int") - 1)
            own = F.when((at > 0) & (F.get(starts, at.cast("int")) - start > 1), F.slice(ordered, start + 1, 2))
            others = F.slice(F.sort_array(F.transform(ordered, lambda x: x.bitwiseXOR(constant))), 1, 2)
            return F.coalesce(own, F.transform(others, lambda x: x.bitwiseXOR(constant)))

        return F.transform(F.lit(_CONSTANTS), lambda constant, number: let(two(constant, number), lambda t: one(t, number)))

    top = lambda i: (F.shiftright(F.get(ordered, i), 64 - BIN_BITS) + BINS // 2).cast("int")
    return let(_starts(ordered, 64 - BIN_BITS), lambda s: let(F.transform(F.slice(s, 1, F.size(s) - 1), top), lambda filled: minimal(s, filled)))


def signature(text: Column) -> Column:
    """array<long>: one value of 32 bits for each permutation, in their order; empty for a text without words."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")

    def kmers(hashes: Column) -> Column:
        last = F.greatest(F.size(hashes) - K, F.lit(0))
        return F.sort_array(F.transform(F.sequence(F.lit(0), last), lambda i: _packed(F.xxhash64(*[F.get(hashes, i + j) for j in range(K)]), i)))

    def ranked(ordered: Column) -> Column:
        mixed = F.zip_with(ordered, _occurrences(ordered), lambda x, n: _packed(F.xxhash64(F.shiftright(x, PLACE_BITS), n), x.bitwiseAND(F.lit(_PLACES))))
        return let(F.sort_array(mixed), _tuples)

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) > 0, let(kmers(h), ranked)).otherwise(F.array().cast("array<bigint>")))


def likeness(a: Column, b: Column) -> Column:
    """Share of permutations with equal tuples."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.lit(BINS))


def as_text(signature_: Column) -> Column:
    return F.lower(F.array_join(F.transform(signature_, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add the fingerprint as text: eight hex digits a permutation."""
    return docs.withColumn(out, as_text(signature(F.col(text).cast("string"))))


def followers(keys: DataFrame) -> DataFrame:
    """(dk, th, cut, next_dk, next_th): the key that follows each, after the last the first. keys: (dk, th, cut), distinct.

    Keys are ranged into partitions; only the first key of each partition goes to all tasks: as many rows as partitions.
    The ranges are written once: planned twice, they would be sampled twice and have different bounds.
    """
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(keys.repartitionByRange(n, "dk", "th").withColumn("range", F.spark_partition_id()), "ranges")
    heads = ranged.groupBy("range").agg(F.min(F.struct("dk", "th")).alias("head"))
    order = Window.partitionBy(F.lit(0)).orderBy("range")
    heads = heads.select("range", F.coalesce(F.lead("head").over(order), F.first("head").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    inside = ranged.withColumn("next", F.lead(F.struct("dk", "th")).over(Window.partitionBy("range").orderBy("dk", "th")))
    both = inside.join(F.broadcast(heads), "range").withColumn("next", F.coalesce("next", "after"))
    return both.selectExpr("dk", "th", "cut", "next.dk as next_dk", "next.th as next_th")


def digest(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, of which the last quarter is the next document's beginning."""
    clean = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("dk"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = clean.withColumn("th", F.xxhash64("text"))
    pairs = followers(keyed.selectExpr("dk", "th", "cast(length(text) div 4 as int) as cut").distinct())
    # both joins read the same columns of texts under the same names, so they share one shuffle of them
    texts = keyed.select("dk", "th", "text", signature(F.col("text")).alias("own"))
    before = pairs.selectExpr("dk as before_dk", "th as before_th", "cut", "next_dk as dk", "next_th as th")
    pieces = texts.join(before, ["dk", "th"]).selectExpr("before_dk as dk", "before_th as th", "substring(text, 1, cut) as piece", "own as following")
    pieces = pieces.groupBy("dk", "th").agg(F.first("piece").alias("piece"), F.first("following").alias("following"))
    edited = texts.join(pieces, ["dk", "th"]).withColumn("edited", F.expr("concat(substring(text, 1, length(text) - cast(length(text) div 4 as int)), piece)"))
    signed = edited.selectExpr("dk", "cast(length(text) as bigint) as n_chars", "sha2(edited, 256) as edited_sha256", "own", "following", "edited").withColumn("changed", signature(F.col("edited")))
    return signed.select(
        F.when(F.col("dk") != _NO_ID, F.col("dk")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
