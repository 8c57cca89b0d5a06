"""Benchmark decontamination as a prefix-filtered set join.

An item's windows are its runs of ``WINDOW`` words (one run of all its words if it has fewer). A window is contained in a
document exactly when all of its shingles follow each other there. So:

1. one pass over the texts keeps only stretches of words in which every shingle may be one of the benchmark's (a bitmap of
   fixed size) and which are long enough for the shortest window: the length bound;
2. shingles are ordered by how often they stand in those stretches, over all documents; of each window the rarest one is
   the prefix that containment makes necessary;
3. prefixes join the shingles of the stretches, a place of the window must fit into the stretch (the positional bound),
   and its words are compared one by one.

Defined results: null text has no words; rows with equal doc_id and text are all returned, with the same result; items
that are null, without id or without words have no windows; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import LOWER, Powers, flat, hot_join, map_arrow, mix, pieces, shuffled, word_spans, written

WINDOW, SHINGLE = 10, 5
#: Bits of the shingle filter (2 MB). More shingles than bits make it less sharp; results stay exact.
FILTER_BITS = 24
_WORD = np.zeros(256, dtype=bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_STEPS = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(SHINGLE)], dtype=np.uint64)


def _words(column: pa.Array, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, ends, words before each row, hash of each word)."""
    data, offsets = flat(column)
    data = LOWER[data]
    starts, ends, before = word_spans(data, offsets, _WORD)
    return data, starts, ends, before, powers.spans(powers.prefix(data), starts, ends)


def _shingles(words: np.ndarray, size: int) -> np.ndarray:
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        out += words[k : n + k] * _STEPS[k]
    return mix(out) >> np.uint64(64 - FILTER_BITS)


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, words, size of its shingles, places of its shingles in the filter) of each distinct window of an item: repeated rows and repeated passages make one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch, column in pieces(batches):
            data, starts, ends, before, hashes = _words(column, powers)
            rows: list[tuple] = []
            for r, item in enumerate(batch.column(0).to_pylist()):
                a, b = before[r], before[r + 1]
                if item is None or a == b:
                    continue
                words = [data[s:e].tobytes().decode() for s, e in zip(starts[a:b], ends[a:b])]
                size = min(window, b - a)
                gram = min(SHINGLE, size)
                places = _shingles(hashes[a:b], gram).astype(np.int64)
                rows += [(item, words[k : k + size], gram, places[k : k + size - gram + 1].tolist()) for k in range(b - a - size + 1)]
            if rows:
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], pa.list_(pa.string())), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.list_(pa.int64()))],
                    names=["item_id", "words", "gram", "places"],
                )

    kind = items.schema["item_id"].dataType.simpleString()
    return map_arrow(items.select("item_id", F.col("text").cast("string").alias("text")), run, f"item_id {kind}, words array<string>, gram int, places array<long>").distinct()


def _filters(windows: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """For each shingle size: (shingles in a row that the shortest window needs, bitmap). At most SHINGLE bitmaps of 2^FILTER_BITS bits."""
    places = windows.select("gram", F.explode("places").alias("p"))
    cells = places.groupBy("gram", F.shiftright("p", 5).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 31 as int))")).alias("bits"))
    need = {r["gram"]: r["need"] for r in windows.groupBy("gram").agg(F.min(F.size("places")).alias("need")).collect()}
    out = {g: (n, np.zeros(1 << (FILTER_BITS - 5), dtype=np.uint32)) for g, n in need.items()}
    for r in cells.collect():  # at most 2^(FILTER_BITS - 5) rows a size
        out[r["gram"]][1][r["cell"]] = r["bits"]
    return out


def stretches(docs: DataFrame, filters: dict[int, tuple[int, np.ndarray]]) -> DataFrame:
    """(key, doc_id, n_words, stretches) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast({g: (n, b.view(np.uint8)) for g, (n, b) in filters.items()})
    inner = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, tables = Powers(), shared.value
        for batch, column in pieces(batches):
            data, starts, ends, before, hashes = _words(column, powers)
            n = len(starts)
            left = np.repeat(before[1:], np.diff(before)) - np.arange(n)  # words from here to the end of the row
            found: dict[int, list[dict]] = {}
            for gram, (need, bits) in tables.items():
                place = _shingles(hashes, gram)
                at = np.flatnonzero((bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1)
                at = at[left[at] >= gram]
                if not len(at):
                    continue
                rows = np.searchsorted(before, at, side="right") - 1
                breaks = np.flatnonzero((np.diff(at) != 1) | (np.diff(rows) != 0)) + 1
                firsts, lasts = np.concatenate([[0], breaks]), np.concatenate([breaks, [len(at)]]) - 1
                keep = lasts - firsts + 1 >= need
                for a, b in zip(firsts[keep], lasts[keep]):
                    row, s, e = int(rows[a]), int(at[a]), int(at[b]) + gram
                    words = [data[x:y].tobytes().decode() for x, y in zip(starts[s:e], ends[s:e])]
                    found.setdefault(row, []).append({"start": s - int(before[row]), "words": words})
            ids = batch.column(0)
            keys = [xxhash.xxh3_128_digest(repr(i).encode() + b"\0" + t) for i, t in zip(ids.to_pylist(), column.to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), ids, pa.array(np.diff(before), pa.int64()), pa.array([found.get(r) for r in range(batch.num_rows)], inner)], names=["key", "doc_id", "n_words", "stretches"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, f"key binary, doc_id {kind}, n_words long, stretches array<struct<start:long,words:array<string>>>")


def matches(windows: DataFrame, found: DataFrame, grams: list[int]) -> DataFrame:
    """(key, item_id, start, size) of each place in a document where a window stands. grams: the windows' shingle sizes."""
    spans = found.where("stretches is not null").select("key", F.explode("stretches").alias("s")).selectExpr("key", "s.start as start", "s.words as words")
    shingles = spans.withColumn("gram", F.explode(F.array(*map(F.lit, grams)).cast("array<int>"))).where("size(words) >= gram")
    shingles = shingles.selectExpr("*", "posexplode(transform(sequence(0, size(words) - gram), i -> xxhash64(slice(words, i + 1, gram)))) as (at, token)")
    often = written(shingles.groupBy("token").agg(F.count("*").alias("n")), "often")
    one = windows.selectExpr("item_id", "words as window", "gram", "posexplode(transform(sequence(0, size(words) - gram), i -> xxhash64(slice(words, i + 1, gram)))) as (offset, token)")
    known = one.join(shuffled(often), "token")  # a window of which a shingle is nowhere is nowhere
    complete = known.groupBy("item_id", "window", "gram").agg(F.count("*").alias("there"), F.min(F.struct("n", "offset", "token")).alias("rarest")).where("there = size(window) - gram + 1")
    prefixes = written(complete.selectExpr("gram", "rarest.token as token", "rarest.n as n", "item_id", "window", "rarest.offset as offset"), "prefixes")
    rows = often.agg(F.sum("n")).first()[0] or 0
    # a shingle that a great part of all stretches holds stays where it is; its windows go there
    near = hot_join(shingles, prefixes, ["token", "gram"], rows).where("at >= offset and at - offset + size(window) <= size(words)")
    exact = near.where("slice(words, cast(at - offset as int) + 1, size(window)) = window")
    return exact.selectExpr("key", "item_id", "start + at - offset as start", "size(window) as size").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: key, doc_id, n_words, n_hit (words inside a window), items (ids with occurring windows, sorted as strings)."""
    windows = written(item_windows(items, window), "windows")
    filters = _filters(windows)
    found = written(stretches(docs, filters), "stretches")
    hits = written(matches(windows, found, sorted(filters)), "matches")
    runs = hits.select("key", "start", (F.col("start") + F.col("size")).alias("end")).groupBy("key", "start").agg(F.max("end").alias("end"))
    runs = runs.selectExpr("key", "start", "end", "coalesce(max(end) over (partition by key order by start rows between unbounded preceding and 1 preceding), 0) as reached")
    counted = runs.groupBy("key").agg(F.sum(F.expr("greatest(0L, end - greatest(start, reached))")).alias("n_hit"))
    named = hits.groupBy("key").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    out = found.select("key", "doc_id", "n_words").join(shuffled(counted.join(shuffled(named), "key")), "key", "left")
    return out.selectExpr("key", "doc_id", "n_words", "coalesce(n_hit, 0L) as n_hit", "coalesce(items, cast(array() as array<string>)) as items")


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    return decontaminate(docs, items).selectExpr("doc_id", "n_words", "n_hit", "cast(size(items) as bigint) as n_items", "sha2(concat_ws(',', items), 256) as items_sha256", "n_hit > 0 as contaminated")


ORACLE = r"""
WITH low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
it AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, size, array_to_string(w[k + 1 : k + size], ' ') AS t FROM (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(len(w) - least(10, len(w)) + 1)) AS k FROM it WHERE len(w) > 0) x),
pos AS (SELECT doc_id, size, k, array_to_string(w[k + 1 : k + size], ' ') AS t FROM (SELECT doc_id, w, size, unnest(range(len(w) - size + 1)) AS k FROM low, (SELECT DISTINCT size FROM win) s) x),
hit AS (SELECT doc_id, item_id, pos.size, k FROM pos JOIN win USING (size, t)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM hit) x GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) x GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM low LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
"""
