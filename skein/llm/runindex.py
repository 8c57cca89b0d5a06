"""Suffix-array dedup of a corpus: every byte covered by a ``LENGTH``-byte string that also starts anywhere else goes.

1. Anchors. The least hashed ``GRAM``-byte string within each ``LENGTH``-byte string (the leftmost of equal ones) is its
   anchor, so equal strings have equal anchors at equal places. The strings of one anchor start side by side and make a
   record: the bytes from the first one's start to the last one's end.
2. Equal records are counted by a 128-bit hash of their bytes: all strings of a record that stands twice are repeats.
   This takes the bulk of copies without moving any text.
3. Records that stand once but share an anchor with other bytes are the edges of repeats. They are gathered by anchor, in
   blocks, and indexed: suffix array, run-compressed Burrows-Wheeler transform, and, at both ends of each run, the
   sampled position with its longest match. Between samples a match shrinks by one a byte, so streaming over the samples gives the
   matching statistics of every position; those of ``LENGTH`` or more are repeats.
4. An anchor with more than ``HOT`` different records (a passage that a great part of the corpus holds) isn't gathered:
   its strings are hashed one by one (128 bits) and counted, pre-aggregated, over all tasks.

Defined results: null text is as empty; matches never cross rows; rows that repeat count as other places, so all of a
repeated row of ``LENGTH`` bytes or more goes; a null doc_id is a document like any other; an empty table gives an empty
one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import Powers, flat, map_arrow, mix, pieces, written

LENGTH, GRAM = 400, 32
HOT = 500
#: Bytes of text in a pass over documents, and in an index.
PASS_BYTES, BLOCK_BYTES = 1_000_000, 500_000
_PLACE_BITS = 31
_NO_ID = -(1 << 63)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row, by minima within blocks from both sides."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, powers: Powers, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first start, last start, hash of the anchor) of each record; starts count from the beginning of all data."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, np.zeros(0, np.uint64)
    prefix = powers.prefix(data)
    hashes = mix((prefix[GRAM:] - prefix[:-GRAM]) * powers.down[: n - GRAM + 1])
    keys = hashes >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS) | np.arange(len(hashes), dtype=np.uint64)
    least = (_least(keys, length - GRAM + 1) & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)  # by start: the place of its anchor
    ends = offsets[1:]
    row = np.repeat(np.arange(len(ends)), np.diff(offsets))[: len(least)]
    inside = np.arange(len(least)) + length <= ends[row]
    new = inside.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~inside[:-1] | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    stop = inside.copy()
    stop[:-1] &= new[1:] | ~inside[1:]
    last = np.flatnonzero(stop)
    return row[first], first, last, hashes[least[first]]


def keyed(docs: DataFrame) -> DataFrame:
    """(dk, th, text)."""
    clean = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("dk"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return clean.select("dk", F.xxhash64("text").alias("th"), "text")


def packed(texts: DataFrame) -> DataFrame:
    """(dk, th, packed): each text compressed, for texts are shuffled whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch, column in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([pack(t) for t in column.to_pylist()], pa.binary())], names=["dk", "th", "packed"])

    return map_arrow(texts, run, "dk long, th long, packed binary")


def records(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(anchor, content, dk, th, first, last, n): the records of each row; n equal ones that follow each other make one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch, column in pieces(batches, size=PASS_BYTES):
            data, offsets = flat(column)
            rows, first, last, anchor = anchors(data, offsets, powers, length)
            if not len(rows):
                continue
            raw, digest = data.tobytes(), xxhash.xxh3_128_digest
            content = [digest(raw[a : b + length]) for a, b in zip(first.tolist(), last.tolist())]
            same = np.zeros(len(rows), dtype=bool)
            same[1:] = [x == y for x, y in zip(content, content[1:])]
            same[1:] &= rows[1:] == rows[:-1]
            heads = np.flatnonzero(~same)
            counts = np.diff(np.append(heads, len(rows)))
            begin = offsets[rows[heads]]
            take = pa.array(rows[heads])
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor[heads].view(np.int64)), pa.array([content[k] for k in heads], pa.binary()), batch.column(0).take(take), batch.column(1).take(take), pa.array(first[heads] - begin), pa.array(last[heads + counts - 1] - begin), pa.array(counts)],
                names=["anchor", "content", "dk", "th", "first", "last", "n"],
            )

    return map_arrow(texts, run, "anchor long, content binary, dk long, th long, first long, last long, n long")


def _cut(members: DataFrame, texts: DataFrame, single_strings: bool, length: int) -> DataFrame:
    """The members' bytes out of their texts; single_strings: the hash of each of their strings."""
    wanted = members.groupBy("dk", "th").agg(F.collect_list(F.struct("anchor", "first", "last", "once")).alias("parts"))  # a document's own
    joined = packed(texts).join(wanted, ["dk", "th"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                column = map(unpack, batch.column(2).to_pylist())
                out: list[tuple] = []
                for text, dk, th, parts in zip(column, batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                    for p in parts:
                        if single_strings:
                            out += [(p["anchor"], dk, th, j, p["once"], xxhash.xxh3_128_digest(text[j : j + length])) for j in range(p["first"], p["last"] + 1)]
                        else:
                            out.append((p["anchor"], dk, th, p["first"], p["once"], text[p["first"] : p["last"] + length]))
                for k in range(0, len(out), 20_000):
                    c = list(zip(*out[k : k + 20_000]))
                    yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in c[:4]), pa.array(c[4], pa.bool_()), pa.array(c[5], pa.binary())], names=["anchor", "dk", "th", "first", "once", "bytes"])

    return map_arrow(joined.select("dk", "th", "packed", "parts"), run, "anchor long, dk long, th long, first long, once boolean, bytes binary")


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of texts, with the sampled ends of its runs."""

    def __init__(self, texts: list[bytes]) -> None:
        m = len(texts)
        sizes = np.array([*map(len, texts)], dtype=np.int64) + 1
        self.starts = np.cumsum(sizes) - sizes
        symbols = np.empty(int(sizes.sum()), dtype=np.int64)
        whole = np.ones(len(symbols), dtype=bool)
        ends = self.starts + sizes - 1
        whole[ends] = False
        symbols[whole] = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.int64) + m
        symbols[ends] = np.arange(m)  # each text ends with a mark of its own, so no match crosses it
        self.symbols = symbols
        self.order, self.levels = self._sort(m + 256)
        last = symbols[self.order - 1]  # the transform; before the first text stands the last mark
        change = np.flatnonzero(np.diff(last)) + 1
        #: Where runs begin (but the first): the number of runs is that plus one.
        self.run_starts = change
        self.runs = len(change) + 1

    def _sort(self, top: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """The suffix array by prefix doubling, and the ranks by each length of prefix."""
        n = len(self.symbols)
        bits = int(top).bit_length()
        step = max(1, 62 // bits)
        step = 1 << (step.bit_length() - 1)
        padded = np.zeros(n + step, dtype=np.int64)
        padded[:n] = self.symbols + 1
        key = np.zeros(n, dtype=np.int64)
        for k in range(step):
            key = key << bits | padded[k : n + k]
        levels = []
        order = np.argsort(key)
        while True:
            ranks = np.empty(n, dtype=np.int64)
            new = np.empty(n, dtype=bool)
            new[0] = True
            ordered = key[order]
            new[1:] = ordered[1:] != ordered[:-1]
            ranks[order] = np.cumsum(new) - 1
            levels.append((step, ranks))
            if new.all():
                return order, levels
            behind = np.zeros(n, dtype=np.int64)
            behind[: max(0, n - step)] = ranks[step:] + 1
            key = ranks * (n + 1) + behind
            # only places in runs of equal rank can still move
            open_ = ~new
            open_[:-1] |= ~new[1:]
            at = np.flatnonzero(open_)
            moved = order[at]
            order[at] = moved[np.argsort(key[moved])]
            step *= 2

    def match(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes, by ranks from long prefixes to short ones and then byte by byte."""
        n = len(self.symbols)
        out = np.zeros(len(a), dtype=np.int64)
        for step, ranks in reversed(self.levels):
            x, y = a + out, b + out
            same = (x < n) & (y < n)
            same[same] = ranks[x[same]] == ranks[y[same]]
            out[same] += step
        for _ in range(self.levels[0][0] - 1):
            x, y = a + out, b + out
            same = (x < n) & (y < n)
            same[same] = self.symbols[x[same]] == self.symbols[y[same]]
            out[same] += 1
        return out

    def statistics(self) -> np.ndarray:
        """Of each position, the length of its longest match elsewhere, streamed from the samples.

        At a run's first suffix the match with the one before is sampled, at its last the match with the one after. Where
        the symbols before two neighbours agree, their matches one position earlier are longer by one: so between
        samples, in text order, a match shrinks by one a byte.
        """
        n = len(self.symbols)
        best = np.zeros(n, dtype=np.int64)
        pairs = self.match(self.order[self.run_starts - 1], self.order[self.run_starts]) if len(self.run_starts) else np.zeros(0, np.int64)
        for sampled, edge in ((self.order[self.run_starts], self.order[0]), (self.order[self.run_starts - 1], self.order[-1])):
            value = np.zeros(n, dtype=np.int64)
            at = np.zeros(n, dtype=bool)
            value[sampled], at[sampled] = pairs, True
            at[edge] = True  # the first and the last suffix have a neighbour on one side only
            source = np.maximum.accumulate(np.where(at, np.arange(n), 0))
            np.maximum(best, value[source] - (np.arange(n) - source), out=best)
        return best


def marked(texts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each text, the ranges (first, last) of starts of strings that stand elsewhere in the texts too."""
    index = RunIndex(texts)
    long = index.statistics() >= length
    edge = np.flatnonzero(np.diff(np.concatenate([[0], long.view(np.int8), [0]])))
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    owner = np.searchsorted(index.starts, edge[::2], side="right") - 1
    for k, a, b in zip(owner.tolist(), edge[::2].tolist(), edge[1::2].tolist()):
        out[k].append((a - int(index.starts[k]), b - 1 - int(index.starts[k])))
    return out


def _indexed(cut: DataFrame, length: int) -> DataFrame:
    """(dk, th, first, last) of the repeats that blocks of anchors find."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[list[tuple]]:
            held, size, anchor = [], 0, None
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    if size >= BLOCK_BYTES and row[0] != anchor:
                        yield held
                        held, size = [], 0
                    anchor = row[0]
                    held.append(row)
                    size += len(row[5])
            if held:
                yield held

        for block in blocks():
            found = [(dk, th, first + a, first + b) for (_, dk, th, first, once, _), ranges in zip(block, marked([r[5] for r in block], length)) if once for a, b in ranges]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["dk", "th", "first", "last"])

    ordered = cut.repartition("anchor").sortWithinPartitions("anchor")
    return map_arrow(ordered, run, "dk long, th long, first long, last long")


def repeats(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(dk, th, first, last): ranges of starts of strings that start elsewhere too."""
    found = written(records(texts, length), "records")
    place = F.min(F.struct("dk", "th", "first", "last")).alias("at")
    contents = written(found.groupBy("anchor", "content").agg(F.sum("n").alias("n"), place), "contents")
    twice = contents.where("n > 1").select("anchor", "content")
    whole = found.join(twice, ["anchor", "content"], "left_semi").select("dk", "th", "first", "last")
    edges = contents.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1").select("anchor", "kinds")
    members = contents.join(edges, "anchor").selectExpr("anchor", "at.dk as dk", "at.th as th", "at.first as first", "at.last as last", "n = 1 as once", "kinds")
    # a record that stands more than once in a row's run of equal ones is as long as one of them
    usual = _indexed(_cut(members.where(f"kinds <= {HOT}").drop("kinds"), texts, False, length), length)
    strings = _cut(members.where(f"kinds > {HOT}").drop("kinds"), texts, True, length)
    again = strings.groupBy("bytes").agg(F.count("*").alias("n")).where("n > 1").select("bytes")
    hot = strings.where("once").join(again, "bytes", "left_semi").selectExpr("dk", "th", "first", "first as last")
    return whole.unionByName(usual).unionByName(hot)


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): kept is what is left of the text's bytes."""
    texts = keyed(docs)
    marks = written(repeats(texts, length), "marks")
    marks = marks.groupBy("dk", "th").agg(F.collect_set(F.struct("first", "last")).alias("ranges"))  # a document's own
    joined = packed(texts).join(marks, ["dk", "th"], "left").select("dk", "packed", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch, column in pieces(batches, "packed", 1_000_000):
            out = []
            for text, ranges in zip(map(unpack, column.to_pylist()), batch.column(2).to_pylist()):
                if not ranges:
                    out.append((len(text), 0, 0, text))
                    continue
                turn = np.zeros(len(text) + 1, dtype=np.int64)
                np.add.at(turn, [r["first"] for r in ranges], 1)
                np.add.at(turn, [r["last"] + length for r in ranges], -1)
                gone = np.cumsum(turn[:-1]) > 0
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((len(text), int(gone.sum()), spans, np.frombuffer(text, np.uint8)[~gone].tobytes()))
            c = list(zip(*out))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in c[:3]), pa.array(c[3], pa.binary())], names=["dk", "n_bytes", "n_removed", "n_spans", "kept"])

    done = map_arrow(joined, run, "dk long, n_bytes long, n_removed long, n_spans long, kept binary")
    return done.select(F.when(F.col("dk") != _NO_ID, F.col("dk")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")


def digest(docs: DataFrame) -> DataFrame:
    return dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: In SQL: every string is taken, by its MD5 hash.
ORACLE = """
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
h AS (SELECT doc_id, j, md5(b[j + 1 : j + 400]) AS h FROM (SELECT doc_id, b, unnest(range(octet_length(b) - 399)) AS j FROM b) x),
d AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
m AS (SELECT doc_id, j, CASE WHEN j - lag(j) OVER (PARTITION BY doc_id ORDER BY j) <= 400 THEN 0 ELSE 1 END AS fresh FROM h SEMI JOIN d USING (h)),
r AS (SELECT doc_id, sum(fresh) OVER (PARTITION BY doc_id ORDER BY j) AS run, j FROM m),
s AS (SELECT doc_id, run, min(j) AS a, max(j) + 400 AS e FROM r GROUP BY ALL),
k AS (SELECT doc_id, count(*) AS n, sum(e - a) AS gone, list(a ORDER BY a) AS starts, list(e ORDER BY a) AS ends FROM s GROUP BY doc_id),
q AS (SELECT doc_id, b, coalesce(n, 0) AS n, coalesce(gone, 0) AS gone, list_concat(coalesce(starts, []), [octet_length(b)]) AS starts, list_concat([0], coalesce(ends, [])) AS ends FROM b LEFT JOIN k USING (doc_id)),
p AS (SELECT doc_id, unnest(range(len(starts))) AS i, b, starts, ends FROM q),
z AS (SELECT doc_id, list(hex(b[ends[i + 1] + 1 : starts[i + 1]]) ORDER BY i) AS parts FROM p GROUP BY doc_id)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(gone AS BIGINT) AS n_removed, n AS n_spans, sha256(unhex(array_to_string(parts, ''))) AS kept_sha256 FROM q JOIN z USING (doc_id)
"""
