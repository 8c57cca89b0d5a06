"""What the training-data operators share: the shared folder, Arrow batches and vectorised word hashing.

Every operator reads its own columns by name and ignores the rest, so extra columns never clash.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text worked on at once; a single longer text makes a piece of its own.
PIECE_BYTES = 2_000_000
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors share; where that is unset, a local one (tests), and on a cluster an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\[\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir isn't set: a cluster needs a folder that all executors share")
        base = "file://" + _own_folder()
    return f"{base.rstrip('/')}/skein-{uuid.uuid4().hex}"


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="skein-")


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join that must not broadcast it: of a table that grows with the input Spark may take a small size for
    granted (what an ``explode`` adds isn't counted, Parquet is counted as packed), and the driver would hold all of it."""
    return df.hint("merge")


#: A key of which this share of all rows or more is hot: so there are at most as many of them as its inverse.
HOT_SHARE = 1 / 5000


def hot_join(left: DataFrame, counted: DataFrame, keys: list[str], rows: int, how: str = "inner") -> DataFrame:
    """Join ``left`` (of ``rows`` rows) with ``counted``, whose column ``n`` says how many rows of left hold each key.

    Hot keys would each fill one task of a shuffle. There are at most ``1 / HOT_SHARE`` of them, so their side is broadcast
    and their rows stay where they are; all other rows are shuffled. how: inner or left; n is dropped.
    """
    least = max(1000, int(rows * HOT_SHARE))
    hot, cold = (counted.where(x).drop("n") for x in (f"n > {least}", f"n <= {least}"))
    if hot.isEmpty():
        return left.join(shuffled(cold), keys, how)
    few = F.broadcast(hot.select(*keys).distinct())
    return left.join(F.broadcast(hot), keys).unionByName(left.join(few, keys, "left_anti").join(shuffled(cold), keys, how))


#: Cells of key hashes: a bit each, 2 MB in all, is what is broadcast, however many keys there are. ``BUCKET`` of them make a row.
CELLS, BUCKET = 1 << 24, 1 << 15


def taken(keys: DataFrame, on: list[str]) -> DataFrame:
    """(__bucket, __bits): which cells hold a key, as bitmaps; at most ``CELLS / BUCKET`` rows of ``BUCKET`` bits."""
    cell = keys.select(F.pmod(F.xxhash64(*on), F.lit(CELLS)).alias("__cell"))
    return cell.groupBy(F.expr(f"__cell div {BUCKET}").alias("__bucket")).agg(F.bitmap_construct_agg(F.expr(f"__cell % {BUCKET}")).alias("__bits"))


def apart(rows: DataFrame, keys: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be in ``keys``, rows whose key certainly isn't): so that only the former must be shuffled.

    Keys are told apart by ``CELLS`` cells of their hash; where nearly all are taken, all rows may be in ``keys``.
    """
    cells = F.broadcast(written(taken(keys, on), "cells"))
    placed = rows.withColumn("__cell", F.pmod(F.xxhash64(*on), F.lit(CELLS))).withColumn("__bucket", F.expr(f"__cell div {BUCKET}"))
    byte = f"cast(conv(hex(substring(__bits, cast((__cell % {BUCKET}) div 8 as int) + 1, 1)), 16, 10) as int)"
    held = F.expr(f"coalesce(shiftright({byte}, cast(__cell % 8 as int)) & 1, 0)")
    marked = placed.join(cells, "__bucket", "left").withColumn("__held", held).drop("__bucket", "__cell", "__bits")
    return tuple(marked.where(F.col("__held") == x).drop("__held") for x in (1, 0))


def utf8(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one large_binary array, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    return column.cast(pa.large_string()).view(pa.large_binary()) if pa.types.is_string(column.type) else column.view(pa.large_binary()) if pa.types.is_large_string(column.type) else column.cast(pa.large_binary())


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large_binary array; offsets begin at 0."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Split Arrow batches into runs of rows of about ``size`` bytes of text, with the text as large_binary."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = utf8(batch.column(batch.schema.get_field_index(text)))
        ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, ends[at] + size, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at), column.slice(at, to - at)
            at = to


class Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, for hashes of substrings in O(1)."""

    def __init__(self, base: int = 0x9E3779B97F4A7C15) -> None:
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                for name, x in (("up", self.base), ("down", self.inverse)):
                    steps = np.full(n, x, dtype=np.uint64)
                    steps[0] = 1
                    setattr(self, name, np.multiply.accumulate(steps))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """Sums of (value + 1) * base^i before each position: n + 1 of them."""
        self.grow(len(values) + 1)
        out = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * self.up[: len(values)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The mixed hash of each span [start, end)."""
        self.grow(len(prefix))
        return mix((prefix[ends] - prefix[starts]) * self.down[starts])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64 (the one of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each row): maximal runs of word bytes that don't cross rows. is_word: 256 booleans."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = is_word[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    end[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, type=kind))


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` that gives a task's memory back when it ends: the worker lives on and serves other stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()

    return df.mapInArrow(run, schema)


def _trim() -> None:
    """Freed memory back to the system, where the C library can do that."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
