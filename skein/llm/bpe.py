"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The adjacent pairs of a pre-token wait in one bucket per merge rank, which holds positions of a doubly linked list
of parts. A three-level bitmap over the ranks gives the lowest waiting rank by find-first-set; entries whose pair
has changed since are stale and skipped. A pre-token of n bytes takes O(n log n), however long it is.

Defined results: null text is as empty (no ids); repeated rows are encoded each; other columns pass unchanged.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from heapq import heappop, heappush
from sys import getsizeof

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import PIECE_BYTES, map_arrow, pieces

#: Bytes of a cache while a task runs (half as much again for pre-tokens of pieces that have several), and the longest key that is kept.
CACHE_BYTES, CACHE_CHARS = 40_000_000, 64
#: Pre-tokens of at most so many bytes merge by a scan of their few ranks, longer ones by the queue; the ids are the same.
SHORT_BYTES = 16
_NONE = 1 << 40
#: What an entry takes in a dictionary, beside its key and its value.
SLOT_BYTES = 104
_BITS = 10
_LOW = (1 << _BITS) - 1
#: A space that touches other white space: such texts are split by the pattern as a whole.
_JOINED_SPACE = re.compile(r" \s|\s ")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class RankQueue:
    """Buckets of positions by rank below 2^30, with a bitmap of three levels over the buckets that aren't empty."""

    __slots__ = ("buckets", "leaves", "middle", "top")

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.leaves: dict[int, int] = {}
        self.middle: dict[int, int] = {}
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        leaf = rank >> _BITS
        bits = self.leaves.get(leaf, 0)
        self.leaves[leaf] = bits | 1 << (rank & _LOW)
        if not bits:
            mid = leaf >> _BITS
            self.middle[mid] = self.middle.get(mid, 0) | 1 << (leaf & _LOW)
            self.top |= 1 << mid

    def pop(self) -> tuple[int, int] | None:
        """The lowest rank and the leftmost position in its bucket."""
        if not self.top:
            return None
        mid = (self.top & -self.top).bit_length() - 1
        bits = self.middle[mid]
        leaf = mid << _BITS | (bits & -bits).bit_length() - 1
        bits = self.leaves[leaf]
        rank = leaf << _BITS | (bits & -bits).bit_length() - 1
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.leaves[leaf] = bits & bits - 1
            if not self.leaves[leaf]:
                self.middle[mid] ^= 1 << (leaf & _LOW)
                if not self.middle[mid]:
                    self.top ^= 1 << mid
        return rank, position


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: the pair of lowest rank merges first, of equal ones the leftmost."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n, get = len(word), ranks.get
    end = list(range(1, n + 1))  # of the part that begins here
    before = list(range(-1, n - 1))  # where the previous part begins
    at: list[int | None] = [get(word[i : i + 2]) for i in range(n)]  # rank of the part here with the next one; of the last part: none
    at[n - 1] = None
    queue = RankQueue()
    push, pop = queue.push, queue.pop
    for i, rank in enumerate(at):
        if rank is not None:
            push(rank, i)
    while (found := pop()) is not None:
        rank, i = found
        if at[i] != rank:
            continue  # stale
        j = end[i]
        at[j] = None
        end[i] = k = end[j]
        if k < n:
            before[k] = i
            at[i] = right = get(word[i : end[k]])
            if right is not None:
                push(right, i)
        else:
            at[i] = None
        h = before[i]
        if h >= 0:
            at[h] = left = get(word[h:k])
            if left is not None:
                push(left, h)
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges over a few parts, where a scan of the waiting ranks costs less than the queue."""
    get = ranks.get
    whole = get(word)
    if whole is not None:
        return [whole]
    parts = [word[i : i + 1] for i in range(len(word))]
    waiting = [get(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
    while waiting and (rank := min(waiting)) != _NONE:
        i = waiting.index(rank)
        parts[i] += parts[i + 1]
        del parts[i + 1], waiting[i]
        if i < len(waiting):
            waiting[i] = get(parts[i] + parts[i + 1], _NONE)
        if i:
            waiting[i - 1] = get(parts[i - 1] + parts[i], _NONE)
    return [ranks[x] for x in parts]


class Pairs:
    """Which two ids merge into which, in a hash table over arrays; and the merges of many short words at once.

    One step merges, in each word, the leftmost pair of lowest rank, so the ids are those of ``merge``.
    """

    SLOTS, NONE = 1 << 19, np.iinfo(np.int32).max
    _FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, ranks: dict[bytes, int]) -> None:
        get = ranks.get
        self.bytes = np.array([get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        self.whole = bool(self.bytes.min() >= 0)  # each byte has an id
        splits = [(a << 32 | b, r) for word, r in ranks.items() for i in range(1, len(word)) if (a := get(word[:i])) is not None and (b := get(word[i:])) is not None]
        keys, found = np.array(splits, dtype=np.int64).reshape(-1, 2).T
        while 2 * len(keys) > self.SLOTS:
            self.SLOTS *= 2
        self.keys, self.found = np.full(self.SLOTS, -1, dtype=np.int64), np.full(self.SLOTS, self.NONE, dtype=np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot] == -1
            self.keys[slot[free]], self.found[slot[free]] = keys[left[free]], found[left[free]]  # of several, the last one stays
            again = self.keys[slot] != keys[left]
            left, slot = left[again], (slot[again] + 1) % self.SLOTS

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * self._FACTOR >> np.uint64(65 - self.SLOTS.bit_length())).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, or ``NONE``."""
        keys = a << 32 | b
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.found[slot], self.NONE)
        open_ = np.flatnonzero((there != keys) & (there != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % self.SLOTS
            there = self.keys[slot[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.found[slot[open_[hit]]]
            open_ = open_[~hit & (there != -1)]
        return out

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as int32 bytes; words have 1 to ``SHORT_BYTES`` bytes."""
        width = SHORT_BYTES
        size = np.fromiter(map(len, words), np.int64, len(words))
        done, ends = np.zeros((len(words), width), dtype="<i4"), size.copy()
        ids = self.bytes[np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width).T]
        rank = self.find(ids[:-1].ravel(), ids[1:].ravel()).reshape(width - 1, -1)
        rank[np.arange(1, width)[:, None] >= size] = self.NONE
        live = np.arange(len(words))
        while len(live):
            at = rank.argmin(axis=0)
            least = rank[at, np.arange(len(live))]
            over = least == self.NONE
            if over.any():
                done[live[over]], ends[live[over]] = ids[:, over].T, size[over]
                on = ~over
                ids, rank, size, live, at, least = ids[:, on], rank[:, on], size[on], live[on], at[on], least[on]
            here = np.arange(len(live))
            ids[at, here] = least
            for j in range(1, width - 1):
                np.copyto(ids[j], ids[j + 1], where=j > at)
            for j in range(width - 2):
                np.copyto(rank[j], rank[j + 1], where=j >= at)
            rank[-1] = self.NONE
            size -= 1
            right = self.find(least.astype(np.int64), ids[at + 1, here])
            rank[at, here] = np.where(at + 1 < size, right, self.NONE)
            inner = np.flatnonzero(at)
            before = at[inner] - 1
            rank[before, inner] = self.find(ids[before, inner], least[inner].astype(np.int64))
        raw, step = done.tobytes(), 4 * width
        return [raw[k : k + 4 * n] for k, n in zip(range(0, len(raw), step), ends.tolist())]


class Cache(dict):
    """What ``make`` gives for short keys, in two halves: when the newer one is full, it becomes the older one, which goes.

    Both together hold about ``CACHE_BYTES``, whatever the texts; no result depends on it.
    """

    def __init__(self, make: Callable, limit: int | None = None) -> None:
        super().__init__()
        self.make, self.old = make, {}
        self.room = self.half = (CACHE_BYTES if limit is None else limit) // 2

    def forget(self) -> None:
        self.clear()
        self.old, self.room = {}, self.half

    def __missing__(self, key: str):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        self.put(key, value)
        return value

    def put(self, key: str, value) -> None:
        if len(key) <= CACHE_CHARS:
            self.room -= getsizeof(key) + getsizeof(value) + SLOT_BYTES
            if self.room < 0:
                self.old, self.room = dict(self), self.half
                self.clear()
            self[key] = value


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.findall = ranks, regex.compile(pattern).findall
        self.spaced, self.words = Cache(self.after_space), Cache(self.pretoken, CACHE_BYTES // 2)
        self.pairs = Pairs(ranks)

    def pretoken(self, word: str) -> bytes:
        raw = word.encode()
        return array("i", (merge_short if len(raw) <= SHORT_BYTES else merge)(raw, self.ranks)).tobytes()

    def by_pattern(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.findall(text)))

    def after_space(self, piece: str) -> bytes:
        words = self.findall(" " + piece)
        return self.pretoken(words[0]) if len(words) == 1 else b"".join(map(self.words.__getitem__, words))

    def codes(self, found: set[str]) -> dict[str, bytes]:
        """Of each piece that stands behind a space; the first pre-tokens of those not in the cache are merged together, each once, whatever mark follows it."""
        cached, older, ranks, words = self.spaced.get, self.spaced.old.get, self.ranks, self.words
        out: dict[str, bytes] = {}
        cut: list[tuple[str, str, list[str]]] = []
        again: list[str] = []
        for piece in found:
            code = cached(piece)
            if code is None:
                code = older(piece)
                if code is not None:
                    again.append(piece)
                elif piece.isascii() and piece.isalpha():
                    cut.append((piece, " " + piece, []))
                    continue
                else:
                    first, *rest = self.findall(" " + piece)
                    cut.append((piece, first, rest))
                    continue
            out[piece] = code
        firsts = list({first for _, first, _ in cut})
        raw = [w.encode() for w in firsts]
        merged = {w: self.ids(ranks[r]) if r in ranks else self.pretoken(w) for w, r in zip(firsts, raw) if r in ranks or len(r) > SHORT_BYTES or not self.pairs.whole}
        short = [k for k, w in enumerate(firsts) if w not in merged]
        merged.update(zip([firsts[k] for k in short], self.pairs.merge([raw[k] for k in short])))
        for piece, first, rest in cut:
            out[piece] = merged[first] + b"".join([words[w] for w in rest]) if rest else merged[first]
            again.append(piece)
        for piece in again:
            self.spaced.put(piece, out[piece])
        return out

    @staticmethod
    def ids(*ids: int) -> bytes:
        return array("i", ids).tobytes()

    def forget(self) -> None:
        """A worker serves other stages too; what a task has gathered goes with it."""
        self.spaced.forget()
        self.words.forget()

    def encode(self, text: str) -> bytes:
        """The ids as int32 bytes. A lone space between two marks always begins a pre-token, so such pieces are looked up whole."""
        if _JOINED_SPACE.search(text):
            return self.by_pattern(text)
        first, *rest = text.split(" ")
        return self.by_pattern(first) + b"".join(map(self.spaced.__getitem__, rest))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """``encode`` of each; what no text before had is worked out together, but for texts longer than a piece."""
        split = [None if len(t) > PIECE_BYTES or _JOINED_SPACE.search(t) else t.split(" ") for t in texts]
        found: set[str] = set()
        for parts in split:
            found.update(parts[1:] if parts else ())
        get = self.codes(found).__getitem__
        return [self.encode(t) if parts is None else self.by_pattern(parts[0]) + b"".join(map(get, parts[1:])) for t, parts in zip(texts, split)]


@lru_cache(maxsize=2)
def encoder_of(rank_path: str, pattern: str) -> Encoder:
    """One for each Python worker: the ranks serve all tasks that run there."""
    return Encoder(load_ranks(rank_path), pattern)


def splits_at_spaces(pattern: str) -> bool:
    """Whether the pattern is the one for which a lone space always begins a pre-token."""
    import public_tokenizers

    return pattern == public_tokenizers.PATTERN


def _encoded(batches: Iterator[pa.RecordBatch], rank_path: str, pattern: str, text: str, ids: str) -> Iterator[pa.RecordBatch]:
    encoder = encoder_of(rank_path, pattern)
    quick = splits_at_spaces(pattern)
    try:
        for batch, column in pieces(batches, text):
            texts = [x.decode() for x in column.to_pylist()]
            packed = encoder.encode_all(texts) if quick else [*map(encoder.by_pattern, texts)]
            ends = np.cumsum([0, *map(len, packed)]) // 4
            values = pa.array(np.frombuffer(b"".join(packed), dtype="<i4"))
            array = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays([*batch.columns, array], names=[*batch.schema.names, ids])
    finally:
        encoder.forget()


def encode(docs: DataFrame, rank_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add column ``ids`` (array<int>) to ``docs``; a column of that name is replaced."""
    docs = docs.drop(ids)
    out = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False), True)])
    return map_arrow(docs, lambda batches: _encoded(batches, rank_path, pattern, text, ids), out)


def decode_flat(ids: np.ndarray, starts: np.ndarray, table: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bytes of all ids and where those of each id end. starts: of each id's bytes in table."""
    lengths = starts[ids + 1] - starts[ids]
    ends = np.cumsum(lengths)
    if not len(ids):
        return b"", ends
    at = np.arange(ends[-1]) + np.repeat(starts[ids] - (ends - lengths), lengths)
    return table[at].tobytes(), ends


@lru_cache(maxsize=2)
def bytes_of(rank_path: str) -> tuple[np.ndarray, np.ndarray]:
    """(where the bytes of each id start, the bytes of all ids)."""
    words: list[bytes] = [b""] * (max((ranks := load_ranks(rank_path)).values()) + 1)
    for word, rank in ranks.items():
        words[rank] = word
    return np.cumsum([0, *map(len, words)]), np.frombuffer(b"".join(words), dtype=np.uint8)


def _decoded(batches: Iterator[pa.RecordBatch], rank_path: str, ids: str, out: str) -> Iterator[pa.RecordBatch]:
    starts, table = bytes_of(rank_path)
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            lists = batch.column(batch.schema.get_field_index(ids))
            counts = np.asarray(lists.value_lengths().fill_null(0))
            flat = np.asarray(lists.flatten()).astype(np.int64)
            data, ends = decode_flat(flat, starts, table)
            ends = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
            array = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([*batch.columns, array.cast(pa.binary())], names=[*batch.schema.names, out])


def decode(encoded: DataFrame, rank_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add column ``out`` (binary): the bytes of the ids; null ids as none. An id outside the vocabulary is an error."""
    encoded = encoded.drop(out)
    schema = T.StructType([*encoded.schema.fields, T.StructField(out, T.BinaryType(), True)])
    return map_arrow(encoded, lambda batches: _decoded(batches, rank_path, ids, out), schema)


def round_trip(docs: DataFrame, rank_path: str, pattern: str, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``decode(encode(docs))`` without column ``text``, in one worker a task: neither texts nor ids go through the JVM between the two."""
    docs = docs.drop(ids, out)
    fields = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType([*fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False), True), T.StructField(out, T.BinaryType(), True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bare = (b.drop_columns([text]) for b in _encoded(batches, rank_path, pattern, text, ids))
        yield from _decoded(bare, rank_path, ids, out)

    return map_arrow(docs, run, schema)


def digests(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    coded = round_trip(docs.select("doc_id", "text"), rank_path, pattern)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def one(texts: Iterable[str], ranks: dict[bytes, int], pattern: str) -> list[list[int]]:
    """Ids of texts without Spark."""
    encoder = Encoder(ranks, pattern)
    coded = encoder.encode_all([*texts]) if splits_at_spaces(pattern) else map(encoder.by_pattern, texts)
    return [np.frombuffer(x, dtype="<i4").tolist() for x in coded]
