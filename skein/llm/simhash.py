"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints within ``DISTANCE`` bits of each other agree, in some group of bits i, up to threshold t_i, whenever the sum
of (t_i + 1) exceeds the distance; t_i = -1 leaves a group unused. Bits that vary together are put into one group, and a
dynamic program gives each group its threshold by the candidates it is estimated to make. Each distinct fingerprint is
indexed once a used group and probes all values within t_i of its own; what meets is verified bit by bit. Copies never
meet: only distinct fingerprints are joined.

The plan (groups, thresholds) is estimated on ``PLAN_ROWS`` fingerprints; it changes cost, never results.

``near_texts`` is the stage of a corpus pipeline: fingerprints of word pairs within ``NEAR_DISTANCE`` bits are candidates, and
a link is a Jaccard similarity of ``NEAR`` or more between the sets of five-word shingles, worked out from whole texts.
Candidates that earlier links have already joined aren't compared again.

Defined results: null and empty texts and texts of white space have fingerprint 0 and link like any other; repeated rows
are returned each; an empty table gives an empty one; component_id is the smallest doc_id of the component that isn't null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import LOWER, Powers, apart, flat, hot_join, map_arrow, mix, pieces, shuffled, word_spans, written

SHINGLE, DISTANCE, SEED = 4, 4, 42
PLAN_ROWS = 3000
#: Of ``near_texts``: words of a shingle that is compared, least similarity, words of a shingle in the fingerprint, bits between candidates.
NEAR_WORDS, NEAR, NEAR_SHINGLE, NEAR_DISTANCE = 5, 0.8, 2, 6
_WORD = np.ones(256, dtype=bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_STEPS = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(NEAR_WORDS)], dtype=np.uint64)
#: Cost of a row that is shuffled against that of a pair that is verified.
ROW_COST = 40


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - shingle + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[:n].tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, stops)])
    cells = np.frombuffer(raw, dtype=np.uint8).reshape(n, 8)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        counts += np.unpackbits(cells[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, column in pieces(batches):
            fps = np.array([fingerprint(t) for t in column.to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=[key, "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return map_arrow(docs.select(F.col(key), F.col(text).cast("string").alias("text")), run, f"`{key}` {kind}, fp long")


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)  # column 0: the highest bit


def bit_groups(sample: np.ndarray, m: int) -> list[int]:
    """Masks of m groups of nearly equal size; each takes, one at a time, the bit that varies most with those it has."""
    bits = _bits(sample).astype(float)
    centred = bits - bits.mean(axis=0)
    spread = np.sqrt((centred**2).mean(axis=0)) + 1e-9
    related = np.abs((centred / spread).T @ (centred / spread)) / max(1, len(sample))
    free, masks = list(range(64)), []
    for g in range(m):
        size = len(free) // (m - g)
        own = [free.pop(int(np.argmax([related[b, free].sum() for b in free])))]
        while len(own) < size:
            own.append(free.pop(int(np.argmax(related[np.ix_(own, free)].sum(axis=0)))))
        masks.append(sum(1 << (63 - b) for b in own))
    return masks


def plan(sample: np.ndarray, n: int, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """(mask, threshold) of the groups in use, the cheapest of several numbers of groups by estimated candidates."""
    sample = np.unique(sample)
    best: tuple[float, list[tuple[int, int]]] | None = None
    for m in range(2, distance + 2):
        masks = bit_groups(sample, m)
        costs = []
        for mask in masks:
            width, own = mask.bit_count(), sample & np.uint64(mask)
            near = np.zeros(65)
            for at in range(0, len(own), 256):
                near += np.bincount(np.bitwise_count(own[at : at + 256, None] ^ own[None, :]).ravel(), minlength=65)
            near[0] -= len(own)
            pairs = np.cumsum(near) / max(1, len(own) * (len(own) - 1))
            row, probes = [0.0], 0
            for t in range(distance + 1):
                probes += comb(width, t)
                chance = max(pairs[t], probes / 2.0**width)
                row.append(n * (probes + 1) * ROW_COST + float(n) * n * chance)
            costs.append(row)  # row[t + 1]: threshold t
        # least[k]: the cheapest way to spend k on the groups so far
        least: list[tuple[float, list[int]]] = [(0.0, [])] + [(float("inf"), [])] * (distance + 1)
        for row in costs:
            least = [min(((least[k - s][0] + row[s], [*least[k - s][1], s - 1]) for s in range(k + 1)), key=lambda x: x[0]) for k in range(distance + 2)]
        total, thresholds = least[distance + 1]
        if best is None or total < best[0]:
            best = total, [(mask, t) for mask, t in zip(masks, thresholds) if t >= 0]
    return best[1]


def _flips(mask: int, threshold: int) -> list[int]:
    """All changes of at most ``threshold`` bits of the mask, as signed longs."""
    bits = [b for b in range(64) if mask >> b & 1]
    return [_signed(sum(1 << b for b in chosen)) for t in range(threshold + 1) for chosen in combinations(bits, t)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(classes: DataFrame, groups: list[tuple[int, int]], distance: int = DISTANCE) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints of ``classes`` (column fp) within the distance."""
    index = probes = None
    for g, (mask, threshold) in enumerate(groups):
        part = f"fp & {_signed(mask)}L" if _signed(mask) != -(1 << 63) else "fp & (-9223372036854775807L - 1L)"
        own = classes.selectExpr(f"{g} as g", f"{part} as part", "fp as b")
        flips = F.expr(f"cast(split('{','.join(map(str, _flips(mask, threshold)))}', ',') as array<bigint>)")  # one literal, folded once
        asked = classes.select(F.lit(g).alias("g"), F.expr(part).alias("own"), F.col("fp").alias("a"), F.explode(flips).alias("flip")).selectExpr("g", "own ^ flip as part", "a")
        index, probes = (own, asked) if index is None else (index.unionByName(own), probes.unionByName(asked))
    met = probes.join(shuffled(index), ["g", "part"]).where(f"a < b and bit_count(a ^ b) <= {distance}")
    return met.select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node of edges (a, b), by large-star and small-star rounds.

    Neighbourhoods are only ever reduced to their minimum, so a node with many of them is pre-aggregated, never gathered.
    """
    edges = written(edges.selectExpr("greatest(a, b) as a", "least(a, b) as b").where("a > b").distinct(), "edges")
    seen = None
    while True:
        both = edges.union(edges.selectExpr("b as a", "a as b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) as m")
        edges = both.where("b > a").join(shuffled(least), "a").selectExpr("b as a", "m as b").where("a > b").distinct()
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        small = edges.join(shuffled(least), "a")
        edges = written(small.selectExpr("b as a", "m as b").where("a > b").union(least.selectExpr("a", "m as b")).distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.expr("xxhash64(a, b) % 1000000007")), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == seen:
            return edges.selectExpr("a as node", "b as root").union(edges.selectExpr("b as node", "b as root").distinct())
        seen = now


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """(key, fp, component, n_links) of each row: n_links counts the other fingerprints that its own links to."""
    marked = written(fingerprints(docs, key, text), "fingerprints")
    classes = written(marked.groupBy("fp").agg(F.min(key).alias("first"), F.count("*").alias("n")), "classes")
    n, rows = classes.count(), marked.count()
    sample = classes.orderBy(F.xxhash64("fp"), "fp").limit(PLAN_ROWS).select("fp").collect()
    if n < 2:
        return hot_join(marked, classes.selectExpr("fp", "first as component", "0L as n_links", "n"), ["fp"], rows).select(key, "fp", "component", "n_links")
    groups = plan(np.array([r["fp"] for r in sample], dtype=np.int64).view(np.uint64), n, distance)
    edges = written(links(classes, groups, distance), "links")
    degree = edges.selectExpr("a as fp").union(edges.selectExpr("b as fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    rooted = classes.join(shuffled(components(edges).withColumnRenamed("node", "fp")), "fp", "left").selectExpr("fp", "first", "n", "coalesce(root, fp) as root")
    named = rooted.join(shuffled(rooted.groupBy("root").agg(F.min("first").alias("component"))), "root").join(shuffled(degree), "fp", "left")
    named = written(named.selectExpr("fp", "component", "coalesce(n_links, 0L) as n_links", "n"), "named")
    return hot_join(marked, named, ["fp"], rows).select(key, "fp", "component", "n_links")


def marked_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, c, fp, packed) of each row: c is the hash of the text, packed the text compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch, column in pieces(batches):
            own = column.to_pylist()
            fps = np.array([fingerprint(t, NEAR_SHINGLE) for t in own], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([xxhash.xxh3_128_digest(t) for t in own], pa.binary()), pa.array(fps), pa.array([pack(t) for t in own], pa.binary())], names=[key, "c", "fp", "packed"])

    kind = docs.schema[key].dataType.simpleString()
    return map_arrow(docs.select(F.col(key), F.col(text).cast("string").alias("text")), run, f"`{key}` {kind}, c binary, fp long, packed binary")


def shingle_hashes(texts: list[bytes], powers: Powers) -> list[np.ndarray]:
    """The distinct shingles of ``NEAR_WORDS`` words of each text, hashed and sorted; of fewer words, one of them all."""
    data, offsets = flat(pa.array(texts, pa.large_binary()))
    data = LOWER[data]
    starts, ends, before = word_spans(data, offsets, _WORD)
    words = powers.spans(powers.prefix(data), starts, ends)
    out = []
    for a, b in zip(before[:-1], before[1:]):
        own, size = words[a:b], min(NEAR_WORDS, b - a)
        n = len(own) - size + 1
        sums = np.full(n if size else 0, size, dtype=np.uint64)
        for k in range(size):
            sums += own[k : n + k] * _STEPS[k]
        out.append(np.unique(mix(sums)))
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - both
    return both / either if either else 1.0


def similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose texts (c, packed) have a similarity of ``NEAR`` or more."""
    left, right = shuffled(texts.selectExpr("c as a", "packed as pa")), shuffled(texts.selectExpr("c as b", "packed as pb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, unpack = Powers(), zstandard.ZstdDecompressor().decompress
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                x, y = (shingle_hashes([*map(unpack, batch.column(k).to_pylist())], powers) for k in (2, 3))
                near = pa.array([jaccard(p, q) >= NEAR for p, q in zip(x, y)], pa.bool_())
                yield batch.select(["a", "b"]).filter(near)

    return map_arrow(pairs.join(left, "a").join(right, "b").select("a", "b", "pa", "pb"), run, "a binary, b binary")


def near_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, component): the least key of all rows whose texts are linked with the row's, directly or not."""
    marked = written(marked_texts(docs, key, text), "texts")
    classes = written(marked.groupBy("c").agg(F.min(key).alias("first"), F.first("fp").alias("fp"), F.count("*").alias("n")), "classes")
    prints = classes.select("fp").distinct()
    n = prints.count()
    sample = prints.orderBy(F.xxhash64("fp"), "fp").limit(PLAN_ROWS).collect()
    same = prints.selectExpr("fp as a", "fp as b")
    near = same if n < 2 else same.union(links(prints, plan(np.array([r["fp"] for r in sample], dtype=np.int64).view(np.uint64), n, NEAR_DISTANCE), NEAR_DISTANCE))
    ends = near.join(shuffled(classes.selectExpr("fp as a", "c as x")), "a").join(shuffled(classes.selectExpr("fp as b", "c as y")), "b").where("a != b or x < y")
    candidates = written(ends.selectExpr("least(x, y) as a", "greatest(x, y) as b"), "candidates")
    asked = candidates.selectExpr("a as c").union(candidates.selectExpr("b as c")).distinct()
    asked = written(asked, "asked")
    texts = written(apart(marked, asked, ["c"])[0].join(shuffled(asked), "c", "left_semi").groupBy("c").agg(F.first("packed").alias("packed")), "compared")
    # first, each text against the least of its candidates: that joins most of a group
    first = written(similar(candidates.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), texts), "first")
    roots = written(components(first), "roots")
    of = lambda end: shuffled(roots.selectExpr(f"node as {end}", f"root as r{end}"))
    rest = written(candidates.join(of("a"), "a", "left").join(of("b"), "b", "left").where("coalesce(ra, a) != coalesce(rb, b)").select("a", "b"), "rest")
    if not rest.isEmpty():
        more = written(similar(rest, texts), "more")
        roots = roots if more.isEmpty() else components(first.union(more))
    named = classes.join(shuffled(roots.withColumnRenamed("node", "c")), "c", "left").selectExpr("c", "first", "n", "coalesce(root, c) as root")
    named = written(named.join(shuffled(named.groupBy("root").agg(F.min("first").alias("component"))), "root").select("c", "component", "n"), "named")
    return hot_join(marked.select(key, "c"), named, ["c"], marked.count()).select(key, "component")


def digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).selectExpr("doc_id", "lower(lpad(hex(fp), 16, '0')) as fingerprint", "component as component_id", "n_links")
