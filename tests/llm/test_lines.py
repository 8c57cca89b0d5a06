import hashlib
import re

import xxhash

from pyspark.sql import functions as F

from skein.llm import lines, ordermin
from tests.llm.data import EDGES, edge_docs, texts

LONG = " ".join(f"w{k}" for k in range(60))
HALF = [" ".join(f"{c}{k}" for k in range(30)) for c in "abc"]
DOCS = [
    (1, f"start one\n{LONG}\nend one"), (2, f"start two\n{LONG}\n\nend two"), (3, "\n".join(HALF)), (4, f"x\n{HALF[0]}\n{HALF[1]}\ny"), (5, f"z\n{HALF[1]}\n{HALF[2]}"), (6, f"{HALF[1]}\nalone"),
    (7, f"{LONG}\n{LONG}\n{LONG}"), (8, "short\nshort\nshort"), (9, f"  {LONG}  \nq"), (10, f"{LONG}\na b\nc d"), (11, f"k\n{LONG}\na b\nc d\nl"),
]


def brute(docs):
    rows = sorted({(i is not None, i, int(0), t) for i, t in docs if t is not None}, key=lambda r: (r[0], r[1] or 0))
    content = [(i, t, [(k, s.strip(" ")) for k, s in enumerate(t.split("\n")) if s.strip(" ")]) for _, i, _, t in rows]
    seen, gone = set(), {}
    places = []
    for d, (i, t, ls) in enumerate(content):
        for a in range(len(ls)):
            n = 0
            for b in range(a, len(ls)):
                n += ls[b][1].count(" ") + 1
                if n >= 50:
                    places.append((d, ls[a][0], ls[b][0], tuple(s for _, s in ls[a : b + 1])))
    first = {}
    for d, a, b, run in places:
        first[run] = min(first.get(run, (d, a)), (d, a))
    for d, a, b, run in places:
        if (d, a) > first[run]:
            gone.setdefault(d, set()).update(range(a, b + 1))
    by = {(i, t): gone.get(d, set()) for d, (i, t, _) in enumerate(content)}
    out = []
    for i, t in docs:
        ls = [] if t is None else t.split("\n")
        g = by.get((i, t), set())
        kept = "\n".join(s for k, s in enumerate(ls) if k not in g)
        out.append((i, len(ls), len(g), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_line_dedup_equals_brute_force(spark):
    for docs in (DOCS, EDGES, texts()):
        assert sorted(map(tuple, lines.digest(edge_docs(spark, docs)).collect()), key=str) == brute(docs)
    assert any(r[2] for r in brute(DOCS)) and lines.digest(edge_docs(spark).where("false")).count() == 0


def test_line_dedup_keeps_columns(spark):
    got = lines.dedup_lines(edge_docs(spark, DOCS))
    assert set(edge_docs(spark).columns) <= set(got.columns)
    assert got.where("n_chars != length(text)").count() == 0


def spark_hash(*values):
    """Spark's xxhash64: each value is hashed with the hash before it as seed. Strings as UTF-8, longs and ints as bytes; null is passed over."""
    seed = 42
    for v in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else v[1].to_bytes(v[0], "little", signed=True)
            seed = xxhash.xxh64_intdigest(raw, seed)
    return seed


def long(x):
    return 8, x - (1 << 64) if x >> 63 else x


def omh(text):
    """The fingerprint by brute force: all numbered k-mers are sorted anew under each permutation."""
    words = [long(spark_hash(w)) for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w]
    if not words:
        return ""
    seen, ranked = {}, []
    for j in range(max(1, len(words) - 4)):
        kmer = spark_hash(*words[j : j + 5]) >> 24
        n = seen[kmer] = seen.get(kmer, -1) + 1
        signed = kmer - (1 << 40) if kmer >> 39 else kmer
        ranked.append((spark_hash((8, signed), (4, n)) >> 24, j))
    out = []
    for number in range(32):
        least = sorted(ranked, key=lambda r: r[0] ^ (number << 35) ^ (1 << 39))[:2]
        value = lambda r: (8, r[0] - (1 << 40) if r[0] >> 39 else r[0])
        tuple_ = spark_hash(*[value(r) for r in sorted(least, key=lambda r: r[1])])
        out.append(f"{number << 27 | tuple_ >> 37:08x}")
    return "".join(out)


def test_fingerprints_equal_brute_force(spark):
    docs = [(k, t) for k, (_, t) in enumerate(EDGES + texts()[:80])] + [(900, " ".join(f"w{k % 7}" for k in range(500))), (901, "a b c d e f"), (902, "a b c d e f g")]
    got = {r["doc_id"]: r["fingerprint"] for r in ordermin.fingerprints(edge_docs(spark, docs)).collect()}
    assert got == {i: omh(t or "") for i, t in docs}


def test_fingerprints(spark):
    docs = sorted(texts()[:60], key=lambda r: r[0])
    rows = {r["doc_id"]: r for r in ordermin.digest(edge_docs(spark, docs)).collect()}
    for (i, t), (_, u) in zip(docs, docs[1:] + docs[:1]):
        cut = len(t) // 4
        edited = t[: len(t) - cut] + u[:cut]
        assert rows[i]["n_chars"] == len(t) and rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (rows[i]["fingerprint"] == rows[i]["edited_fingerprint"]) == (rows[i]["near_edited"] == 1.0)
    near = [r["near_edited"] for r in rows.values() if r["n_chars"] > 400]
    far = [r["near_next"] for r in rows.values() if r["n_chars"] > 400]
    assert sum(near) / len(near) > sum(far) / len(far) + 0.2


def test_fingerprints_sense_order_and_repeats(spark):
    words = [f"w{k}" for k in range(400)]
    moved = words[200:] + words[:200]
    rows = [(1, " ".join(words)), (2, " ".join(words)), (3, " ".join(moved)), (4, " ".join(words * 2)), (5, " ".join(words[:395] + ["q"] * 5)), (6, ""), (7, None), (8, "w1 w2"), (9, "w1  w2 ")]
    got = {r["id"]: r["s"] for r in spark.createDataFrame(rows, "id int, t string").select("id", ordermin.signature(F.col("t")).alias("s")).collect()}
    like = lambda a, b: len(set(got[a]) & set(got[b])) / ordermin.BINS
    assert got[1] == got[2] and got[6] == got[7] == [] and got[8] == got[9] and len(got[8]) == len(got[1]) == ordermin.BINS
    assert like(1, 5) > 0.8 > like(1, 3) > 0.3  # moved passages keep the k-mers but not their order
    assert like(1, 4) < 0.7  # repeats count: half of its numbered k-mers are new


def test_fingerprint_edges(spark):
    got = ordermin.digest(edge_docs(spark)).collect()
    assert len(got) == len(EDGES)
    twice = [r for r in got if r["doc_id"] == 9]
    assert twice[0] == twice[1]
    assert ordermin.digest(edge_docs(spark).where("false")).count() == 0
    one = ordermin.digest(edge_docs(spark, [(1, "a b c d e f g h")])).collect()[0]
    assert one["near_next"] == 1.0


def test_followers_of_a_table_that_is_sampled(spark):
    """Range bounds come from a sample once a partition holds more keys than that takes."""
    keys = spark.range(0, 40_000, 1, 8).selectExpr("id % 20000 as dk", "xxhash64(id) as th", "cast(id % 7 as int) as cut")
    want = sorted(map(tuple, keys.collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        got = ordermin.followers(keys).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(map(tuple, got)) == [(*a, *b[:2]) for a, b in zip(want, want[1:] + want[:1])]
