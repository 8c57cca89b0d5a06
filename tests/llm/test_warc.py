import hashlib
import io

import pytest
from pyspark.sql import functions as F

from skein.llm import warc

BIG = "".join(f"<p>{k} é</p>" for k in range(9000))
PAGES = [(1, "http://a/x y", "x" * 150), (2, "http://b", "x" * 150), (2, "http://b", "x" * 150), (3, None, None), (4, "http://c", ""), (5, "http://d", "short"), (6, "http://e", "short"), (7, "http://f", BIG), (8, "http://g", BIG), (9, "http://h", "é" * 50), (10, "http://i", "é" * 49 + "a"), (None, "http://j", "x" * 150), (11, "http://k", "\r\n\r\n0\r\n\r\n" * 3000)]


def expected():
    out = []
    for i, _, html in PAGES:
        raw = (html or "").encode()
        same = [j for j, _, h in PAGES if (h or "").encode() == raw and j is not None]
        first = min(same) if same else None
        visits = len(raw) >= 100 and i != first
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if visits else "response", first if visits else None, None))
    return sorted(out, key=str)


def test_archive_round_trip(spark):
    pages = spark.createDataFrame([(*p, "x", "x") for p in PAGES], "page_id long, url string, html string, digest string, payload string").repartition(3)
    assert sorted(map(tuple, warc.digest(spark, pages).collect()), key=str) == expected()
    assert warc.digest(spark, pages.where("false")).count() == 0


def test_segments_over_files(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = warc.archive(spark, pages).where("page_id = 7").select("payload").first()[0]
    assert bytes(got).decode() == BIG


def test_revisits_name_a_record_that_is_there(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    manifest = warc.written(warc.write(warc.with_decisions(pages), f"file://{tmp_path}"))
    found = {}
    for path in tmp_path.iterdir():
        with open(path, "rb") as stream:
            found |= {h["warc-record-id"]: h for h, _ in warc.parse(stream)}
    visits = [h for h in found.values() if h["warc-type"] == "revisit"]
    assert len(visits) == sum(r[3] == "revisit" for r in expected())
    for h in visits:
        target = found[h["warc-refers-to"]]
        assert target["warc-type"] == "response" and target["warc-payload-digest"] == h["warc-payload-digest"]
    assert manifest.count() == len(PAGES) == manifest.select("name").distinct().count()


def segments(payload=BIG.encode()):
    members = list(warc.response("<urn:page:7:t>", "http://f", payload, "d"))
    return [x for m in members for x in warc.parse(io.BytesIO(m))]


def rows(found):
    return [{"number": int(h["warc-segment-number"]), "total": int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None, "headers": list(h.items()) if h["warc-type"] == "response" else None, "block": b} for h, b in found]


def test_reassembly():
    parts = rows(segments())
    assert len(parts) > 3
    assert warc._assembled("o", parts[::-1])[6] == BIG.encode()
    assert warc._assembled("o", parts + parts[1:2])[6] == BIG.encode()
    for broken, why in ((parts[:1] + parts[2:], "missing"), (parts[:-1], "missing"), (parts[1:], "missing"), (parts + [parts[1] | {"block": b"z"}], "twice"), (parts[:-1] + [parts[-1] | {"total": 5}], "total")):
        assert warc._assembled("o", broken)[6] is None and why in warc._assembled("o", broken)[7]


@pytest.mark.parametrize("body", [b"5\r\nab", b"zz\r\n", b"2\r\nabX\r\n0\r\n\r\n", b""])
def test_broken_framing(body):
    payload, _, problem = warc.unframe(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + body)
    assert payload is None and problem


def test_chunk_extensions_and_identity():
    assert warc.unframe(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: Chunked\r\n\r\n2;x=1\r\nab\r\n0\r\n\r\n")[0] == b"ab"
    assert warc.unframe(b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nab")[:2] == (b"ab", 2)
    assert warc.unframe(b"nothing")[2]


def test_decisions_about_a_hot_payload_are_whole(spark):
    many = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit("y" * 200).alias("html"))
    assert warc.with_decisions(many).where("refers_to = 0").count() == 2999
