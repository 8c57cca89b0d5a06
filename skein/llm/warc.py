"""WARC archives of pages: writing with revisits and segments, and reading with reassembly.

Each record is a gzip member of its own. A payload that another page of smaller id has too becomes a revisit record; a
block above ``SEGMENT_BYTES`` is cut into a first record and continuation records, which may stand in other files; bodies
above ``CHUNK_BYTES`` are framed by chunked transfer encoding. Reading groups continuations by WARC-Segment-Origin-ID,
orders them by segment number, checks that none is missing and that the total length holds, and takes the framing off.

Defined results: null html is an empty payload; payloads below ``LEAST_BYTES`` are never revisits; rows that repeat a
page_id make a record each, and of equal payloads all with the smallest page_id are responses; a null page_id counts as
the largest; a null url writes no target; a record whose segments are missing, doubled with other bytes, or of another
total length, or whose framing breaks off, comes back with payload null and the reason in ``problem``; an empty table
writes no archive and reads no record; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import hot_join, map_arrow, shared_folder, written

LEAST_BYTES = 100
SEGMENT_BYTES, CHUNK_BYTES, FILE_BYTES = 32_768, 4096, 64_000_000
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
DATE = "2020-01-01T00:00:00Z"
RECORD = "page_id long, url string, record_type string, refers_to long, digest string, payload_bytes long, payload binary, problem string"
_FIELDS = ["page_id", "url", "record_type", "refers_to", "digest", "payload_bytes"]
_PAGE = re.compile(r"<urn:page:(-?\d+)")


def with_decisions(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, payload_bytes, refers_to): refers_to is null for responses."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    base = base.withColumns({"digest": F.sha2("payload", 256), "payload_bytes": F.length("payload").cast("long")})
    copied = base.where(F.col("payload_bytes") >= LEAST_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    joined = hot_join(base, written(copied, "copied"), ["digest"], base.count(), "left")
    return joined.select("page_id", "url", "payload", "digest", "payload_bytes", F.expr("case when first is not null and (page_id is null or page_id != first) then first end").alias("refers_to"))


def _record(kind: str, name: str, block: bytes, *more: tuple[str, str]) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", DATE), *more, ("Content-Length", str(len(block)))]
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _block(payload: bytes) -> bytes:
    if len(payload) < CHUNK_BYTES:
        return _HTTP + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    parts = [_HTTP, b"Transfer-Encoding: chunked\r\n\r\n"]
    for at in range(0, len(payload), CHUNK_BYTES):
        chunk = payload[at : at + CHUNK_BYTES]
        parts += [b"%x\r\n" % len(chunk), chunk, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def new_name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}:{uuid.uuid4().hex}>"


def _about(url: str | None, digest: str) -> list[tuple[str, str]]:
    target = [] if url is None else [("WARC-Target-URI", re.sub(r"\s", "%20", url))]
    return [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"), *target]


def response(name: str, url: str | None, payload: bytes, digest: str) -> Iterator[bytes]:
    """The gzip members of a page's record and its continuations."""
    block, more = _block(payload), _about(url, digest)
    if len(block) <= SEGMENT_BYTES:
        yield _record("response", name, block, *more)
        return
    last = -(-len(block) // SEGMENT_BYTES)
    for n in range(1, last + 1):
        part = block[(n - 1) * SEGMENT_BYTES : n * SEGMENT_BYTES]
        number = ("WARC-Segment-Number", str(n))
        if n == 1:
            yield _record("response", name, part, *more, number)
        else:
            end = [("WARC-Segment-Total-Length", str(len(block)))] if n == last else []
            yield _record("continuation", f"{name[:-1]}:{n}>", part, ("WARC-Segment-Origin-ID", name), number, *end)


def revisit(name: str, url: str | None, digest: str, payload_bytes: int, response_name: str) -> bytes:
    """The gzip member of a page whose payload the record of that name has."""
    block = _HTTP + b"Content-Length: %d\r\n\r\n" % payload_bytes
    return _record("revisit", name, block, *_about(url, digest), ("WARC-Refers-To", response_name), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))


def _write(rows: DataFrame, folder: str, members: Callable[..., Iterable[bytes]]) -> DataFrame:
    """Write the members of each row into archives; (path, page_id, digest, name) of each record. rows: page_id, digest and what members takes after the name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, base = pyarrow.fs.FileSystem.from_uri(folder)
        place.create_dir(base, recursive=True)
        stream, done = None, []

        def end() -> pa.RecordBatch:
            stream.close()
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*done), (pa.string(), pa.int64(), pa.string(), pa.string()))], names=["path", "page_id", "digest", "name"])

        for batch in batches:
            columns = [batch.column(k) for k in range(batch.num_columns)]
            for k in range(batch.num_rows):  # row by row: a batch may hold much
                page_id, digest, *more = (c[k].as_py() for c in columns)
                name = new_name(page_id)
                if stream is None:
                    path, size, done = f"{base}/pages-{uuid.uuid4().hex}.warc.gz", 0, []
                    stream = place.open_output_stream(path, compression=None)
                for member in members(name, digest, *more):
                    stream.write(member)
                    size += len(member)
                done.append((path, page_id, digest, name))
                if size >= FILE_BYTES:
                    yield end()
                    stream = None
        if stream is not None:
            yield end()

    return map_arrow(rows, run, "path string, page_id long, digest string, name string")


def write(decided: DataFrame, folder: str) -> DataFrame:
    """Write archives into ``folder``, a URI that all executors reach; the result (path, page_id, digest, name) names the records of tasks that ended.

    Responses come first, so that each revisit can name the record it refers to.
    """
    whole = decided.where("refers_to is null").select("page_id", "digest", "url", "payload")
    responses = written(_write(whole, folder, lambda name, digest, url, payload: response(name, url, payload, digest)), "responses")
    again = written(decided.where("refers_to is not null").select("page_id", "digest", "url", "payload_bytes"), "again")
    visits = again.groupBy("digest").agg(F.count("*").alias("n"))
    names = responses.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull(), "page_id", "name")).alias("of")).join(visits, "digest").selectExpr("digest", "of.name as of", "n")
    named = hot_join(again, names, ["digest"], again.count()).select("page_id", "digest", "url", "payload_bytes", "of")
    return responses.unionByName(_write(named, folder, lambda name, digest, url, size, of: [revisit(name, url, digest, size, of)]))


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of a stream of gzip members."""
    unpacker, held = zlib.decompressobj(31), bytearray()
    data = stream.read(1 << 20)
    while data:
        held += unpacker.decompress(data)
        if unpacker.eof:
            data = unpacker.unused_data or stream.read(1 << 20)
            unpacker = zlib.decompressobj(31)
        else:
            data = stream.read(1 << 20)
        while (at := held.find(b"\r\n\r\n")) >= 0:
            lines = bytes(held[:at]).decode().split("\r\n")
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            start = at + 4
            end = start + int(headers["content-length"])
            if len(held) < end + 4:
                break
            yield headers, bytes(held[start:end])
            del held[: end + 4]
    if held:
        raise ValueError("the archive breaks off within a record")


def unframe(block: bytes) -> tuple[bytes | None, int, str | None]:
    """(payload, its length by the header, problem) of an HTTP response block."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        return None, 0, "no HTTP header"
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
    if "chunked" not in headers.get("transfer-encoding", "").lower():
        return body, int(headers.get("content-length", len(body))), None
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            size = -1
        if size < 0 or end + 2 + size > len(body):
            return None, 0, "chunked framing breaks off"
        if not size:
            payload = b"".join(parts)
            return payload, len(payload), None
        parts.append(body[end + 2 : end + 2 + size])
        if body[end + 2 + size : end + 4 + size] != b"\r\n":
            return None, 0, "chunked framing breaks off"
        at = end + 4 + size


def _page_of(name: str | None) -> int | None:
    found = _PAGE.match(name or "")
    return int(found[1]) if found else None


def _row(headers: dict[str, str], block: bytes | None, problem: str | None = None) -> tuple:
    payload, size = None, None
    if block is not None:
        payload, size, problem = unframe(block)
        if payload is not None and headers["warc-type"] != "revisit" and size != len(payload):
            payload, problem = None, "the body has another length than its header says"
    digest = headers.get("warc-payload-digest", "").removeprefix("sha256:") or None
    return _page_of(headers.get("warc-record-id")), headers.get("warc-target-uri"), headers.get("warc-type"), _page_of(headers.get("warc-refers-to")), digest, size, payload if headers.get("warc-type") != "revisit" else None, problem


_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("problem", pa.string())])
_SCANNED = pa.schema([*_ARROW, ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("headers", pa.map_(pa.string(), pa.string()))])


def _batches(rows: Iterator[tuple], schema: pa.Schema, weight: int) -> Iterator[pa.RecordBatch]:
    """Batches of some MB."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[weight] or b"") + 200
        if size > 4_000_000:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema)


def read(manifest: DataFrame, root: str) -> DataFrame:
    """``RECORD`` rows of all records in the archives that the manifest names; root: a URI of their file system.

    Each archive is read once, in a task of its own. Only segments are shuffled.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, _ = pyarrow.fs.FileSystem.from_uri(root)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for path in batch.column(0).to_pylist():
                    with place.open_input_stream(path, compression=None) as stream:
                        for h, b in parse(stream):
                            if "warc-segment-number" not in h:
                                yield (*_row(h, b), None, None, None, None)
                                continue
                            total, first = h.get("warc-segment-total-length"), h["warc-type"] != "continuation"
                            origin = h["warc-record-id"] if first else h.get("warc-segment-origin-id")
                            yield (*[None] * 6, b, None, origin, int(h["warc-segment-number"]), int(total) if total else None, list(h.items()) if first else None)

        return _batches(rows(), _SCANNED, 6)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches((_assembled(*(c[k].as_py() for c in batch.columns)) for batch in batches for k in range(batch.num_rows)), _ARROW, 6)

    paths = manifest.select("path").distinct()
    found = written(map_arrow(paths.repartition(max(1, paths.count()), "path"), scan, RECORD + ", origin string, number int, total long, headers map<string,string>"), "scanned")
    # a group is the segments of one record, never more than its page
    grouped = found.where("number is not null").groupBy("origin").agg(F.collect_list(F.struct("number", "total", "headers", F.col("payload").alias("block"))).alias("segments"))
    return found.where("number is null").select(*_ARROW.names).unionByName(map_arrow(grouped, join, RECORD))


def _assembled(origin: str | None, segments: list[dict]) -> tuple:
    by: dict[int, dict] = {}
    problem = None
    for s in segments:
        if by.setdefault(s["number"], s)["block"] != s["block"]:
            problem = f"segment {s['number']} stands there twice"
    numbers = sorted(by)
    headers = dict(by[1]["headers"]) if 1 in by and by[1]["headers"] else {"warc-record-id": origin or "", "warc-type": "response"}
    totals = {s["total"] for s in by.values() if s["total"] is not None}
    block = b"".join(by[n]["block"] for n in numbers)
    if problem is None and (numbers != list(range(1, len(numbers) + 1)) or not totals):
        problem = "a segment is missing"
    if problem is None and totals != {len(block)}:
        problem = "the total length is another"
    return _row(headers, None if problem else block, problem)


def archive(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives into the shared folder and read them back."""
    folder = f"{shared_folder(spark)}/warc"
    return read(written(write(with_decisions(pages), folder), "manifest"), folder)


def digest(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Length and digest are those of the payload that was read; of a revisit, those that its record states."""
    records = archive(spark, pages).withColumn("own", F.sha2("payload", 256))
    return records.selectExpr("page_id", "payload_bytes", "case when record_type = 'revisit' then digest else own end as payload_digest", "record_type", "refers_to", "problem")


ORACLE = f"""
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id <> first THEN first END AS refers_to,
  CAST(NULL AS VARCHAR) AS problem
FROM f
"""
