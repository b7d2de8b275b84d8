"""WARC archives: writing with segmentation, reading with segment reassembly.

Writing: each payload becomes an HTTP response with chunked transfer framing. A block longer than a
segment is cut: the first record is a response with segment number 1, the others are continuation
records that name its record id, and the last one has the total length. Payloads equal to one that
another record stores become revisit records, which name that record's URI and date. Every record is
a gzip member of its own, as readers of WARC 1.1 expect, and each task's first file begins with a
warcinfo record. Spark's own text sink writes the bytes, so archives are committed like any other
output; its line separator is a gzip member without content, which readers pass over.

Reading: records are parsed from whole archive files. Continuation records are grouped with their
origin, ordered by segment number, checked against the total length, and the chunked framing is
decoded.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from charta.llm.wordhash import portions, settle
from charta.llm.workdir import written

#: Bytes of a block in one record, of a chunk in the transfer framing, and rows in one archive.
SEGMENT, CHUNK, ROWS = 65536, 16384, 4000
END = b"\r\n\r\n"
EMPTY = gzip.compress(b"", mtime=0)
#: Repeated payloads, counted, and bytes of their urls up to which their table (a digest and an id each) is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 16_000_000
DATE = "2024-01-01T00:00:00Z"
_B32 = base64.b32encode


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Payload in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError where the framing is broken. Chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("no chunk size")
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk of another length")
        out.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no end of HTTP headers")
    return unchunked(body) if re.search(rb"(?im)^transfer-encoding:[ \t]*chunked[ \t]*\r?$", head) else body


def digest(payload: bytes) -> str:
    return _B32(hashlib.sha1(payload).digest()).decode()


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block


def _id(key: str) -> str:
    h = hashlib.md5(key.encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def _uri(raw: bytes | None) -> str:
    """As a header can hold it: control characters and spaces escaped."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", (raw or b"").decode(errors="replace"))


def warcinfo(key: str) -> bytes:
    return _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _id(f"{key}/info")), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"software: charta\r\nformat: WARC File Format 1.1\r\n")


def records_of(key: str, uri: str, page_id: str, payload: bytes, sha1: str, refers_to: tuple[str, str] | None, segment: int = SEGMENT) -> list[bytes]:
    """The records, without their end, of one capture; ``key`` makes their ids. refers_to: page_id and URI of the record that stores the payload."""

    def name(number: int) -> str:
        return _id(f"{key}/{number}")

    common = [("WARC-Date", DATE), ("WARC-Target-URI", uri), ("X-Page-ID", page_id), ("WARC-Payload-Digest", f"sha1:{sha1}"), ("X-Payload-Length", str(len(payload)))]
    if refers_to is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        return [_record([("WARC-Type", "revisit"), ("WARC-Record-ID", name(1)), *common, ("WARC-Profile", profile), ("WARC-Refers-To-Target-URI", refers_to[1]), ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page-ID", refers_to[0])], b"")]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    if len(parts) == 1:
        return [_record([("WARC-Type", "response"), ("WARC-Record-ID", name(1)), ("Content-Type", "application/http; msgtype=response"), *common], block)]
    out = [_record([("WARC-Type", "response"), ("WARC-Record-ID", name(1)), ("Content-Type", "application/http; msgtype=response"), *common, ("WARC-Segment-Number", "1")], parts[0])]
    for i, part in enumerate(parts[1:], 2):
        total = [("WARC-Segment-Total-Length", str(len(block)))] if i == len(parts) else []
        out.append(_record([("WARC-Type", "continuation"), ("WARC-Record-ID", name(i)), common[0], common[1], ("WARC-Segment-Origin-ID", name(1)), ("WARC-Segment-Number", str(i)), *total], part))
    return out


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, sha1, refers_to and refers_to_url of ``pages`` (page_id, url, html, any others).

    refers_to: the largest page_id with an equal payload of ``least_bytes`` or more, null for that one
    itself and for shorter payloads. Bytes of html and url are taken as they are, UTF-8 or not; null
    html is an empty payload. Only digests, ids and urls are grouped; payloads stay where they are
    while the table of repeated ones is small. Of repeated rows all those with
    the largest page_id are responses. A null page_id counts as smaller than any other and refers to
    them.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("binary").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html"))
    # grouped by SHA-256, for which no two unequal texts are known to agree
    rows = rows.withColumns({"sha1": F.sha1("html"), "sha2": F.unhex(F.sha2("html", 256))})
    newest = rows.groupBy("sha2").agg(F.max(F.struct("page_id", "url")).alias("newest"), F.count("*").alias("copies")).filter("copies > 1 and newest.page_id is not null").drop("copies")
    newest = written(newest, "newest")
    count, size = newest.agg(F.count("*"), F.sum(F.octet_length("newest.url"))).first()
    found = rows.join(F.broadcast(newest) if count <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else newest, "sha2", "left")
    other = (F.octet_length("html") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("newest.page_id"))
    return found.select("page_id", "url", "html", "sha1", F.when(other, F.col("newest.page_id")).alias("refers_to"), F.when(other, F.col("newest.url")).alias("refers_to_url"))


def write(pages: DataFrame, path: str, least_bytes: int = 0, segment: int = SEGMENT) -> None:
    """Write one capture for each row of ``pages`` as gzip-compressed WARC files of at most ROWS records, named part-*.txt.

    See ``with_revisits`` for nulls and repeated rows. A payload of any length is cut into segments. An
    empty table gives no records.
    """
    rows = with_revisits(pages, least_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in (x for b in batches for x in portions(b, 2)):
            out = []
            for page_id, url, html, sha1, refers, refers_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page, uri = "" if page_id is None else str(page_id), _uri(url)
                key = f"{page}/{uri}/{sha1}/{at}"
                if not at:
                    out.append(warcinfo(key))
                at += 1
                out += records_of(key, uri, page, html, _B32(bytes.fromhex(sha1)).decode(), None if refers is None else (str(refers), _uri(refers_url)), segment)
            yield pa.RecordBatch.from_arrays([pa.array([gzip.compress(x + END, 6, mtime=0) for x in out], pa.binary())], names=["value"])

    records = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    # the separator's bytes are code points of this encoding; values are written as the bytes that they are
    records.write.option("lineSep", EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", ROWS).text(path)


def inflated(data: bytes, step: int = 1 << 14) -> bytes:
    """The content of all gzip members; ValueError if the last one is cut short. Fed in small steps, as what is left over of a step is copied."""
    out, at, view = [], 0, memoryview(data)
    while at < len(data):
        member = zlib.decompressobj(31)
        while not member.eof:
            if at >= len(data):
                raise ValueError("gzip member cut short")
            out.append(member.decompress(view[at : at + step]))
            at += step
        at = min(at, len(data)) - len(member.unused_data)
    return b"".join(out)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of every record of an archive, compressed or not; ValueError if it is cut short."""
    if data[:2] == b"\x1f\x8b":
        data = inflated(data)
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError("no WARC record")
        headers = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            headers[name.strip().lower().decode()] = value.strip().decode(errors="replace")
        at = end + 4
        size = int(headers["content-length"])
        if len(data) < at + size:
            raise ValueError("record cut short")
        yield headers, data[at : at + size]
        at += size
        while data.startswith(b"\r\n", at):
            at += 2


_FIELDS = ("warc-type", "warc-record-id", "warc-target-uri", "x-page-id", "warc-payload-digest", "x-payload-length", "x-refers-to-page-id", "warc-segment-origin-id")
_RECORD = "type string, record_id string, uri string, page string, digest string, length string, refers string, origin string, number int, total long, block binary"


def records(spark: SparkSession, path: str) -> DataFrame:
    """A row for every record of the archives under ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*[(n, pa.string()) for n in ("type", "record_id", "uri", "page", "digest", "length", "refers", "origin")], ("number", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])
        for batch in batches:
            for data in batch.column(0):
                rows, held = [], 0
                for h, block in parse(data.as_py()):
                    number, total = h.get("warc-segment-number"), h.get("warc-segment-total-length")
                    rows.append((*[h.get(f) for f in _FIELDS], number and int(number), total and int(total), block))
                    held += len(block)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path).select("content")
    return files.mapInArrow(run, _RECORD)


_CAPTURE = pa.schema([*[(n, pa.string()) for n in ("record_type", "url", "page", "refers")], ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("fault", pa.string())])


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _CAPTURE, strict=True)], schema=_CAPTURE)

    for batch in batches:
        cols = {n: c.to_pylist() for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "parts"}
        lists = batch.column("parts")
        rows, held = [], 0
        for i, kind in enumerate(cols["type"]):
            block = b"".join([x.as_buffer() for x in lists[i].values])
            want, length, total = cols["digest"][i], cols["length"][i], cols["total"][i]
            payload, fault = None, None
            if kind == "response":
                if cols["last"][i] != cols["count"][i] or (total is None) != (cols["count"][i] == 1) or (total is not None and total != len(block)):
                    fault = "segments missing or of another total length"
                else:
                    try:
                        payload = payload_of(block)
                    except ValueError as e:
                        fault = str(e)
            sha1 = digest(payload) if payload is not None else (want or "").removeprefix("sha1:") or None
            if payload is not None and want is not None and want != f"sha1:{sha1}":
                fault = "another digest"
            rows.append((kind, cols["uri"][i], cols["page"][i], cols["refers"][i], payload, len(payload) if payload is not None else length and int(length), sha1, fault))
            held += len(block)
            if held > 8 << 20:
                yield out(rows)
                rows, held = [], 0
        if rows:
            yield out(rows)
        settle()


def read(spark: SparkSession, path: str) -> DataFrame:
    """Captures in the archives under ``path``: page_id, url, record_type, payload (null for revisits), payload_bytes, payload_digest, refers_to and fault (null, or why a payload can't be told).

    Records in one piece are decoded where they are read; only segments are shuffled, and grouped by
    the record id of their first one, so a group is one payload. Archives without captures give no
    rows; a number that can't be read as page_id is null.
    """
    found = records(spark, path).filter("type <> 'warcinfo'")
    whole = found.filter("number is null").select("type", "uri", "page", "refers", "digest", "length", F.lit(None).cast("long").alias("total"), F.lit(1).alias("last"), F.lit(1).cast("long").alias("count"), F.array("block").alias("parts"))
    parts = found.filter("number is not null").withColumn("origin", F.coalesce("origin", "record_id")).withColumn("first", F.when(F.col("number") == 1, F.struct("type", "uri", "page", "refers", "digest", "length")))
    joined = parts.groupBy("origin").agg(F.max("first").alias("first"), F.max("total").alias("total"), F.max("number").alias("last"), F.count("*").alias("count"), F.sort_array(F.collect_list(F.struct("number", "block"))).alias("parts"))
    joined = joined.select(F.coalesce("first.type", F.lit("response")).alias("type"), "first.uri", "first.page", "first.refers", "first.digest", "first.length", "total", "last", "count", F.col("parts.block").alias("parts"))
    kind = "record_type string, url string, page string, refers string, payload binary, payload_bytes long, payload_digest string, fault string"
    out = whole.unionByName(joined).mapInArrow(_decoded, kind)
    return out.select(F.expr("try_cast(page as long)").alias("page_id"), "url", "record_type", "payload", "payload_bytes", "payload_digest", F.expr("try_cast(refers as long)").alias("refers_to"), "fault")
