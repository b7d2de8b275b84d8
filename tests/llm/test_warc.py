import base64
import gzip
import hashlib
import zlib

import pytest

from charta.llm import warc
from charta.llm.workdir import fresh_path


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, payload string, sha1 int")


def captured(spark, rows, **settings):
    path = fresh_path(spark, "archives")
    warc.write(pages_of(spark, rows), path, **settings)
    return path, warc.read(spark, path).collect()


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


ROWS = [(1, "http://a/", "same"), (5, "http://b/ c", "same"), (3, None, None), (4, "u", ""), (7, "u", "é" * 900), (8, "u", "line\r\n\r\nWARC/1.1\r\n\r\n0\r\n\r\n" * 9), (None, "n", "same"), (9, "u", "x" * 300_000), (2, "http://a/", "same")]


def test_round_trip(spark):
    _, out = captured(spark, ROWS, segment=700)
    got = {r["page_id"]: r for r in out}
    assert len(out) == len(ROWS) and not [r for r in out if r["fault"]]
    for i, _, h in ROWS:
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len((h or "").encode()), sha(h))
        assert (r["payload"] is None) == (r["record_type"] == "revisit")
        assert r["payload"] is None or bytes(r["payload"]) == (h or "").encode()
    assert {i: r["refers_to"] for i, r in got.items() if r["record_type"] == "revisit"} == {1: 5, 2: 5, None: 5, 3: 4}
    assert got[5]["url"] == "http://b/%20c"


def test_joined_by_shuffle_alike(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    test_round_trip(spark)


def test_short_payloads_are_not_revisits(spark):
    _, out = captured(spark, ROWS, least_bytes=5)
    assert {r["record_type"] for r in out} == {"response"}


def test_repeated_rows_and_empty_table(spark):
    _, out = captured(spark, [(1, "u", "t"), (1, "u", "t"), (0, "u", "t")])
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in out) == [(0, "revisit", 1), (1, "response", None), (1, "response", None)]
    assert captured(spark, [])[1] == []


def test_faults_are_told(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"payload" * 30)
    key = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:a>"), ("X-Page-ID", "1"), ("WARC-Segment-Number", "1")]
    rest = [("WARC-Type", "continuation"), ("WARC-Record-ID", "<urn:b>"), ("WARC-Segment-Origin-ID", "<urn:a>"), ("WARC-Segment-Number", "2"), ("WARC-Segment-Total-Length", str(len(block) + 1))]
    lone = [("WARC-Type", "continuation"), ("WARC-Record-ID", "<urn:c>"), ("WARC-Segment-Origin-ID", "<urn:z>"), ("WARC-Segment-Number", "3")]
    good = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:d>"), ("X-Page-ID", "4")]
    records = [warc._record(rest, block[90:]), warc._record(key, block[:90]), warc._record(lone, b"zz"), warc._record(good, block)]
    (tmp_path / "a.txt.gz").write_bytes(gzip.compress(b"".join(r + b"\r\n\r\n" for r in records)))
    out = warc.read(spark, f"file://{tmp_path}").collect()
    assert sorted((r["page_id"] or 0, bool(r["fault"])) for r in out) == [(0, True), (1, True), (4, False)]


def test_framing():
    for size in (1, 7, 1000):
        assert warc.unchunked(warc.chunked(b"abc" * 50, size)) == b"abc" * 50
    assert warc.unchunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for bad in (b"", b"5\r\nabc\r\n0\r\n\r\n", b"zz\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(bad)
    assert warc.payload_of(b"HTTP/1.1 200 OK\r\n\r\nplain") == b"plain"


def test_bytes_that_are_no_utf8_stay_as_they_are(spark):
    raw = b"<p>\xff\xfe caf\xe9</p>"
    pages = spark.createDataFrame([(1, b"http://a/\xff", raw), (2, b"u", raw), (3, b"u", b"")], "page_id long, url binary, html binary").selectExpr("page_id", "cast(url as string) url", "cast(html as string) html")
    path = fresh_path(spark, "archives")
    warc.write(pages, path)
    got = {r["page_id"]: r for r in warc.read(spark, path).collect()}
    assert {i: r["payload_bytes"] for i, r in got.items()} == {1: len(raw), 2: len(raw), 3: 0}
    assert got[1]["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode() and got[1]["refers_to"] == 2
    assert bytes(got[2]["payload"]) == raw


def members_of(data):
    """What each gzip member holds."""
    while data:
        member = zlib.decompressobj(31)
        yield member.decompress(data)
        assert member.eof
        data = member.unused_data


def test_archives_begin_with_warcinfo_and_revisits_name_what_they_refer_to(spark, tmp_path):
    warc.write(pages_of(spark, [(1, "http://a/", "t"), (2, "http://b/", "t")]).coalesce(1), f"file://{tmp_path}/x")
    (file,) = (tmp_path / "x").glob("*.txt")
    found = list(warc.parse(file.read_bytes()))
    members = [m for m in members_of(file.read_bytes()) if m]
    assert len(members) == len(found) == 3 and all(m.startswith(b"WARC/1.1\r\n") and m.endswith(b"\r\n\r\n") for m in members)
    kinds = [h["warc-type"] for h, _ in found]
    assert kinds[0] == "warcinfo" and sorted(k for k in kinds if k != "warcinfo") == ["response", "revisit"]
    revisit = next(h for h, _ in found if h["warc-type"] == "revisit")
    assert revisit["warc-refers-to-target-uri"] == "http://b/" and revisit["warc-target-uri"] == "http://a/"
    for h, block in found:
        assert h["warc-block-digest"] == f"sha1:{warc.digest(block)}"


def test_long_payload_of_many_segments(spark):
    _, out = captured(spark, [(1, "u", "0123456789abcdef" * 2_000_000), (2, "u", "z")])
    assert sorted((r["page_id"], r["payload_bytes"], r["fault"]) for r in out) == [(1, 32_000_000, None), (2, 1, None)]


def test_members_of_any_size_are_inflated():
    parts = [b"", b"x", b"abc" * 9000, bytes(range(256)) * 400, b"", b"end"]
    whole = b"".join(gzip.compress(p) for p in parts)
    for step in (1, 7, 1 << 14):
        assert warc.inflated(whole, step) == b"".join(parts)
    with pytest.raises(ValueError):
        warc.inflated(whole[:-3])
