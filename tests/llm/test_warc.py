"""Archives as other software writes and reads them."""

import gzip
import pathlib
import re

import pytest

from geoloom.llm import warc


def files(path):
    return [f.read_bytes() for f in sorted(pathlib.Path(path).glob("part-*"))]


def test_written_records_have_the_mandatory_fields(spark, tmp_path):
    rows = [(1, "http://a/", "same"), (2, "http://b/", "same"), (2, "http://b/", "same"), (3, None, None), (None, "http://c/", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(pages, path := str(tmp_path / "w"))
    heads = re.findall(rb"WARC/1\.1\r\n(.*?)\r\n\r\n", b"".join(files(path)), re.S)
    fields = [dict(line.split(": ", 1) for line in h.decode().split("\r\n")) for h in heads]
    assert len(fields) == 5
    for f in fields:
        assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= set(f)
        assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", f["WARC-Date"])
        assert f["WARC-Type"] != "revisit" or f["WARC-Profile"].endswith("identical-payload-digest")
    assert len({f["WARC-Record-ID"] for f in fields}) == 5
    got = sorted(((r.page_id or 0), r.record_type, r.refers_to) for r in warc.read_archives(spark, path).collect())
    assert got == [(0, "response", None), (1, "revisit", 2), (2, "response", None), (2, "response", None), (3, "response", None)]


@pytest.mark.parametrize("split", [134217728, 300])
def test_foreign_records(spark, tmp_path, split):
    body = b"<p>x</p>"
    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + body
    magic = warc.MAGIC
    records = [
        b"WARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Type: application/warc-fields\r\nContent-Length: 12\r\n\r\nsoftware: me",
        b"warc-type:response\r\nwarc-record-id:<urn:uuid:2>\r\nwarc-target-uri:http://x/\r\ncontent-type: application/http;msgtype=response\r\ncontent-length:%d\r\n\r\n" % len(http) + http,
        b"WARC-Type: resource\r\nWARC-Target-URI:   http://y/\r\nX-Folded: a\r\n b: c\r\nContent-Length:\t%d  \r\n\r\n" % len(body) + body,
        b"WARC-Type: resource\r\nContent-Length: 0\r\n\r\n",
        b"WARC-Type: resource\r\nWARC-Target-URI: z\r\nContent-Length: %d\r\n\r\n" % (500 * len(magic) + 1) + magic * 500 + b"!",
    ]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.warc").write_bytes(b"".join(magic + r + warc.GAP for r in records))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        got = [(r.record_type, r.url, bytes(r.payload), r.page_id) for r in warc.read_archives(spark, str(tmp_path / "f")).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [("warcinfo", None, b"software: me", None), ("response", "http://x/", body, None), ("resource", "http://y/", body, None), ("resource", None, b"", None), ("resource", "z", magic * 500 + b"!", None)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_compressed_archives_are_read_too(spark, tmp_path):
    (tmp_path / "g").mkdir()
    data = warc.MAGIC + b"WARC-Type: resource\r\nContent-Length: 2\r\n\r\nhi" + warc.GAP
    (tmp_path / "g" / "a.warc.gz").write_bytes(gzip.compress(data * 3))
    assert [bytes(r.payload) for r in warc.read_archives(spark, str(tmp_path / "g")).collect()] == [b"hi"] * 3


def test_very_long_payload_and_clashing_columns(spark, tmp_path):
    text = "é " * 1_500_000
    pages = spark.createDataFrame([(1, "http://a/", text, 5, "b"), (2, "http://a/", text, 6, "c")], "page_id long, url string, html string, refers_to long, body string")
    warc.write_archives(pages, path := str(tmp_path / "w"))
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archives(spark, path).collect()}
    assert got == {1: (4_500_000, "revisit", 2), 2: (4_500_000, "response", None)}
