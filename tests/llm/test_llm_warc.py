"""The archive reader on archives of others, on ties and on odd columns."""

import gzip
import random

from difflens.llm import warc


def member(version, fields, block):
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return gzip.compress(f"{version}\r\n{head}\r\n".encode() + block + b"\r\n\r\n")


def foreign():
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n<p>one</p>"
    said = lambda kind, block, **more: {"WARC-Type": kind, "WARC-Record-ID": f"<urn:{kind}>", "WARC-Date": "2020-01-01T00:00:00Z", "Content-Length": len(block), **more}
    revisit = b"HTTP/1.1 200 OK\r\nContent-Length: 77\r\n\r\n"
    return [
        ("warcinfo", member("WARC/1.0", said("warcinfo", b"software: y\r\n"), b"software: y\r\n")),
        ("request", member("WARC/1.0", said("request", b"GET / HTTP/1.1\r\n\r\n"), b"GET / HTTP/1.1\r\n\r\n")),
        ("response", member("WARC/1.0", said("response", http, **{"Content-Type": "application/http; msgtype=response", "WARC-Target-URI": "http://a/"}), http)),
        ("response", member("WARC/0.18", said("response", b"a. IN A\r\n\r\n1", **{"Content-Type": "text/dns"}), b"a. IN A\r\n\r\n1")),
        ("revisit", member("WARC/1.1", said("revisit", revisit, **{"WARC-Payload-Digest": "sha1:" + "A" * 32, "WARC-Refers-To": "<urn:response>"}), revisit)),
        ("resource", member("WARC/1.1", said("resource", b"plain", **{"X-Long": "v" * 3000, "X-Folded": "a\r\n b"}), b"plain")),
        ("metadata", member("WARC/1.0", said("metadata", b"k: v"), b"k: v")),
        ("malformed", member("WARC/1.0", {"WARC-Type": "response", "WARC-Record-ID": "<urn:short>", "Content-Length": 99}, b"too short")),
        ("malformed", member("WARC/1.0", {"WARC-Record-ID": "<urn:untyped>", "Content-Length": 1}, b"x")),
    ]


def test_archives_of_others(spark, tmp_path):
    rnd, records = random.Random(4), foreign() * 3
    big = rnd.randbytes(300_000)
    records.insert(5, ("resource", member("WARC/1.0", {"WARC-Type": "resource", "WARC-Record-ID": "<urn:big>", "Content-Length": len(big)}, big)))
    (tmp_path / "x.warc.gz").write_bytes(b"".join(m for _, m in records))
    size = sum(len(m) for _, m in records)
    files = spark.createDataFrame([("x.warc.gz", size)], "file string, bytes long")
    for step in (4 << 20, 5000, 700):
        got = warc.read_archives(spark, f"file://{tmp_path}", files, range_bytes=step).collect()
        assert sorted(r.record_type for r in got) == sorted(k for k, _ in records)
        by = {r.record_id: r for r in got}
        assert by["<urn:big>"].payload == big and by["<urn:resource>"].payload == b"plain"
        assert {r.payload for r in got if r.record_type == "response"} == {b"<p>one</p>", b"a. IN A\r\n\r\n1"}
        assert (by["<urn:revisit>"].payload_bytes, by["<urn:revisit>"].payload_digest, by["<urn:revisit>"].refers_to_record) == (77, "0" * 40, "<urn:response>")
        assert by["<urn:short>"].payload is None and by["<urn:warcinfo>"].payload == b"software: y\r\n"


def test_equal_page_ids_and_clashing_columns(spark):
    long = "é" * 600
    rows = [(5, "u", long, "p", 1), (5, "u", long, "p", 1), (3, None, long, "p", 1), (None, "u", long, "p", 1), (7, "u", "short", "p", 1), (8, "u", "short", "p", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string, n int")
    got = sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in warc.round_trip(pages).collect())
    assert got == [(0, "revisit", 5, 1200), (3, "revisit", 5, 1200), (5, "response", None, 1200), (5, "response", None, 1200), (7, "response", None, 5), (8, "response", None, 5)]
