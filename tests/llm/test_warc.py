import base64
import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from kscreen.llm import warc as W

HTML = ["<p>a</p>", "<p>é</p>", "<p>a</p>", None, "", "<p>a</p>", "x" * 100_000, "line\r\n\r\nWARC/1.1\r\n"]


def pages(spark, htmls):
    rows = [(i, f"http://h{i}.example/p?q={i}", h, "x", 1) for i, h in enumerate(htmls)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string, first long")


def captures(spark, df, **options):
    c = W.assemble(W.read_archives(W.write_archives(df, **options)))
    f = F.from_json("metadata.fields", "map<string,string>")
    return c.select(f["page-id"].cast("long").alias("page_id"), "response", "request", f["refers-to-page-id"].cast("long").alias("refers_to"), "n_requests", "n_metadata").collect()


def test_round_trip(spark):
    got = {r.page_id: r for r in captures(spark, pages(spark, HTML))}
    assert sorted(got) == list(range(len(HTML)))
    for i, h in enumerate(HTML):
        body = (h or "").encode()
        last = max(j for j, x in enumerate(HTML) if (x or "") == (h or ""))
        r = got[i].response
        assert r.payload_bytes == len(body)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert (r.type, got[i].refers_to) == (("response", None) if i == last else ("revisit", last))
        assert r.payload == (body if i == last else None)
        assert r.target_uri == f"http://h{i}.example/p?q={i}"
        assert (got[i].n_requests, got[i].n_metadata, got[i].request.type) == (1, 1, "request")
        if i != last:
            assert r.refers_to_uri == f"http://h{last}.example/p?q={last}"


def test_small_payloads_are_not_revisits(spark):
    assert {r.response.type for r in captures(spark, pages(spark, ["a", "a", "", ""]), min_bytes=2)} == {"response"}


def test_nulls_ties_and_nothing(spark):
    df = spark.createDataFrame([(None, None, "a"), (None, "u", "a"), (4, "u", "b"), (4, "u", "b"), (None, "u", "b")], "page_id long, url string, html string")
    got = sorted((r.page_id is None, r.response.type, r.refers_to or 0) for r in captures(spark, df))
    assert got == [(False, "response", 0), (False, "response", 0), (True, "response", 0), (True, "response", 0), (True, "revisit", 4)]
    assert captures(spark, df.limit(0)) == []


def rec(record_id, kind, to=(), payload=None, fields=None):
    return ("f", record_id, kind, list(to), "u", "d", None, None if payload is None else len(payload), None, 200 if payload else None, fields, payload)


def assembled(spark, rows, **options):
    return W.assemble(spark.createDataFrame(rows, W.RECORD), **options).collect()


def test_stray_records(spark):
    rows = [rec("r1", "request", ["gone"]), rec("m1", "metadata", ["x"], fields={"a": "b"}), rec("x", "response", payload=b"abc"), rec("r2", "request", ["x"]), rec("r0", "request", ["x"])]
    got = {r.capture_id: r for r in assembled(spark, rows)}
    assert set(got) == {"gone", "x"}
    assert got["gone"].response is None and got["gone"].request.record_id == "r1"
    assert (got["x"].response.payload, got["x"].request.record_id, got["x"].n_requests, got["x"].n_metadata) == (b"abc", "r0", 2, 1)


def test_every_response_is_a_capture(spark):
    rows = [rec("x", "response", payload=b"a"), rec("x", "response", payload=b"b"), rec(None, "response", payload=b"c"), rec(None, "response", payload=b"d"), rec("q", "request", ["x"])]
    rows += [rec(None, "request"), rec(None, "request"), rec(None, "metadata", fields={"k": "v"}), rec("w", "warcinfo")]
    got = assembled(spark, rows)
    assert sorted((r.response.payload, r.n_requests) for r in got if r.response) == [(b"a", 1), (b"b", 1), (b"c", 0), (b"d", 0)]
    assert sorted((r.n_requests, r.n_metadata) for r in got if not r.response) == [(0, 1), (1, 0), (1, 0)]


def test_concurrent_to_is_followed(spark):
    rows = [rec("x", "response", payload=b"a"), rec("q", "request", ["x"]), rec("m", "metadata", ["q"]), rec("y", "revisit", ["p"]), rec("p", "request"), rec("n", "metadata", ["gone", "y"])]
    rows += [rec("z", "response", payload=b"z"), rec("o", "request", ["gone2"])]
    got = {r.capture_id: r for r in assembled(spark, rows, payload=False)}
    ids = lambda r: (r.request and r.request.record_id, r.metadata and r.metadata.record_id)
    assert ids(got["x"]) == ("q", "m") and ids(got["y"]) == ("p", "n") and ids(got["z"]) == (None, None)
    assert len(got) == 4 and [ids(r) for r in got.values() if r.response is None] == [("o", None)]
    assert "payload" not in got["x"].response.asDict()
    assert assembled(spark, []) == []


def archive(tmp_path, *records):
    (tmp_path / "a.warc.gz").write_bytes(b"".join(records))
    return str(tmp_path / "a.warc.gz")


def test_other_archives(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\n\r\n"
    sha256 = "sha256:" + hashlib.sha256(b"x").hexdigest()
    file = archive(
        tmp_path,
        W.record("response", "1", [], "application/http", http + b"no digest"),
        W.record("response", "2", [("WARC-Payload-Digest", sha256)], "application/http", http + b"x"),
        W.record("response", "3", [], "application/http", b"garbage"),
        W.record("response", "4", [], "application/http", b"HTTP/1.1 abc OK\r\n\r\nbody"),
        W.record("metadata", "5", [("WARC-Concurrent-To", "<urn:uuid:0>"), ("WARC-Concurrent-To", "<urn:uuid:1>")], "application/warc-fields", b"a: b\r\n"),
    )
    rows = W.read_archives(spark.createDataFrame([(file, 5)], "file string, n_captures long"))
    got = {r.record_id[-1]: r for r in rows.collect()}
    assert [(got[i].payload_digest, got[i].status) for i in "1234"] == [(None, 200), (None, 200), (None, None), (None, None)]
    assert got["5"].concurrent_to == ["urn:uuid:0", "urn:uuid:1"]
    assert {r.capture_id[-1]: r.n_metadata for r in W.assemble(rows).collect()} == {"1": 1, "2": 0, "3": 0, "4": 0}
    bad = archive(tmp_path, W.record("response", "1", [("WARC-Payload-Digest", "sha1:AAAA")], "application/http", http + b"x"))
    with pytest.raises(Exception, match="differ"):
        W.read_archives(spark.createDataFrame([(bad, 1)], "file string, n_captures long")).collect()


def test_very_long_payload(spark):
    body = "0123456789" * 1_000_000
    got = captures(spark, pages(spark, [body, body, "b"]))
    assert sorted((r.page_id, r.response.type, r.response.payload_bytes) for r in got) == [(0, "revisit", 10_000_000), (1, "response", 10_000_000), (2, "response", 1)]


def test_parse_refuses_other_bytes():
    with pytest.raises(ValueError):
        list(W.parse(io.BytesIO(b"hello\r\n")))
    data = gzip.decompress(W.record("warcinfo", "1", [], "text/plain", b"abc"))
    assert [(h["warc-type"], b) for h, b in W.parse(io.BytesIO(data + data))] == [("warcinfo", b"abc")] * 2
