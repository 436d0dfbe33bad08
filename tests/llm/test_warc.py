import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from ontoweave.llm import warc

PAGES = "page_id bigint, url string, html string"
LONG = "x" * 150


def archived(spark, tmp_path, rows, **extra):
    pages = spark.createDataFrame(rows, PAGES).withColumns(extra)
    path = str(tmp_path / "warc")
    warc.write_archives(pages, path, per_file=3)
    return path, warc.assemble(spark, path)


def test_round_trip(spark, tmp_path):
    tricky = "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n<html>é\U0001f600\x00</html>\r\n\r\n" * 5
    rows = [
        (1, "http://a/1", "<p>short</p>"), (2, "http://a/2", "<p>short</p>"), (3, None, None), (4, "http://a/ b\r\nX: y", ""),
        (5, "http://a/5", tricky), (6, "http://a/6", tricky), (7, "http://a/7", LONG), (9, "http://a/9", LONG), (8, "u", LONG),
        (None, "http://a/n", LONG), (10, "http://a/10", "z" * 3_000_000), (7, "http://a/7", LONG), (-4, "v", "\r\n" * 60),
    ]
    path, captures = archived(spark, tmp_path, rows, page=F.lit(1), payload=F.lit("clash"))
    got = warc.resolve(captures).collect()
    assert len(got) == len(rows)
    kept = sorted((r["page_id"] is None, r["page_id"] or 0, r["response"]["type"], r["refers_to"], r["payload_bytes"], r["payload_sha256"]) for r in got)
    first = {hashlib.sha256(h.encode()).hexdigest(): min(i for i, _, x in rows if x == h and i is not None) for _, _, h in rows if h and len(h.encode()) >= 100}
    wanted = []
    for i, _, html in rows:
        body = (html or "").encode()
        digest = hashlib.sha256(body).hexdigest()
        again = i is not None and digest in first and i != first[digest]
        wanted.append((i is None, i or 0, "revisit" if again else "response", first[digest] if again else None, len(body), digest))
    assert kept == sorted(wanted)
    for r in got:
        if r["response"]["type"] == "response":
            assert hashlib.sha256(r["response"]["payload"]).hexdigest() == r["payload_sha256"]
        else:
            assert bytes(r["response"]["payload"]) == b""
        assert r["request"]["http_head"].startswith("GET ") and r["metadata"]["fields"] is not None
    assert all("\n" not in (r["response"]["target_uri"] or "") for r in got)


def test_urls_keep_all_but_blanks_and_controls(spark, tmp_path):
    urls = ["http://x.org/a%20b?q=1&r=%E2%82%AC#f", "http://é.org/漢?a=+", "http://x.org/a b\tc\r\nX: y\x7f", "", "%", "http://x.org/" + "p" * 5000]
    path, captures = archived(spark, tmp_path, [(i, u, LONG) for i, u in enumerate(urls)])
    got = {r["metadata"]["fields"].split()[1]: r["response"]["target_uri"] for r in captures.collect()}
    wanted = {**{str(i): u for i, u in enumerate(urls)}, "2": "http://x.org/a%20b%09c%0D%0AX:%20y%7F"}
    assert got == wanted
    heads = {r["request"]["http_head"].split("\r\n")[0] for r in captures.collect()}
    assert heads == {f"GET {u} HTTP/1.1" for u in wanted.values()}


def test_archives_are_plain_warc(spark, tmp_path):
    path, _ = archived(spark, tmp_path, [(1, "http://a", LONG)])
    files = list((tmp_path / "warc").glob("*.gz"))
    text = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: request") and text.endswith(b"\r\n\r\n")
    kinds = [h[b"warc-type"] for f in files for h, _ in warc.parse(f.read_bytes())]
    assert kinds == [b"request", b"response", b"metadata"]


def test_members_of_a_compressed_archive(spark, tmp_path):
    path, _ = archived(spark, tmp_path, [(1, "http://a", LONG), (2, "http://b", "y" * 500)])
    plain = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "warc").glob("*.gz"))
    cut = plain.index(b"WARC/1.1", 10)
    members = gzip.compress(plain[:cut]) + gzip.compress(plain[cut:])
    assert list(warc.parse(plain)) == list(warc.parse(members)) and len(list(warc.parse(plain))) == 6
    with pytest.raises(ValueError):
        list(warc.parse(plain[:-200]))
    with pytest.raises(ValueError):
        list(warc.parse(gzip.compress(plain)[:-30]))


def test_no_pages(spark, tmp_path):
    path, captures = archived(spark, tmp_path, [])
    assert warc.resolve(captures).collect() == []


def test_a_capture_without_its_request(spark, tmp_path):
    record = (
        "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Type: application/http; msgtype=response\r\n"
        "Content-Length: 21\r\n\r\nHTTP/1.1 200 OK\r\n\r\nhi\r\n\r\n"
    )
    (tmp_path / "one.warc").write_bytes(record.encode())
    (row,) = warc.resolve(warc.assemble(spark, str(tmp_path))).collect()
    assert (row["request"], row["metadata"], row["page_id"], row["payload_bytes"]) == (None, None, None, 2)
