from __future__ import annotations

import base64
import gzip
import hashlib
import random

from conftest import rows as collected

from revcast.llm import warc
from revcast.llm.common import stored

SCHEMA = "page_id long, url string, html string"
INNER = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n\r\n"
PAGES = [
    (1, "http://a/1", "same"),
    (7, "http://a/7", "same"),
    (3, "http://a/3", "same"),
    (4, None, None),
    (5, "", ""),
    (6, "http://a/6\r\nWARC-Type: revisit", INNER),
    (8, "http://a/8", INNER),
    (9, "http://a/9", "é" * 300_000),
    (10, "http://a/9", "é" * 300_000),
    (11, "http://a/11", "own\r\n\r\n"),
    (12, "http://a/12", "twice"),
    (12, "http://a/12", "twice"),
    (None, "http://a/none", "none"),
    (None, "http://a/none", "none"),
    (None, "http://a/7", "same"),
    (13, "http://a/13", "\r\n\r\n"),
    (14, "http://a/14", "\x00\x1f\x8b"),
]


def brute(pages, least=0):
    out = []
    seen = set()
    largest = {}
    for i, _, html in pages:
        largest.setdefault(html or "", []).append(-1 if i is None else i)
    for i, _, html in pages:
        data = (html or "").encode()
        top = max(largest[html or ""])
        own = (-1 if i is None else i) == top and (html or "") not in seen
        if own:
            seen.add(html or "")
        own = own or len(data) < least
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if own else "revisit", None if own or top < 0 else top))
    return sorted(out, key=str)


def answer(df):
    return sorted(collected(df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")), key=str)


def test_archives_agree_with_brute_force(lm_spark):
    pages = lm_spark.createDataFrame([(*p, "x", 0) for p in PAGES], SCHEMA + ", payload string, record_id int").repartition(3)
    found = stored(warc.archived(pages), "t")
    assert answer(found) == brute(PAGES) and found.where("not intact").isEmpty()
    assert answer(warc.archived(pages, least_bytes=5)) == brute(PAGES, 5)
    ids = [r["record_id"] for r in found.collect()]
    assert len(set(ids)) == len(ids)
    assert {r["refers_to_id"] for r in found.collect() if r["record_type"] == "revisit"} <= {r["record_id"] for r in found.where("record_type = 'response'").collect()}


def test_many_copies(lm_spark):
    rng = random.Random(5)
    pages = [(i, f"http://a/{i}", "hot" if rng.random() < 0.4 else f"page {rng.randrange(60)}") for i in range(800)]
    assert answer(warc.archived(lm_spark.createDataFrame(pages, SCHEMA).repartition(4))) == brute(pages)


def test_files_are_plain_warc(lm_spark, tmp_path):
    pages = lm_spark.createDataFrame(PAGES, SCHEMA).coalesce(1)
    warc.write_pages(pages, str(tmp_path / "a"))
    warc.deduplicate(lm_spark, str(tmp_path / "a"), str(tmp_path / "b"))
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "b").glob("*.gz")))
    at = count = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        head = raw[at:end].decode().split("\r\n")
        assert head[0] == "WARC/1.1"
        fields = dict(x.split(": ", 1) for x in head[1:])
        size = int(fields["Content-Length"])
        block = raw[end + 4 : end + 4 + size]
        assert fields["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
        if fields["WARC-Type"] == "revisit":
            assert fields["WARC-Profile"] == warc.PROFILE and fields["WARC-Refers-To"].startswith("<urn:uuid:") and block.endswith(b"\r\n\r\n")
        at = end + 4 + size + 4
        assert raw[at - 4 : at] == b"\r\n\r\n"
        count += 1
    assert count == len(PAGES)


def test_reader_of_other_archives():
    def record(kind, body, extra=b""):
        return b"WARC/1.0\r\nWARC-Type: %s\r\n%sContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind, extra, len(body), body)

    http = b"HTTP/1.1 200 OK\r\nContent-Length: 4\r\n\r\n"
    whole = [record(b"warcinfo", b"software: x"), record(b"response", http + b"abcd"), record(b"response", http + b"WARC"), record(b"revisit", http, b"WARC-Payload-Digest: sha1:X\r\n")]
    for packed in (b"".join(whole), b"".join(map(gzip.compress, whole)), gzip.compress(b"".join(whole))):
        got = list(warc.parsed(packed))
        assert [(r["record_type"], r["payload_bytes"], r["payload"], r["intact"]) for r in got] == [("response", 4, b"abcd", True), ("response", 4, b"WARC", True), ("revisit", 4, None, True)]
    assert [r["intact"] for r in warc.parsed(whole[1][:-6])] == [False]
    assert list(warc.parsed(b"")) == []


def test_empty_table(lm_spark):
    assert collected(warc.archived(lm_spark.createDataFrame([], SCHEMA))) == []
