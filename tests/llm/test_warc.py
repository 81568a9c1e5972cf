import hashlib

import pytest

from docloom.llm import warc

BODY = "<html>" + "ä" * 700 + "</html>"
PAGES = [(1, "http://a/ b", BODY), (2, "http://a/2", BODY), (5, "http://a/5", BODY), (5, "http://a/5", BODY), (3, None, None), (4, "http://x/", ""),
         (6, "http://x/6", "short"), (7, "http://x/7", "short"), (8, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\n\r\n" * 60), (None, "u", "none")]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, digest string, value string")


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("records", [2, 1000])
def test_round_trip(spark, version, records, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS", records)
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0 if records == 2 else 100)
    got = warc.archive(pages(spark), version=version).collect()
    assert sorted((r.page_id or -1, r.payload_bytes, r.payload_digest) for r in got) == sorted(
        (i or -1, len((b or "").encode()), hashlib.sha1((b or "").encode()).hexdigest()) for i, _, b in PAGES
    )
    kinds = sorted((r.page_id, r.record_type, r.refers_to) for r in got if r.page_id in (1, 2, 5))
    assert kinds == [(1, "revisit", 5), (2, "revisit", 5), (5, "response", None), (5, "revisit", 5)]
    assert all(r.record_type == "response" for r in got if r.page_id not in (1, 2, 5))
    assert all(bytes(r.payload).decode() == (dict((i, b) for i, _, b in PAGES)[r.page_id] or "") for r in got if r.record_type == "response")


def test_empty(spark):
    assert warc.archive(pages(spark, []).limit(0)).count() == 0


def test_headers_of_both_versions():
    one = warc.arc_version_block(1, "x.arc") + b"\n" + warc.arc_record(1, "http://u", b"abc", "x", kind="text/html; charset=x") + b"\n"
    two = warc.arc_version_block(2, "x.arc") + b"\n" + warc.arc_record(2, "http://v", b"HTTP/1.0 200 OK\r\n\r\nbody\n", "x") + b"\n"
    first, second = map(warc.from_arc, warc.parse_arc(one + two))
    assert (first["type"], first["payload"], first["date"]) == ("resource", b"abc", "2024-01-01T00:00:00Z")
    assert (second["type"], second["payload"], second["url"]) == ("response", b"body\n", "http://v")
    with pytest.raises(ValueError, match="cut off"):
        list(warc.parse_arc(one[:-3]))


def test_a_record_larger_than_a_batch(spark):
    body = "x" * (40 << 20) + "end"
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.archive(pages(spark, [(1, "u", body), (2, "u", body), (3, "u", "y")])).collect()}
    assert got == {1: ("revisit", 2, len(body)), 2: ("response", None, len(body)), 3: ("response", None, 1)}
