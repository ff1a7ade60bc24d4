import base64
import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from andamio.llm import warc

PAGES = "page_id long, url string, html string, key string, file string"
ROWS = [
    (5, "https://www.Example.com/a?x=1#y", "<p>same</p>"),
    (3, "http://example.com/b", "<p>same</p>"),
    (9, None, "<p>same</p>"),
    (1, "no scheme", None),
    (2, "https://a.org/é\nX", ""),
    (4, "https://a.org/é", "größer 日本\r\n\r\nx"),
    (4, "https://a.org/é", "größer 日本\r\n\r\nx"),
    (4, "https://a.org/other", "changed"),
    (None, "https://a.org/n", "<p>same</p>"),
    (None, None, "only here"),
    (-7, "https://a.org/", "long " * 50_000),
    *[(100 + i, "https://hot.net/", f"v{i % 3}") for i in range(60)],
]


def expected(rows, least):
    first = {}
    for i, _, h in rows:
        h = h or ""
        first[h] = min((x for x in (first.get(h), i) if x is not None), default=None)
    out = Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        revisit = len(raw) >= least and i != first[h or ""]
        out[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first[h or ""] if revisit else None] += 1
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], PAGES)


@pytest.mark.parametrize(("least", "sizes"), [(0, {}), (5, {"shards": 3, "block_lines": 2, "archive_bytes": 300}), (0, {"shards": 1, "block_lines": 1})])
def test_round_trip(spark, least, sizes):
    got = Counter(tuple(r) for r in warc.round_trip(frame(spark, ROWS), least, **sizes).collect())
    assert got == expected(ROWS, least)


def test_look_up_finds_one_key_and_its_payload(spark):
    pages = frame(spark, ROWS)
    root, shards = warc.archive(pages, shards=4, block_lines=3)
    key = pages.filter("page_id = 4 AND html LIKE 'gr%'").select(warc.url_key(F.col("url"), F.col("page_id")).alias("key"))
    assert key.first().key.startswith("org,a)/é ")
    rows = warc.read_records(warc.look_up(key, root, shards), root).collect()
    assert [bytes(r.payload).decode() for r in rows] == ["größer 日本\r\n\r\nx"] * 2
    missing = spark.createDataFrame([("zz",), ("",), ("org,a)/q",)], "key string")
    assert warc.look_up(missing, root, shards).collect() == []


def test_empty_table(spark):
    assert warc.round_trip(frame(spark, [])).collect() == []


def test_record_is_warc():
    fields, http, payload = warc.parse(warc.record(7, "http://a/\r\nb", b"xyz", "D", None, False))
    assert fields["WARC-Target-URI"] == "http://a/%0D%0Ab" and payload == b"xyz" and http["Content-Length"] == "3"
    fields, http, payload = warc.parse(warc.record(7, None, b"xyz", "D", 3, True))
    assert (warc.page_number(fields["WARC-Refers-To"]), payload, http["Content-Length"]) == (3, b"", "3")
