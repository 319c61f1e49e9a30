import gzip
import hashlib

import brute
import pytest
from pyspark.sql import functions as F, types as T

from sparkloom.llm import warc

SCHEMA = T.StructType(
    [T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())]
    + [T.StructField(n, T.StringType()) for n in ("digest", "size", "holder", "key", "payload", "n")]
)


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 6) for r in rows], SCHEMA)


BIG, OTHER = "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 80, "<b>" * 500
ROWS = [
    (1, "http://www.Example.com/a?x=1#top", BIG),
    (2, "http://www.example.com/a?x=1", BIG),
    (3, None, BIG),
    (None, "https://user@example.org:443/", BIG),
    (4, "http://b.org", "small"),
    (5, "http://b.org", "small"),
    (6, "http://b.org/\r\nX-Evil: 1", OTHER),
    (6, "http://b.org/twice", OTHER),
    (7, "http://b.org/é", OTHER[:-3]),
    (8, "", None),
    (9, "http://b.org", ""),
    (9, "http://b.org", ""),
    (10, "http://long.org/", "y" * 3_000_000),
    (2, "http://www.example.com/a?x=1", BIG),
]


def expected(rows):
    top, out = {}, []
    bodies = [(i, (h or "").encode()) for i, _, h in rows]
    for i, body in bodies:
        if i is not None:
            top[body] = max(i, top.get(body, i))
    for i, body in bodies:
        revisit = len(body) >= 1000 and body in top and top[body] != i
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", top[body] if revisit else None))
    return out


def read(pages):
    rows = warc.archive_and_read(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return brute.plain_order(rows.collect())


def test_edge_cases(spark):
    assert read(frame(spark, ROWS).repartition(4)) == brute.plain_order(expected(ROWS))


def test_empty_table(spark):
    assert read(frame(spark, [])) == []


def test_only_unnamed_copies(spark):
    rows = [(None, "http://a.b", BIG), (None, "http://a.b", BIG)]
    assert read(frame(spark, rows)) == brute.plain_order(expected(rows))


@pytest.mark.parametrize("block", [1, 7, 512])
def test_look_up_through_many_blocks_and_files(spark, monkeypatch, block):
    """A URL with very many captures, others with few, and some that are not there."""
    monkeypatch.setattr(warc, "BLOCK_LINES", block)
    rows = [(i, "http://hot.com/" if i % 3 == 0 else f"http://h{i % 50}.com/p{i}", f"page {i}") for i in range(400)]
    pages = frame(spark, rows)
    base = warc.shared_uri(spark, "warc-test")
    captures = warc.write_archives(pages, base)
    index = warc.write_index(captures, base)
    wanted = ["http://hot.com/", "http://h1.com/p1", "http://h1.com/missing", "http://zzz.zz/", "http://a.a/"]
    keys = spark.createDataFrame([(u,) for u in wanted], "url string").select(warc.capture_key(F.col("url")).alias("key"))
    got = warc.read_records(warc.look_up(keys, index, base), base, with_payload=True).collect()
    assert sorted((r.page_id, r.payload.decode()) for r in got) == sorted((i, h) for i, u, h in rows if u in wanted)


def test_records_are_readable_members(spark):
    base = warc.shared_uri(spark, "warc-test")
    line = warc.write_archives(frame(spark, [(1, "http://a.b/c", "<p>x</p>")]), base).first()
    with open(f"{base.removeprefix('file://')}/{line.file}", "rb") as file:
        raw = gzip.decompress(file.read())
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and raw.endswith(b"<p>x</p>\r\n\r\n")


def test_keys(spark):
    urls = {
        "http://www.Example.com/a?x=1#top": "com,example,www)/a?x=1",
        "https://user:pw@example.org:443": "org,example)/",
        "b.org/x": "org,b)/x",
        "http://b.org:8080/": "org:8080,b)/",
    }
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select("url", warc.capture_key(F.col("url")).alias("k")).collect()
    assert {r.url: r.k for r in rows} == urls
