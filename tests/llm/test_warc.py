import base64
import gzip
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from dunning.llm.warc import GZIP_MAGIC, check_count, list_warc, op8_warc, read_warc, record, write_warc

SCHEMA = "page_id long, url string, html string, payload string, size int"


def digest(s):
    return base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()


def rows(n=60):
    bodies = ["<p>é</p>" * (i % 7) + ("" if i % 3 else str(i)) for i in range(n)]
    out = [(i, f"http://a/{i}", b, "x", 1) for i, b in enumerate(bodies)]
    return out + [(100, None, None, None, None), (101, "http://b c", "", "x", 2), (None, "u", "no id", "x", 3), (102, "u", "z" * 3_000_000, "x", 4)]


def wanted(some, least=0):
    last = {}
    for i, _, html, *_ in some:
        if i is not None:
            last[html or ""] = max(i, last.get(html or "", i))
    out = []
    for i, _, html, *_ in some:
        n, to = len((html or "").encode()), last.get(html or "")
        first = n < least or to is None or to == i
        out.append((str(i), n, digest(html), "response" if first else "revisit", None if first else to))
    return sorted(out, key=str)


@pytest.mark.parametrize("least, spread", [(0, 700), (20, 4 << 20)])
def test_round_trip_in_small_ranges(spark, least, spread):
    pages = spark.createDataFrame(rows(), SCHEMA)
    files = write_warc(pages, least_bytes=least, archive_bytes=4000)
    got = read_warc(spark, files, spread).collect()
    shown = lambda s: None if s is None else s.removeprefix("urn:page:") or "None"
    assert sorted(((shown(r.record_id), r.payload_bytes, r.payload_digest, r.type, r.refers_to and int(shown(r.refers_to))) for r in got), key=str) == wanted(rows(), least)
    assert all(hashlib.sha1(r.payload).digest() == base64.b32decode(r.payload_digest) for r in got if r.type == "response")


def test_query_on_its_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    got = [(str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in op8_warc(spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got, key=str) == wanted(pages)


def test_places_that_only_look_like_records(spark, tmp_path):
    fake = GZIP_MAGIC + b"\x00" * 30 + GZIP_MAGIC * 9 + gzip.compress(b"not a record")
    data, starts = b"", []
    for i in range(40):
        starts.append(len(data))
        data += record(i, fake * (i % 5) + os.urandom(50), "u", None) + (fake if i % 4 == 0 else b"")
    (tmp_path / "a.warc.gz").write_bytes(data)
    got = read_warc(spark, list_warc(spark, str(tmp_path)).withColumn("file", F.regexp_replace("file", "^file:", "file://")), 333).collect()
    assert sorted(r.place for r in got) == starts


def test_empty_table_and_missing_url(spark):
    assert read_warc(spark, write_warc(spark.createDataFrame([], SCHEMA))).count() == 0
    pages = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "page_id long, html string")
    got = read_warc(spark, write_warc(pages)).collect()
    assert sorted((r.record_id, r.type) for r in got) == [("urn:page:1", "response"), ("urn:page:1", "response"), ("urn:page:2", "response")]


def test_long_headers_are_read_back(spark):
    """A hardly compressible url of 200,000 characters, and none is lost."""
    rng = random.Random(1)
    long = "data:," + "".join(chr(rng.randrange(33, 127)) for _ in range(200_000))
    pages = spark.createDataFrame([(1, "http://a", "x"), (2, long, "y"), (3, "http://c", "z")], "page_id long, url string, html string")
    files = write_warc(pages)
    for spread in (1000, 4 << 20):
        got = read_warc(spark, files, range_bytes=spread).collect()
        assert sorted((r.record_id, len(r.uri)) for r in got) == [("urn:page:1", 8), ("urn:page:2", len(long)), ("urn:page:3", 8)]
        check_count(files, spark.createDataFrame([(r.place,) for r in got], "place long"))
    with pytest.raises(RuntimeError):
        check_count(files, spark.createDataFrame([(0,), (1,)], "place long"))


def test_readers_are_dealt_to_tasks(spark):
    """The rows that name files are few and small; each range is work."""
    pages = spark.createDataFrame([(i, "u", str(i) * 500) for i in range(300)], "page_id long, url string, html string").repartition(4)
    files = write_warc(pages, archive_bytes=2000)
    ranges = files.selectExpr("sum(ceil(size / 1000))").first()[0]
    parts = read_warc(spark, files, range_bytes=1000).select(F.spark_partition_id().alias("p")).distinct().count()
    assert ranges > 20 and parts > ranges / 4
