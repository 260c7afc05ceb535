"""Archives written and read back: exact round trips, revisits, coalesced ranges, odd rows."""

import zlib

from orderloom.llm import warc
from orderloom.llm.queries import QUERIES, SQL
from orderloom.sources.stage import StageTables
from tests.conftest import SMALL
from tests.oracle_check import compare, connect

LONG = "<p>" + "é" * 100 + "</p>"


def test_round_trip_of_all_pages(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    stage = StageTables(spark)
    index = warc.write(pages, stage)
    want = {r.page_id: r.html or "" for r in pages.collect()}
    got = {r.page_id: bytes(r.payload).decode() for r in warc.read(index, stage).collect()}
    assert got == want
    few = {r.page_id: r for r in warc.read(index.filter("page_id % 7 = 3"), stage).collect()}
    assert set(few) == {k for k in want if k % 7 == 3}
    fs, base = warc.open_store(f"{stage.folder}/warc-archives")
    row = index.filter("page_id = 5").first()
    with fs.open_input_file(f"{base}/{row.archive}") as f:  # every record is a gzip member of its own
        assert zlib.decompress(f.read_at(row.length, row.offset), 31).startswith(b"WARC/1.1\r\nWARC-Type: response")


def test_odd_rows(spark):
    rows = [(9, "http://a/\r\nb", LONG), (4, None, LONG), (4, "u", LONG), (7, "u", LONG), (1, "u", None), (2, "u", ""),
            (3, "u", "x"), (5, "u", "x"), (None, "u", LONG), (None, "u", "y")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    stage = StageTables(spark)
    index = warc.write(df, stage)
    assert index.count() == len(rows)
    columns = ["page_id", "payload_bytes", "record_type", "refers_to"]
    got = sorted(tuple(r) for r in warc.resolve(stage.keep("r", warc.read(index, stage))).filter("page_id > 0").select(*columns).collect())
    n = len(LONG.encode())
    short = [(1, 0, "response", None), (2, 0, "response", None), (3, 1, "response", None)]
    long = [(4, n, "response", None)] * 2 + [(5, 1, "response", None), (7, n, "revisit", 4), (9, n, "revisit", 4)]
    assert got == short + long
    assert warc.write(df.limit(0), stage, "none").count() == 0


def test_ranges():
    places = [(0, 10), (10, 5), (100, 5), (100 + warc.RANGE_GAP + 6, 4), (warc.RANGE_BYTES * 2, 3)]
    assert [(a, b, h) for a, b, h in warc.ranges(places)] == [
        (0, 105, [0, 1, 2]), (106 + warc.RANGE_GAP, 110 + warc.RANGE_GAP, [3]), (warc.RANGE_BYTES * 2, warc.RANGE_BYTES * 2 + 3, [4])]
    assert list(warc.ranges([])) == []


def test_query_equals_statement(spark):
    difference, n = compare(QUERIES["op3_warc"](spark, SMALL), connect(SMALL), SQL["op3_warc"])
    assert difference is None and n > 0, difference


def test_addresses_that_spark_uses():
    assert warc.address("s3a://bucket/a/b") == "s3://bucket/a/b" and warc.address("s3://bucket/a") == "s3://bucket/a"
    assert warc.address("file:/tmp/x") == "file:///tmp/x" and warc.address("hdfs://host/s3a:x") == "hdfs://host/s3a:x"
    assert warc.open_store("/tmp/x")[1] == "/tmp/x"
