import base64
import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from readyscope.llm import registry, warc


def test_query_equals_plain_version(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    last = {}
    for page in pages:
        octets = (page["html"] or "").encode()
        last[octets] = max(last.get(octets, page["page_id"]), page["page_id"])
    wanted = set()
    for page in pages:
        octets = (page["html"] or "").encode()
        sha1 = base64.b32encode(hashlib.sha1(octets).digest()).decode()
        kind, of = ("response", None) if last[octets] == page["page_id"] else ("revisit", last[octets])
        wanted.add((page["page_id"], len(octets), sha1, kind, of))
    rows = registry.queries()["op3_warc"](spark, sf_dir).collect()
    assert {tuple(r) for r in rows} == wanted and len(rows) == len(pages)


def test_query_equals_sql(spark, sf_dir):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{sf_dir}/pages.parquet')")
    wanted = duck.execute(warc.ORACLE).fetchall()
    rows = registry.queries()["op3_warc"](spark, sf_dir).collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, wanted)) and rows


@pytest.fixture(scope="module")
def odd_pages(spark):
    rows = [
        (1, "u1", "<a>é"), (2, "u\r\n2", "<a>é"), (3, None, None), (4, "u4", ""), (None, "n", "x"),
        (None, "n2", "x"), (5, "u5", "only"), (5, "u5", "only"), (None, "n3", "only"),
        (7, "z", "q" * 300_000), (8, "dup", "one"), (8, "dup", "two"),
    ]
    rows = [(*r, "k", "s") for r in rows]
    return spark.createDataFrame(rows, "page_id long, url string, html string, keeper string, sha256 string")


def test_odd_pages(spark, odd_pages):
    archive = warc.write_archive(odd_pages)
    records = warc.record_bytes(warc.read_archive(spark, archive)).collect()
    found = sorted(
        (r["page_id"] or -1, r["record_type"], r["refers_to"], bytes(r["payload"]).decode()[:9])
        for r in records
    )
    assert found == sorted([
        (1, "revisit", 2, "<a>é"), (2, "response", None, "<a>é"), (3, "revisit", 4, ""),
        (4, "response", None, ""), (-1, "response", None, "x"), (-1, "response", None, "x"),
        (5, "response", None, "only"), (5, "response", None, "only"), (-1, "revisit", 5, "only"),
        (7, "response", None, "q" * 9), (8, "response", None, "one"), (8, "response", None, "two"),
    ])
    # every payload is stored once
    assert spark.read.parquet(archive.payloads).count() == 7
    for r in records:
        head, _, block = bytes(r["record"]).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and block.endswith(b"\r\n\r\n")
        assert int(fields["Content-Length"]) == len(block) - 4
        sha1 = base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode()
        assert fields["WARC-Payload-Digest"] == f"sha1:{sha1}"
        assert ("WARC-Refers-To" in fields) == (fields["WARC-Type"] == "revisit")
    assert "WARC-Target-URI: u%0D%0A2\r\n" in next(r["header"] for r in records if r["page_id"] == 2)


def test_small_payloads_are_responses(spark, odd_pages):
    records = warc.read_archive(spark, warc.write_archive(odd_pages, min_bytes=5)).collect()
    kinds = {(r["page_id"], r["record_type"]) for r in records}
    assert (1, "revisit") in kinds and (3, "response") in kinds  # 5 bytes, and none


def test_damage_is_noticed(spark, odd_pages):
    archive = warc.write_archive(odd_pages)
    payloads = spark.read.parquet(archive.payloads)
    damaged = archive.payloads + "-damaged"
    payloads.withColumn("payload", F.concat("payload", F.lit(b"!"))).write.parquet(damaged)
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_archive(spark, warc.Archive(damaged, archive.headers)).collect()
    lost = archive.payloads + "-lost"
    payloads.limit(0).write.parquet(lost)
    with pytest.raises(Exception, match="lost payload"):
        warc.read_archive(spark, warc.Archive(lost, archive.headers)).collect()


def test_empty_table(spark, odd_pages):
    assert warc.read_archive(spark, warc.write_archive(odd_pages.limit(0))).count() == 0


def test_payloads_are_not_shuffled_to_be_stored(spark, odd_pages):
    records = odd_pages.select("page_id", "sha256")
    small = spark.createDataFrame([(1, "a")], "page_id long, sha256 string")
    plan = warc._matching(records, small, "left_anti")._jdf.queryExecution().executedPlan()
    assert "CartesianProduct" not in plan.toString()
