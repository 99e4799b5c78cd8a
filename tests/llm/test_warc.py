"""The archive against hashlib, record bytes against a plain writer, and the tables of payloads."""

import base64
import hashlib

from pyspark.sql import functions as F

from cardmill.llm import warc

PAGES = [
    (1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (3, "http://a/3", "<p>é</p>"), (4, None, None), (5, "x\r\ny", ""),
    (None, "http://n", "<p>same</p>"), (6, "http://a/6", "z" * 200_000), (3, "http://a/3", "<p>é</p>"), (-7, "http://a/7", "\r\nWARC-Type: no\r\n"),
    *[(100 + i, f"http://h/{i}", "hot") for i in range(60)],
]


def frame(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")


def expected(rows):
    last = {}
    for i, _, html in rows:
        body = (html or "").encode()
        last[body] = max(last.get(body, -(2**63)), -(2**63) if i is None else i)
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        again = i != last[body]
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((i, len(body), digest, "revisit" if again else "response", last[body] if again else None, True))
    return out


def test_archive_round_trip(spark):
    key = lambda r: (r[0] is None, r[0] or 0)
    got = sorted((tuple(r) for r in warc.archived_pages(frame(spark)).collect()), key=key)
    assert got == sorted(expected(PAGES), key=key)
    assert warc.archived_pages(frame(spark).where(F.lit(False))).count() == 0


def test_payloads_are_stored_once_and_records_rebuilt(spark, tmp_path):
    archive = warc.Archive(str(tmp_path / "a"))
    warc.write_archive(frame(spark), archive)
    stored = [bytes(r["payload"]) for r in spark.read.parquet(archive.payloads).collect()]
    assert sorted(stored) == sorted({(h or "").encode() for _, _, h in PAGES})
    records = warc.read_records(spark, archive).select(warc.record_bytes().alias("b"), warc.field("WARC-Type").alias("t"))
    made = [bytes(r["b"]) for r in records.collect() if r["t"] == "response"]
    body = PAGES[2][2].encode()
    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
    want = (
        "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:3>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\n"
        f"WARC-Target-URI: http://a/3\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n"
    ).encode() + body + b"\r\n\r\n"
    assert made.count(want) == 2


def test_damage_is_seen(spark, tmp_path):
    archive = warc.Archive(str(tmp_path / "b"))
    warc.write_archive(frame(spark, PAGES[:3]), archive)
    broken = spark.read.parquet(archive.payloads).withColumn("payload", F.concat("payload", F.encode(F.lit("!"), "UTF-8")))
    other = warc.Archive(str(tmp_path / "c"))
    broken.write.parquet(other.payloads)
    spark.read.parquet(archive.headers).write.parquet(other.headers)
    assert {r["verified"] for r in warc.read_records(spark, other).collect()} == {False}


def test_small_payloads_are_all_responses(spark):
    rows = warc.digested(frame(spark))
    made = warc.records(rows, warc.last_of(rows), least_bytes=4).where("payload_bytes < 4").collect()
    assert len(made) == 62 and {r["record_type"] for r in made} == {"response"}
