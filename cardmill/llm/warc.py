"""Content-addressed web archive: payload bytes once per digest, exact record headers apart, records rebuilt by joins.

Everything is DataFrame code. An archive is two Parquet tables in the shared folder: ``payloads`` (sha256, sha1, payload)
with one row per distinct payload, and ``headers`` (sha256, sha1, header) with one row per record, ``header`` being the
record's bytes up to and including the empty line. A record is its header, the payload unless it is a revisit, and two line
ends. Payloads are addressed by SHA-256 and SHA-1 together and digested again when they are read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardmill.llm.scratch import store
from cardmill.session import checkpoint_root

#: Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Pages carry no date; the header asks for one.
DATE = "1970-01-01T00:00:00Z"
RECORD_ID = "urn:page:"
UNKNOWN = "unknown"


@dataclass
class Archive:
    path: str

    @property
    def payloads(self) -> str:
        return f"{self.path}/payloads"

    @property
    def headers(self) -> str:
        return f"{self.path}/headers"


def base32_sha1(hex_digest: Column) -> Column:
    """The 40 hex digits of a SHA-1 as 32 upper-case base32 letters."""
    letters = []
    for k in range(0, 40, 5):  # twenty bits are five hex digits or four letters
        bits = F.conv(F.substring(hex_digest, k + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            place = F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1
            letters.append(F.substring(F.lit(BASE32), place, F.lit(1)))
    return F.concat(*letters)


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit(f"<{RECORD_ID}"), F.coalesce(page_id.cast("string"), F.lit(UNKNOWN)), F.lit(">"))


#: Stands for a missing page id, so that equal keys are plain keys.
NO_ID = -(2**63)


def digested(pages: DataFrame) -> DataFrame:
    """page_id, key (the id, or NO_ID), url, payload and its digests of each page row. Null html is an empty payload."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    page_id = F.col("page_id").cast("long")
    rows = pages.select(
        page_id.alias("page_id"),
        F.coalesce(page_id, F.lit(NO_ID)).alias("key"),
        F.col("url").cast("string").alias("url"),
        payload.alias("payload"),
    )
    return rows.select("*", F.sha2("payload", 256).alias("sha256"), F.sha1("payload").alias("sha1"))


def last_of(rows: DataFrame) -> DataFrame:
    """The largest key of each payload, stored: joins with it meet two exchanges, so a hot payload's rows can be split."""
    return store(rows.groupBy("sha256", "sha1").agg(F.max("key").alias("last")), "payload-ids").df


def records(rows: DataFrame, last: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, sha256, sha1, payload_bytes, record_type, refers_to of each row; payloads stay behind.

    Of rows with equal payloads of at least ``least_bytes`` that with the largest page_id is the response and the others
    revisit it; smaller payloads are all responses. Rows without an id rank lowest; rows that share the largest id are
    all responses.
    """
    sized = rows.select("page_id", "key", "url", "sha256", "sha1", F.octet_length("payload").cast("long").alias("payload_bytes"))
    again = (F.col("payload_bytes") >= least_bytes) & (F.col("key") != F.col("last"))
    return sized.join(last, ["sha256", "sha1"]).select(
        "page_id",
        "url",
        "sha256",
        "sha1",
        "payload_bytes",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("last")).alias("refers_to"),
    )


def header_of(row: DataFrame) -> Column:
    """The exact header bytes of a record of ``records``."""
    revisit = F.col("record_type") == "revisit"
    lines = [
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("refers_to")))),
        F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.lit(f"WARC-Date: {DATE}"),
        # A line end inside an address would end the header line.
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.col("url"), r"[\r\n]", "%0A")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32_sha1(F.col("sha1"))),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, 0).otherwise(F.col("payload_bytes")).cast("string")),
    ]
    return F.encode(F.concat(F.array_join(F.array_compact(F.array(*lines)), END), F.lit(END + END)), "UTF-8")


def write_archive(pages: DataFrame, archive: Archive, least_bytes: int = 0) -> None:
    """Both tables of an archive. ``pages`` needs page_id, url and html; other columns are ignored whatever their names.

    Payload bytes cross the network once, dealt by digest and id, so equal payloads of many pages do not meet; only the
    row whose id is the largest for its payload is stored.
    """
    rows = digested(pages)
    last = last_of(rows)
    made = records(rows, last, least_bytes)
    made.select("sha256", "sha1", header_of(made).alias("header")).write.parquet(archive.headers)
    place = ["sha256", "sha1", "key"]
    stored = rows.select(*place, "payload").join(last.withColumnRenamed("last", "key"), place).dropDuplicates(place)
    stored.select("sha256", "sha1", "payload").write.option("compression", "zstd").parquet(archive.payloads)


def read_records(spark: SparkSession, archive: Archive) -> DataFrame:
    """The original records: header (binary), payload (binary), verified (the payload still has both digests).

    A revisit gets the payload it refers to; ``record_bytes`` leaves it out.
    """
    headers = spark.read.parquet(archive.headers)
    payloads = spark.read.parquet(archive.payloads)
    verified = (F.sha2("payload", 256) == F.col("sha256")) & (F.sha1("payload") == F.col("sha1"))
    checked = payloads.select("sha256", "sha1", "payload", verified.alias("verified"))
    return headers.join(checked, ["sha256", "sha1"]).select("header", "payload", "verified", "sha1")


def record_bytes() -> Column:
    """The bytes of a record of ``read_records`` as they stand in a WARC file."""
    length = field("Content-Length").cast("long")
    body = F.when(length > 0, F.col("payload")).otherwise(F.encode(F.lit(""), "UTF-8"))
    return F.concat(F.col("header"), body, F.encode(F.lit(END + END), "UTF-8"))


def field(name: str) -> Column:
    """A field of the header as text; null where the header has no such line."""
    found = F.regexp_extract(F.decode(F.col("header"), "UTF-8"), rf"(?md)^{name}: ([^\r\n]*)\r$", 1)
    return F.when(found != "", found)


def _page_id(name: str) -> Column:
    number = F.regexp_extract(field(name), rf"^<{RECORD_ID}(-?[0-9]+)>$", 1)
    return F.when(number != "", number.cast("long"))


def archived_pages(pages: DataFrame) -> DataFrame:
    """Writes an archive of the pages in the shared folder and gives one row per record as read back from it:
    page_id, payload_bytes, payload_digest, record_type, refers_to, verified."""
    spark = pages.sparkSession
    archive = Archive(f"{checkpoint_root(spark).rstrip('/')}/warc-{uuid.uuid4().hex}")
    write_archive(pages, archive)
    return read_records(spark, archive).select(
        _page_id("WARC-Record-ID").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.sha1("payload")).alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        _page_id("WARC-Refers-To").alias("refers_to"),
        "verified",
    )
