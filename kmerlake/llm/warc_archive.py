"""Content-addressed WARC archive.

`write_archive` stores every distinct payload once under its SHA-256 and keeps each record's exact
header block in a second table. `reconstruct` joins the two into the original records. A payload's
address is verified twice: at writing, all payloads under one SHA-256 must agree in SHA-1 and length;
at reading, both digests are computed again from the stored bytes.

Defined cases: null payloads are empty ones; of equal payloads of at least `min_bytes` the smallest
id is the response and the others revisit it, smaller ones are all responses; repeated rows of the
smallest id are all responses; a null id is never smaller than another; a null url gives an empty
URI, and line ends in a url are percent-encoded; other columns are ignored; payloads of any length are kept
whole, one at a time in memory; an empty table gives an empty archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EOL = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Five hex digits are 20 bits, hence four base-32 digits; conv writes those as 0-9A-V."""
    hexa = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexa, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(key: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.concat(F.lit("<urn:uuid:"), *(x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ((F.lit("-"),) if a > 1 else ()) + (F.substring(h, a, n),)), F.lit(">"))


def _header(date: str) -> Column:
    """The record's header block up to and with the empty line."""
    url = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(EOL))
    revisit = F.col("record_type") == "revisit"
    return F.concat(
        F.lit(VERSION + EOL),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _record_id(F.col("page_id"))),
        line("WARC-Target-URI", url),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        F.when(revisit, F.concat(line("WARC-Refers-To", _record_id(F.col("refers_to"))), line("WARC-Profile", F.lit(REVISIT_PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit(EOL),
    )


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z") -> None:
    """pages: page_id, url, html. Writes {path}/payloads and {path}/records."""
    keyed = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    keyed = keyed.withColumn("address", F.sha2("payload", 256))
    store = keyed.groupBy("address").agg(
        F.first("payload").alias("payload"),
        F.min("page_id").alias("first_page"),
        F.min(base32_sha1(F.col("payload"))).alias("payload_digest"),
        F.max(base32_sha1(F.col("payload"))).alias("_other"),
        F.min(F.length("payload")).cast("long").alias("payload_bytes"),
        F.max(F.length("payload")).alias("_longest"),
    )
    agree = (F.col("payload_digest") == F.col("_other")) & (F.col("payload_bytes") == F.col("_longest"))
    store = store.filter(F.when(agree, True).otherwise(F.raise_error(F.concat(F.lit("different payloads share the digest "), "address")).isNull()))
    store.drop("_other", "_longest").write.parquet(f"{path}/payloads")
    index = pages.sparkSession.read.parquet(f"{path}/payloads").drop("payload")
    # many records may share an address: the sort-merge join's skewed partitions are split at run time
    records = keyed.select("page_id", "url", "address").join(index.hint("merge"), "address")
    first = ~F.col("page_id").eqNullSafe(F.col("first_page")) & (F.col("payload_bytes") >= min_bytes)
    records = records.withColumn("record_type", F.when(first, "revisit").otherwise("response"))
    records = records.withColumn("refers_to", F.when(first, F.col("first_page")))
    records.select("page_id", "address", _header(date).alias("header"), "refers_to").write.parquet(f"{path}/records")


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """page_id, header, payload of every original record; revisits get the bytes they refer to."""
    records, store = spark.read.parquet(f"{path}/records"), spark.read.parquet(f"{path}/payloads")
    return records.join(store.select("address", "payload").hint("merge"), "address")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Per record what its header says, with the payload's digests verified from the bytes."""
    r = reconstruct(spark, path)
    field = lambda name: F.regexp_extract("header", f"\r\n{name}: ([^\r\n]*)\r\n", 1)
    digest = base32_sha1(F.col("payload"))
    sound = (F.sha2("payload", 256) == F.col("address")) & (F.concat(F.lit("sha1:"), digest) == field("WARC-Payload-Digest"))
    length = F.length("payload").cast("long")
    kind = field("WARC-Type")
    sound &= F.when(kind == "revisit", 0).otherwise(length) == field("Content-Length").cast("long")
    return r.select(
        "page_id",
        length.alias("payload_bytes"),
        F.when(sound, digest).otherwise(F.raise_error(F.concat(F.lit("damaged record of page "), F.col("page_id").cast("string"))).cast("string")).alias("payload_digest"),
        kind.alias("record_type"),
        "refers_to",
        "header",
        "payload",
    )


def export_warc(spark: SparkSession, archive: str, path: str, records_per_file: int = 10_000) -> None:
    """Plain WARC files: a record ends with two line ends, which is what the text writer puts after each."""
    r = reconstruct(spark, archive)
    body = F.when(F.col("header").contains("WARC-Type: revisit"), F.lit("")).otherwise(F.col("payload").cast("string"))
    r.select(F.concat("header", body)).write.option("lineSep", EOL * 2).option("maxRecordsPerFile", records_per_file).text(path)
