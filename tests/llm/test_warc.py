import base64
import hashlib
import re

import pytest

from kmerlake.llm import warc_archive as W

PAGES = [(5, "http://a/", "<p>same</p>"), (3, "http://b/", "<p>same</p>"), (9, "http://c/\r\nX: y", "<p>same</p>"), (1, None, None), (2, "http://d/", ""), (7, "http://e/", "é漢" * 500), (8, "http://f/", "tiny"), (11, "http://g/", "tiny"), (3, "http://b/", "<p>same</p>"), (None, "http://n/", "tiny")]


def archive(spark, path, min_bytes=0):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'x' AS payload", "'y' AS address")
    W.write_archive(pages, path, min_bytes)
    return W.read_archive(spark, path).collect()


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_round_trip(spark, tmp_path, min_bytes):
    got = archive(spark, f"file://{tmp_path}/a", min_bytes)
    first = {}
    for p, _, html in PAGES:
        if p is not None:
            first[html or ""] = min(first.get(html or "", p), p)
    want = []
    for p, _, html in PAGES:
        data = (html or "").encode()
        revisit = len(data) >= min_bytes and p != first[html or ""]
        want.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first[html or ""] if revisit else None, data))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], bytes(r["payload"])) for r in got), key=str) == sorted(want, key=str)
    assert spark.read.parquet(f"file://{tmp_path}/a/payloads").count() == len({h or "" for _, _, h in PAGES})
    assert all(r["header"].endswith("\r\n\r\n") and r["header"].count("\r\n\r\n") == 1 for r in got)


def test_damage_is_found(spark, tmp_path):
    archive(spark, f"file://{tmp_path}/a")
    store = spark.read.parquet(f"file://{tmp_path}/a/payloads")
    store.selectExpr("address", "CAST('other' AS binary) AS payload", "first_page", "payload_digest", "payload_bytes").write.parquet(f"file://{tmp_path}/b/payloads")
    spark.read.parquet(f"file://{tmp_path}/a/records").write.parquet(f"file://{tmp_path}/b/records")
    with pytest.raises(Exception, match="damaged"):
        W.read_archive(spark, f"file://{tmp_path}/b").collect()


def test_export(spark, tmp_path):
    archive(spark, f"file://{tmp_path}/a")
    W.export_warc(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/w")
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*")))
    n = 0
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert head.startswith(b"WARC/1.1") and rest[size : size + 4] == b"\r\n\r\n"
        data, n = rest[size + 4 :], n + 1
    assert n == len(PAGES)


def test_empty(spark, tmp_path):
    W.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/a")
    assert W.read_archive(spark, f"file://{tmp_path}/a").count() == 0
