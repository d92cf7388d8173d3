"""Texts longer than any block, beside columns whose names the operators use themselves: whole results, no crash."""

import random
import zlib

import numpy as np
import pytest

from kmerlake.llm import license_scan, near_duplicates, packing, quality_rules, token_store, tokens, warc_archive
from tests.llm.fixtures import SCHEMA

CLASH = "1 AS n_words, 2 AS piece, 'x' AS component_id, 3 AS start, 4 AS length, 'y' AS kept, 5 AS labels, 6 AS n_tokens, 7 AS hash, 8 AS key, 9 AS _0, 10 AS words, 11 AS offset, 12 AS level"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = [f"w{rng.randrange(40_000)}" for _ in range(400_000)]
    long = " ".join(words)
    words[::1000] = ["edited"] * len(words[::1000])
    assert len(long) > 2_200_000  # over every block of the operators
    return [(1, long, "en", "s", 0), (2, " ".join(words), "en", "s", 0), (3, "short text with the MIT License in it", "en", "s", 0), (4, None, "en", "s", 0), (5, "x" * 2_500_000, "en", "s", 0)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", *CLASH.split(", ")).repartition(3)


@pytest.fixture(scope="module")
def encoded(rows):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.default_vocabulary())
    return {r[0]: np.array([*whole.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4") for r in rows}


def test_tokens_and_pieces_are_those_of_the_whole_text(spark, docs, encoded, tmp_path):
    token_store.write_shards(docs, f"file://{tmp_path}/t", tokens.default_vocabulary())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in token_store.read_documents(spark, f"file://{tmp_path}/t").collect()}
    assert got == {i: (len(x), zlib.crc32(x.tobytes())) for i, x in encoded.items()}
    seen: dict[int, int] = {}
    for r in sorted(packing.pack_documents(docs).collect(), key=lambda r: (r["doc_id"], r["piece"])):
        own = encoded[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == seen.get(r["doc_id"], 0) and r["length"] <= 1024 and r["ids_crc32"] == zlib.crc32(own.tobytes())
        seen[r["doc_id"]] = r["start"] + r["length"]
    assert seen == {i: len(x) for i, x in encoded.items()}


def test_near_copies_of_long_texts_link(docs, rows):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates.near_duplicates(docs).collect()}
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in ((r[0], r[1].split()) for r in rows[:2])}
    assert len(sets[1] & sets[2]) / len(sets[1] | sets[2]) > 0.75
    assert got[1] == (len(sets[1]), 1) and got[2] == (len(sets[2]), 1) and got[5] == (1, 5) and got[4] == (0, 4)


def test_rules_and_licenses_see_the_whole_text(docs, rows):
    measured = {r["doc_id"]: (r["n_words"], r["word_chars"]) for r in quality_rules.ledger(docs.select(*SCHEMA.replace(" long", "").replace(" string", "").split(", "))).collect()}
    assert measured == {r[0]: (len((r[1] or "").split()), sum(map(len, (r[1] or "").split()))) for r in rows}
    found = {r["doc_id"]: r["n_words"] for r in license_scan.scan(docs.drop("n_words", "labels")).collect()}
    assert found[1] == 400_000 and found[3] == 8 and found[5] == 1


def test_long_payloads(spark, rows, tmp_path):
    pages = spark.createDataFrame([(r[0], "http://x", r[1], 7, "y") for r in rows] + [(9, "http://y", rows[0][1], 7, "y")], "page_id long, url string, html string, payload int, digest string")
    warc_archive.write_archive(pages, f"file://{tmp_path}/w")
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc_archive.read_archive(spark, f"file://{tmp_path}/w").collect()}
    assert got[1] == (len(rows[0][1]), "response", None) and got[9] == (len(rows[0][1]), "revisit", 1) and got[4] == (0, "response", None) and len(got) == 6
