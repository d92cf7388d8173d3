import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from kmerlake.llm import merkle as M
from kmerlake.llm import queries
from tests.llm.fixtures import SCHEMA, corpus, empty, frame


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row):
    doc_id, text, lang, source, n_chars = row
    return H(*map(field, (doc_id, source, lang, n_chars, text)))


def lower(row):
    t = row[1]
    return (row[0], t if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t), *row[2:])


def climb(nodes):
    """(root, for each node the runs beside its path as (before, after))."""
    paths, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, at in zip(paths, places, strict=True):
            run = nodes[at - at % 16 : at - at % 16 + 16]
            p.append(("".join(run[: at % 16]), "".join(run[at % 16 + 1 :])))
        nodes = [H(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
        places = [at // 16 for at in places]
    return nodes[0], paths


def brute(rows):
    first = lambda x: (x is not None, "" if x is None else x)
    sources = sorted({r[3] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {s: sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources}
    sub = {s: climb([leaf(r) for r in trees[s]]) for s in sources}
    root, tops = climb([sub[s][0] for s in sources])
    out = []
    for s, top in zip(sources, tops, strict=True):
        for r, path in zip(trees[s], sub[s][1], strict=True):
            x = leaf(lower(r)) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else leaf(r)
            for before, after in path + top:
                x = H(before, x, after)
            out.append((r[0], leaf(r), sub[s][0], root, H(*(a + b for a, b in path + top)), x, x == root))
    assert first(None) < first("")
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def query(spark, rows, path):
    frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    return queries.op13_merkle(spark, str(path))


def test_odd_rows_equal_brute_force(spark, tmp_path):
    rows = corpus() + [(7000, "Xé" * 300_000, "en", "", 1), (7001, "", None, "=", None), (7001, None, None, "=", None)]
    assert got(query(spark, rows, tmp_path)) == brute(rows)


@pytest.mark.parametrize("sizes", [[1], [3 * M.BUCKET + 300, M.BUCKET, M.BUCKET + 1, 2, 16, 17, 257], [1] * 300])
def test_sizes_of_trees(spark, tmp_path, sizes):
    rng = random.Random(len(sizes))
    rows = [(i * 1000 + j, f"Text {rng.random()}", "en", None if i == 1 else f"s{i}", j) for i, n in enumerate(sizes) for j in range(n)]
    rng.shuffle(rows)
    assert got(query(spark, rows, tmp_path)) == brute(rows)


def test_no_rows(spark, tmp_path):
    assert got(query(spark, [], tmp_path)) == []


def test_whole_table_verifies_unless_touched_and_extra_columns_do_not_count(spark):
    docs = frame(spark).filter("doc_id IS NOT NULL")
    clashing = docs.selectExpr("*", "1 AS key", "2 AS pos", "'x' AS leaf", "3 AS bucket", "4 AS levels", "5 AS size", "6 AS id")
    plain, more = M.proofs(M.build(docs)), M.proofs(M.build(clashing, claimed={"n_chars": F.expr("if(doc_id = 3, n_chars + 1, n_chars)")}))
    assert plain.filter("NOT verified").count() == 0
    assert {r["id"] for r in more.filter("NOT verified").collect()} == {3}
    assert plain.select("root").distinct().collect() == more.select("root").distinct().collect()


def test_a_bucket_of_many_sources_in_a_task(spark):
    rows = [(i, "t", "en", f"s{i % 7}", 1) for i in range(2 * M.CHUNK)]
    found = M.proofs(M.build(spark.createDataFrame(rows, SCHEMA).coalesce(1)))
    assert found.filter("verified").count() == len(rows)


def test_empty(spark):
    assert M.proofs(M.build(empty(spark))).count() == 0
