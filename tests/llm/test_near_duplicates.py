import re

import numpy as np
import pytest

from kmerlake.llm import graph, near_duplicates
from kmerlake.llm.shingles import signatures
from tests.llm.fixtures import corpus, empty, frame

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    ids = sorted({r[0] for r in rows if r[0] is not None})
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(r[0], shingles(r[1])) for r in rows if r[0] is not None]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and a != b and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return sorted((r[0] if r[0] is not None else -1, len(shingles(r[1])), find(r[0]) if r[0] is not None else -1) for r in rows)


def test_equals_brute_force(spark):
    rows = corpus()
    got = near_duplicates.near_duplicates(frame(spark, rows)).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in got) == brute(rows)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)


def chain(n=60, edits=6):
    """Each text is a few words from the one before: similar neighbours, dissimilar ends."""
    words = [f"w{i}" for i in range(200)]
    out = []
    for i in range(n):
        out.append((i * 3, " ".join(words), "en", "chain", 0))
        for j in range(edits):
            words[(i * 37 + j) % 200] = f"v{i}x{j}"
    return out


def test_chains_and_hub(spark):
    rows = chain() + [(1000 + i, " ".join(f"common{j}" if j % 40 else f"own{i}x{j}" for j in range(300)), "en", "hub", 0) for i in range(60)]
    got = near_duplicates.near_duplicates(frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(rows)


def test_open_buckets_in_many_chunks(spark, monkeypatch):
    """Texts of several sizes with much in common, a large component among them, dealt into chunks of a few sketches each."""
    monkeypatch.setattr(near_duplicates, "CHUNK_BYTES", 1500)
    text = lambda i, common, own: " ".join([*(f"c{j}" for j in range(common)), *(f"o{i}x{j}" for j in range(own))])
    rows = [(i, text(i, 150 + i % 7 * 15, 40 + i % 5 * 9), "en", "boiler", 0) for i in range(90)]
    rows += [(200 + i, text(0, 150, 40) + f" tail{i} end{i}", "en", "large", 0) for i in range(40)]
    rows += [(300 + i, text(i, 150 + i % 7 * 15, 40 + i % 5 * 9) + f" more{i} last{i}", "en", "pairs", 0) for i in range(0, 90, 4)]
    got = near_duplicates.near_duplicates(frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(rows)
    assert len({r["component_id"] for r in got}) > 10


def test_chunks_meet_once_and_no_possible_link_is_left_out(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "CHUNK_BYTES", 1000)
    rng = np.random.default_rng(5)
    members = [(int(b), i * 3 + int(b), 7 if i % 3 else i, int(n)) for b in range(2) for i, n in enumerate(rng.integers(3, 400, 80))]
    members += [(2, 900 + i, i, 20) for i in range(5)] + [(3, 950 + i, 1, 20) for i in range(50)]
    dealt = near_duplicates._dealt(spark.createDataFrame(members, "band long, node long, root long, n long"), 75)
    at = {}
    for r in dealt.collect():
        at.setdefault((r["band"], r["big"], r["size"], r["chunk"]), []).append((r["node"], r["root"], r["n"]))
    met = {}
    for r in near_duplicates._meetings(dealt.select("band", "big", "size", "chunk", "chunks").distinct()).collect():
        x, y = (r["band"], r["big"], r["size"], r["chunk"]), (r["band"], r["big_"], r["size_"], r["chunk_"])
        for a in at[x]:
            for b in at.get(y, []):
                if x != y or a < b:
                    met[(r["band"], *sorted((a[0], b[0])))] = met.get((r["band"], *sorted((a[0], b[0]))), 0) + 1
    assert set(met.values()) == {1}
    for i, (band, a, ra, n) in enumerate(members):
        for band_, b, rb, m in members[:i]:
            if band == band_ and ra != rb and 4 * min(n, m) >= 3 * max(n, m):
                assert (band, *sorted((a, b))) in met


def test_empty(spark):
    assert near_duplicates.near_duplicates(empty(spark)).count() == 0


def test_drop_keeps_columns_and_one_of_each(spark):
    docs = frame(spark)
    kept = near_duplicates.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert {c for _, _, c in brute(corpus()) if c >= 0} == {i for i in ids if i is not None}


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 62, 4000).astype(np.uint64)
    errors = []
    for n in (3, 40, 400, 3000):
        for share in (0.25, 0.5, 0.75, 0.9):
            common = int(2 * n * share / (1 + share))
            a, b = pool[:n], pool[n - common : 2 * n - common] if 2 * n - common <= 4000 else None
            if b is None or len(b) < n:
                continue
            s = signatures(np.concatenate([a, b]), np.array([0, n, 2 * n]))
            true = common / (2 * n - common)
            errors.append(abs(float((s[0] == s[1]).mean()) - true))
    assert max(errors) < 0.16 and np.mean(errors) < 0.05


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_links(spark, seed):
    rng = np.random.default_rng(seed)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(500 + i, 501 + i) for i in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
