import hashlib
import random

import pytest

from kmerlake.llm import queries
from kmerlake.llm import reply_trees as R

SCHEMA = "tree long, node long, parent long, role string, text string, score double"
NASTY = ["", None, "\\", "\\0", "\\\\1", "</turn>", "</tur</turn>n>", "### ", "#### assistant: x", "\n", "</turn>\n### assistant: no", "\\### Assistant: </turn> ok", "é𝄞</turn", "a: b", "x" * 200_000]


def brute(rows, top):
    """(tree, rank) -> [(role, text)] by walking."""
    out = {}
    for tree in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == tree]
        nodes = {}
        for _, node, parent, _, _, score in own:
            p, s = nodes.get(node, (None, float("-inf")))
            nodes[node] = (parent if p is None else p if parent is None else min(p, parent), max(s, score or 0.0))
        up = {n: p if p is not None and p != n and p in nodes else None for n, (p, _) in nodes.items()}
        branches = []
        for leaf in set(nodes) - {p for p in up.values() if p is not None}:
            path = [leaf]
            while up[path[-1]] is not None and len(path) <= len(nodes):
                path.append(up[path[-1]])
            if up[path[-1]] is None:
                branches.append((-sum(nodes[n][1] for n in path), -len(path), leaf is not None, leaf or 0, path[::-1]))
        for rank, (*_, path) in enumerate(sorted(branches)[:top], 1):
            said = [sorted((r[3] or "", r[4] or "") for r in own if r[1] == n) for n in path]
            out[tree, rank] = [t for turns in said for t in turns]
    return out


def read(spark, df, path, top, links=None):
    R.write_conversations(df, str(path), top, links)
    return R.read_conversations(spark, str(path)).collect()


def random_rows(seed, trees=12):
    rng = random.Random(seed)
    rows = []
    for t in range(trees):
        n = rng.choice([1, 2, 5, 30, 70])
        for i in range(n):
            parent = None if i == 0 else rng.choice([i - 1, i - 1, rng.randrange(i), 10_000 + i])
            rows.append((t if t else None, i, parent, rng.choice(["user", "assistant", "a: b", "", None]), rng.choice(NASTY), rng.choice([None, 0.5, 1.0, -1.0])))
    rows += [(50, 1, 2, "user", "in a circle", 1.0), (50, 2, 1, "user", "in a circle", 1.0), (50, 3, 1, "user", "hangs on it", 1.0)]
    rows += [(51, 1, 1, "user", "own parent", None), (51, None, 1, "assistant", "no id", None), (51, 1, 1, "user", "own parent", None)]
    return rows


@pytest.mark.parametrize(("seed", "top"), [(1, 1), (2, 3)])
def test_best_paths_equal_walking_and_read_back(spark, tmp_path, seed, top):
    rows = random_rows(seed)
    found = read(spark, spark.createDataFrame(rows, SCHEMA), tmp_path / "out", top)
    expected = brute(rows, top)
    assert {(r["tree"], r["rank"]): [tuple(t) for t in r["turns"]] for r in found} == expected
    for r in found:
        said = expected[r["tree"], r["rank"]]
        assert r["learned"] == [text for role, text in said if role == "assistant"]
        assert r["text"].count("</turn>") == r["text"].count("### ") == len(said)


def test_hot_and_other_trees_are_alike(spark, tmp_path, monkeypatch):
    rows = random_rows(3)
    monkeypatch.setattr(R, "HOT_SHARE", 8)
    found = read(spark, spark.createDataFrame(rows, SCHEMA), tmp_path / "out", 2)
    assert {(r["tree"], r["rank"]): [tuple(t) for t in r["turns"]] for r in found} == brute(rows, 2)


def test_a_long_thread_takes_few_joins(spark, tmp_path):
    n = 700
    rows = [(1, i, i - 1 if i else None, "user" if i % 2 == 0 else "assistant", f"t{i}", None) for i in range(n)]
    df = spark.createDataFrame(rows, SCHEMA).drop("score")
    nodes = R._nodes(df)
    assert len(R._jumps(nodes)) == 10
    (only,) = read(spark, df, tmp_path / "out", 1)
    assert [t["text"] for t in only["turns"]] == [f"t{i}" for i in range(n)]


def test_branches_are_all_paths(spark):
    rows = [(1, 0, None, "u", "", 1.0), (1, 1, 0, "a", "", 2.0), (1, 2, 0, "a", "", 5.0), (1, 3, 1, "u", "", 4.0)]
    found = [tuple(r) for r in R.branches(spark.createDataFrame(rows, SCHEMA)).orderBy("rank").collect()]
    assert found == [(1, 3, 0, 3, 7.0, 1), (1, 2, 0, 2, 6.0, 2)]


def test_query_over_odd_conversations(spark, tmp_path):
    said = [(1, t, r, x) for t, (r, x) in enumerate(zip(["system", "user", "assistant"] * 5, NASTY, strict=True))]
    said += [(2, None, "user", "first"), (2, 0, "assistant", "b"), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (None, 3, None, None), (3, 5, "user", "x")]
    spark.createDataFrame([(*r, 1, 2, 3) for r in said], "conv_id long, turn long, role string, text string, tree int, node int, parent int").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r["conv_id"]: r for r in queries.op11_chat_format(spark, str(tmp_path)).collect()}
    by_conv = {-7: [("user", NASTY[11]), ("assistant", NASTY[11])], 2: [("user", "first"), ("assistant", "a"), ("assistant", "a"), ("assistant", "b")], None: [("", "")], 3: [("user", "x")], 1: [(r, x or "") for _, _, r, x in said if _ is not None][:15]}
    assert set(found) == set(by_conv)
    for conv, turns in by_conv.items():
        r, learned = found[conv], "".join(x for role, x in turns if role == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), sha(learned))


def test_empty(spark, tmp_path):
    assert read(spark, spark.createDataFrame([], SCHEMA), tmp_path / "out", 1) == []
