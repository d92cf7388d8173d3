import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kmerlake.llm import queries
from kmerlake.llm import spelling as S
from kmerlake.llm.range_reporting import WaveletTree
from tests.llm.fixtures import SCHEMA, corpus, empty, frame


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    out = {}
    forms = {}
    for w, n in counts.items():
        beside = [x for x in counts if near(w, x)]
        best = min(((-counts[x], x) for x in beside if counts[x] >= 10 * n), default=None)
        forms[w] = best and best[1]
        out[w] = [forms[w], w, n, len(beside), best and -best[0]]
    for w in out:
        while forms[out[w][1]] is not None:
            out[w][1] = forms[out[w][1]]
    return {w: tuple(v) for w, v in out.items()}


def count(rows):
    found = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            found[low[: h % len(low)] + low[h % len(low) + 1 :] if h % 31 == 0 else low] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def as_dict(df):
    rows = df.collect()
    found = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(found) == len(rows)
    return found


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    base = ["".join(rng.choice("abÀÿz") for _ in range(rng.randint(7, 10))) for _ in range(12)]
    texts = [" ".join(rng.choice(base[:3]) if rng.random() < 0.8 else rng.choice(base) for _ in range(20)) for _ in range(300)]
    rows = corpus(60) + [(5100 + i, t.title() if i % 7 else t, "en", "s", 0) for i, t in enumerate(texts)] + [(5001, "Wordless 12 " * 3, "en", "s", 0), (5002, "long" * 3000 + " " + "long" * 2999 + "lon x " + "long" * 3000 + " " + "long" * 2999 + "lon", "en", "s", 0)]
    spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA + ", word string, n int").write.parquet(f"{tmp_path}/documents.parquet")
    expected = brute(count(rows))
    assert any(v[0] for v in expected.values()) and any("À" in w for w in expected)
    assert as_dict(queries.op12_spelling_variants(spark, str(tmp_path))) == expected


@pytest.mark.parametrize("letters", [1 << 20, 50])
def test_runs_of_equal_letters_and_chains_of_forms(spark, monkeypatch, letters):
    monkeypatch.setattr(S, "CHUNK_LETTERS", letters)
    rng = random.Random(9)
    counts = {"".join(rng.choice("ab") for _ in range(rng.randint(7, 9))): 10 ** rng.randint(0, 4) for _ in range(150)} | {"a" * n: 10 ** (n - 7) for n in range(7, 12)}
    found = as_dict(S.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert found == brute(counts) and found["aaaaaaa"][1] != found["aaaaaaa"][0]


@settings(max_examples=60, deadline=None)
@given(st.permutations(range(40)), st.integers(0, 40), st.integers(0, 40), st.integers(0, 40), st.integers(0, 40))
def test_rectangles(values, a, b, c, d):
    which, height = WaveletTree(np.array(values)).report(np.array([a, 0]), np.array([b, 40]), np.array([c, c]), np.array([d, d]))
    for q, (lo, hi) in enumerate(((a, b), (0, 40))):
        assert sorted(height[which == q].tolist()) == sorted(v for v in values[lo:hi] if c <= v < d)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_small_trees(n):
    which, height = WaveletTree(np.arange(n)).report(np.array([0]), np.array([n]), np.array([0]), np.array([n]))
    assert sorted(height.tolist()) == list(range(n)) and (which == 0).all()


def test_no_words(spark):
    assert S.group_variants(S.vocabulary(S.runs(empty(spark)).withColumnRenamed("run", "word"))).count() == 0
    assert S.group_variants(S.vocabulary(S.runs(frame(spark).filter("text IS NULL")).withColumnRenamed("run", "word"))).count() == 0
