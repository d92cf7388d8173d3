import itertools
import random
import re

import numpy as np
import pyarrow as pa

from kmerlake.llm import decontamination as D
from tests.llm.fixtures import corpus, empty, frame, sentence


def norm(t):
    return re.sub(rb"[^0-9a-z\x80-\xff]+", b" ", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())).strip()


LONG = D.GRIDS[:1]


def brute(rows, items, grids=LONG):
    out = {}
    for doc, text, *_ in rows:
        x = np.frombuffer(norm(text) + b" ", np.uint8)
        for item, t in items:
            p = norm(t)
            spans = {(i, i + n) for n, stride in grids for i in range(0, max(1, len(p) - n), stride)} | {(max(0, len(p) - n), len(p)) for n, _ in grids}
            windows = {(i, min(j, len(p))) for i, j in spans}
            if 0 < len(p) < D.Q:
                if b" " + p + b" " in b" " + x.tobytes():
                    out.setdefault((doc, item), []).append(0)
                continue
            for i, j in windows if p else []:
                w = p[i:j]
                e = D.edits(np.frombuffer(w, np.uint8), x, D.budget(len(w)))
                if e <= D.budget(len(w)):
                    out.setdefault((doc, item), []).append(e)
    return sorted(((a, b, len(v), min(v)) for (a, b), v in out.items()), key=str)


def planted():
    rng = random.Random(3)
    items = [(i, sentence(rng, "en", rng.randint(4, 60)).capitalize() + ".") for i in range(12)] + [(90, "short"), (91, None), (92, "of the"), (93, "exactly matched text")]
    rows = [r for r in corpus(40)]
    for i, (_, t) in enumerate(items[:12]):
        words = t.split(" ")
        for j, edit in enumerate((0, 1, 3, 8)):
            w = list(words)
            for _ in range(min(edit, len(w) // 3)):
                w[rng.randrange(len(w))] = rng.choice(["of", "xyz", "longerword"])
            rows.append((3000 + 10 * i + j, sentence(rng, "de", 30) + ", " + " ".join(w).upper() + "!\n" + sentence(rng, "fr", 30), "en", "s", 0))
    rows.append((3900, "exactly matched text", "en", "s", 0))
    rows.append((3901, items[5][1][: len(items[5][1]) // 2], "en", "s", 0))
    return rows, items


def test_equals_brute_force(spark):
    rows, items = planted()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"], r["windows"], r["edits"]) for r in D.contaminated(frame(spark, rows), bench, LONG).collect()), key=str)
    by_doc = [(d, i, w, e) for d, i, w, e in brute(rows, items)]
    assert got == by_doc
    assert {d for d, *_ in got if d is not None} >= {3000 + 10 * i for i in range(12)}


def test_drop_and_empty(spark):
    rows, items = planted()
    items = [i for i in items if i[1] != "of the"]  # two words that nearly all have
    docs, bench = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    kept = {r["doc_id"] for r in D.drop_contaminated(docs, bench).collect()}
    assert not kept & {3000 + 10 * i for i in range(12)} and set(range(40)) <= kept
    assert D.contaminated(empty(spark), bench).count() == 0
    assert D.contaminated(docs, bench.limit(0)).count() == 0
    assert D.drop_contaminated(docs, bench.limit(0)).count() == docs.count()


def test_bound_is_positive():
    assert all(D.bound(n) >= 1 for n in range(1, 200))


def edited(text, places):
    """text with another letter at each place."""
    return "".join("q" if i in places else c for i, c in enumerate(text))


def test_whole_edit_budget(spark):
    rng = random.Random(8)
    items = [(n, "".join(rng.choice("abcdefghijklmnop") for _ in range(n))) for n in (32, 80, 96)]
    rows = [(10 * n + e, "zz " + edited(t, {5 + (n // e) * i for i in range(e)}) + " zz", "en", "s", 0) for n, t in items for e in {32: (1, 2, 3), 80: (5, 7, 8), 96: (7, 8, 9)}[n]]
    got = {r["doc_id"]: r["edits"] for r in D.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), LONG).collect()}
    assert got == {321: 1, 322: 2, 805: 5, 807: 7, 967: 7, 968: 8}


def test_benchmark_in_groups(spark, monkeypatch):
    rows, items = planted()
    monkeypatch.setattr(D, "CHARACTERS_AT_ONCE", 300)
    monkeypatch.setattr(D, "HITS_AT_ONCE", 64)
    monkeypatch.setattr(D, "BANDS_AT_ONCE", 16)
    got = D.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["item_id"], r["windows"], r["edits"]) for r in got), key=str) == brute(rows, items, D.GRIDS)


def test_passages_between_long_windows(spark):
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefghijklmnop") for _ in range(384))
    bench = spark.createDataFrame([(7, text)], "item_id long, text string")
    n = 63  # the stated least length
    rows = [(s, "zz " + text[s : s + n] + " zz", "en", "s", 0) for s in range(0, len(text) - n + 1, 5)] + [(1000, "zz " + text[16:128] + " zz", "en", "s", 0), (1001, "zz " + text[:30], "en", "s", 0)]
    docs = frame(spark, rows)
    assert [r["doc_id"] for r in D.drop_contaminated(docs, bench).collect()] == [1001]


def test_items_of_every_length(spark):
    """Found with as many edits as their length allows, and not with one more, by the same rule as brute force."""
    rng = random.Random(11)
    items = [(n, "".join(rng.choice("abcdefghijklmnop") for _ in range(n))) for n in [*range(1, 26), 31, 34, 40, 48, 63, 80, 88, 95, 96, 97, 120, 199]]
    rows = []
    for n, t in items:
        for e in range(D.budget(n) + 2):
            places = set(rng.sample(range(n), min(e, n)))
            rows.append((1000 * n + e, "zz " + edited(t, places) + " zz", "en", "s", 0))
            cut = "".join(c for i, c in enumerate(t) if i not in places)
            rows.append((1000 * n + 100 + e, "zz " + cut + " zz", "en", "s", 0))
    got = sorted(((r["doc_id"], r["item_id"], r["windows"], r["edits"]) for r in D.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), LONG).collect()), key=str)
    assert got == brute(rows, items)
    assert {(1000 * n + D.budget(n), n) for n, _ in items if n <= D.WINDOW} <= {(d, i) for d, i, *_ in got}


def test_hot_gram_long_text_nulls_and_clashing_names(spark):
    rows = [(1, "ab " * 2000 + "zu " * 500_000 + "of the stated passage that an item has in whole " + "ab " * 1000, "en", "s", 0), (None, None, None, None, None)]
    bench = spark.createDataFrame([(i, "ab " * 60) for i in range(9)] + [(77, "of the stated passage that an item has in whole"), (None, None)], "item_id long, text string")
    docs = frame(spark, rows).selectExpr("*", "1 AS item_id", "'x' AS windows", "2 AS edits")
    got = {(r["doc_id"], r["item_id"], r["edits"]) for r in D.contaminated(docs, bench).collect()}
    assert got == {(1, i, 0) for i in range(9)} | {(1, 77, 0)}
    assert D.drop_contaminated(docs, bench).columns == docs.columns


def test_seeds_are_the_cheapest_that_do_not_overlap():
    rng = np.random.default_rng(4)
    for q, many, places in ((2, 3, 9), (3, 2, 8), (4, 1, 5), (3, 3, 7)):
        cost = rng.integers(1, 9, (40, places))
        got = D.seeds(cost, q, many)
        choices = [c for c in itertools.combinations(range(places), many) if all(b - a >= q for a, b in itertools.pairwise(c))]
        for row, chosen in zip(cost, got.tolist(), strict=True):
            assert tuple(chosen) in choices
            assert sum(row[i] for i in chosen) == min(sum(row[i] for i in c) for c in choices)


def test_words_that_all_share_and_repeated_windows(spark):
    """A small vocabulary, whose q-grams are everywhere, and passages that several items share."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("etaoin") for _ in range(rng.randint(2, 7))) for _ in range(25)]

    def text(n):
        return " ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(25)], k=n))

    shared = text(30)
    items = [(i, text(rng.randint(3, 40)) + (" " + shared if i % 3 == 0 else "")) for i in range(9)] + [(50, "ab " * 70)]
    rows = [(i, text(60) + " " + items[i % 9][1][i : i + 120] + " " + text(9), "en", "s", 0) for i in range(24)] + [(90, "zu ab " + "ab " * 40, "en", "s", 0)]
    got = D.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["item_id"], r["windows"], r["edits"]) for r in got), key=str) == brute(rows, items, D.GRIDS)
    assert len(got) > 24


def test_seed_hits_do_not_grow_with_common_words():
    """Seeds of a larger benchmark are of its rare q-grams: far fewer hits than q-grams shared."""
    rng = random.Random(13)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(3000)]

    def text(n):
        return " ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(3000)], k=n))

    items = [text(25).encode() for _ in range(400)]
    made = D.Benchmark.build(pa.table({"number": range(400), "item_id": range(400), "pattern": items}), LONG)
    x = np.frombuffer(text(5000).encode(), np.uint8)
    (seeds,) = made.grams
    _, number = seeds(D.grams(x, seeds.q))
    names, many = np.unique(D.grams(made.data, seeds.q), return_counts=True)
    of_all = np.searchsorted(names, D.grams(x, seeds.q))
    of_all = np.minimum(of_all, len(names) - 1)
    shared = many[of_all][names[of_all] == D.grams(x, seeds.q)].sum()
    assert 20 * (seeds.first[number + 1] - seeds.first[number]).sum() < shared
