import math
import re
import zlib
from collections import Counter

import numpy as np

from kmerlake.llm import brown_lm, exchange
from tests.llm.fixtures import corpus, empty, frame

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD)), None]


def brute(rows):
    rem = lambda d: None if d is None else zlib.crc32(str(d).encode()) % 5
    c = Counter(t for r in rows if rem(r[0]) not in (None, 1) for t in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    out = []
    for r in rows:
        own = tokens(r[1])
        base = sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own)
        out.append((r[0], rem(r[0]) == 1, len(own), sum(c[t] > 0 for t in own), n, round(base, 6)))
    return sorted(out, key=str)


def check(spark, rows):
    got = brown_lm.score_documents(frame(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=str) == brute(rows)
    return got


def test_base_equals_brute_force_and_classes_help(spark):
    got = check(spark, corpus(300))
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["score"] < 0 for r in got)


def class_of(model, word):
    """Of a token as `tokens` gives it."""
    if word is None:
        return int(model.classes.unit[brown_lm.END])
    raw = np.frombuffer(word.encode(), np.uint8)
    _, _, place, unit = model.words.units(raw, np.array([0, len(raw)]))
    return int(model.classes.of(place, unit)[0])


def scores(model, rows):
    """Scores by dictionaries, given each word's class."""
    train = [tokens(r[1]) for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 != 1]
    own = {t: class_of(model, t) for r in rows for t in tokens(r[1])}
    count = Counter(t for ts in train for t in ts)
    pairs = Counter((own[a], own[b]) for ts in train for a, b in zip([None, *ts], ts, strict=False))
    left, right, kinds = Counter(), Counter(), Counter(own[t] for t in count)
    for (a, b), n in pairs.items():
        left[a] += n
        right[b] += n
    size, end = brown_lm.CLASSES + 1, own[None]
    out = []
    for r in rows:
        total = 0.0
        for a, b in zip([None, *tokens(r[1])], tokens(r[1]), strict=False):
            x, y = own[a], own[b]
            total += math.log10((pairs[x, y] + 0.5) / (left[x] + 0.5 * size))
            total += 0.0 if y == end else math.log10((count[b] + 0.5) / (right[y] + 0.5 * (kinds[y] + 1)))
        out.append((r[0], round(total, 6)))
    return sorted(out, key=str)


def test_score_equals_brute_force(spark, monkeypatch):
    models = []
    texts = brown_lm._texts
    monkeypatch.setattr(brown_lm, "_texts", lambda d, m: models.append(m) or texts(d, m))
    whole = brown_lm.vocabulary
    for size in (1 << 16, 50):
        monkeypatch.setattr(brown_lm, "vocabulary", lambda d, size=size: whole(d, size))
        rows = corpus(200)
        got = brown_lm.score_documents(frame(spark, rows)).collect()
        assert sorted(((r["doc_id"], round(r["score"], 6)) for r in got), key=str) == scores(models[-1], rows)


def test_words_are_exchanged_one_by_one(spark):
    rng = np.random.default_rng(3)
    first, second = ([f"{c}{i}xx" for i in range(40)] for c in "ab")
    rows = [(i, " ".join(w for _ in range(40) for w in (first[rng.integers(40)], second[rng.integers(40)])), "en", "s", 0) for i in range(60)]
    d = brown_lm._prepared(frame(spark, rows))
    w = brown_lm.Words.of(brown_lm.vocabulary(d))
    unit = np.zeros(brown_lm.UNITS, np.int64)
    unit[brown_lm.END] = brown_lm.CLASSES
    start = brown_lm.Classes(w, unit, rng.integers(0, 4, len(w.unit)))
    train = [tokens(r[1]) for r in rows if zlib.crc32(str(r[0]).encode()) % 5 != 1]
    place = {t: int(w.units(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[2][0]) for t in first + second}
    count = Counter(t for ts in train for t in ts)
    seen = np.zeros(len(w.unit), np.int64)
    for t, at in place.items():
        seen[at] = count[t]
    reached = []
    for sweeps in (1, 8):
        classes, table = brown_lm.assign(d, start, seen, sweeps)
        own = {t: int(classes.place[at]) for t, at in place.items()} | {None: brown_lm.CLASSES}
        want = np.zeros_like(table)
        for ts in train:
            for x, y in zip([None, *ts], ts, strict=False):
                want[own[x], own[y]] += 1
        assert np.array_equal(table, want)
        reached.append(exchange.objective(table))
    assert reached[1] > reached[0]
    assert not {own[t] for t in first} & {own[t] for t in second}


def test_rare_words_path(spark, monkeypatch):
    want = {(r["doc_id"], r["n_tokens"]): r["base_score"] for r in check(spark, corpus())}
    monkeypatch.setattr(brown_lm, "FREQUENT", 1000)
    few = lambda docs, size=0: whole(docs, 8)
    whole = brown_lm.vocabulary
    monkeypatch.setattr(brown_lm, "vocabulary", few)
    again = check(spark, corpus())
    assert all(abs(want[r["doc_id"], r["n_tokens"]] - r["base_score"]) < 1e-6 for r in again)


def test_empty_and_unlearned(spark):
    assert brown_lm.score_documents(empty(spark)).count() == 0
    check(spark, [(None, "nothing to learn", "en", "s", 0), (None, None, None, None, 0)])


def test_perplexity(spark):
    p = {r["held_out"]: r for r in brown_lm.perplexity(brown_lm.score_documents(frame(spark))).collect()}
    assert p[True]["perplexity"] < p[True]["base_perplexity"]


def test_gain_is_the_change_of_the_objective():
    rng = np.random.default_rng(5)
    n, c = 12, 4
    counts = rng.integers(0, 9, (n, n)).astype(float)
    own = rng.integers(0, c, n)
    table = lambda o: np.array([[counts[np.ix_(o == a, o == b)].sum() for b in range(c)] for a in range(c)])
    for u in range(n):
        r, left = (np.bincount(own, weights=x, minlength=c) for x in (counts[u], counts[:, u]))
        to, gain = exchange.best_class(int(own[u]), r, left, counts[u, u], table(own), c)
        best = max(range(c), key=lambda b: exchange.objective(table(np.where(np.arange(n) == u, b, own))))
        moved = np.where(np.arange(n) == u, to, own)
        assert abs(exchange.objective(table(moved)) - exchange.objective(table(own)) - gain) < 1e-6
        assert abs(exchange.objective(table(moved)) - exchange.objective(table(np.where(np.arange(n) == u, best, own)))) < 1e-6


def test_clustering_ends_where_no_unit_gains(spark):
    rng = np.random.default_rng(7)
    n, c = 60, 5
    kind = rng.integers(0, 4, n)
    x = rng.poisson(2 + 30 * (kind[:, None] == (kind[None, :] + 1) % 4)).astype(float)
    rows = [(0, int(a * brown_lm.UNITS + b), int(x[a, b])) for a, b in zip(*np.nonzero(x), strict=True)]
    classes, table = brown_lm.cluster(spark.createDataFrame(rows, "kind int, key long, n long"), c)
    own = classes[:n]
    want = np.zeros((c + 1, c + 1))
    np.add.at(want, (own[:, None] + np.zeros(n, int), own[None, :] + np.zeros((n, 1), int)), x)
    assert np.allclose(table, want)
    for u in range(n):
        right, left = (np.bincount(own, weights=y, minlength=c + 1) for y in (x[u], x[:, u]))
        assert exchange.best_class(int(own[u]), right, left, x[u, u], table, c)[1] <= 1e-6
