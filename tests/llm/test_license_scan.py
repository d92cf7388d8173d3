import random
import re

from kmerlake.llm import license_scan
from kmerlake.llm.license_templates import PHRASES
from tests.llm.fixtures import corpus, empty, frame

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
    found = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    places = [i for i, _ in found]
    return len(w), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))


def test_base_places_equal_brute_force(spark):
    rows = corpus() + [(2000, "mit license " * 500 + "general public license, general public public license", "en", "s", 0)]
    got = sorted(([r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["doc_id"]] for r in license_scan.scan(frame(spark, rows)).collect()), key=str)
    assert got == sorted(([*brute(r[1]), r[0]] for r in rows), key=str)


def test_edited_notice_is_found_and_random_text_is_not(spark):
    notice = "Redistribution and use in source and binary forms, with or without small modification, are allowed provided that the following conditions are met:"
    rows = [(1, "some words before " * 30 + notice + " and after" * 20, "en", "s", 0), (2, "use in source of binary modification conditions are met following " * 5, "en", "s", 0), (3, "Licensed under CC BY-NC 4.0.", "en", "s", 0)]
    got = {r["doc_id"]: r for r in license_scan.scan(frame(spark, rows)).collect()}
    assert got[1]["labels"] == "bsd" and 0.75 <= got[1]["score"] < 1 and abs(got[1]["spans"][0]["first"] - 90) <= 2
    assert got[2]["labels"] == "" and got[2]["score"] == 0
    assert got[3]["labels"] == "cc-by-nc" and got[3]["score"] == 1


def test_empty(spark):
    assert license_scan.scan(empty(spark)).count() == 0


def brute_labels(text, t):
    """Base labels, and each notice that stands somewhere with no more words differing than it may; and the best share."""
    h = license_scan._hashes(text or "")
    base = {t.labels[i] for i in range(t.n_phrases) if any((h[a : a + len(t.words[i])] == t.words[i]).all() for a in range(len(h) - len(t.words[i]) + 1))}
    found, best = set(base), float(bool(base))
    for i in range(t.n_phrases, len(t.words)):
        n = len(t.words[i])
        e = license_scan.edits(t.words[i], h, license_scan.allowed(n))
        if e <= license_scan.allowed(n):
            found.add(t.labels[i])
            best = max(best, 1 - e / n)
    return ",".join(sorted(base)), ",".join(sorted(found)), best


def test_labels_and_score_equal_brute_force(spark):
    """Notices with words exchanged at random, as many as they may and one more; all in full beside the corpus."""
    rng = random.Random(6)
    t = license_scan.Templates()
    rows = list(corpus(40))
    for i, (_, notice) in enumerate(license_scan.NOTICES):
        n = len(notice.split())
        for e in {0, license_scan.allowed(n), license_scan.allowed(n) + 1}:
            w = notice.split()
            for at in rng.sample(range(1, n - 1), e):
                w[at] = f"changed{at}"
            rows.append((9000 + 10 * i + e % 10, "Some words before. " + " ".join(w).upper() + ".\nAnd after", "en", "s", 0))
    rows.append((9999, "mit license " * 3 + "word " * 300_000 + license_scan.NOTICES[1][1], "en", "s", 0))
    docs = frame(spark, rows).selectExpr("*", "1 AS row", "'x' AS hits", "2 AS zones", "3 AS template")
    got = sorted(((r["doc_id"], r["base_labels"], r["labels"], round(r["score"], 9)) for r in license_scan.scan(docs).collect()), key=str)
    want = []
    for d, text, *_ in rows:
        base, every, best = brute_labels(text if d != 9999 else "mit license " * 3 + "word " * 50 + license_scan.NOTICES[1][1], t)
        want.append((d, base, every, round(best, 9)))
    assert got == sorted(want, key=str)
