import re
from collections import Counter

from kmerlake.llm import quality_rules as R
from tests.llm.fixtures import corpus, empty, frame


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_measurements_equal_brute_force(spark):
    rows = corpus() + [(3000, "a b c d e f g h i " * 9, "en", "s", 0), (3001, "same line\nsame line\nsame  line\n\n" * 5, "en", "s", 0), (3002, "# $ <b> 𝄞 \x0b x", "en", "s", 0)]
    got = R.measure(frame(spark, rows)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted(([r["doc_id"], *(r[n] for n in names)] for r in got), key=str) == sorted(([r[0], *brute(r[1])] for r in rows), key=str)


def test_policies_and_ablation_read_the_ledger(spark):
    book = R.ledger(frame(spark)).cache()
    rows = R.apply_policy(book, R.LENIENT).collect()
    assert all(r["kept"] == (r["fail_bits"] & R.LENIENT.mask == 0) for r in rows)
    kept = sum(r["kept"] for r in rows)
    for r in R.ablation(book, R.LENIENT).collect():
        bit = R.mask_of(r["rule"])
        assert (r["documents"], r["kept"]) == (len(rows), kept)
        assert r["failing"] == sum(bool(x["fail_bits"] & bit) for x in rows)
        assert r["only_this"] == sum(x["fail_bits"] & R.LENIENT.mask == bit for x in rows)


def test_no_python_in_the_plan(spark):
    plan = R.apply_policy(R.ledger(frame(spark)), R.STRICT)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_empty(spark):
    assert R.ledger(empty(spark)).count() == 0
