"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document. The ledger keeps the measurements and one failure bit per
rule; policies are versioned masks over those bits, so a new policy or an ablation reads the ledger
and never the texts again.

Defined cases: null or empty text has no words and fails `few_words`; rows are judged one by one, so
repeated rows and ids give repeated results; texts of any length are measured whole; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Name and failing condition of each rule; a rule's bit is its place here. Append only: ledgers keep bits.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "100 * n_symbols > 25 * word_chars",
    "few_letters": "100 * n_letters < 50 * word_chars",
    "long_words": "word_chars > 30 * n_words",
    "repeated_lines": "n_lines >= 8 AND 100 * n_dup_lines > 60 * n_lines",
    "symbols_strict": "100 * n_symbols > 10 * word_chars",
    "repeated_lines_strict": "100 * n_dup_lines > 30 * n_lines",
}


def mask_of(*rules: str) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in set(rules))


@dataclass(frozen=True)
class Policy:
    version: str
    mask: int


BASE = Policy("base", mask_of("few_words", "repeated_windows"))
LENIENT = Policy("lenient-1", BASE.mask | mask_of("symbols", "few_letters", "long_words", "repeated_lines"))
STRICT = Policy("strict-1", (1 << len(RULES)) - 1)


def _count_of(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def measure(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document with every measurement that a rule needs."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(F.col(key).alias(key), t.alias("_t"))
    d = d.select(
        key,
        F.array_remove(F.split("_t", SPACE_RUN), "").alias("_w"),
        F.length(F.translate("_t", SPACES, "")).cast("long").alias("word_chars"),
        _count_of(F.col("_t"), SYMBOLS).alias("n_symbols"),
        F.length(F.regexp_replace("_t", "\\P{L}+", "")).cast("long").alias("n_letters"),
        F.filter(F.split("_t", "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "").alias("_l"),
    )
    n = F.size("_w")
    # a window's hash chains the hashes of its words; windows are compared within one text only
    windows = F.when(
        n > WINDOW,
        F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_w", i, WINDOW))),
    )
    d = d.select(
        key, "word_chars", "n_symbols", "n_letters",
        n.cast("long").alias("n_words"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        windows.alias("_h"),
    )
    again = F.size(F.array_distinct("_h")) < F.size("_h")
    d = d.withColumn("_s", F.when(again, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, at: F.coalesce(F.get("_s", at)["h"] == x["h"], F.lit(False))
    twice = F.filter("_s", lambda x, i: same(x, i - 1) | same(x, i + 1))
    d = d.withColumn("_p", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(
        "_p",
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    repeated = F.coalesce(covered, F.lit(0)).cast("long")
    return d.select(key, "n_words", "word_chars", "n_symbols", "n_letters", "n_lines", "n_dup_lines", repeated.alias("n_repeat_words"))


def ledger(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """measure() and `fail_bits`: bit i is set if rule i of RULES fails."""
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, text, key).withColumn("fail_bits", bits)


def apply_policy(book: DataFrame, policy: Policy, flag: str = "kept") -> DataFrame:
    return book.withColumn(flag, F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0)


def ablation(book: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of the policy: documents that fail it, and those that would be kept without it. One pass, one row per rule."""
    sums, names = [], [r for i, r in enumerate(RULES) if policy.mask >> i & 1]
    failing = F.col("fail_bits").bitwiseAND(F.lit(policy.mask))
    for r in names:
        bit = mask_of(r)
        sums += [F.count_if(failing.bitwiseAND(F.lit(bit)) != 0).alias(f"f_{r}"), F.count_if(failing == bit).alias(f"o_{r}")]
    total = book.agg(F.count("*").alias("documents"), F.count_if(failing == 0).alias("kept"), *sums)
    rows = F.array(*(F.struct(F.lit(policy.version).alias("policy"), F.lit(r).alias("rule"), F.col(f"f_{r}").alias("failing"), F.col(f"o_{r}").alias("only_this")) for r in names))
    return total.select("documents", "kept", F.inline(rows))
