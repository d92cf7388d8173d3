"""Small corpora made from a seed, with the odd cases that every operator must take."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOWELS = {"en": "the of and to in that is was for on with as".split(), "de": "der die und das ist nicht ein für über mit auf den".split(), "fr": "le la les des est une que pour dans où été être".split()}


def sentence(rng: random.Random, lang: str, n: int) -> str:
    own = VOWELS[lang]
    tails = {"en": ["ing", "tion", "ly"], "de": ["ung", "chen", "heit"], "fr": ["ment", "eux", "elle"]}[lang]
    return " ".join(rng.choice(own) if rng.random() < 0.6 else rng.choice("bcdfglmnprst") + rng.choice("aeiou") + rng.choice("lmnrst") + rng.choice(tails) for _ in range(n))


def corpus(n: int = 120, seed: int = 7) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(VOWELS))
        rows.append([i, ".\n".join(sentence(rng, lang, rng.randint(3, 40)) for _ in range(rng.randint(1, 6))), lang, f"src{i % 3}"])
    for i in range(0, n, 9):  # near copies: one word changed
        words = rows[i][1].split(" ")
        words[rng.randrange(len(words))] = "Changed"
        rows.append([n + i, " ".join(words), rows[i][2], "copies"])
    for i in range(0, n, 15):
        rows.append([2 * n + i, rows[i][1], rows[i][2], "copies"])
    odd = ["", None, "one", "two words", " \t\n ", "A.", "12345 678", "!!! ???", "The\n\nthe  \nTHE", "é", "x" * 3000, "the of " * 2000, "line that many documents share\n" * 3]
    rows += [[1000 + i, t, "en", "odd"] for i, t in enumerate(odd)]
    rows += [[1100, "Released under the MIT License.\nthe code", "en", "odd"], [1101, "under the GNU General Public License, version 3. MIT license mit LICENSE", None, "odd"], [1102, "Licensed under the Apache\nLicense, Version 2.0.", "en", "odd"]]
    rows.append(rows[0][:])  # a repeated row
    rows.append([rows[1][0], "another text under the same number as one that is there", "en", "odd"])
    rows.append([None, rows[3][1], "en", "odd"])
    rows.append([None, None, None, None])
    return [(*r, len(r[1]) if r[1] is not None else None) for r in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(corpus() if rows is None else rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
