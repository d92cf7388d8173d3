"""Spelling variants: words that differ by one inserted, deleted or replaced letter, and the form each goes back to.

Two words that differ by one edit at a place are equal before it and behind it. Words are put in forward order and, by
their letters from the end, in reverse order; a word is the point of its two ranks. For each place of a word, the
words that begin as it does before the place are an interval of the forward order, those that end as it does
behind the place one of the reverse order, and the points in both are reported by a wavelet tree (range_reporting):
with one letter skipped among words as long as it, those with a letter replaced, with none skipped among
words one letter longer, those with one inserted (and so, from the other side, deleted).

No task holds all words. The places are in PIECES pieces, so all words near a word by an edit in one piece share the other
pieces; words of lengths m and m + 1 meet under a hash of m, the piece and the letters outside it, and orders, intervals
and trees are made for all groups of about CHUNK_LETTERS letters at a time. A pair is reported at one place
only (the first that gives it), so in one group. Letters outside a piece are most of a word: groups are small whatever
letters are frequent, and a group is held whole. Intervals compare whole words, so words that share a hash by chance do not become near.

Counts, near words and forms are exact and for all words. Defined cases: null texts have no words; words of fewer than
`least` letters or less than `often` occurrences take no part; of several most frequent near words the first in
code-point order is the form; texts of any length are taken whole; no words give no rows. Letters are A-Z, a-z and U+00C0 to U+00FF.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerlake.llm import scratch
from kmerlake.llm.graph import _jumped
from kmerlake.llm.range_reporting import WaveletTree
from kmerlake.llm.workers import trimmed

PIECES = 3
CHUNK_LETTERS = 1 << 20
RATIO = 10
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, least: int = 7, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Maximal runs of letters of at least `least`, A-Z in lower case: the columns `keep` and run, a row for each."""
    found = F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    return docs.select(*keep, F.explode(found).alias("_run")).select(*keep, F.translate("_run", UPPER, LOWER).alias("run"))


def vocabulary(words: DataFrame, least: int = 7, often: int = 2) -> DataFrame:
    """words: word. Gives word and n."""
    return words.filter(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= often)


def _grouped(words: DataFrame, least: int) -> DataFrame:
    """key, m, piece, word, n: each word for each piece, as the shorter and as the longer of two."""
    size = F.length("word")
    lengths = F.filter(F.array(size - 1, size), lambda m: m >= least)
    spots = F.flatten(F.transform(lengths, lambda m: F.transform(F.array(*map(F.lit, range(PIECES))), lambda j: F.struct(m.alias("m"), j.alias("piece")))))
    rows = words.select("word", "n", F.explode(spots).alias("x")).select("word", "n", "x.m", "x.piece")
    before = F.expr(f"left(word, m * piece div {PIECES})")
    behind = F.expr(f"right(word, m - m * (piece + 1) div {PIECES})")
    return rows.select(F.xxhash64("m", "piece", before, F.lit("|"), behind).alias("key"), F.col("m").cast("int"), F.col("piece").cast("int"), "word", "n")


def _latin(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets) of words, whose code points are below 256."""
    words = words.cast(pa.large_string())
    _, at, data = words.buffers()
    at = np.frombuffer(at, np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if len(words) else np.empty(0, np.uint8)
    lead = data == 0xC3
    code = data + np.where(np.concatenate([[False], lead[:-1]]), np.uint8(0x40), np.uint8(0))
    before = np.concatenate([[0], np.cumsum(lead)])
    at = at - at[0]
    return code[~lead], at - before[at]


def _intervals(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, start, end) of a matrix of words, a row each, zeros behind.

    order sorts by group and letters; start[i] and end[i] are, for each place of the order, the bounds of those with
    the same group and first i letters.
    """
    n, width = rows.shape
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{width}").reshape(-1), kind="stable")
    order = order[np.argsort(group[order], kind="stable")]
    x, g = rows[order], group[order]
    differ = x[1:] != x[:-1]
    common = np.where(differ.any(1), differ.argmax(1), width)
    common = np.concatenate([[-1], np.where(g[1:] == g[:-1], common, -1)])
    start, end = np.empty((width + 1, n), np.int32), np.empty((width + 1, n), np.int32)
    place = np.arange(n, dtype=np.int32)
    for i in range(width + 1):
        new = common < i
        start[i] = np.maximum.accumulate(np.where(new, place, 0))
        after = np.where(np.append(new[1:], True), place + 1, n)
        end[i] = np.minimum.accumulate(after[::-1])[::-1]
    return order, start, end


def _near_pairs(group: np.ndarray, m: np.ndarray, piece: np.ndarray, code: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of words that are near by an edit in the group's piece, each pair once. m: the shorter length."""
    size = np.diff(at)
    n, width = len(size), int(size.max())
    words = np.zeros((n, width), np.uint8)
    own = np.repeat(np.arange(n), size)
    column = np.arange(len(code)) - at[own]
    words[own, column] = code
    turned = np.zeros((n, width), np.uint8)
    turned[own, size[own] - 1 - column] = code
    forward, f_start, f_end = _intervals(words, group)
    reverse, r_start, r_end = _intervals(turned, group)
    f_place, r_place = np.empty(n, np.int64), np.empty(n, np.int64)
    f_place[forward] = r_place[reverse] = np.arange(n)
    short = size == m
    # every place of the piece of every word of the shorter length
    first, last = m * piece // PIECES, m * (piece + 1) // PIECES
    asks = np.flatnonzero(short)
    places = (last - first + (piece == PIECES - 1))[asks]  # behind the last letter, too
    row = np.repeat(asks, places)
    i = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(places) - places, places)
    found = []
    for skipped, among in ((1, short), (0, ~short)):
        ask = i + skipped <= m[row]
        w, p = row[ask], i[ask]
        rest = m[w] - p - skipped
        # ranks among the words of this length alone
        f_before = np.concatenate([[0], np.cumsum(among[forward])])
        r_before = np.concatenate([[0], np.cumsum(among[reverse])])
        left, right = f_before[f_start[p, f_place[w]]], f_before[f_end[p, f_place[w]]]
        low, high = r_before[r_start[rest, r_place[w]]], r_before[r_end[rest, r_place[w]]]
        # with a letter skipped, the word itself is in both
        some = (right - left > skipped) & (high - low > skipped)
        w, p, left, right, low, high = (v[some] for v in (w, p, left, right, low, high))
        points = forward[among[forward]]
        tree = WaveletTree(r_before[r_place[points]])
        which, height = tree.report(left, right, low, high)
        by_height = reverse[among[reverse]]
        a, b, p = w[which], by_height[height], p[which]
        if skipped:
            once = a < b
        else:
            # a letter put beside its like gives the same word at either place: the first counts
            once = (p == 0) | (words[b, p] != words[a, np.maximum(p, 1) - 1])
        found.append((a[once], b[once]))
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def _reported(table: pa.Table, ratio: int) -> pa.RecordBatch | None:
    """Both ways of each pair of a chunk of whole groups: word, near and near_n (null unless near is frequent enough to be word's form)."""
    key, m = table["key"].to_numpy(), table["m"].to_numpy()
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (m[1:] != m[:-1])])
    group = np.cumsum(new) - 1
    # groups of one word, or without one of the shorter length, have no pairs
    size = table["size"].to_numpy()
    rows = np.flatnonzero((np.bincount(group) > 1)[group] & (np.bincount(group, size == m) > 0)[group])
    if not len(rows):
        return None
    words, n = table["word"].combine_chunks().take(pa.array(rows)), table["n"].to_numpy()[rows]
    a, b = _near_pairs(np.unique(group[rows], return_inverse=True)[1], m[rows].astype(np.int64), table["piece"].to_numpy()[rows].astype(np.int64), *_latin(words))
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    no_form = n[b] < ratio * n[a]
    return pa.RecordBatch.from_arrays([words.take(pa.array(a)), words.take(pa.array(np.ma.array(b, mask=no_form))) if len(b) else words[:0], pa.array(n[b], pa.int64(), mask=no_form)], ["word", "near", "near_n"])


def near_words(words: DataFrame, least: int = 7, ratio: int = RATIO) -> DataFrame:
    """words: word (at least `least` letters), n, each once. Every near pair, both ways: word, near, near_n; the latter two are null if near is no form of word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, letters = [], 0
        for b in batches:
            held.append(b)
            letters += b.num_rows and int(np.sum(b.column(3).to_numpy()))
            if letters < CHUNK_LETTERS:
                continue
            table = pa.Table.from_batches(held)
            key = table["key"].to_numpy()
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
            if len(cuts):
                out = _reported(table.slice(0, cuts[-1]), ratio)
                rest = table.slice(cuts[-1])
                held, letters = rest.to_batches(), int(np.sum(rest["size"].to_numpy()))
                if out is not None:
                    yield out
        if held and sum(b.num_rows for b in held):
            out = _reported(pa.Table.from_batches(held), ratio)
            if out is not None:
                yield out

    # words of like length lie together, so a long one widens few rows
    rows = _grouped(words, least).withColumn("size", F.length("word")).select("key", "m", "piece", "size", "word", "n")
    return rows.repartition("key").sortWithinPartitions("m", "key").mapInArrow(trimmed(run), "word string, near string, near_n long")


def group_variants(words: DataFrame, least: int = 7, ratio: int = RATIO) -> DataFrame:
    """words: word, n, each once. Adds form (the most frequent near word that is `ratio` times as frequent), form_n, n_near and root (form of form and so on)."""
    words = scratch.keep(words.select("word", "n"), "words")
    pairs = near_words(words, least, ratio)
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("rank"), F.col("near"))))
    per = pairs.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    known = words.join(per, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.near").alias("form"), (-F.col("best.rank")).alias("form_n"))
    known = scratch.keep(known, "forms")
    # a form is more frequent than its word, so this ends
    roots = _jumped(scratch.keep(known.filter("form IS NOT NULL").select(F.col("word").alias("node"), F.col("form").alias("parent")), "hooks"))
    roots = roots.select(F.col("node").alias("word"), F.col("parent").alias("root"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def without_letter(run: Column, at: Column) -> Column:
    """run without its code point number `at`, from 0."""
    return F.concat(F.substr(run, F.lit(1), at.cast("int")), F.substr(run, at.cast("int") + 2))
