"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are compared as letters and digits, A-Z lower-cased, with one space for everything between. A
benchmark item is cut into overlapping windows; a window of n characters may differ by `budget(n)` edits.
Where it occurs with e of them, at least n - q + 1 - q * e of its q-grams stand unchanged (`bound`) on e + 1
neighbouring diagonals (place in the document less place in the window), and of any e + 1 that do not overlap
one does. So each window has its e + 1 rarest such q-grams as seeds (`seeds`: the choice that the benchmark has
at the fewest places). One scan over the documents looks the seeds up inside the task; the bands that a seed
falls in are open. A band is two neighbouring cells of e + 1 diagonals, so bands overlap, and in each open one
the window's q-grams are counted by diagonal: first by a byte of their hash, which may count too many, then
exactly. Regions that meet the window's bound are verified by an alignment confined to the band. Only
occurrences leave the task, and none can be lost. Windows of the same text are looked for once.

`GRIDS` has windows of two lengths. The long ones find copies whose edits lie close together; of the short
ones, every passage of an item of LEAST_PASSAGE characters holds a whole one, so it is found wherever it is
cut out, with the short window's edits. Shorter passages of an item are not sure to be found.

The items are broadcast, CHARACTERS_AT_ONCE or so at a time; a larger benchmark takes a scan for each group
of them. Hits are made HITS_AT_ONCE at a time whatever a seed's frequency, so memory follows the longest
document.

Defined cases: null or empty texts share nothing; an item shorter than a window is one window; items of
fewer than Q characters must stand unchanged and as whole words; rows of one doc_id or item_id are reported
together, null ids as null; very long texts are compared whole; other columns pass through or are ignored;
empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerlake.llm import scratch
from kmerlake.llm.alignment import banded
from kmerlake.llm.alignment import edits as edits
from kmerlake.llm.textkit import FOLD, U64, blocks
from kmerlake.llm.workers import trimmed

Q, SMALL_Q = 8, 6
WINDOW, STRIDE = 96, 48
PASSAGE, PASSAGE_STRIDE = 48, 16
GRIDS = ((WINDOW, STRIDE), (PASSAGE, PASSAGE_STRIDE))
LEAST_PASSAGE = PASSAGE + PASSAGE_STRIDE - 1
EDIT_PERCENT = 9
CHARACTERS_AT_ONCE = 2_000_000
HITS_AT_ONCE = 1 << 19
BANDS_AT_ONCE = 1 << 13

MIX = U64(0x9E3779B97F4A7C15)
_KEPT = np.zeros(256, bool)
_KEPT[48:58] = _KEPT[97:123] = _KEPT[128:] = True


def budget(n: int) -> int:
    """Edits allowed in a window of n characters."""
    return n * EDIT_PERCENT // 100


def gram(n: int) -> int:
    """Length of the q-grams that a window of n characters is filtered by: the longest of a few that its budget leaves a bound for."""
    return next(q for q in (Q, SMALL_Q, n) if q * (budget(n) + 1) <= n)


def bound(n: int) -> int:
    """Q-grams of a window that stay whole, however its edits lie."""
    return n - gram(n) + 1 - gram(n) * budget(n)


def normalised(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a block's texts: no space at the start, at most one at the end."""
    low = FOLD[data]
    kept = _KEPT[low]
    stay = kept.copy()
    stay[1:] |= kept[:-1]
    first = at[:-1][at[:-1] < len(stay)]
    stay[first] = kept[first]
    low[~kept] = 32
    return low[stay], np.concatenate([[0], np.cumsum(stay)])[at]


def grams(x: np.ndarray, q: int) -> np.ndarray:
    """The q bytes (8 at most) from each place on as a number; zeros follow the last."""
    padded = np.concatenate([x, np.zeros(7, np.uint8)])
    two = padded[:-1].astype(np.uint16) | padded[1:].astype(np.uint16) << np.uint16(8)
    four = two[:-2].astype(np.uint32) | two[2:].astype(np.uint32) << np.uint32(16)
    eight = four[:-4].astype(U64) | four[4:].astype(U64) << U64(32)
    return eight & U64((1 << 8 * q) - 1)


def items(benchmark: DataFrame) -> DataFrame:
    """number, item_id, pattern (normalised): a row for each text with a character."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        for b in batches:
            out: list[tuple] = []
            for row, data, at in blocks(b.column(1)):
                x, of = normalised(data, at)
                for i in range(len(of) - 1):
                    t = x[of[i] : of[i + 1]].tobytes().strip()
                    if t:
                        out.append((number, b.column(0)[row + i].as_py(), t))
                        number += 1
            cols = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["number", "item_id", "pattern"])

    return benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(trimmed(cut), "number long, item_id long, pattern binary")


def seeds(cost: np.ndarray, q: int, many: int) -> np.ndarray:
    """For each row of costs by place, `many` places at least q apart whose costs have the least sum."""
    best = [np.zeros(cost.shape, cost.dtype)]
    for _ in range(many):
        before = np.full(cost.shape, np.iinfo(cost.dtype).max >> 1)
        if len(best) == 1:
            before[:] = 0
        else:
            before[:, q:] = best[-1][:, :-q]
        best.append(np.minimum.accumulate(before + cost, axis=1))
    out = np.empty((len(cost), many), np.int64)
    column, last = np.arange(cost.shape[1]), np.full(len(cost), cost.shape[1] - 1)
    for j in range(many, 0, -1):
        least = best[j][np.arange(len(cost)), last]
        out[:, j - 1] = ((best[j] == least[:, None]) & (column <= last[:, None])).argmax(1)
        last = out[:, j - 1] - q
    return out


@dataclass
class Grams:
    """Seeds of the windows that have q-grams of one length, sorted: gram i stands at first[i] to first[i + 1] of row and at."""

    q: int
    name: np.ndarray
    first: np.ndarray
    row: np.ndarray  # the seed's window
    at: np.ndarray  # its place there
    used: np.ndarray  # a mark for each slot of names
    shift: np.uint64

    def slot(self, name: np.ndarray) -> np.ndarray:
        return ((name * MIX) >> self.shift).astype(np.int64)

    def __call__(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, numbers of the seeds there) of q-grams g."""
        place = np.flatnonzero(self.used[self.slot(g)])
        g = g[place]
        number = np.minimum(np.searchsorted(self.name, g), len(self.name) - 1)
        same = self.name[number] == g
        return place[same], number[same]


def _on_diagonals(near: np.ndarray, pattern: np.ndarray, diagonals: int) -> np.ndarray:
    """For each column, how many rows of pattern equal near's on one of the diagonals, all added up."""
    total = np.zeros(pattern.shape[1], np.int32)
    for d in range(diagonals):
        total += (near[d : d + len(pattern)] == pattern).view(np.uint8).sum(0, dtype=np.uint8)  # windows are well below 256 long
    return total


@dataclass
class Benchmark:
    """Items to look for, and their windows."""

    item: pa.Array
    data: np.ndarray
    first: np.ndarray  # of each different window: where in data it stands
    n: np.ndarray
    edits: np.ndarray
    bound: np.ndarray
    grams: list[Grams]
    of: np.ndarray  # of[w] to of[w + 1] of text and window have the text of window w
    text: np.ndarray
    window: np.ndarray  # a name of its own for each window of each item

    @classmethod
    def build(cls, rows: pa.Table, grids: tuple[tuple[int, int], ...]) -> Benchmark:
        """rows: number, item_id, pattern."""
        patterns = rows.column("pattern").to_pylist()
        data = np.frombuffer(b"".join(patterns), np.uint8)
        of = np.concatenate([[0], np.cumsum([len(p) for p in patterns])]).astype(np.int64)
        same: dict[bytes, int] = {}
        different: list[tuple[int, int]] = []
        found: list[tuple[int, int, int]] = []
        for i, (number, p) in enumerate(zip(rows.column("number").to_pylist(), patterns, strict=True)):
            spans = {(s, min(s + width, len(p))) for width, stride in grids for s in [*range(0, max(1, len(p) - width), stride), max(0, len(p) - width)]}
            for k, (s, e) in enumerate(sorted(spans)):
                w = same.setdefault(p[s:e], len(different))
                if w == len(different):
                    different.append((int(of[i]) + s, e - s))
                found.append((w, i, (number << 22) + k))
        first, n = (np.array(c, np.int64) for c in zip(*different, strict=True)) if different else (np.empty(0, np.int64),) * 2
        w, text, window = (np.array(c, np.int64) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
        order = np.argsort(w, kind="stable")
        q, most, least = (np.array([f(int(k)) for k in n], np.int64) for f in (gram, budget, bound))
        made = [cls._seeded(data, of, first, n, most, q, k) for k in np.unique(q).tolist()]
        return cls(rows.column("item_id").combine_chunks(), data, first, n, most, least, made, np.searchsorted(w[order], np.arange(len(n) + 1)), text[order], window[order])

    @staticmethod
    def _seeded(data: np.ndarray, of: np.ndarray, first: np.ndarray, n: np.ndarray, most: np.ndarray, q_of: np.ndarray, q: int) -> Grams:
        g = grams(data, q)
        places = np.arange(len(data))
        within = places + q <= of[np.searchsorted(of, places, "right")]
        counted, many = np.unique(g[within], return_counts=True)
        cost = np.zeros(len(g), np.int64)
        cost[within] = many[np.searchsorted(counted, g[within])]
        rows, at = [], []
        for size in np.unique(n[q_of == q]).tolist():
            own = np.flatnonzero((q_of == q) & (n == size))
            for i in range(0, len(own), BANDS_AT_ONCE):
                some = own[i : i + BANDS_AT_ONCE]
                place = seeds(cost[first[some][:, None] + np.arange(size - q + 1)], q, budget(size) + 1)
                rows.append(np.repeat(some, place.shape[1]))
                at.append(place.reshape(-1))
        row, at = np.concatenate(rows), np.concatenate(at)
        names = g[first[row] + at]
        order = np.argsort(names, kind="stable")
        name, start = np.unique(names[order], return_index=True)
        bits = min(max((64 * len(name)).bit_length(), 16), 24)
        made = Grams(q, name, np.append(start, len(order)), row[order], at[order], np.zeros(1 << bits, bool), U64(64 - bits))
        made.used[made.slot(name)] = True
        return made

    def occurrences(self, x: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text of x, row of window and text, edits) of the regions that hold a window within its budget."""
        out = [r for g in self.grams for r in self._regions(g, x, of)]
        if not out:
            return (np.empty(0, np.int64),) * 3
        doc, row, least = (np.concatenate(c) for c in zip(*out, strict=True))
        order = np.lexsort((least, row, doc))
        doc, row, least = doc[order], row[order], least[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])
        doc, row, least = doc[new], row[new], least[new]
        many = self.of[row + 1] - self.of[row]
        member = np.repeat(self.of[row] - np.cumsum(many) + many, many) + np.arange(many.sum())
        return np.repeat(doc, many), member, np.repeat(least, many)

    def _regions(self, g: Grams, x: np.ndarray, of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text of x, different window, edits), some more than once."""
        names = grams(x, g.q)
        short = (names * MIX >> U64(56)).astype(np.uint8)
        own_names = grams(self.data, g.q)
        own_short = (own_names * MIX >> U64(56)).astype(np.uint8)
        place, number = g(names)
        doc = np.searchsorted(of, place, "right") - 1
        whole = place + g.q <= of[doc + 1]
        place, number, doc = place[whole], number[whole], doc[whole]
        size = g.first[number + 1] - g.first[number]
        total, a = np.cumsum(size), 0
        longest = int(self.n.max(initial=0))
        cells = len(x) + longest + 3
        rows = len(self.n)
        while a < len(place):
            b = max(a + 1, int(np.searchsorted(total, total[a] - size[a] + HITS_AT_ONCE, "right")))
            each = np.repeat(np.arange(a, b), size[a:b])
            own = g.first[number[each]] + np.arange(len(each)) - (total[each] - size[each] - total[a] + size[a])
            row, diagonal = g.row[own], place[each] - g.at[own] + longest
            width = self.edits[row] + 1
            cell = diagonal // width
            wide = width > 1  # without edits there is one diagonal and no band
            key = (doc[each] * rows + row) * cells + cell + 1
            key = np.sort(np.concatenate([key, key[wide] - 1]))
            key = key[np.concatenate([[True], key[1:] != key[:-1]])]
            a = b
            of_doc, row, cell = key // cells // rows, key // cells % rows, key % cells - 1
            # where the window's first character would stand on the band's first diagonal, less `longest`
            at = cell * (self.edits[row] + 1) - longest
            for n in np.unique(self.n[row]).tolist():
                same = np.flatnonzero(self.n[row] == n)
                diagonals = 2 * budget(n) + 2 if budget(n) else 1
                for i in range(0, len(same), BANDS_AT_ONCE):
                    some = same[i : i + BANDS_AT_ONCE]
                    for by, of_own in ((short, own_short), (names, own_names)):
                        spot = at[some] + np.arange(n - g.q + diagonals)[:, None]
                        inside = (spot >= of[of_doc[some]]) & (spot <= of[of_doc[some] + 1] - g.q)
                        near = np.where(inside, by[np.clip(spot, 0, len(x) - 1)], by.dtype.type(0))
                        pattern = of_own[self.first[row[some]] + np.arange(n - g.q + 1)[:, None]]
                        some = some[_on_diagonals(near, pattern, diagonals) >= bound(n)]
                    yield self._verified(x, of, of_doc[some], row[some], at[some], n)

    def _verified(self, x: np.ndarray, of: np.ndarray, doc: np.ndarray, row: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Those of the bands, all of windows of n characters, that hold the window."""
        if not budget(n):
            # all q-grams on one diagonal: it stands there unchanged
            lo, hi = at, at + n
            apart = (lo == of[doc]) | (x[lo - 1] == 32)
            apart &= (hi == of[doc + 1]) | (x[np.minimum(hi, len(x) - 1)] == 32)
            found = np.where(apart | (n >= Q), 0, -1)
        else:
            found = np.full(len(doc), -1)
            for i in range(0, len(doc), 2048):
                some = slice(i, i + 2048)
                patterns = self.data[self.first[row[some]][:, None] + np.arange(n)]
                found[some] = banded(patterns, x, at[some], 2 * budget(n) + 2, of[doc[some]], of[doc[some] + 1], budget(n))
        good = np.flatnonzero(found >= 0)
        return doc[good], row[good], found[good]


def _occurrences(docs: DataFrame, benchmark: Benchmark) -> DataFrame:
    """doc_id, item_id, window and edits, once or more for each window that occurs in a row."""
    sent = docs.sparkSession.sparkContext.broadcast(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Benchmark = sent.value
        for batch in batches:
            for first, data, at in blocks(batch.column(1)):
                doc, row, least = b.occurrences(*normalised(data, at))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(first + doc)), b.item.take(pa.array(b.text[row])), pa.array(b.window[row]), pa.array(least, pa.int64())],
                    ["doc_id", "item_id", "window", "edits"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(run), "doc_id long, item_id long, window long, edits long")


def contaminated(docs: DataFrame, benchmark: DataFrame, grids: tuple[tuple[int, int], ...] = GRIDS) -> DataFrame:
    """Per document and item that occurs in it: doc_id, item_id, windows (of the item, found), edits (of the best)."""
    found = scratch.keep(items(benchmark), "benchmark-items")
    groups = max(1, -(-(found.agg(F.sum(F.length("pattern"))).first()[0] or 0) // CHARACTERS_AT_ONCE))
    own = F.pmod(F.xxhash64("number"), F.lit(groups))
    # about CHARACTERS_AT_ONCE at a time
    scans = [_occurrences(docs, Benchmark.build(found.filter(own == g).toArrow(), grids)) for g in range(groups)]
    spots = reduce(DataFrame.unionByName, scans)
    return spots.groupBy("doc_id", "item_id").agg(F.count_distinct("window").alias("windows"), F.min("edits").alias("edits"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that an item occurs in. Rows without an id are judged together: they go if one of them is found."""
    gone = scratch.keep(contaminated(docs, benchmark).select(F.col("doc_id").alias("_kml_gone")).distinct(), "contaminated")
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["_kml_gone"]), "left_anti")
