"""Brown class-based bigram model, trained and applied by Spark jobs.

A word's probability is P(class | class before) * P(word | class). Exchange clustering assigns words to
classes in two steps. First until no unit gains: units are the `FREQUENT` most frequent words, each by
itself, and `GROUPS` groups of all other words by spelling (length and last letters). Then all `VOCABULARY`
words that were seen `LEAST` times or more are exchanged one by one (`assign`), `SWEEPS` scans of the
training texts long. Words outside the vocabulary have their group's class. So every word of the corpus has
a class and every training token counts. The end of a text is a class of its own and also stands before
its first word.

Counts of all words are exact. Those of the `VOCABULARY` words that are most frequent by the tasks' own
counts are summed map-side and broadcast (a fixed number of rows); every other word is shuffled once, in
blocks, to where its count and its share of each text's score are worked out.

Both smoothings add a half: to each known word of a class and one unknown, and to each class transition.

Defined cases: null texts are empty, one end token; rows with a null id are scored, not learned from and
not held out; repeated rows are learned from and scored each; texts of any length are read whole; other columns are ignored; with nothing to
learn from, all counts are 0; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kmerlake.llm import exchange, scratch
from kmerlake.llm.textkit import FOLD, U64, blocks, mix, owners, words
from kmerlake.llm.workers import trimmed

VOCABULARY = 1 << 16
FREQUENT = 1000
GROUPS = 256
CLASSES = 32
LEAST = 5
SWEEPS = 4
#: Words in a block of counts, and tasks that first add the blocks of one range of words.
RANGE = 256
SALTS = 16
ADD = 0.5
_EMPTY = np.empty(0, U64)


def _remainder() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))


def _prepared(docs: DataFrame) -> DataFrame:
    """doc_id, text, train, held_out."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return d.withColumn("train", F.coalesce(_remainder() != 1, F.lit(False))).withColumn("held_out", F.coalesce(_remainder() == 1, F.lit(False)))


def _spelling(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Group of each word: its length to 12 and its last two bytes."""
    n = np.minimum(ends - starts, 12).astype(U64)
    last = FOLD[data[ends - 1]].astype(U64)
    other = FOLD[data[np.maximum(ends - 2, starts)]].astype(U64)
    return (mix(n | last << U64(8) | other << U64(16)) % U64(GROUPS)).astype(np.int64)


class Lookup:
    """Places of hashes in a sorted table, by their top bits; -1 for those it does not have."""

    def __init__(self, table: np.ndarray, bits: int = 18):
        self.table, self.shift = np.append(table, _EMPTY), U64(64 - bits)
        self.first = np.searchsorted(table >> self.shift, np.arange((1 << bits) + 1, dtype=U64))
        self.depth = int(np.diff(self.first).max(initial=0))

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        if not len(self.table):
            return out
        at = self.first[(h >> self.shift).astype(np.int64)]
        for _ in range(self.depth):
            hit = (self.table[np.minimum(at, len(self.table) - 1)] == h) & (at < len(self.table))
            out[hit] = at[hit]
            at = at + 1
        return out


def _counted(h: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if n is None:
        return np.unique(h, return_counts=True)
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    first = np.flatnonzero(new)
    return h[first], np.add.reduceat(n, first) if len(first) else n[:0]


def vocabulary(docs: DataFrame, size: int = VOCABULARY) -> np.ndarray:
    """Hashes of the most frequent training words, most frequent first. Each task offers twice as many as are taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0
        for b in batches:
            for _, data, at in blocks(b.column(0)):
                held.append(_counted(words(data, at)[0]))
                waiting += len(held[-1][0])
                if waiting > 4_000_000:
                    held = [_counted(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                    waiting = 0
        if held:
            h, n = _counted(*(np.concatenate(x) for x in zip(*held, strict=True)))
            top = np.argsort(-n, kind="stable")[: 2 * size]
            yield pa.RecordBatch.from_arrays([pa.array(h[top].view(np.int64)), pa.array(n[top], pa.int64())], ["word", "n"])

    found = docs.filter("train").select("text").mapInArrow(trimmed(run), "word long, n long")
    top = found.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size).select("word").toArrow()
    return top.column(0).to_numpy().astype(np.int64).view(U64)


@dataclass
class Words:
    """The broadcast vocabulary, sorted by hash: a word's own unit, or -1 where its spelling decides."""

    lookup: Lookup
    unit: np.ndarray

    @classmethod
    def of(cls, ranked: np.ndarray) -> Words:
        order = np.argsort(ranked, kind="stable")
        return cls(Lookup(ranked[order]), np.where(order < FREQUENT, order, -1))

    def units(self, data: np.ndarray, at: np.ndarray):
        """(hashes, of, places in the vocabulary or -1, units) of a block's words."""
        h, starts, ends, of = words(data, at)
        place = self.lookup(h)
        unit = FREQUENT + _spelling(data, starts, ends)
        own = np.where(place >= 0, self.unit[place], -1) if len(self.unit) else np.full(len(h), -1)
        return h, of, place, np.where(own >= 0, own, unit)


UNITS = FREQUENT + GROUPS + 1
END = UNITS - 1


def _with_ends(x: np.ndarray, of: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """An end behind each document's items, and the offsets then."""
    return np.insert(x, of[1:], end), of + np.arange(len(of))


def _count(docs: DataFrame, sent) -> DataFrame:
    """key and n over training texts. kind 0: unit * UNITS + next unit; 1: place in the vocabulary; 2: place * UNITS + unit, of words without a unit of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w: Words = sent.value
        pairs = np.zeros(UNITS * UNITS, np.int32)
        seen = np.zeros(len(w.unit) + 1, np.int64)
        spelled = np.full(len(w.unit) + 1, -1)
        for b in batches:
            for _, data, at in blocks(b.column(0)):
                _, of, place, unit = w.units(data, at)
                seen += np.bincount(place + 1, minlength=len(seen))
                spelled[place + 1] = unit
                u, _ = _with_ends(unit, of, END)
                before = np.empty_like(u)
                before[:1], before[1:] = END, u[:-1]
                key, n = np.unique(before * UNITS + u, return_counts=True)
                pairs[key] += n.astype(np.int32)
        for kind, x in ((0, pairs), (1, seen[1:])):
            key = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key), pa.array(x[key], pa.int64())], ["kind", "key", "n"])
        at = np.flatnonzero((seen[1:] > 0) & (w.unit < 0))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), 2, np.int32)), pa.array(at * UNITS + spelled[1:][at]), pa.array(np.ones(len(at), np.int64))], ["kind", "key", "n"])

    found = docs.filter("train").select("text").mapInArrow(trimmed(run), "kind int, key long, n long")
    return found.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _row_keys(ids: pa.Array, data: np.ndarray, at: np.ndarray, h: np.ndarray, of: np.ndarray) -> np.ndarray:
    """A name of each row from its id and its words in order."""
    spread = mix(h + U64(0x9E3779B97F4A7C15) * (np.arange(len(h), dtype=U64) - np.repeat(of[:-1], np.diff(of)).astype(U64)))
    total = np.concatenate([np.zeros(1, U64), np.cumsum(spread, dtype=U64)])
    own = total[of[1:]] - total[of[:-1]]
    doc = ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
    return mix(own + mix(doc + U64(1)) + np.diff(of).astype(U64))


def _rare(docs: DataFrame, sent, parts: int) -> DataFrame:
    """Words outside the vocabulary, once a text, in blocks by part of the hash: part, words, rows, n, units, keys, train."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w: Words = sent.value
        for b in batches:
            all_words, all_docs, all_n, all_units, keys = [], [], [], [], []
            before = 0
            for row, data, at in blocks(b.column(1)):
                h, of, place, unit = w.units(data, at)
                n_docs = len(of) - 1
                keys.append(_row_keys(b.column(0).slice(row, n_docs), data, at, h, of))
                rare = np.flatnonzero(place < 0)
                x, d, u = h[rare], owners(of)[rare], unit[rare]
                order = np.lexsort((x, d))
                x, d, u = x[order], d[order], u[order]
                new = np.ones(len(x), bool)
                new[1:] = (x[1:] != x[:-1]) | (d[1:] != d[:-1])
                first = np.flatnonzero(new)
                all_words.append(x[first])
                all_docs.append(d[first] + before)
                all_n.append(np.diff(np.append(first, len(x))))
                all_units.append(u[first])
                before += n_docs
            if not keys:
                continue
            x, d, n, u, k = (np.concatenate(a) for a in (all_words, all_docs, all_n, all_units, keys))
            train = b.column(2).to_numpy(zero_copy_only=False).astype(np.uint8)
            part = (x % U64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            out = []
            for p in np.flatnonzero(np.diff(cuts)).tolist():
                at = order[cuts[p] : cuts[p + 1]]
                rows, own = np.unique(d[at], return_inverse=True)
                small = [own.astype("<u4"), np.minimum(n[at], 0xFFFFFFFF).astype("<u4"), u[at].astype("<u2")]
                raw = b"".join(c.tobytes() for c in small)
                out.append((p, len(at), len(rows), x[at].tobytes(), pa.compress(raw, codec="zstd", asbytes=True), k[rows].tobytes(), train[rows].tobytes()))
            cols = list(zip(*out, strict=True)) or [[]] * 7
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["part", "n_items", "n_rows", "words", "items", "keys", "train"])

    return docs.select("doc_id", "text", "train").mapInArrow(trimmed(run), "part long, n_items long, n_rows long, words binary, items binary, keys binary, train binary")


def _rare_shares(rare: DataFrame, width: int) -> DataFrame:
    """kind 0: a part of the rows' keys, and blocks of keys, sums of log10(count + ADD) and known ones among their rare tokens. kind 1: a unit and its number of known words. The number is in n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ws, ks, ns, us, ts = [], [], [], [], []
        for b in batches:
            for _, m, _, x, items, keys, train in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                raw = pa.decompress(items, decompressed_size=10 * m, codec="zstd", asbytes=True)
                own = np.frombuffer(raw, "<u4", m)
                ws.append(np.frombuffer(x, U64))
                ks.append(np.frombuffer(keys, U64)[own])
                ns.append(np.frombuffer(raw, "<u4", m, 4 * m).astype(np.int64))
                us.append(np.frombuffer(raw, "<u2", m, 8 * m))
                ts.append(np.frombuffer(train, np.uint8)[own])
        if not ws:
            return
        w, k, n, u, t = (np.concatenate(a) for a in (ws, ks, ns, us, ts))
        order = np.argsort(w, kind="stable")
        new = np.ones(len(w), bool)
        new[1:] = w[order][1:] != w[order][:-1]
        first = np.flatnonzero(new)
        c = np.add.reduceat((n * t)[order], first)
        each = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(w))))
        share, known = np.empty(len(w)), np.empty(len(w), np.int64)
        share[order], known[order] = np.log10(c + ADD)[each], (c > 0)[each]
        rows, own = np.unique(k, return_inverse=True)
        v = np.bincount(u[order][first][c > 0], minlength=UNITS)
        g = np.flatnonzero(v)
        total = np.bincount(own, weights=n * share, minlength=len(rows))
        some = np.bincount(own, weights=n * known, minlength=len(rows)).astype("<i8")
        part = (rows % U64(4 * width)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(4 * width + 1))
        out = [(0, p, len(at), rows[at].tobytes(), total[at].tobytes(), some[at].tobytes()) for p in np.flatnonzero(np.diff(cuts)).tolist() for at in [order[cuts[p] : cuts[p + 1]]]]
        out += [(1, int(u_), int(v[u_]), None, None, None) for u_ in g.tolist()]
        types = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["kind", "key", "n", "rows", "share", "known"])

    return rare.repartition(width, "part").mapInArrow(trimmed(run), "kind int, key long, n long, rows binary, share binary, known binary")


def _summed(shares: DataFrame, width: int) -> DataFrame:
    """key, _share, _known: one row for each key, from blocks dealt by parts of the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks_ = [[np.frombuffer(x, kind) for x, kind in zip(row, (U64, "<f8", "<i8"), strict=True)] for b in batches for row in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)]
        if blocks_:
            k, share, known = (np.concatenate(c) for c in zip(*blocks_, strict=True))
            keys, own = np.unique(k, return_inverse=True)
            sums = np.bincount(own, weights=share, minlength=len(keys)), np.bincount(own, weights=known, minlength=len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *map(pa.array, sums)], ["key", "_share", "_known"])

    return shares.filter("kind = 0").repartition(width, "key").select("rows", "share", "known").mapInArrow(trimmed(run), "key long, _share double, _known long")


def _neighbours(counts: DataFrame) -> DataFrame:
    """unit, others, n, right: a unit's neighbours on either side. At most UNITS rows a side."""
    pairs = counts.filter("kind = 0").select(F.expr(f"CAST(key DIV {UNITS} AS INT)").alias("a"), F.expr(f"CAST(key % {UNITS} AS INT)").alias("b"), "n")
    sides = pairs.select(F.col("a").alias("unit"), F.col("b").alias("other"), "n", F.lit(True).alias("right")).unionByName(pairs.select(F.col("b").alias("unit"), F.col("a").alias("other"), "n", F.lit(False).alias("right")))
    return sides.groupBy("unit").agg(F.collect_list(F.struct("right", "other", "n")).alias("near"))


def _read_near(batches: Iterator[pa.RecordBatch]):
    for b in batches:
        for unit, near in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            v = near.values
            right, other, n = (v.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            yield unit, right.astype(bool), other, n.astype(float)


def cluster(counts: DataFrame, classes: int = CLASSES) -> tuple[np.ndarray, np.ndarray]:
    """(class of each unit, class transition counts), when no unit gains by moving alone.

    Gains are exact for a unit by itself. Of all moves that gain, highest first, the first 1, 2, 4, ... are tried
    together in one job and the number that gains most is made; as one move always gains, each round does.
    """
    near = scratch.keep(_neighbours(counts), "brown-neighbours")
    own = np.arange(UNITS) % classes
    own[END] = classes
    size = classes + 1

    def tables(tried: list[np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = np.zeros((len(tried), size, size))
            for unit, right, other, n in _read_near(batches):
                for i, now in enumerate(tried):
                    t[i, now[unit]] += exchange.class_counts(other[right], n[right], now, size)
            yield pa.RecordBatch.from_arrays([pa.array([t.reshape(-1)], pa.list_(pa.float64()))], ["t"])

        found = near.mapInArrow(trimmed(run), "t array<double>").collect()
        return sum((np.array(r["t"]).reshape(-1, size, size) for r in found), np.zeros((len(tried), size, size)))

    def moves(now: np.ndarray, t: np.ndarray, least: float) -> list[tuple[float, int, int]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            units, to, gains = [], [], []
            for unit, right, other, n in _read_near(batches):
                if unit != END:
                    r, l_ = (exchange.class_counts(other[s], n[s], now, size) for s in (right, ~right))
                    best, gain = exchange.best_class(int(now[unit]), r, l_, float(n[right & (other == unit)].sum()), t, classes)
                    if gain > least:
                        units.append(unit)
                        to.append(best)
                        gains.append(gain)
            yield pa.RecordBatch.from_arrays([pa.array(units, pa.int64()), pa.array(to, pa.int64()), pa.array(gains, pa.float64())], ["unit", "to", "gain"])

        return sorted((-r["gain"], r["unit"], r["to"]) for r in near.mapInArrow(trimmed(run), "unit long, to long, gain double").collect())

    t = tables([own])[0]
    while True:
        now = exchange.objective(t)
        found = moves(own, t, max(1e-6, 1e-12 * abs(now)))  # less is rounding
        tried = []
        for k in sorted({len(found), *(1 << i for i in range(len(found).bit_length()))} - {0}):
            tried.append(own.copy())
            for _, unit, to in found[:k]:
                tried[-1][unit] = to
        after = tables(tried) if tried else np.empty((0, size, size))
        reached = [exchange.objective(x) for x in after]
        if max(reached, default=now) <= now:
            return own, t
        best = int(np.argmax(reached))
        own, t = tried[best], after[best]


@dataclass
class Classes:
    """What decides a token's class: the vocabulary, each unit's class, and each vocabulary word's own."""

    words: Words
    unit: np.ndarray
    place: np.ndarray

    def of(self, place: np.ndarray, unit: np.ndarray) -> np.ndarray:
        own = np.append(self.place, -1)[place]
        return np.where(own >= 0, own, self.unit[unit])


def _word_counts(docs: DataFrame, classes: Classes, size: int) -> DataFrame:
    """range, counts: for `RANGE` words, their counts by class on the right and on the left and with themselves; the class table has range -1.

    A row is the sum over the tasks of one of `SALTS` parts, so there are at most `SALTS` rows of a range.
    """
    sent = docs.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k: Classes = sent.value
        n_words = -(-len(k.place) // RANGE) * RANGE
        sides = np.zeros((2, n_words * size), np.int64)
        itself = np.zeros(n_words, np.int64)
        table = np.zeros(size * size, np.int64)
        for b in batches:
            for _, data, at in blocks(b.column(0)):
                _, of, place, unit = k.words.units(data, at)
                c, _ = _with_ends(k.of(place, unit), of, k.unit[END])
                p, _ = _with_ends(place, of, -1)
                c, p = np.append(k.unit[END], c), np.append(-1, p)
                for side, word, near in ((sides[0], p[:-1], c[1:]), (sides[1], p[1:], c[:-1])):
                    side += np.bincount((word * size + near)[word >= 0], minlength=len(side))
                itself += np.bincount(p[1:][(p[1:] >= 0) & (p[1:] == p[:-1])], minlength=n_words)
                table += np.bincount(c[:-1] * size + c[1:], minlength=len(table))
        by_range = [x.reshape(-1, RANGE * size) for x in sides] + [itself.reshape(-1, RANGE)]
        ranges = ((r, np.concatenate([x[r] for x in by_range])) for r in range(n_words // RANGE) if any(x[r].any() for x in by_range))
        yield from _packed(chain([(-1, table)], ranges))

    found = docs.filter("train").select("text").mapInArrow(trimmed(run), "range long, counts binary")
    return _added(found.withColumn("salt", F.spark_partition_id() % SALTS), "range", "salt")


def _packed(rows: Iterable[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    rows = iter(rows)
    while some := list(islice(rows, 64)):
        packed = [pa.compress(x.astype("<i8").tobytes(), codec="zstd", asbytes=True) for _, x in some]
        yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in some], pa.int64()), pa.array(packed, pa.binary())], ["range", "counts"])


def _opened(b: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray]]:
    for r, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
        n = size * size if r < 0 else RANGE * (2 * size + 1)
        yield r, np.frombuffer(pa.decompress(x.as_buffer(), decompressed_size=8 * n, codec="zstd"), "<i8")


def _added(rows: DataFrame, *keys: str, size: int = CLASSES + 1) -> DataFrame:
    """The sums by key. A task holds one sum for each range at most, which the vocabulary bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for r, x in _opened(b, size):
                sums[r] = sums[r] + x if r in sums else x
        yield from _packed(sums.items())

    width = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return rows.repartition(width, *keys).select("range", "counts").mapInArrow(trimmed(run), "range long, counts binary")


def assign(docs: DataFrame, start: Classes, seen: np.ndarray, sweeps: int = SWEEPS) -> tuple[Classes, np.ndarray]:
    """(classes, class transition counts) after exchanging the vocabulary's words of `LEAST` counts or more.

    Each scan of the training texts counts every word's neighbours by class and the class table. From them a
    word's gain is exact if it moves alone. All gaining moves are made together; where the next scan shows that
    the objective did not rise, the quarter of them with the highest gains is made instead. The best is kept.
    """
    size = CLASSES + 1

    def scan(now: Classes) -> tuple[DataFrame, np.ndarray]:
        kept = scratch.keep(_word_counts(docs, now, size), "brown-words")
        tables = [np.frombuffer(pa.decompress(bytes(r["counts"]), decompressed_size=8 * size * size, codec="zstd"), "<i8") for r in kept.filter("range < 0").collect()]
        return kept, sum(tables, np.zeros(size * size)).reshape(size, size)

    def moves(kept: DataFrame, now: Classes, t: np.ndarray) -> list[tuple[float, int, int]]:
        """At most one of each word of the vocabulary."""
        sent = docs.sparkSession.sparkContext.broadcast((now.place, seen, t))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, n, table = sent.value
            found = []
            for b in batches:
                for r, x in _opened(b, size):
                    right, left = x[: 2 * RANGE * size].reshape(2, RANGE, size)
                    itself = x[2 * RANGE * size :]
                    for i in range(min(RANGE, len(own) - r * RANGE)):
                        word = r * RANGE + i
                        if n[word] >= LEAST:
                            to, gain = exchange.best_class(int(own[word]), right[i], left[i], float(itself[i]), table, CLASSES)
                            if gain > 1e-6:
                                found.append((word, to, gain))
            cols = list(zip(*found, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["word", "to", "gain"])

        whole = _added(kept.filter("range >= 0"), "range").mapInArrow(trimmed(run), "word long, to long, gain double")
        return sorted((-r["gain"], r["word"], r["to"]) for r in whole.collect())

    best = start
    kept, table = scan(best)
    found, take = moves(kept, best, table), 1.0
    for _ in range(sweeps - 1):
        made = found[: int(np.ceil(len(found) * take))]
        if not made:
            break
        place = best.place.copy()
        place[[w for _, w, _ in made]] = [to for _, _, to in made]
        tried = Classes(best.words, best.unit, place)
        kept, after = scan(tried)
        if exchange.objective(after) > exchange.objective(table):
            best, table = tried, after
            found = moves(kept, best, table)
        else:
            take /= 4
    return best, table


@dataclass
class Model:
    words: Words
    log_count: np.ndarray  # of each vocabulary word: log10(count + ADD)
    known: np.ndarray
    classes: Classes
    transition: np.ndarray  # log10
    emission: np.ndarray  # log10 of what a class's word counts are divided by
    end_share: float
    tokens: int
    distinct: int


def _texts(docs: DataFrame, model: Model) -> DataFrame:
    """Per row what the vocabulary and the classes give: key, doc_id, held_out, n_tokens, share, known, path."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = sent.value
        log_count, known = np.append(m.log_count, 0.0), np.append(m.known, False)
        for b in batches:
            for row, data, at in blocks(b.column(1)):
                h, of, place, unit = m.words.units(data, at)
                n, doc = len(of) - 1, owners(of)
                ids = b.column(0).slice(row, n)
                key = _row_keys(ids, data, at, h, of)
                share = np.bincount(doc, weights=log_count[place], minlength=n) + m.end_share
                some = np.bincount(doc, weights=known[place], minlength=n).astype(np.int64) + (m.tokens > 0)
                c, ends = _with_ends(m.classes.of(place, unit), of, m.classes.unit[END])
                before = np.empty_like(c)
                before[:1], before[1:] = m.classes.unit[END], c[:-1]
                path = np.bincount(owners(ends), weights=m.transition[before, c] - m.emission[c], minlength=n)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), ids, b.column(2).slice(row, n), pa.array(np.diff(ends), pa.int64()), pa.array(share), pa.array(some), pa.array(path)], ["key", "doc_id", "held_out", "n_tokens", "share", "known", "path"])

    return docs.select("doc_id", "text", "held_out").mapInArrow(trimmed(run), "key long, doc_id long, held_out boolean, n_tokens long, share double, known long, path double")


def score_documents(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (the class model's log10 probability)."""
    spark = docs.sparkSession
    d = _prepared(docs)
    w = Words.of(vocabulary(d))
    sent = spark.sparkContext.broadcast(w)
    counts = scratch.keep(_count(d, sent), "brown-counts")
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    shares = scratch.keep(_rare_shares(_rare(d, sent, 4 * width), width), "brown-rare")

    seen = np.zeros(len(w.unit), np.int64)
    for place, n in zip(*counts.filter("kind = 1").select("key", "n").toArrow().to_pydict().values(), strict=True):  # at most VOCABULARY rows
        seen[place] = n
    units, _ = cluster(counts)
    units_of = w.unit.copy()
    for r in counts.filter("kind = 2").select("key").collect():  # at most VOCABULARY rows
        units_of[r["key"] // UNITS] = r["key"] % UNITS
    classes, table = assign(d, Classes(w, units, np.where(units_of >= 0, units[units_of], -1)), seen)
    size, end = len(table), units[END]
    # distinct words by class: those of the vocabulary, and by unit (at most UNITS rows) the others
    per_class = np.bincount(classes.place[(seen > 0) & (classes.place >= 0)], minlength=size)
    for r in shares.filter("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).collect():
        per_class[units[r["key"]]] += r["n"]
    ends = int(round(table[:, end].sum()))
    tokens, kinds = int(round(table.sum())), int(per_class.sum()) + (ends > 0)
    emission = np.log10(table.sum(0) + ADD * (per_class + 1))
    emission[end] = np.log10(ends + ADD)  # an end is certain in its class
    transition = np.log10((table + ADD) / (table.sum(1) + ADD * size)[:, None])
    model = Model(w, np.log10(seen + ADD), seen > 0, classes, transition, emission, float(np.log10(ends + ADD)), tokens, kinds)

    texts = _texts(d, model)
    both = texts.join(_summed(shares, width), "key", "left")
    # rows of one key are equal in id and words, and the shares are of all of them
    rows = F.count("*").over(Window.partitionBy("key"))
    both = both.withColumn("_rows", rows)
    share = F.col("share") + F.coalesce(F.col("_share") / F.col("_rows"), F.lit(0.0))
    known = F.col("known") + F.coalesce(F.expr("_known DIV _rows"), F.lit(0).cast("long"))
    log_all = float(np.log10(tokens + ADD * (kinds + 1)))
    return both.select(
        "doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (share - F.col("n_tokens") * F.lit(log_all)).alias("base_score"), (share + F.col("path")).alias("score"),
    )


def perplexity(scored: DataFrame) -> DataFrame:
    """held_out, tokens, base_perplexity, perplexity (per token)."""
    per = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(F.sum("n_tokens").alias("tokens"), per("base_score").alias("base_perplexity"), per("score").alias("perplexity"))
