"""License scan by diagonal voting.

Every rolling word k-gram of a text that some template has is joined with its places in the templates. A
hit votes for a diagonal (place in the text minus place in the template); diagonals of one template no
farther apart than `slack` words are one candidate span, and spans with enough votes are verified by
aligning the words there with the template's, of which `allowed` may differ. As a word that differs costs
k grams at most, a span needs no more votes than are left then. Phrases use k = 2 and one diagonal in
full; notices k = 3.

Most grams that no template has are left out while the words are cut, by a table of 2^MARK_BITS marks that
has no false negatives; the join decides.

Defined cases: null text is empty; a text without hits has no labels, null places and score 0; every row
is scanned by itself, so repeated rows and ids give repeated results, and a null id stays null; very long
texts are scanned whole; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kmerlake.llm import scratch
from kmerlake.llm.alignment import edits
from kmerlake.llm.license_templates import NOTICES, PHRASES
from kmerlake.llm.textkit import NOT_ALNUM, blocks, owners, rolling, words
from kmerlake.llm.workers import trimmed

PHRASE_GRAM, NOTICE_GRAM = 2, 3
SLACK = 4
MARK_BITS = 20
SHORT = 10  # words
BROADCAST_GRAMS = 200_000


def _hashes(text: str) -> np.ndarray:
    return words(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]), NOT_ALNUM)[0]


class Templates:
    """Numbered templates: phrases first."""

    def __init__(self, phrases: dict[str, str] = PHRASES, notices: list[tuple[str, str]] = NOTICES):
        self.labels = [*phrases.values(), *(label for label, _ in notices)]
        self.words = [_hashes(t) for t in [*phrases, *(t for _, t in notices)]]
        self.n_phrases = len(phrases)
        self.longest = max(map(len, self.words))

    def gram(self, i: int) -> int:
        return PHRASE_GRAM if i < self.n_phrases else NOTICE_GRAM

    def places(self) -> list[tuple[int, int, int]]:
        """(gram hash, template, place)"""
        return [(int(h), i, at) for i, w in enumerate(self.words) for at, h in enumerate(rolling(w, self.gram(i)).view(np.int64))]


def _scan(docs: DataFrame, t: Templates) -> DataFrame:
    """row, doc_id, n_words, hits (place and gram), zones (first place and word hashes around hits)."""
    known = {k: np.unique(np.concatenate([rolling(w, k) for i, w in enumerate(t.words) if t.gram(i) == k])) for k in (PHRASE_GRAM, NOTICE_GRAM)}
    reach = t.longest + SLACK

    def zones(h: np.ndarray, places: np.ndarray) -> list[dict]:
        out: list[list[int]] = []
        for p in np.unique(places).tolist():
            a, b = max(0, p - reach), min(len(h), p + reach)
            if out and a <= out[-1][1]:
                out[-1][1] = b
            else:
                out.append([a, b])
        return [{"start": a, "words": h[a:b].view(np.int64)} for a, b in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        tables = {}
        for k, grams in known.items():
            tables[k] = np.zeros(1 << MARK_BITS, bool)
            tables[k][(grams >> np.uint64(64 - MARK_BITS)).astype(np.int64)] = True
        hit_type = pa.list_(pa.struct([("place", pa.int64()), ("gram", pa.int64())]))
        zone_type = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.list_(pa.int64()))]))
        for batch in batches:
            for first, data, at in blocks(batch.column(1)):
                h, _, _, of = words(data, at, NOT_ALNUM)
                doc, n = owners(of), len(of) - 1
                hits: list[list[dict]] = [[] for _ in range(n)]
                for k in known:
                    g = rolling(h, k)
                    maybe = np.flatnonzero(tables[k][(g >> np.uint64(64 - MARK_BITS)).astype(np.int64)])
                    maybe = maybe[doc[maybe] == doc[maybe + k - 1]]
                    for d, p, x in zip(doc[maybe].tolist(), maybe.tolist(), g[maybe].view(np.int64).tolist(), strict=True):
                        hits[d].append({"place": p - int(of[d]), "gram": x})
                around = [zones(h[of[d] : of[d + 1]], np.array([x["place"] for x in hits[d]])) if hits[d] else None for d in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + np.arange(n)), batch.column(0).slice(first, n), pa.array(np.diff(of), pa.int64()), pa.array(hits, hit_type), pa.array(around, zone_type)],
                    ["row", "doc_id", "n_words", "hits", "zones"],
                )
                row += n

    schema = "row long, doc_id long, n_words long, hits array<struct<place:long,gram:long>>, zones array<struct<start:long,words:array<long>>>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(run), schema)


def _template_places(spark: SparkSession, t: Templates) -> DataFrame:
    places = t.places()
    df = spark.createDataFrame(places, "gram long, template int, at int")
    return F.broadcast(df) if len(places) <= BROADCAST_GRAMS else df


def diagonals(scanned: DataFrame, t: Templates) -> DataFrame:
    """row, template, diagonal, votes."""
    hits = scanned.filter(F.size("hits") > 0).select("row", F.inline("hits"))
    voted = hits.join(_template_places(scanned.sparkSession, t), "gram")
    return voted.groupBy("row", "template", (F.col("place") - F.col("at")).alias("diagonal")).agg(F.count("*").alias("votes"))


def spans(votes: DataFrame, slack: int = SLACK) -> DataFrame:
    """row, template, lo, hi (the diagonals merged), votes."""
    w = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(w) > slack, F.lit(True))
    groups = votes.withColumn("_new", apart.cast("int")).withColumn("_span", F.sum("_new").over(w))
    return groups.groupBy("row", "template", "_span").agg(F.min("diagonal").alias("lo"), F.max("diagonal").alias("hi"), F.sum("votes").alias("votes")).drop("_span")


def allowed(n: int) -> int:
    """Words of a notice that may differ; short ones must stand as they are, for they differ in a word."""
    return 0 if n < SHORT else n // 5


def scan(docs: DataFrame, templates: Templates | None = None) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (label, first word, one after the last, score)."""
    t = templates or Templates()
    scanned = scratch.keep(_scan(docs, t), "license-hits")
    votes = scratch.keep(diagonals(scanned, t), "license-votes")
    grams = {i: len(w) - t.gram(i) + 1 for i, w in enumerate(t.words)}
    needed = F.element_at(F.create_map(*(F.lit(x) for kv in grams.items() for x in kv)), F.col("template"))
    left = {i: max(1, n - NOTICE_GRAM * allowed(len(t.words[i]))) for i, n in grams.items()}
    enough = F.element_at(F.create_map(*(F.lit(x) for kv in left.items() for x in kv)), F.col("template"))
    phrase = votes.filter((F.col("template") < t.n_phrases) & (F.col("votes") == needed)).groupBy("row").agg(
        F.count("*").alias("n_base"), F.min("diagonal").alias("first_word"), F.max("diagonal").alias("last_word"), F.collect_set("template").alias("phrases")
    )
    notice = spans(votes.filter(F.col("template") >= t.n_phrases)).filter(F.col("votes") >= enough)
    notice = notice.groupBy("row").agg(F.collect_list(F.struct("template", "lo", "hi")).alias("candidates"))
    joined = scanned.drop("hits").join(phrase, "row", "left").join(notice, "row", "left")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span_type = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for b in batches:
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            base, labels, score, found = [], [], [], []
            for i in range(b.num_rows):
                own = {t.labels[p] for p in col["phrases"][i].as_py() or []}
                best, kept = float(bool(own)), []
                every = set(own)
                zones = [(z["start"], np.array(z["words"], np.int64).view(np.uint64)) for z in col["zones"][i].as_py() or []] if col["candidates"][i].is_valid else []
                for c in col["candidates"][i].as_py() or []:
                    w = t.words[c["template"]]
                    a, e = max(0, c["lo"] - SLACK), c["hi"] + len(w) + SLACK
                    text = next((h[max(0, a - s) : e - s] for s, h in zones if s <= max(a, 0) < s + len(h) or a <= s < e), np.empty(0, np.uint64))
                    differ = edits(w, text, allowed(len(w)))
                    share = 1 - differ / len(w)
                    if differ <= allowed(len(w)):
                        every.add(t.labels[c["template"]])
                        kept.append({"label": t.labels[c["template"]], "first": max(0, c["lo"]), "end": c["hi"] + len(w), "score": share})
                        best = max(best, share)
                base.append(",".join(sorted(own)))
                labels.append(",".join(sorted(every)))
                score.append(best)
                found.append(sorted(kept, key=lambda x: (x["first"], x["label"])))
            n_base = col["n_base"].fill_null(0)
            yield pa.RecordBatch.from_arrays(
                [col["doc_id"], col["n_words"], n_base, col["first_word"], col["last_word"], pa.array(base, pa.string()), pa.array(labels, pa.string()), pa.array(score, pa.float64()), pa.array(found, span_type)],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,end:long,score:double>>"
    return joined.mapInArrow(trimmed(verify), schema)
