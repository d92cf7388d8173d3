"""Language identification by the nearest of several centroids a language.

A document is a TF-IDF vector of letter n-grams (one to three bytes of the folded text, everything but
letters being one space), hashed into BUCKETS, with log counts and length one. Each language's sample is
split into CLUSTERS centroids by spherical k-means; the nearest centroid by cosine names the language.

Rejection is by distance. A part of the sample that took no part in the clustering tells how near to their
centroid texts of a length (a power of two of different n-grams) are: a document goes if its cosine is less
than REJECT_SHARE of that of the LOW_SHARE farthest of them. Texts with fewer than EVIDENCE different
n-grams (some 100 letters) are too short to tell; they go only if they have no letter.

The classifier is fitted on about SAMPLE_DOCS labelled rows a language, chosen by a hash of the id;
prediction is over all rows and whole texts.

Defined cases: null text, or text without any letter, is `und` with score 0 and rejected; rows without a
label are not learned from; a null id is neither learned from nor held out; with nothing to learn from, all
are `und`; ties go to the first centroid by language and number; repeated rows are predicted each; very long
texts count whole; other columns pass through or are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kmerlake.llm import scratch
from kmerlake.llm.columns import add_columns
from kmerlake.llm.textkit import FOLD, blocks
from kmerlake.llm.workers import trimmed

BITS = 12
BUCKETS = 1 << BITS
ORDERS = (1, 2, 3)
CLUSTERS = 4
SWEEPS = 8
SAMPLE_DOCS = 1000  # a language
LEAST_CLUSTER = 0.02  # of a language's rows; smaller ones are outliers and no centroid
HELD_FOR_LIMITS = 5  # one in so many sampled rows
LOW_SHARE, REJECT_SHARE = 0.01, 0.4
FLOOR = 0.05  # a cosine below is always rejected
EVIDENCE = 256
LEAST_ROWS = 20  # to set a limit by
UNKNOWN = "und"
CHUNK = 128  # documents counted at a time

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True


def gram_counts(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, counts): a row of bucket counts for each text, CHUNK texts at a time."""
    for row, data, at in blocks(texts):
        for i in range(0, len(at) - 1, CHUNK):
            cut = at[i : i + CHUNK + 1]
            yield row + i, _count(data[cut[0] : cut[-1]], cut - cut[0])


def _count(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    n = len(at) - 1
    low = FOLD[data]
    # capitals of the Latin-1 block: C3 80 to C3 9E but for the multiplication sign
    capital = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)
    low[1:][capital] += 32
    letter = _LETTER[low]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[at[:-1][at[:-1] < len(keep)]] = True
    low[~letter] = 32
    x, doc = low[keep].astype(np.uint32), np.repeat(np.arange(n), np.diff(at))[keep]
    total = np.zeros(n * BUCKETS, np.int64)
    for order in ORDERS:
        if len(x) < order:
            break
        m = len(x) - order + 1
        code = np.full(m, order, np.uint32)
        for i in range(order):
            code = code << np.uint32(8) | x[i : i + m]
        place = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        inside = doc[:m] == doc[order - 1 :]
        total += np.bincount((doc[:m] * BUCKETS + place)[inside], minlength=n * BUCKETS)
    return total.reshape(n, BUCKETS)


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts).astype(np.float32) * idf
    norm = np.sqrt(np.einsum("ij,ij->i", v, v))
    return v / np.maximum(norm, 1e-12)[:, None]


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    limits: np.ndarray  # the least cosine by length class
    idf: np.ndarray


def learnable(key: str = "doc_id") -> Column:
    """Rows to learn from; the others are held out."""
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(5)) != 0


def _sample(docs: DataFrame, bound: int) -> DataFrame:
    labelled = docs.filter(F.coalesce(learnable(), F.lit(False)) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rates = labelled.groupBy("lang").agg((F.lit(bound * 1.0) / F.count("*")).alias("_rate")).withColumnRenamed("lang", "_lang")
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # one row a language
    rates = scratch.keep(rates, "language-rates")
    return labelled.join(rates, F.col("lang") == F.col("_lang")).filter(at < F.col("_rate")).select("doc_id", "lang", "text")


LENGTHS = BITS + 1


def _length_class(counts: np.ndarray) -> np.ndarray:
    """Power of two of the different n-grams of each row."""
    return np.log2(np.maximum((counts > 0).sum(1), 1)).astype(int)


def _limits(cosine: np.ndarray, length: np.ndarray) -> np.ndarray:
    """By length class, the cosine below which a text is rejected."""
    out = np.full(LENGTHS, FLOOR)
    for c in range(int(np.log2(EVIDENCE)), LENGTHS):
        own = cosine[length == c]
        out[c] = max(FLOOR, REJECT_SHARE * np.quantile(own, LOW_SHARE)) if len(own) >= LEAST_ROWS else out[c - 1]
    return out


def _cluster(v: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids by spherical k-means: seeds drawn by squared distance (k-means++), clusters of outliers seeded again and left out at the end."""
    v = v[np.einsum("ij,ij->i", v, v) > 0.5]  # without empty texts
    if not len(v):
        return v
    seeds = [int(rng.integers(len(v)))]
    while len(seeds) < min(k, len(v)):
        far = np.clip(1 - (v @ v[seeds].T).max(1), 0, None) ** 2
        seeds.append(int(rng.choice(len(v), p=far / far.sum())) if far.sum() > 0 else int(rng.integers(len(v))))
    c = v[seeds].copy()
    least = max(1, int(LEAST_CLUSTER * len(v)))
    for sweep in range(SWEEPS + 1):
        own = np.argmax(v @ c.T, axis=1)
        size = np.bincount(own, minlength=len(c))
        if sweep == SWEEPS:
            return c[size >= least] if (size >= least).any() else c
        for j in range(len(c)):
            if size[j] >= least:
                m = v[own == j].mean(0)
                c[j] = m / max(float(np.linalg.norm(m)), 1e-12)
            else:
                c[j] = v[rng.choice(np.flatnonzero(own == size.argmax()))]


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, clusters: int = CLUSTERS) -> Model:
    """docs: doc_id, text, lang."""

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, counts in gram_counts(b.column(2)):
                doc, place = np.nonzero(counts)
                at = pa.array(np.searchsorted(doc, np.arange(len(counts) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (place, counts[doc, place])]
                yield pa.RecordBatch.from_arrays([b.column(i).slice(row, len(counts)) for i in (0, 1)] + lists, ["doc_id", "lang", "place", "n"])

    sample = _sample(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text"), sample_docs)
    rows = scratch.keep(sample.mapInArrow(trimmed(sparse), "doc_id long, lang string, place array<int>, n array<int>"), "language-sample")
    n = rows.count()
    idf = np.full(BUCKETS, np.log(n + 1.0), np.float32)
    for r in rows.select(F.explode("place").alias("p")).groupBy("p").count().collect():  # a row a bucket
        idf[r["p"]] = np.log((n + 1.0) / (r["count"] + 1.0)) + 0.05

    def dense(pdf: pd.DataFrame) -> np.ndarray:
        counts = np.zeros((len(pdf), BUCKETS), np.int64)
        for i, (place, k) in enumerate(zip(pdf["place"], pdf["n"], strict=True)):
            counts[i, place] = k
        return counts

    def centroids(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "size"])
        kept = pdf[~pdf["held"]] if len(pdf) >= 2 * HELD_FOR_LIMITS else pdf
        c = _cluster(_vectors(dense(kept), idf), clusters, np.random.default_rng(len(kept)))
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "cluster": range(len(c)), "centroid": list(c.astype(float))})

    # about SAMPLE_DOCS rows a group; a few centroids a language come to the driver
    held = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(HELD_FOR_LIMITS)) == 0
    split = rows.withColumn("held", held).withColumn("size", F.size("place"))
    found = split.groupBy("lang").applyInPandas(centroids, "lang string, cluster int, centroid array<double>").orderBy("lang", "cluster").collect()
    stacked = np.array([r["centroid"] for r in found], np.float32).reshape(-1, BUCKETS)

    def nearness(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), CHUNK):
                counts = dense(pdf.iloc[i : i + CHUNK])
                cosine = (_vectors(counts, idf) @ stacked.T).max(1) if len(stacked) else np.zeros(len(counts))
                yield pd.DataFrame({"cosine": cosine.astype(float), "length": _length_class(counts)})

    # a fifth of the sample, two numbers a row
    near = split.filter("held").mapInPandas(nearness, "cosine double, length int").toPandas()
    return Model([r["lang"] for r in found], stacked, _limits(near["cosine"].to_numpy(), near["length"].to_numpy()), idf)


def identify(docs: DataFrame, model: Model, prefix: str = "") -> DataFrame:
    """docs and lang_pred, score (the cosine), rejected. Reads the text only."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> list[pa.Array]:
        m = sent.value
        best, score = np.zeros(len(texts), int), np.zeros(len(texts), np.float64)
        letters, far = np.zeros(len(texts), bool), np.zeros(len(texts), bool)
        for row, counts in gram_counts(texts):
            end = row + len(counts)
            letters[row:end] = counts.any(1)
            if len(m.languages):
                cosine = _vectors(counts, m.idf) @ m.centroids.T
                best[row:end] = cosine.argmax(1)
                score[row:end] = np.clip(cosine.max(1), 0, 1)
                far[row:end] = score[row:end] < m.limits[_length_class(counts)]
        for i in np.flatnonzero(letters):
            t = texts[int(i)].as_py()
            letters[i] = any(c.isalpha() for c in t[:64]) or any(c.isalpha() for c in t)
        known = letters & bool(m.languages)
        names = np.array([*m.languages, UNKNOWN], object)
        score[~known] = 0
        return [pa.array(names[np.where(known, best, len(names) - 1)].tolist(), pa.string()), pa.array(score), pa.array(~known | far)]

    added = T.StructType([T.StructField(prefix + "lang_pred", T.StringType()), T.StructField(prefix + "score", T.DoubleType()), T.StructField(prefix + "rejected", T.BooleanType())])
    return add_columns(docs, ["text"], added, run)


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs without those that the classifier, fitted on them, rejects."""
    found = identify(docs, fit(docs), prefix="_kml_")
    return found.filter("NOT _kml_rejected").drop("_kml_lang_pred", "_kml_score", "_kml_rejected")
