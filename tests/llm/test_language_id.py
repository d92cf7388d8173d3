import math
import random
import zlib

import numpy as np
import pyarrow as pa

from kmerlake.llm import language_id
from tests.llm.fixtures import corpus, empty, frame


def predicted(docs):
    return language_id.identify(docs.select("doc_id", "text"), language_id.fit(docs)).collect()


def test_held_out_accuracy(spark):
    rows = corpus(400)
    docs = frame(spark, rows)
    truth = {r[0]: r[2] for r in rows if r[0] is not None and r[0] < 1000}
    held = [r for r in predicted(docs) if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["text"] and len(r["text"]) > 60]
    assert len(held) > 40
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and not r["rejected"] for r in held)


def test_no_letters_is_unknown_and_labels_do_not_leak(spark):
    docs = frame(spark)
    model = language_id.fit(docs)
    for r in language_id.identify(docs, model).collect():
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters)
        assert r["rejected"] or letters
    swapped = docs.selectExpr("doc_id", "text", "'xx' AS lang", "'yy' AS source")
    a = {(r["text"], r["lang_pred"], r["score"]) for r in language_id.identify(docs, model).collect()}
    assert a == {(r["text"], r["lang_pred"], r["score"]) for r in language_id.identify(swapped, model).collect()}


def test_nothing_to_learn_from(spark):
    docs = frame(spark).selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang")
    assert {r["lang_pred"] for r in predicted(docs)} == {"und"}
    assert predicted(empty(spark)) == []


def test_other_scripts_are_rejected_clean_texts_stay(spark):
    rows = corpus()
    rows.append((5000, "漢字仮名交じり文の例です。" * 20, "ja0", "odd", 0))
    kept = {r["doc_id"] for r in language_id.keep_identified(frame(spark, [(*r[:2], None if r[2] == "ja0" else r[2], *r[3:]) for r in rows])).collect()}
    assert 5000 not in kept
    assert set(range(120)) <= kept


def junk(rng, n=500):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))


FINNISH = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. " * 2


def test_unlearned_texts_in_known_letters_are_rejected(spark):
    rng = random.Random(4)
    rows = corpus(900) + [(6000 + i, junk(rng), None, "odd", 0) for i in range(30)] + [(6100, FINNISH, None, "odd", 0)]
    kept = {r["doc_id"] for r in language_id.keep_identified(frame(spark, rows)).collect()}
    assert not kept & {*range(6000, 6030), 6100}
    assert {r[0] for r in rows if r[0] is not None and r[0] < 900} <= kept


def test_clusters_are_no_outliers():
    rng = np.random.default_rng(3)
    v = np.abs(rng.normal(0, 0.05, (300, 12)))
    v[:150, 0] += 1
    v[150:299, 1] += 1
    v[299, 11] += 1  # the only one of its kind
    v = (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32)
    for seed in range(5):
        c = language_id._cluster(v, 4, np.random.default_rng(seed))
        assert c[:, 11].max() < 0.5 and c[:, 0].max() > 0.9 and c[:, 1].max() > 0.9


def brute_vector(text, idf):
    """Counts of hashed n-grams, then TF-IDF of length one, byte by byte."""
    low = "".join(c.lower() if c.isascii() or "À" <= c <= "Þ" and c != "×" else c for c in text or "").encode()
    out = []
    for b in low:
        if 97 <= b <= 122 or b >= 128:
            out.append(b)
        elif not out or out[-1] != 32:
            out.append(32)
    if low and not (97 <= low[0] <= 122 or low[0] >= 128):
        # the first byte stands even if it is none, and so does the one after a letter
        out = [32] + out[1:]
    n = {}
    for order in language_id.ORDERS:
        for i in range(len(out) - order + 1):
            code = order
            for b in out[i : i + order]:
                code = code << 8 | b
            place = ((code * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - language_id.BITS)
            n[place] = n.get(place, 0) + 1
    v = {p: math.log1p(c) * float(idf[p]) for p, c in n.items()}
    norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
    return {p: x / norm for p, x in v.items()}


def test_equals_brute_force(spark):
    rows = corpus(300)
    docs = frame(spark, rows)
    model = language_id.fit(docs)
    for r in language_id.identify(docs.select("doc_id", "text"), model).collect():
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        v = brute_vector(r["text"], model.idf)
        cosine = [sum(x * float(c[p]) for p, x in v.items()) for c in model.centroids]
        best = max(cosine)
        assert abs(r["score"] - best) < 1e-4
        assert r["lang_pred"] in {m for m, c in zip(model.languages, cosine, strict=True) if c > best - 1e-4}
        assert abs(best - model.limits[int(math.log2(max(len(v), 1)))]) < 1e-4 or r["rejected"] == (best < model.limits[int(math.log2(max(len(v), 1)))])


def test_long_texts_and_clashing_names(spark):
    docs = frame(spark, [*corpus(60), (9000, "der die und das ist " * 200_000, None, "odd", 0)]).selectExpr("*", "'x' AS lang_pred", "0 AS score", "1 AS place", "2 AS held")
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns
    assert 9000 in {r["doc_id"] for r in kept.select("doc_id").collect()}


def test_counts_are_of_whole_texts():
    (_, counts), = language_id.gram_counts(pa.array(["ab" * 100_000]))
    assert counts.sum() == 200_000 + 199_999 + 199_998
