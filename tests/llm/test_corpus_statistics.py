"""Phrases, importance resampling, toxicity: against plain Python, on the whole small table and on odd rows."""
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartflow.llm import phrases, resample, toxicity

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ----------------------------------------------------------------- phrases
def phrase_counts(docs, longest):
    """(lang, words) -> occurrences, and lang -> words."""
    f, n = collections.Counter(), collections.Counter()
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f.update((lang or "und", tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    return f, n


def best_phrases(docs, least, longest, top):
    f, n = phrase_counts(docs, longest)
    rows = collections.defaultdict(list)
    several = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    for (lang, w), a in several.items():
        if any(100 * b >= 80 * a for (other, x), b in several.items() if other == lang and len(x) > len(w)
               and any(x[i:i + len(w)] == w for i in range(len(x) - len(w) + 1))):
            continue
        score, _, left, right = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        rows[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return {(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in rows.items()
            for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])}


def as_set(frame):
    return {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in frame.collect()}


def test_collocations_are_those_of_plain_counting(spark, odd_docs, no_docs, clashing_docs):
    rng = random.Random(4)
    rows = [(i, rng.choice(["en", "de", None, "und"]), " ".join(rng.choice(["New", "york", "city", "é", "the", "a\tb", "of,", "x.y", "big\napple"]) for _ in range(rng.randint(0, 60))))
            for i in range(120)] + [(200, "en", "in the big red house " * 400), (201, "en", None), (202, None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(5)
    want = best_phrases([r[1:] for r in rows], 12, 4, 40)
    for shards, chunk, bits in ((3, 500, 16), (2, 97, 6)):  # a bitmap of 64 bits is full: nothing but time is lost
        assert as_set(phrases.collocations(docs, 12, 4, 40, shards=shards, chunk=chunk, filter_bits=bits)) == want
    assert phrases.collocations(no_docs).count() == 0
    assert as_set(phrases.collocations(clashing_docs, 5)) == best_phrases([(r.lang, r.text) for r in odd_docs.collect()], 5, 4, 2000)


def test_phrases_over_the_borders_of_slices_and_chunks(spark, monkeypatch):
    text = "one two three four five. " * 300 + "six " * 500
    docs = spark.createDataFrame([("en", text)], "lang string, text string")
    want, n = phrase_counts([("en", text)], 4)
    for size in (16, 333):
        monkeypatch.setattr(phrases, "SLICE", size)
        parts = list(phrases.word_parts(text))
        assert sum(len(p) for p in parts) == n["en"] + 300 and len(parts) > 5
    got, words = phrases.frequent_phrases(docs, 7, 4, chunk=50)
    assert {("en", tuple(r.phrase.split())): r.total for r in got.collect()} == {k: a for k, a in want.items() if a >= 7}
    assert words.first().n == n["en"]


def test_scores_are_exact_beyond_64_bits(spark):
    big = 9_000_000_000_000
    frame = spark.createDataFrame([(big, big, big + 1)], "a long, l long, r long")
    value = F.expr("CAST(CAST(a AS decimal(20,0)) * 2000000 div (CAST(l AS decimal(20,0)) + CAST(r AS decimal(20,0))) AS BIGINT)")
    assert frame.select(value.alias("s")).first().s == 2_000_000 * big // (2 * big + 1)


# ----------------------------------------------------------------- importance resampling
def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def buckets_of(text):
    w = words_of(text)
    return [zlib.crc32(" ".join(w[i:i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plain_scores(docs, target):
    """(doc_id, n_features, weight, score) and how many are drawn."""
    found = [(i, len(words_of(t)), buckets_of(t)) for i, t in docs]
    s, t = collections.Counter(b for _, _, bs in found for b in bs), collections.Counter(b for x in target for b in buckets_of(x))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (S + 10_000.0) / ((s[b] + 1.0) * (T + 10_000.0)))) for b in range(10_000)]
    rows = []
    for i, words, bs in found:
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in bs)
        rows.append((i, words, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, -r[3]))
    drawn = order[:5 * len(order) // 100]
    return rows, drawn


def test_crc_of_spans_is_the_library_s():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 20_000).astype(np.uint8)
    at, size = rng.integers(0, 15_000, 2000), rng.integers(1, 5000, 2000)
    size[:500] = rng.integers(1, 20, 500)
    for positions in (4, 16, 512):
        got = resample.PositionCrc(positions).of_spans(data, at, size)
        assert got.tolist() == [zlib.crc32(data[a:a + n].tobytes()) for a, n in zip(at, size)]


def test_features_of_sliced_texts(monkeypatch):
    texts = ["", "A b-c Ü2 d", "x" * 3000 + " y z", "one two three four " * 40, "  é😀 ß_"]
    monkeypatch.setattr(resample.slices, "__defaults__", (30,))
    monkeypatch.setattr(resample, "SLICE", 64)
    monkeypatch.setattr(resample, "LOOKED_UP", 50)
    got = collections.defaultdict(list)
    for _, document, bucket in resample.features(texts, resample.PositionCrc(8), 10_000, 3):
        for d, b in zip(document.tolist(), bucket.tolist()):
            got[d].append(b)
    for i, text in enumerate(texts):
        assert sorted(got[i]) == sorted(buckets_of(text))


def test_weights_scores_and_draws_are_those_of_plain_python(spark, odd_docs, no_docs, clashing_docs):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    target = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    ties = [(10 ** 6 + i, "the same words of a text that is long enough to be drawn from all documents of the table and more") for i in range(40)]
    docs = table.union(spark.createDataFrame(ties + [(10 ** 6, ties[0][1]), (None, ties[0][1])], table.schema))
    rows, drawn = plain_scores([tuple(r) for r in docs.collect()], [r.text for r in target.collect()])
    got = resample.scored(docs, target).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got), key=str) == sorted(rows, key=str)
    assert [r.doc_id for r in sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])] == [r[0] for r in drawn]
    assert sorted(r["rank"] for r in got if r["rank"] is not None) == list(range(1, len(drawn) + 1))
    out = resample.resampled(clashing_docs, target, least_words=1, percent=50)
    assert out.columns == clashing_docs.columns and out.count() == 3  # of 6 with words
    odd = resample.scored(odd_docs, no_docs).collect()
    assert len(odd) == odd_docs.count() and all(r.weight == 0 for r in odd if r.n_words == 0)
    assert resample.scored(no_docs, target).count() == 0 and resample.resampled(no_docs, target).count() == 0


# ----------------------------------------------------------------- toxicity
def test_corrected_risk_never_rewards_a_negative_part():
    margins, positive = np.array([3.0, 2.0, -4.0, -5.0]), np.array([True, True, False, False])
    slope = toxicity.nonnegative_slope(margins, positive, 0.4)
    assert (slope[:2] > 0).all() and (slope[2:] < 0).all()  # the second risk is below zero: up on it alone
    slope = toxicity.nonnegative_slope(np.array([-1.0, 1.0, 2.0, 3.0]), positive, 0.2)
    h, base = 1e-6, np.array([-1.0, 1.0, 2.0, 3.0])

    def risk(m):
        loss = lambda x: np.logaddexp(0, x)
        return 0.2 * loss(-m[:2]).mean() + loss(m[2:]).mean() - 0.2 * loss(m[:2]).mean()
    assert np.allclose(slope, [(risk(base + h * e) - risk(base - h * e)) / (2 * h) for e in np.eye(4)], atol=1e-6)


def made_docs(spark, n=1500):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows = []
    for i in range(n):
        toxic = rng.random() < 0.2
        text = [rng.choice(words) for _ in range(rng.randint(5, 200))]
        for _ in range(rng.randint(2, 5) if toxic else 0):
            text.insert(rng.randint(0, len(text)), rng.choice(["Vilword", "awfulling", "awfulless"]))
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def test_held_out_documents_are_told_apart_from_positives_and_unlabelled_text_alone(spark):
    rows = made_docs(spark)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    # clean labels are used for the prior only: here it is given, and only positives are labelled
    labels = spark.createDataFrame([(i, 1) for i, _, y in rows if y and i % 3], "doc_id long, toxic int").where(toxicity.in_training())
    model = toxicity.train(docs.where(toxicity.in_training()), labels, prior=0.2)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    held = [(got[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 200 and all(0 <= s <= 1 for s, _ in held)
    assert sum((s >= 0.5) == bool(y) for s, y in held) > 0.97 * len(held)
    again = toxicity.train(docs.where(toxicity.in_training()).repartition(7), labels, prior=0.2)
    assert (again.weights == model.weights).all() and again.place == model.place


def test_toxicity_of_the_table(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs.where(toxicity.in_training()), labels.where(toxicity.in_training()))
    rows = toxicity.score(docs, model, ["doc_id"]).join(labels, "doc_id").where(~toxicity.in_training()).collect()
    assert sum((r.score >= 0.5) == (r.toxic == 1) for r in rows) > 0.95 * len(rows)
    good, bad = [r.score for r in rows if not r.toxic], [r.score for r in rows if r.toxic]
    assert sum((b > g) + (b == g) / 2 for b in bad for g in good) > 0.95 * len(bad) * len(good)


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs, clashing_docs):
    labels = spark.createDataFrame([(1, 0), (5, 1), (5, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    model = toxicity.train(odd_docs, labels)
    rows = toxicity.score(clashing_docs, model, ["doc_id", "score"]).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 5}) == 1
    for nothing in (toxicity.train(no_docs, labels), toxicity.train(odd_docs, labels.limit(0))):
        assert nothing is None and {r.score for r in toxicity.score(odd_docs, nothing, ["doc_id"]).collect()} == {0.0}
    assert toxicity.score(no_docs, model, ["doc_id"]).count() == 0


@pytest.mark.parametrize("prior", [0.001, 0.5])
def test_even_odds_lie_in_the_widest_gap_of_least_error(prior):
    margins = np.array([5.0, 6.0, 5.5, -3.0, -2.0, -2.5, 5.2])
    positive = np.array([True, True, True, False, False, False, False])
    at = toxicity.even_margin(margins, positive, prior)
    assert -3.0 <= at <= 6.0
    assert toxicity.even_margin(np.zeros(4), np.array([True, False, True, False]), prior) == 0.0
