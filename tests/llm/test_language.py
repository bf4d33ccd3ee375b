import os

import pytest
from pyspark.sql import functions as F

from veridelta.llm import language as LG

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="samples aren't here")


@pytest.fixture(scope="module")
def samples(spark):
    return [(r.lang, r.text) for r in spark.read.parquet(f"{SF}/lang_samples.parquet").orderBy("sample_id").collect()]


def test_held_out_accuracy(samples):
    """Fit on three quarters of each language, score the rest: labels right, few rejected."""
    seen = {}
    held, used = [], []
    for lang, text in samples:
        seen[lang] = seen.get(lang, 0) + 1
        (held if seen[lang] % 4 == 0 else used).append((lang, text))
    m = LG.fit(used)
    s = LG.Scorer(m).label([t for _, t in held])
    right = wrong = rejected = 0
    for of, lang, ce in zip(s["of"], s["lang"], s["ce"]):
        if lang < 0:
            rejected += 1
        elif m.langs[lang] == held[of][0]:
            right += 1
        else:
            wrong += 1
    assert wrong == 0 and right > 20 * rejected


def test_probabilities_sum_to_one(samples):
    """Of each context that was seen, the shares and the back-off weight make one."""
    import numpy as np

    words = ["ba", "bab", "abba", "cab", "ba"]
    fitted = LG._fit_one(words)
    grams, _ = LG._grams(words, LG.ORDER)
    share = {int(g): float(s) for k in range(LG.ORDER) for g, s in zip(fitted[k][0], fitted[k][1])}
    back = {int(g): float(b) for k in range(LG.ORDER) for g, b in zip(fitted[k][0], fitted[k][2])}
    for k in range(1, LG.ORDER):
        after = {}
        for i in range(1, grams.shape[1]):
            if grams[k][i]:
                after.setdefault(int(grams[k - 1][i - 1]), set()).add(int(grams[k][i]))
        for ctx, gs in after.items():
            assert np.isclose(sum(share[g] for g in gs) + back[ctx], 1, atol=1e-5)


def test_segments_and_cases(spark, samples):
    m = LG.fit(samples)
    by = {}
    for lang, text in samples:
        by.setdefault(lang, text)
    mixed = by["en"] + "\n" + by["ru"]
    data = [(1, by["en"], "en"), (2, by["en"], "en-US"), (3, by["en"], "English"), (4, by["en"], "fr"), (5, by["en"], None), (6, by["en"], "n/a"), (7, mixed, "en"), (8, None, None), (9, "", "en"), (10, by["zh"], "zho"), (11, by["en"] + " (" + by["es"].replace("(", "").replace(")", "") + ")", "en"), (12, by["en"].upper(), "EN"), (13, by["ru"].upper(), "ru"), (14, by["en"], "xx")]
    df = spark.createDataFrame(data, "ord long, text string, language string").withColumn("langs", F.lit(0)).withColumn("_label", F.lit("x")).withColumn("lang", F.lit("x"))
    got = sorted((r.ord, r.lang) for r in LG.label_cases(df, m, ["ord"], "text", "language").collect())
    assert got == [(4, "en"), (5, "en"), (6, "en"), (7, "en"), (7, "ru"), (14, "en")]
    seg = LG.segment_languages(df, m, ["ord"], "text")
    docs = {}
    for r in LG.document_languages(df, m, ["ord"], "text").collect():
        docs.setdefault(r.ord, []).append(r)
    assert set(docs) == set(range(1, 15)) and [r.lang for r in docs[8] + docs[9]] == [None, None]
    assert sorted(r.lang for r in docs[7]) == ["en", "ru"] and sum(r.share for r in docs[7]) == pytest.approx(1)
    assert docs[1][0].lang == "en" and docs[1][0].share == 1 and docs[1][0].confidence > 0.9 and docs[8][0].confidence is None
    assert {r.lang for r in seg.where("ord = 7 and lang is not null").collect()} == {"en", "ru"}
    assert all(0 < r.confidence <= 1 for r in seg.collect())
    assert LG.label_cases(df.limit(0), m, ["ord"], "text", "language").count() == 0


def test_confidence_is_calibrated(samples):
    """The temper is fitted on a held-out fifth; on another quarter that neither models nor temper have seen, confidence is near accuracy."""
    seen, held, used = {}, [], []
    for lang, text in samples:
        seen[lang] = seen.get(lang, 0) + 1
        (held if seen[lang] % 4 == 0 else used).append((lang, text))
    m = LG.fit(used)
    assert m.temper in LG.TEMPERS[1:-1] and m.error < 0.05
    fresh = [(m.langs.index(x), t) for x, t in held]
    pieces = [(j, " ".join(w[a : a + n])) for j, t in fresh for s in LG.segments(t) for w in [s.split()] for n in LG.PIECES for a in range(0, len(w) - n + 1, n)]
    got = LG.Scorer(m).label([t for _, t in pieces])
    right = got["ce"].argmin(axis=1) == [pieces[i][0] for i in got["of"]]
    gap = 0.0
    for lo in range(10):
        own = (got["confidence"] >= lo / 10) & (got["confidence"] < (lo + 1) / 10 + (lo == 9))
        if own.any():
            gap += abs(got["confidence"][own].mean() - right[own].mean()) * own.mean()
    print("temper", m.temper, "error", m.error, "fresh", gap)
    assert gap < 0.06


def test_samples_are_drawn_for_each_language(spark, samples, monkeypatch):
    """A bound on the samples takes none of the languages away, wherever they stand in the alphabet."""
    monkeypatch.setattr(LG, "FIT_ROWS", 15)
    df = spark.createDataFrame(samples * 2, "lang string, text string")
    m = LG.models_from(df)
    assert m.langs == sorted({x for x, _ in samples})
    monkeypatch.setattr(LG, "MOST_LANGUAGES", 3)
    with pytest.raises(ValueError):
        LG.models_from(df)


def test_noise_is_rejected(samples):
    s = LG.Scorer(LG.fit(samples)).label(["zxq vvk qqj xkz wqx zzq kkx", "Terms | Privacy", "Ada Byron", "12 34 56"])
    assert (s["lang"] < 0).all()


def test_very_long_text(samples):
    text = (samples[0][1] + " ") * 3000
    s = LG.Scorer(LG.fit(samples)).label([text])
    assert (s["of"] == 0).all() and len(s["of"]) > 2000
