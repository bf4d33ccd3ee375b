import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veridelta.llm import mixing as M
from veridelta.llm import sizes

VOCABULARY = os.path.join(sizes.FOLDER, sizes.VOCABULARY)
needs = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="vocabulary isn't here")
TARGETS = [("m", "a", 0.5, 1), ("m", "b", 0.3, 4), ("m", "none", 0.2, 9), ("n", "a", 0.1, 2), ("n", "c", 0.9, 1)]


def tables(spark):
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choices(["mill", "archive", "vote", "ledger"], k=n))
    docs = [(i, s, text(rng.randrange(5, 60))) for i, s in enumerate(["a"] * 1500 + ["b"] * 300 + ["c"] * 700 + ["x"] * 50)] + [(9000, "a", None), (9001, "a", ""), (9002, None, "words here")]
    return spark.createDataFrame(docs, "doc_id long, source string, text string"), spark.createDataFrame(TARGETS, "mix_id string, source string, target_share double, max_repeats int")


@needs
def test_shares_and_caps(spark):
    df, targets = tables(spark)
    for c in ("tokens", "use", "chunk", "k", "_wanted", "h", "slot"):
        df = df.withColumn(c, F.lit(1))
    out = M.mix(df, targets, VOCABULARY).cache()
    uses = Counter((r.mix_id, r.doc_id) for r in out.collect())
    most = {(m, s): r for m, s, _, r in TARGETS}
    source = {r.doc_id: r.source for r in df.collect()}
    assert all(n <= most[(m, source[d])] for (m, d), n in uses.items())
    assert out.groupBy("mix_id", "doc_id", "use").count().where("count > 1").count() == 0
    rep = {(r.mix_id, r.source): r for r in M.report(out, targets).collect()}
    assert rep[("m", "none")].actual_share == 0 and rep[("m", "none")].drawn == 0
    for (m, s), want in {("m", "a"): 0.625, ("m", "b"): 0.375, ("n", "a"): 0.1, ("n", "c"): 0.9}.items():
        assert rep[(m, s)].actual_share == pytest.approx(want, abs=0.02)
    assert all(r.spans >= 1 for r in out.collect())
    # every stretch of the mix is mixed
    firsts = out.where("mix_id = 'm' and slot < 40").groupBy("source").agg(F.sum("tokens").alias("t")).collect()
    total = sum(r.t for r in firsts)
    assert {r.source: r.t / total for r in firsts}["a"] == pytest.approx(0.625, abs=0.1)


@needs
def test_chunks_change_nothing(spark, monkeypatch):
    df, targets = tables(spark)
    one = M.schedule(spark, {"m": (5000, [("a", 0.0, 0.7), ("b", 0.7, 1.0)])}).collect()
    monkeypatch.setattr(M, "CHUNK", 300)
    two = M.schedule(spark, {"m": (5000, [("a", 0.0, 0.7), ("b", 0.7, 1.0)])}).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))
    k = sorted(r.k for r in two if r.source == "a")
    assert k == list(range(len(k))) and abs(len(k) - 3500) <= 3
    out = M.mix(df, targets, VOCABULARY, block=256)
    assert out.groupBy("mix_id", "doc_id", "use").count().where("count > 1").count() == 0


def test_schedule_finds_the_source_of_every_point(spark):
    """Many sources, narrow ones among them: by the table of cells as by walking through the weights."""
    rng = random.Random(4)
    w = [rng.random() ** 4 + 1e-5 for _ in range(300)]
    cum, at = [], 0.0
    for i, x in enumerate(w):
        to = 1.0 if i == len(w) - 1 else at + x / sum(w)
        cum.append((f"s{i:03d}", at, to))
        at = to
    got = {r.slot: r.source for r in M.schedule(spark, {"m": (4000, cum), "n": (7, cum[:0] + [("only", 0.0, 1.0)])}).where("mix_id = 'm'").collect()}
    assert len(got) == 4000
    for i in range(0, 4000, 7):
        u = (i + 0.5) * M.GOLDEN % 1.0
        assert got[i] == next(s for s, _, to in cum if u < to)


@needs
def test_documents_longer_than_a_slot(spark):
    df = spark.createDataFrame([(i, "a", "mill " * (900 if i % 3 == 0 else 20)) for i in range(60)], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("m", "a", 1.0, 1)], "mix_id string, source string, target_share double, max_repeats int")
    rows = M.mix(df, targets, VOCABULARY).collect()
    starts = {r.slot for r in rows}
    filled = sum(r.spans - 1 for r in rows)
    assert max(r.spans for r in rows) >= 4 and len(starts) < max(starts) + 1
    assert M.report(spark.createDataFrame(rows), targets).first().spanned == filled


@needs
def test_empty_and_bad(spark):
    df, targets = tables(spark)
    assert M.mix(df.limit(0), targets, VOCABULARY).count() == 0
    assert M.mix(df, targets.limit(0), VOCABULARY).count() == 0
    with pytest.raises(ValueError):
        M.mix(df, targets.withColumn("target_share", F.lit(-1.0)), VOCABULARY)


def test_counts_as_the_library_does():
    if not os.path.exists(VOCABULARY):
        pytest.skip("vocabulary isn't here")
    enc = sizes.encoder(VOCABULARY)
    texts = ["a b c", "图书馆", "<|endoftext|> x", None, "", "\ud800 y"]
    got = sizes.count_tokens(texts, VOCABULARY)
    assert got[:3] == [len(enc.encode_ordinary(t)) for t in texts[:3]] and got[3:5] == [0, 0] and got[5] > 0
    assert enc.decode(enc.encode_ordinary(texts[1])) == texts[1]
