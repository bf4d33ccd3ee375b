import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridelta.llm import repetition as R


def texts(seed=0, n=120):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = [f"w{rng.choice('abcdefgh')}{rng.choice('ijklmnop')}{rng.choice('qrstuv')}" for _ in range(rng.randrange(5, 80))]
        if rng.random() < 0.4:
            a = rng.randrange(len(words))
            words += words[a : a + rng.randrange(5, 40)] * rng.choice((1, 3))
        t = " ".join(words)
        out.append(t.upper() if rng.random() < 0.1 else t.replace(" w", ", W", 2))
    han = "图书馆屋顶基金会议时间地点人物事件记录说明来源"
    for _ in range(30):
        s = "".join(rng.choices(han, k=rng.randrange(10, 90)))
        out.append(s + "，" + s[:30] * rng.choice((0, 1, 2)))
    return [*out, "", "7 8 9", "spam " * 400, "a b\nc d\n" * 20]


def test_equals_brute_force():
    ts = texts()
    got, share = R.measure([*ts, None]), R.shares([*ts, None])
    assert np.allclose(share[:-1], [R.exact_share(t) for t in ts]) and (got[-1] == [0, 0, 0, 1, 1]).all() and share[-1] == 0
    assert (got >= 0).all() and (got <= 1).all()
    phrases, short = got[:, 1], got[:, 0]
    assert (phrases >= share - 1e-12).all() and (short >= phrases - 1e-12).all()  # the bound of the last rule


def test_blocks_change_nothing(monkeypatch):
    ts = texts(3)
    whole = R.measure(ts)
    monkeypatch.setattr(R, "BLOCK_CHARS", 500)
    assert np.allclose(R.measure(ts), whole)


def test_case_digits_and_spacing_do_not_count():
    a = "the old mill burned down and nobody knew why it did so"
    assert R.shares([a + ". 12 " + a.upper().replace(" ", "  ")])[0] == pytest.approx(0.5)
    assert R.shares(["one two three four five six seven eight nine " * 1])[0] == 0


def test_learned_list(monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.random((3000, 5))
    y = ((x[:, 0] > 0.8) & (x[:, 1] > 0.5)) | (x[:, 3] < 0.1)
    rules = R.learn(x, y)
    hit = np.zeros(len(x), bool)
    for r in rules:
        hit |= R._holds(r, x)
    assert (hit == y).mean() > 0.98 and 1 <= len(rules) <= 12
    assert R.learn(x, np.zeros(3000, bool)) == [] and R.learn(x[:0], y[:0]) == []


def test_list_in_spark_is_the_list_in_numpy(spark):
    ts = texts(5)
    data = [(i, t) for i, t in enumerate(ts)] + [(999, None)]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("rule", F.lit("x")).withColumn("repeated", F.lit("x")).withColumn("label", F.lit("x"))
    rules = R.fit(df)
    got = {r.doc_id: r for r in R.classify(df, rules=rules).collect()}
    x = R.measure(ts)
    assert rules[-1] == R.BOUND and all(R.STATISTICS[j] != "repeated" for r in rules for j, _, _ in r)
    for i in range(len(ts)):
        first = next((k + 1 for k, r in enumerate(rules) if R._holds(r, x[i : i + 1])[0]), 0)
        assert got[i].rule == first
    found = {r.doc_id: r for r in R.repetitive(df, rules=rules).collect()}
    assert set(found) == {i for i, t in enumerate(ts) if R.exact_share(t) >= R.SHARE}
    assert all(r.rule == got[i].rule and np.isclose(r.repeated, R.exact_share(ts[i])) for i, r in found.items())
    assert R.repetitive(df, rules=[[(1, ">=", 2.0)]]).count() == 0  # without a rule that flags it, a document isn't found
    assert got[999].rule == 0 and got[999].repeated == 0


def test_one_repetitive_document_among_thousands(spark):
    rng = random.Random(2)
    data = [(i, " ".join(f"w{rng.choice('abcdefgh')}{rng.choice('ijklmnop')}{rng.choice('qrstuv')}" for _ in range(15))) for i in range(6000)]
    data[4321] = (4321, " ".join("the old mill burned down and nobody knew why it did so".split() * 3))
    got = R.repetitive(spark.createDataFrame(data, "doc_id long, text string"))
    assert [r.doc_id for r in got.collect()] == [4321]
    alone = R.classify(spark.createDataFrame(data[4321:4322], "doc_id long, text string"))
    assert alone.where("rule > 0").count() == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert R.classify(df).count() == 0 and R.repetitive(df).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="documents aren't here")
def test_learned_rules_on_documents_they_have_not_seen(spark):
    """Precision and recall of the learned rules alone, without the bound and the exact check, on the documents outside the sample."""
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    x, y = R.sample(df, rows=3000)
    rules = R.learn(x, y)
    seen = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(9)), F.lit(2**31)) < int(2**31 * 3000 / df.count())
    rest = R.classify(df.where(~seen & F.col("text").isNotNull()), rules=rules).select("rule", "repeated").collect()
    flagged, true = np.array([r.rule > 0 for r in rest]), np.array([r.repeated >= R.SHARE for r in rest])
    both = (flagged & true).sum()
    print("rules", len(rules), "precision", both / flagged.sum(), "recall", both / true.sum(), "of", true.sum())
    assert both / flagged.sum() > 0.9 and both / true.sum() > 0.97
