import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from veridelta.llm import packing as P
from veridelta.llm import sizes

VOCABULARY = os.path.join(sizes.FOLDER, sizes.VOCABULARY)
needs = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="vocabulary isn't here")


def caps(spark, **k):
    return spark.createDataFrame(list(k.items()), "pack_id string, capacity_tokens int")


def check(rows, capacity, tokens):
    """No window over capacity, every text whole and once, only larger ones split."""
    used, pieces = defaultdict(int), defaultdict(list)
    for r in rows:
        used[r.window] += r.tokens
        pieces[r.doc_id].append((r.piece, r.start, r.tokens))
    assert max(used.values(), default=0) <= capacity
    assert {d: sum(t for _, _, t in p) for d, p in pieces.items()} == tokens
    for d, p in pieces.items():
        p.sort()
        assert [x[0] for x in p] == list(range(len(p))) and (len(p) == 1 or tokens[d] > capacity)
        assert all(p[i + 1][1] == p[i][1] + p[i][2] for i in range(len(p) - 1))
    return used


@needs
def test_packs(spark):
    rng = random.Random(2)
    data = [(i, " ".join(rng.choices(["mill", "archive", "vote", "图书馆"], k=rng.randrange(1, 90)))) for i in range(400)] + [(1000, "word " * 900), (1001, ""), (1002, None)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(7)
    for c in ("part", "window", "piece", "tokens", "pack_id", "grp", "merged"):
        df = df.withColumn(c, F.lit(1))
    out = P.pack(df, caps(spark, s=128, m=512), VOCABULARY).collect()
    want = {d: n for (d, t), n in zip(data, sizes.count_tokens([t for _, t in data], VOCABULARY)) if t is not None}
    for name, c in (("s", 128), ("m", 512)):
        used = check([r for r in out if r.pack_id == name], c, want)
        total = sum(want.values())
        assert total / (len(used) * c) > 0.95
    rep = {r.pack_id: r for r in P.report(spark.createDataFrame(out), caps(spark, s=128, m=512)).collect()}
    assert rep["s"].tokens == sum(want.values()) and rep["s"].windows >= rep["s"].least_windows


@needs
def test_empty_and_bad_capacities(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert P.pack(df, caps(spark, s=16), VOCABULARY).count() == 0
    with pytest.raises(ValueError):
        P.pack(df, caps(spark, s=0), VOCABULARY)


def test_packer_is_best_fit_and_bounded():
    p = P.Packer(10, 2)
    assert [p.place(x) for x in (6, 7, 3, 4)] == [0, 1, 1, 0]  # best fit fills both
    assert p.space == []
    a, b = p.place(6), p.place(7)
    c = p.place(5)  # fits in neither: the fullest (b) is emitted
    assert {w for _, w in p.space} == {a, c} and b not in {w for _, w in p.space}
    assert p.place(0) in (a, c)


def test_merge_is_dense():
    rng = random.Random(0)
    used = [rng.randrange(0, 101) for _ in range(500)]
    to = P.merge_windows(used, 100)
    full = defaultdict(int)
    for w, u in zip(to, used):
        full[w] += u
    assert max(full.values()) <= 100 and sum(v <= 50 for v in full.values()) <= 1
