import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from veridelta.llm import sitelines as L

SCHEMA = "ord long, source string, text string"


def form(line):
    return re.sub(r"[\s\d]+", "", line).lower()


def brute(data, min_rows=5, share=0.15):
    rows = Counter(s for _, s, _ in data)
    n = Counter()
    for _, s, t in data:
        n.update({(s, form(x)) for x in (t or "").split("\n") if form(x)})
    rep = {k for k, c in n.items() if c >= min_rows and c >= share * rows[k[0]]}
    return {(o, i) for o, s, t in data for i, x in enumerate((t or "").split("\n"), 1) if (s, form(x)) in rep}


def make(seed=1, n=300):
    rng = random.Random(seed)
    data = []
    for o in range(n):
        s = rng.choice(("a", "a", "a", "b", "c", None))
        lines = [f"text {rng.random()} of {o} {chr(97 + rng.randrange(26)) * 5}" for _ in range(rng.randrange(5))]
        for k in range(4):
            if rng.random() < (0.14, 0.17, 0.5, 0.9)[k]:
                lines.insert(rng.randrange(len(lines) + 1), rng.choice((f"Share {rng.randrange(99)} {s}{k}", f"SHARE  {rng.randrange(99)} {s}{k}"[:40])))
        data.append((o, s, "\n".join(lines) if rng.random() < 0.95 else None))
    return data


def found(spark, data, **k):
    return {tuple(r) for r in L.found_lines(spark.createDataFrame(data, SCHEMA), **k).collect()}


def test_equals_brute_force(spark):
    data = make()
    assert found(spark, data) == brute(data)


def test_few_counters_fall_back_to_exact_counts(spark):
    """With three counters the summaries can rule out nothing; the rows are the same."""
    data = make(2)
    assert found(spark, data, counters=3) == brute(data)


def test_counters_bound_their_error():
    rng = np.random.default_rng(0)
    stream = np.r_[rng.integers(0, 5, 4000), rng.integers(5, 5000, 4000)]
    true = Counter(stream.tolist())
    h, n, err = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    for part in np.array_split(stream, 17):
        h, n, off = L.reduce_counters(np.r_[h, part], np.r_[n, np.ones(len(part), np.int64)], 40)
        err += off
    have = dict(zip(h.tolist(), n.tolist()))
    assert err <= len(stream) / 41
    assert all(true[x] - err <= have.get(x, 0) <= true[x] for x in true)


def test_edges(spark):
    data = [(i, "a", "Footer 12\n\n 7 \nbody " + "xyz"[i % 3] * (i + 1)) for i in range(6)] + [(10, "a", None), (11, None, "Footer"), (12, "b", ""), (13, "a", "Footer 1\nFOOTER\nfoo ter 9")]
    assert found(spark, data) == {(i, 1) for i in range(6)} | {(13, 1), (13, 2), (13, 3)}
    assert found(spark, []) == set()
    df = spark.createDataFrame(data, SCHEMA)
    for c in ("src", "line", "lines", "_set", "_src", "n", "rows", "h"):
        df = df.withColumn(c, F.lit(5))
    out = {r.ord: r for r in L.remove_lines(df).collect()}
    assert out[10].text is None and out[0].text == "\n 7 \nbody x" and out[13].text == "" and out[0].src == 5 and out[0]._set == 5 and out[11].text == "Footer"


def test_rounds_of_merging_change_nothing(spark):
    rows = [(i, f"s{i % 7}", "\n".join(["share this", f"line {'abcdefghij'[j % 10] * (1 + i % 13)}"][j % 2] for j in range(6))) for i in range(400)]
    df = spark.createDataFrame(rows, "ord long, source string, text string").repartition(30)
    few = lambda **o: sorted(map(tuple, L.summaries(df, **o).where("h is not null").select("src", "h", "n").collect()))
    assert few() == few(fan=2) == few(fan=5)
    of = {r.src: r.n for r in L.summaries(df, fan=3).groupBy("src").agg(F.sum("rows").alias("n")).collect()}
    assert of == {f"s{k}": sum(i % 7 == k for i in range(400)) for k in range(7)}
