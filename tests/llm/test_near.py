import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridelta.llm import near
from veridelta.llm.tokens import jaccard, words

SCHEMA = "ord long, text string, claim string"


def brute(data, field):
    """Every pair of values near-same by words, or equal."""
    out = set()
    rows = [(r[0], r[1 if field == "text" else 2]) for r in data if r[1 if field == "text" else 2] is not None]
    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if a != b and (jaccard(x, y) >= 0.7 or x == y):
                out.add((field, min(a, b), max(a, b)))
    return out


def make(seed=1, groups=25):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(900)]
    data, o = [], 0
    for _ in range(groups):
        base = rng.choices(vocabulary, k=60)
        for _ in range(rng.choice((1, 1, 2, 4))):
            t = list(base)
            for _ in range(rng.randrange(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                t = t[30:] + t[:30]
            text = " ".join(t)
            o += 1
            data.append((o, text.upper() if rng.random() < 0.2 else text, None if rng.random() < 0.2 else " ".join(base[:20])))
    return data


def test_equals_brute_force(spark):
    data = make()
    got = near.near_pairs(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == brute(data, "text") | brute(data, "claim")


def test_edges(spark):
    data = [(1, None, None), (2, "", "…"), (3, "", "…"), (4, "!!", "?"), (5, "a b c", "a"), (6, "c b a", "A"), (7, "a b c", None), (8, "x " * 50_000, "图书馆屋顶基金"), (9, "x y", "图书馆屋顶基金。")]
    got = {tuple(r) for r in near.near_pairs(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got == {("text", 2, 3), ("claim", 2, 3), ("text", 5, 6), ("text", 5, 7), ("text", 6, 7), ("claim", 5, 6), ("claim", 8, 9)}


def test_empty_and_clashing_columns(spark):
    assert near.near_pairs(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, "a b", "x"), (2, "a b", "y")], SCHEMA)
    for c in ("field", "c1", "c2", "words", "value", "g", "o"):
        df = df.withColumn(c, F.lit(7))
    assert [tuple(r) for r in near.near_pairs(df).collect()] == [("text", 1, 2)]


def test_groups(spark):
    a = "one two three four five six seven eight nine ten"
    data = [(1, a, None), (2, a.upper(), "x"), (3, a.replace("ten", "eleven"), None), (4, "other words entirely here", "x"), (5, None, "")]
    got = {(r.field, r.ord): r for r in near.near_groups(spark.createDataFrame(data, SCHEMA)).collect()}
    t = lambda o: got[("text", o)]
    assert t(1)["class"] == t(2)["class"] != t(3)["class"] and t(1).grp == t(2).grp == t(3).grp != t(4).grp
    assert (t(1).links, t(3).links, t(4).links) == (1, 1, 0) and len(got) == 7 and got[("claim", 2)].grp == got[("claim", 4)].grp
    assert near.near_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hot_class(spark):
    """A third of all rows are copies: a class of its own, linked once to its neighbour."""
    data = [(i, "one two three four five six seven eight nine ten", None) for i in range(60)] + [(100, "one two three four five six seven eight nine eleven", None)]
    members, links = near.near_classes(spark.createDataFrame(data, SCHEMA))
    assert members.count() == 61 and links.count() == 1
    assert near.near_pairs(spark.createDataFrame(data, SCHEMA)).count() == 60 * 59 // 2 + 60


@pytest.mark.parametrize("shard_bits", [0, 3])
def test_collisions_are_complete_and_once(shard_bits):
    """All pairs within two bits of some table come out once over tables and shards."""
    rng = np.random.default_rng(2)
    p = near.Plan(12, 3, shard_bits)
    base = rng.integers(0, 1 << 36, 40, dtype=np.uint64)
    flips = base[:, None] ^ (np.uint64(1) << rng.integers(0, 36, (40, 4), dtype=np.uint64))
    fp = np.concatenate([base, flips.ravel(), base])[:, None]
    part = lambda t: (fp[:, 0] >> np.uint64(12 * t)) & np.uint64(0xFFF)
    want = {(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if any(int(part(t)[i] ^ part(t)[j]).bit_count() <= 2 for t in range(3))}
    got = []
    for t in range(3):
        for shard in range(1 << shard_bits):
            own = part(t)
            neighbours = np.stack([own, *(own ^ np.uint64(1 << k) for k in range(12))], axis=1)
            here = np.flatnonzero(((neighbours >> np.uint64(12 - shard_bits)).astype(int) == shard).any(axis=1))
            for i, j in near.collisions(fp[here], t, shard, p, 64):
                got += [tuple(sorted((here[a], here[b]))) for a, b in zip(i, j)]
    assert sorted(got) == sorted(want)


def test_blocks_of_a_hot_shard_change_nothing(spark):
    """Hundreds of different variants of one template: all fall in a few shards, which are cut into many cells."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    data = []
    for k in range(250):
        t = list(base)
        for p in rng.sample(range(60), 4):
            t[p] = f"c{k}x{p}"
        data.append((k, " ".join(t), None))
    df = spark.createDataFrame(data, SCHEMA)
    names = ["a1", "a2", "b1", "b2"]
    whole = sorted(tuple(sorted((tuple(r[:2]), tuple(r[2:])))) for r in near.near_classes(df)[1].select(*names).collect())
    cut = sorted(tuple(sorted((tuple(r[:2]), tuple(r[2:])))) for r in near.near_classes(df, hot_rows=60, block_rows=40)[1].select(*names).collect())
    assert whole == cut and len(whole) == len(set(whole))
    want = len(brute(data, "text"))
    assert want > 20_000 and len(whole) >= 0.999 * want


@pytest.mark.parametrize("values", [12_000, 3_600_000, 36_000_000, 10**10])
def test_recall_at_the_limit(values):
    """Of pairs of a given similarity, the share that tables and bound both let through, whatever the number of values."""
    rng = np.random.default_rng(values % 97)
    p = near.plan(values)
    far = near.furthest(p.bits * p.tables, near.NEAR)
    mask = np.uint64((1 << p.bits) - 1)
    for similarity, least in ((0.7, 0.95), (0.75, 0.99), (0.8, 0.998)):
        n, words = 600, 140
        own = round(words * (1 - similarity) / (1 + similarity))
        h = rng.integers(0, 2**32, (n, words + own), dtype=np.uint32)
        a, b = near.fingerprints([x[:words] for x in h], p), near.fingerprints([x[own:] for x in h], p)
        some = np.zeros(n, bool)
        for t in range(p.tables):
            some |= np.bitwise_count(((a ^ b)[:, t // p.per_word] >> np.uint64((t % p.per_word) * p.bits)) & mask) <= 2
        found = some & (np.bitwise_count(a ^ b).sum(axis=1) <= far)
        assert found.mean() >= least - 2 * np.sqrt(least * (1 - least) / n), (similarity, found.mean())


def test_plan_grows_with_the_values():
    small, large = near.plan(1000), near.plan(10**9)
    assert large.bits > small.bits and large.tables >= small.tables and large.shard_bits > small.shard_bits


def test_words_fold_case_and_looks():
    assert words("Gründung im ДОМ") == words("ＧＲÜNDUNG  im​ дом")
    assert words("图书馆") == ["图书", "书馆"]
