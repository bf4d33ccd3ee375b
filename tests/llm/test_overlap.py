import random
import re

from pyspark.sql import functions as F

from veridelta.llm import overlap as O
from veridelta.llm.tokens import words

SCHEMA = "ord long, id string, split string, source string, claim string"


def similarity(a, b):
    """Punctuation doesn't count, so Han characters on both sides of it are neighbours."""
    x, y = (set(words(re.sub(r"(?<=[一-龥])[，。…]+(?=[一-龥])", "", v))) for v in (a, b))
    return len(x & y) / len(x | y)


def brute(data):
    out = set()
    for a in data:
        for b in data:
            if a[2] != "train" and b[2] == "train":
                near = a[4] is not None and b[4] is not None and words(a[4]) and similarity(a[4], b[4]) >= 0.7 - 1e-12
                if near or (a[1] is not None and a[1] == b[1]):
                    out.add((a[0], b[0]))
    return out


def make(seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    data = []
    for k in range(60):
        base = ["the", "old", "mill", *rng.choices(vocabulary, k=24)]
        for _ in range(rng.choice((1, 2, 3))):
            t = list(base)
            for _ in range(rng.randrange(0, 3)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                t = t[12:] + t[:12]
            data.append((len(data), f"i{rng.randrange(90)}", rng.choice(("train", "train", "dev", "test")), f"s{k % 3}", " ".join(t).title() if rng.random() < 0.5 else " ".join(t)))
    return data


def test_equals_brute_force(spark):
    data = make()
    got = [(r.eval_ord, r.train_ord) for r in O.overlaps(spark.createDataFrame(data, SCHEMA)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(data)


def test_small_shards_and_blocks_change_nothing(spark):
    data = make(5)
    got = O.overlaps(spark.createDataFrame(data, SCHEMA), shard_passages=50, block_texts=7)
    assert {(r.eval_ord, r.train_ord) for r in got.collect()} == brute(data)


def test_untold_common_words_change_nothing(spark, monkeypatch):
    """Without counts the words go by spelling, and all pairs still come out."""
    data = make(6)
    monkeypatch.setattr(O, "common_words", lambda members: {})
    assert {(r.eval_ord, r.train_ord) for r in O.overlaps(spark.createDataFrame(data, SCHEMA)).collect()} == brute(data)


def test_any_order_of_words(spark):
    rng = random.Random(1)
    data = []
    for k in range(40):
        t = [f"v{rng.randrange(200)}" for _ in range(20)]
        data.append((2 * k, None, "train", "s", " ".join(t)))
        data.append((2 * k + 1, None, "dev", "s", " ".join(rng.sample(t, 20))))
    han = "图书馆屋顶基金会议时间地点人物事件记录说明来源"
    data += [(900, None, "train", "s", han), (901, None, "test", "s", han[12:] + "，" + han[:12])]
    got = {(r.eval_ord, r.train_ord) for r in O.overlaps(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got == brute(data) and len(got) >= 41


def test_insertions_down_to_the_limit(spark):
    rng = random.Random(3)
    data = []
    for k in range(30):
        t = [f"k{k}x{j}" for j in range(28)]
        data.append((2 * k, None, "train", "s", " ".join(t)))
        for j in range(12 if k % 3 else 13):  # 28 of 40 words are in common, or 28 of 41
            t.insert(rng.randrange(len(t) + 1), f"new{k}x{j}")
        data.append((2 * k + 1, None, "test", "s", " ".join(t)))
    got = {(r.eval_ord, r.train_ord) for r in O.overlaps(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got == brute(data) and len(got) == 20


def test_variants_of_a_hot_claim(spark):
    """Hundreds of records whose words are all common among themselves, five words of forty changed."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(40)]
    data = [(0, None, "train", "s", " ".join(base))]
    for k in range(1, 301):
        t = list(base)
        for p in rng.sample(range(40), 5):
            t[p] = f"c{rng.randrange(30)}"
        data.append((k, None, "dev", "s", " ".join(t)))
    got = {(r.eval_ord, r.train_ord) for r in O.overlaps(spark.createDataFrame(data, SCHEMA), shard_passages=100, block_texts=1).collect()}
    assert got == brute(data) and len(got) > 290


def test_edges(spark):
    data = [(1, None, "train", "s", None), (2, None, "dev", "s", None), (3, "a", "dev", None, ""), (4, "a", "train", "s", "…"), (5, "b", None, "s", "one"), (6, "c", "train", "s", "ONE"), (7, "d", "test", "s", "图书馆屋顶基金会议"), (8, "e", "train", "s", "图书馆屋顶基金会议。"), (9, "f", "train", "s", "one")]
    df = spark.createDataFrame(data, SCHEMA)
    for c in ("norm", "train", "c1", "h", "e1", "shard", "coverage", "bag", "words", "cell", "i", "o"):
        df = df.withColumn(c, F.lit(1))
    got = {(r.eval_ord, r.train_ord, r.same_id) for r in O.overlaps(df.drop("train")).collect()}
    assert got == {(3, 4, True), (5, 6, False), (5, 9, False), (7, 8, False)}
    assert O.overlaps(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hot_claim_is_one_class(spark):
    data = [(i, f"t{i}", "train", "s", "the same claim of many rows here today") for i in range(40)] + [(100 + i, f"e{i}", "dev", "s", "the same claim of many rows here") for i in range(10)]
    _, links = O.covered_classes(spark.createDataFrame(data, SCHEMA))
    assert links.count() == 1 and O.overlaps(spark.createDataFrame(data, SCHEMA)).count() == 400


def test_report(spark):
    data = [(1, "a", "train", "s", "one two three four five six"), (2, "b", "dev", "t", "one two three four five six"), (3, "a", "test", "u", "other")]
    got = {(r.split, r.source): (r.pairs, r.records, r.by_id, r.by_claim) for r in O.report(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got == {("dev", "t"): (1, 1, 0, 1), ("test", "u"): (1, 1, 1, 0)}


def test_report_counts_pairs_without_making_them(spark):
    data = make(9) + [(1000 + k, "hot", "train" if k % 2 else "dev", "s9", "a claim that many rows of either split hold") for k in range(60)]
    df = spark.createDataFrame(data, SCHEMA)
    pairs = O.overlaps(df).collect()
    of = {r[0]: (r[2], r[3]) for r in data}
    want = {}
    for r in pairs:
        x = want.setdefault(of[r.eval_ord], [0, set(), 0, 0])
        x[0] += 1
        x[1].add(r.eval_ord)
        x[2] += r.same_id
        x[3] += r.similarity is not None
    assert {(r.split, r.source): [r.pairs, r.records, r.by_id, r.by_claim] for r in O.report(df).collect()} == {k: [a, len(b), c, d] for k, (a, b, c, d) in want.items()}


def test_intervals_are_merged():
    assert O.coverage("a b c d e f", "x a b c d y") == 4 / 6 and O.coverage("a b a b a b", "a b a") == 5 / 6 and O.coverage("a b", "b a") == 0


def test_many_near_copies_of_one_claim(spark):
    rng = random.Random(7)
    base = [f"b{i}" for i in range(45)]
    data = [(0, None, "train", "s", " ".join(base))]
    for k in range(1, 101):
        t = list(base)
        for j, p in enumerate(rng.sample(range(45), 3)):
            t[p] = f"new{k}x{j}"
        data.append((k, None, "dev", "s", " ".join(t)))
    got = O.overlaps(spark.createDataFrame(data, SCHEMA)).collect()
    assert {(r.eval_ord, r.train_ord) for r in got} == brute(data) == {(k, 0) for k in range(1, 101)}
    assert all(r.coverage >= 0.7 for r in got)
