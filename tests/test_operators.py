import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from veridelta.operators import claims as C
from veridelta.operators import graph as G
from veridelta.operators import kg
from veridelta.operators import rank as R
from veridelta.operators import split as S


def union_find(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(120):03}", f"n{rng.randrange(120):03}") for _ in range(90)] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(40)] + [("hub", f"h{i}") for i in range(60)]
    got = dict(map(tuple, G.components(spark.createDataFrame(edges, "src string, dst string")).collect()))
    assert got == union_find(edges)


def test_components_of_nothing(spark):
    assert G.components(spark.createDataFrame([], "src string, dst string")).count() == 0
    assert G.components(spark.createDataFrame([("a", "a"), (None, "b")], "src string, dst string")).collect() == [("a", "a")]


def test_or_dedup_walks_in_order(spark, rows):
    data = [(1, "a", "x"), (2, "a", "y"), (3, "b", "y"), (4, "b", "z"), (5, "c", "x"), (6, "d", "w")]
    seen_a, seen_b, want = set(), set(), []
    for o, a, b in data:
        if a not in seen_a and b not in seen_b:
            seen_a.add(a)
            seen_b.add(b)
            want.append(o)
    df = spark.createDataFrame(data, "ord long, a string, b string")
    assert [r[0] for r in rows(R.or_dedup(df, "a", "b", "ord"))] == want


def test_percentiles(spark, rows):
    df = spark.createDataFrame([("a", v) for v in range(10)] + [("b", 7), ("a", None)], "g string, v int")
    assert rows(R.percentiles(df, ["g"], "v", [10, 50])) == [("a", 10, 1), ("a", 50, 4), ("b", 10, 7), ("b", 50, 7)]
    assert rows(R.percentiles(df, ["g"], "v", [10, 100], "floor"))[:2] == [("a", 10, 1), ("a", 100, 9)]


def test_quota_and_fill(spark, rows):
    df = spark.createDataFrame([(1, "k1", "A", 5), (2, "k1", "A", 9), (3, "k2", "A", 7), (4, "k3", "B", 1), (5, "k4", "C", 1)], "ord int, k string, c string, v int")
    assert [r["ord"] for r in R.quota(df, "k", "c", [F.desc("v"), F.col("ord")], {"A": 1, "B": 3}).orderBy("ord").collect()] == [2, 4]
    a, b = df.where("ord < 3"), df.where("ord > 1")
    assert [r["ord"] for r in R.fill_to_target([a, b], F.col("ord").cast("string"), "ord", 4).collect()] == [1, 2, 3, 4]
    assert rows(R.shortfalls(df, "c", {"A": 5, "D": 2})) == [("A", 5, 3, 2), ("D", 2, 0, 2)]


def queries_column(spark, qs):
    return spark.createDataFrame([(qs,)], "q array<struct<id:string,depends_on:array<string>>>")


def test_topology_reasons(spark):
    reason = lambda qs: queries_column(spark, qs).select(G.topology_reason(F.col("q"))).first()[0]
    assert reason([("a", []), ("b", ["a"])]) is None
    assert reason([("a", []), ("a", [])]) == "duplicate_id"
    assert reason([("a", []), ("b", ["a", "a"])]) == "duplicate_dependency"
    assert reason([("a", ["a"])]) == "self_dependency"
    assert reason([("a", ["z"])]) == "unknown_dependency"
    assert reason([("a", ["b"]), ("b", ["c"]), ("c", ["a"])]) == "cycle"
    assert reason([("b", ["a"]), ("a", [])]) == "not_topological"


def test_ancestors(spark):
    got = queries_column(spark, [("a", []), ("b", ["a"]), ("c", ["b"]), ("d", [])]).select(G.ancestors(F.col("q"))).first()[0]
    assert got == {"a": [], "b": ["a"], "c": ["a", "b"], "d": []}


def edge_table(spark, rows):
    return spark.createDataFrame([(*r[:4], dt.date.fromisoformat(r[4]), dt.date.fromisoformat(r[5])) for r in rows], "id string, head string, relation string, tail string, start date, end date")


def test_simple_paths_equal_brute_force(spark):
    rng = random.Random(1)
    e = [(f"e{i}", f"n{rng.randrange(8)}", "r", f"n{rng.randrange(8)}", "2020-01-01", "2020-01-02") for i in range(20)]
    df = edge_table(spark, e)
    seeds = spark.createDataFrame([("n0",), ("n3",)], "node string")
    got = sorted((tuple(r["nodes"]), tuple(x["id"] for x in r["edges"])) for r in G.simple_paths(df, seeds, 3).collect())
    adj = [(h, t, i) for i, h, _, t, *_ in e] + [(t, h, i) for i, h, _, t, *_ in e]
    want = []
    for s, path in itertools.product(("n0", "n3"), itertools.product(adj, repeat=3)):
        nodes = [s]
        for a, b, _ in path:
            if a != nodes[-1] or b in nodes:
                break
            nodes.append(b)
        else:
            want.append((tuple(nodes), tuple(i for _, _, i in path)))
    assert got == sorted(want)


def test_modes_and_window(spark):
    e = "array<struct<id:string,relation:string,start:string,end:string,direction:string>>"
    df = spark.createDataFrame([([("a", "caused_by", "2020-01-01", "2020-01-05", "forward"), ("b", "r", "2020-02-01", "2020-02-02", "forward")],), ([("a", "caused_by", "2020-01-01", "2020-01-05", "reverse"), ("b", "caused_by", "2020-01-03", "2020-02-02", "forward")],)], f"e {e}")
    got = df.select(G.temporal_mode(F.col("e")), G.relation_mode(F.col("e")), G.path_window(F.col("e"))["end"]).collect()
    assert sorted(map(tuple, got), key=repr) == [("parallel", None, "2020-02-02"), ("sequence", "reverse_sequence", "2020-02-02")]


def test_contradictions(spark, rows):
    df = spark.createDataFrame([("x", 1, "positive", 1, 5), ("x", 2, "negative", 5, 9), ("x", 3, "negative", 6, 9), ("y", 4, "positive", 1, 9)], "t string, k int, p string, s int, e int")
    assert rows(G.contradictions(df, ["t"], "k", "p", "s", "e")) == [(2, 1)]


def test_depth_hubs_dangling(spark, rows):
    e = edge_table(spark, [(f"e{i}", a, "r", b, "2020-01-01", "2020-01-01") for i, (a, b) in enumerate([("a", "b"), ("b", "c"), ("c", "d"), ("a", "x"), ("a", "y")])])
    assert rows(G.depth_layers(e, spark.createDataFrame([("a",)], "node string"), 2)) == [("a", 0), ("b", 1), ("c", 2), ("x", 1), ("y", 1)]
    assert G.without_hubs(e, 1).count() == 2
    assert rows(G.dangling(e, spark.createDataFrame([(x,) for x in "abcxy"], "id string"))) == [("d", 1)]


@pytest.mark.parametrize("walked", [0, 7])
def test_or_dedup_in_rounds(spark, monkeypatch, walked):
    """Hot keys, chains and nulls against the sequence itself."""
    monkeypatch.setattr(R, "WALKED", walked)
    rng = random.Random(11)
    data = [(i, rng.choice(["hot", None, *(f"a{rng.randrange(25)}" for _ in range(3))]), rng.choice(["warm", f"b{rng.randrange(40)}", f"b{rng.randrange(40)}", None])) for i in rng.sample(range(1000), 160)]
    data += [(2000 + i, f"c{i // 2}", f"d{(i + 1) // 2}") for i in range(12)]  # a chain: each row shares a key with the one before
    seen_a, seen_b, want = set(), set(), []
    for o, a, b in sorted(data):
        if a not in seen_a and b not in seen_b:
            seen_a.add(a)
            seen_b.add(b)
            want.append(o)
    df = spark.createDataFrame(data, "ord long, a string, b string")
    assert sorted(r.ord for r in R.or_dedup(df, "a", "b", "ord").collect()) == want
    assert R.or_dedup(df.limit(0), "a", "b", "ord").count() == 0


def test_split_has_no_leak(spark):
    rng = random.Random(5)
    data = [(i, rng.choice([2, 3]), [f"t{rng.randrange(60)}" for _ in range(rng.randrange(0, 3))]) for i in range(80)]
    df = spark.createDataFrame(data, "ord long, hop int, tokens array<string>")
    out, report = S.disjoint_split(df, "ord", "tokens", "hop", {2: 5, 3: 4})
    out = out.cache()
    assert out.count() == 80 and S.leakage(df, out, "ord", "tokens").count() == 0
    n = dict(map(tuple, out.join(df, "ord").where("split = 'test'").groupBy("hop").count().collect()))
    assert {k: n.get(k, 0) for k in (2, 3)} == report["test"] == {2: 5, 3: 4} and report["status"] == "exact_quotas_met"


def test_split_says_when_its_search_was_cut(spark, monkeypatch):
    data = [(i, 2 + i % 2, [f"t{i // 3}"]) for i in range(12)]
    df = spark.createDataFrame(data, "ord long, hop int, tokens array<string>")
    status = lambda quota: S.disjoint_split(df, "ord", "tokens", "hop", quota)[1]["status"]
    assert status({2: 1, 3: 1}) == "quota_shortfall"
    monkeypatch.setattr(S, "ALL_STATES", 1)
    monkeypatch.setattr(S, "MOST_STATES", 1)
    assert status({2: 4, 3: 4}) == "quota_shortfall_search_cut"


def test_families_stay_together(spark):
    data = [(1, "a", None, 2, ["x"]), (2, "b", "a", 2, ["y"]), (3, "c", "gone", 2, None), (4, "d", None, 2, ["z"]), (5, "e", "b", 2, ["q"])]
    own, missing = S.with_families(spark.createDataFrame(data, "ord long, id string, parent string, hop int, tokens array<string>"), "ord", "tokens", "id", "parent")
    assert [tuple(r) for r in missing.collect()] == [(3, "gone")]
    comp = {r.ord: r.component for r in S.record_components(own, "ord", "tokens").collect()}
    assert comp[1] == comp[2] and len({comp[1], comp[3], comp[4]}) == 3 and len(comp) == 5


def test_split_uses_every_kind_of_component(spark):
    """Thousands of kinds of components, each once: the one kind that meets the quota is found however rare it is."""
    data, o = [], 0
    for k in range(300):
        for h, n in ((2, 40 + k % 17), (3, 50 + k // 17)):
            for _ in range(n if k else 0):
                data.append((o, h, [f"t{k}"]))
                o += 1
    data += [(o, 2, ["last"]), (o + 1, 3, ["last"]), (o + 2, 3, ["last"])]
    out, report = S.disjoint_split(spark.createDataFrame(data, "ord long, hop int, tokens array<string>"), "ord", "tokens", "hop", {2: 1, 3: 2})
    assert report["status"] == "exact_quotas_met" and {r.ord for r in out.where("split = 'test'").collect()} == {o, o + 1, o + 2}


def test_numbers_in_two_levels(spark):
    rng = random.Random(6)
    data = [(("hot" if rng.random() < 0.7 else rng.choice(["a", "b", None])), x) for x in rng.sample(range(10_000), 800)]
    got = R.numbered(spark.createDataFrame(data, "g string, v long").repartition(7), ["g"], "v").collect()
    want = {}
    for g, v in sorted(data, key=lambda x: x[1]):
        want[v] = sum(a == g and b < v for a, b in data)
    assert {r.v: r.number for r in got} == want and len(got) == 800
    assert R.numbered(spark.createDataFrame([], "g string, v long"), ["g"], "v").count() == 0


def test_choose_equals_brute_force():
    kinds, quota = [((1, 0), 2), ((2, 1), 2), ((0, 3), 1), ((9, 0), 1)], (4, 4)
    took, got = S.choose(kinds, quota)
    best = max(sum(k * sum(v) for (v, _), k in zip(kinds, ks)) for ks in itertools.product(*(range(n + 1) for _, n in kinds)) if all(sum(k * v[i] for (v, _), k in zip(kinds, ks)) <= quota[i] for i in (0, 1)))
    assert sum(got) == best and sum(k * v[0] for v, k in took.items()) == got[0]


def test_choice_in_an_array_is_the_best(monkeypatch):
    rng = random.Random(13)
    for _ in range(25):
        kinds = [(tuple(rng.randrange(0, 4) for _ in range(2)), rng.randrange(1, 4)) for _ in range(4)]
        kinds = list({v: (v, n) for v, n in kinds}.values())
        quota = (rng.randrange(0, 8), rng.randrange(1, 8))
        took, got, cut = S.search(kinds, quota)
        sums = {tuple(sum(k * v[i] for (v, _), k in zip(kinds, ks)) for i in (0, 1)) for ks in itertools.product(*(range(n + 1) for _, n in kinds))}
        score = lambda s: (sum(s), -sum((q - x) ** 2 for q, x in zip(quota, s)), s)
        assert not cut and got == max((s for s in sums if all(x <= q for x, q in zip(s, quota))), key=score)
        assert tuple(sum(k * v[i] for v, k in took.items()) for i in (0, 1)) == got and all(k <= dict(kinds)[v] for v, k in took.items())


def test_facts_reject_in_order(spark):
    ent = [("a", "Ada", "person", "d", "1"), ("b", "Club", "organization", "d", "2")]
    full = lambda **k: tuple(({"head": "a", "relation": "r", "tail": "b", "start": "2020-01-01", "end": "2020-01-02", "time_precision": "day", "temporal_kind": "state", "polarity": "positive", "evidence_quote": "quote"} | k).values())
    facts = [full(), full(tail="z"), full(polarity="x"), full(time_precision="x"), full(start="x"), full(start="2021-01-01"), full(evidence_quote="other")]
    kind = "struct<entities:array<struct<id:string,label:string,type:string,domain:string,disambiguation:string>>,facts:array<struct<head:string,relation:string,tail:string,start:string,end:string,time_precision:string,temporal_kind:string,polarity:string,evidence_quote:string>>>"
    df = spark.createDataFrame([(1, "s", "en", "a quote here", (ent, facts))], f"ord long, id string, language string, text string, pre_extracted {kind}")
    assert [r.reason for r in kg.facts(df).orderBy("pos").collect()] == [None, "unknown_entity", "polarity", "precision", "date", "reversed", "quote"]
    assert kg.nodes(df).count() == 2 and kg.edges(df).count() == 1


def test_quotes_and_corrections(spark):
    text = "A post said “the old mill burned down twice” and a claim “the old mill burned down” too. The mill never burned, the owner told us today.\n\nMore."
    r = spark.createDataFrame([(text,)], "t string").withColumn("q", C.quote_candidates(F.col("t"))).select("q", C.correction_after(F.col("t"), F.get("q", 0)), C.mining_reason(F.lit("False:"), F.col("t")), C.mining_reason(F.lit("x"), F.lit("calm"))).first()
    assert r[0] == ["the old mill burned down twice"]
    assert r[1].startswith("The mill never burned") and r[2] is None and r[3] == "no_refutation"


def test_span_edits_are_seeded_and_distinct(spark):
    df = spark.createDataFrame([(1, "On 2020-03-04 Ada Byron met 1,204 people before Bob Stone left."), (2, None), (3, "nothing")], "k int, c string")
    got = C.span_edits(df, "k", "c", F.array(F.lit("Eve Moss"))).collect()
    assert {r.k for r in got} == {1} and len({r.variant for r in got}) == len(got)
    assert sorted(map(tuple, C.span_edits(df, "k", "c", F.array(F.lit("Eve Moss"))).collect())) == sorted(map(tuple, got))
    assert any("after Bob" in r.variant for r in got) and any(r.edits == 2 for r in got)


def test_span_edits_in_threes_fill_up_to_the_cap(spark):
    df = spark.createDataFrame([(1, "It began on 2020-03-04.")], "k int, c string")
    got = C.span_edits(df, "k", "c").collect()
    assert [r.edits for r in got] == [1, 1, 1, 2, 2, 2, 3] and len({r.variant for r in got}) == 7
    assert [r.edits for r in C.span_edits(df, "k", "c", most=5).collect()] == [1, 1, 1, 2, 2]
    two = dict(C.plans({"a": [(0, 1, "x"), (4, 5, "y")], "b": [(2, 3, "z"), (6, 7, "w")]}))
    assert two["a+b"] == [(0, 1, "x"), (6, 7, "w")] and two["b+a"] == [(2, 3, "z"), (4, 5, "y")]


def test_mentions_longest_first(spark, rows):
    t = spark.createDataFrame([(1, "We saw Port Vale City and Port Vale, not port vale.")], "k int, t string")
    n = spark.createDataFrame([("Port Vale",), ("Port Vale City",), ("Vale",)], "name string")
    assert set(rows(C.mentions(t, n, "k", "t"))) == {(1, "Port Vale", 6, 2), (1, "Port Vale City", 2, 3)}


def test_mentions_of_any_case_script_and_length(spark, rows):
    t = spark.createDataFrame([(1, "Then la Fondation Vramskind met the Old Mill Road Rowing Club of 1887."), (2, "昨天北京图书馆开放，北京下雨。"), (3, "la Fondation")], "k int, t string")
    n = spark.createDataFrame([("la Fondation Vramskind",), ("the Old Mill Road Rowing Club",), ("Rowing Club of 1887",), ("北京图书馆",), ("北京",), ("x y",)], "name string")
    assert set(rows(C.mentions(t, n, "k", "t"))) == {(1, "la Fondation Vramskind", 1, 3), (1, "the Old Mill Road Rowing Club", 5, 6), (2, "北京图书馆", 2, 5), (2, "北京", 9, 2)}
    assert rows(C.mentions(t, n.limit(0), "k", "t")) == []
    assert rows(C.mentions(t, n, "k", "t", small=0)) == rows(C.mentions(t, n, "k", "t"))


RULES = [
    ("Mia was born on May 4, 1911, in Oslo", ("born_on", "May 4, 1911", "date", None)), ("born in 1911", ("born_year", "1911", "value", None)), ("Mia died in 1999.", ("died_year", "1999", "value", None)), ("She was a careful printer and a poet", ("is_a", "careful printer", "value", None)),
    ("Mia founded the Quay Press in 1950", ("founded", "Quay Press", "entity", None)), ("He joined the Old Club.", ("member_of", "Old Club", "entity", None)), ("Mia married Jon Ask and left", ("married_to", "Jon Ask", "entity", None)),
    ("the son of Ada Oll", ("child_of", "Ada Oll", "entity", None)), ("sister of Eve Oll", ("sibling_of", "Eve Oll", "entity", None)), ("He played a young miller in The Mill, a film", ("acted_in", "The Mill", "entity", "a young miller")),
    ("directed The Mill", ("directed", "The Mill", "entity", None)), ("won the Salt Prize of 1960", ("won", "Salt Prize", "entity", None)), ("the president of the Salt Board", ("leader_of", "Salt Board", "entity", None)),
    ("It is headquartered in Port Vale.", ("located_in", "Port Vale", "entity", None)), ("It took place in Upper Vale", ("occurred_in", "Upper Vale", "entity", None)), ("She served as deputy clerk from 1950", ("served_as", "deputy clerk", "value", None)),
    ("It rained all day", None), ("He married Al", None), (None, None),
]


def test_relation_rules(spark):
    got = spark.createDataFrame([(k, s) for k, (s, _) in enumerate(RULES)], "k int, s string").select("k", C.relation(F.col("s")).alias("r")).orderBy("k").collect()
    assert [g.r and tuple(g.r) for g in got] == [w for _, w in RULES] and len(C.RELATION_RULES) == 23


def test_distinctive_names(spark):
    rows = [("a", "Port Vale (city)", "Vale Town", 5), ("b", "Port  Vale", None, 9), ("c", "Island", None, 1), ("d", "Vale", None, 1), ("e", "Orchard", None, None), ("f", "main page", None, 3), ("g", None, None, 3), ("h", "Abe", None, 2)]
    names = C.distinctive_names(spark.createDataFrame(rows, "id string, label string, title string, views long"), title="title", views="views")
    assert {tuple(r) for r in names.collect()} == {("Port Vale", "b", True), ("Vale Town", "a", False), ("Orchard", "e", False)}


def test_relation_edges(spark):
    names = spark.createDataFrame([("Quay Press", "q1", False), ("Salt Board of Vale", "s1", True)], "name string, id string, ambiguous boolean")
    facts = spark.createDataFrame([("1", "m", "Mia founded the Quay Press in 1950", "1950-03", "month"), ("2", "m", "Mia was born on May 4, 1911", "1900", "year"), ("3", "m", "Mia directed The Mill", None, None), ("4", "m", "born in 1911", "1950", "year"), ("5", "m", "It rained", None, None), ("6", "m", "She was a careful printer.", None, None)], "id string, head string, text string, date string, precision string")
    got = {r.id: tuple(r)[2:8] for r in C.relation_edges(facts, names).collect()}
    assert got == {"1": ("founded", "q1", "Quay Press", "entity", "1950-03", "month"), "2": ("born_on", None, "May 4, 1911", "other", "1911-05-04", "day"), "3": ("directed", None, "The Mill", "other", None, None), "4": ("born_year", None, "1911", "value", "1911", "year"), "6": ("is_a", None, "careful printer", "value", None, None)}


def test_relations_whatever_the_label(spark, rows, tmp_path):
    from veridelta.plans.mining import relation_mentions

    labels = ["en", "eng", "en_GB", "English", None, "fr"]
    spark.createDataFrame([(i, x, f"Ada{i} joined the Old Club on Monday. Rien.") for i, x in enumerate(labels)], "ord long, language string, text string").write.parquet(f"{tmp_path}/raw.parquet")
    assert rows(relation_mentions(spark, str(tmp_path))) == [("member_of", 6, 6, 1)]


def test_apply_responses(spark, rows):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    resp = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, " ")], "k int, o int, v string")
    assert rows(C.apply_responses(df, resp, ["k"], "o", "v")) == [(1, "y"), (2, "b"), (3, "c")]
