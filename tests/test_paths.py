import datetime as dt
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veridelta.operators import paths as P
from veridelta.operators import rank as R

EDGES = "id string, head string, relation string, tail string, start date, end date, precision string, kind string"
DAY = dt.date(2020, 5, 1)


def edge(i, a, b, relation="won", start=DAY, end=None, precision="day", kind="typed"):
    return (i, a, relation, b, start, end or start, precision, kind)


def town(seed=1, nodes=60, more=150):
    rng = random.Random(seed)
    rel = ["won", "founded", "married_to", "causes", "caused_by", "parallel_to"]
    out = []
    for k in range(more):
        a = "hub" if rng.random() < 0.33 else f"n{rng.randrange(nodes)}"
        out.append(edge(f"e{k:03d}", a, f"n{rng.randrange(nodes)}", rng.choice(rel), DAY + dt.timedelta(days=rng.randrange(900)), kind=rng.choice(["typed", "mention"])))
    return [e[:5] + (e[4] + dt.timedelta(days=rng.randrange(40)),) + e[6:] for e in out]


def types(spark, data):
    ns = sorted({x for e in data for x in (e[1], e[3])})
    return spark.createDataFrame([(n, ["person", "city", "event"][k % 3]) for k, n in enumerate(ns)], "node string, type string")


@pytest.mark.parametrize("kinds, edges, want", [
    (["Person"], [edge("a", "x", "y")], ["temporal_synchronization", "person_identity_fusion"]),
    (["event"], [edge("a", "x", "y", "founded"), edge("b", "y", "z", "adapted_from", dt.date(2021, 1, 1))], ["institutional_affiliation", "artifact_adaptation"]),
    (["place", None], [edge("a", "x", "y", "married_to", DAY, dt.date(2021, 1, 1)), edge("b", "x", "y", "causes"), edge("c", "x", "y", "parallel_to")], ["geospatial_coincidence", "genealogical_linkage", "event_causality", "role_parallelism"]),
    (["event"], [], []),
])
def test_strategies(spark, kinds, edges, want):
    rows = [dict(zip(("id", "head", "relation", "tail", "start", "end", "precision", "kind"), e)) for e in edges]
    df = spark.createDataFrame([(kinds, rows)], f"t array<string>, e array<struct<{EDGES.replace(' ', ':').replace(',:', ',')}>>")
    assert df.select(P.strategies(F.col("t"), F.col("e"))).first()[0] == want


@pytest.mark.parametrize("edges, want", [
    ([("causes", 0, 0, "day", "forward"), ("won", 5, 5, "day", "reverse")], "sequence"), ([("causes", 5, 5, "day", "forward"), ("won", 0, 0, "day", "forward")], None), ([("caused_by", 5, 5, "day", "forward"), ("won", 0, 0, "day", "forward")], "reverse_sequence"),
    ([("caused_by", 0, 0, "day", "reverse"), ("won", 1, 1, "day", "forward")], "sequence"), ([("causes", 0, 0, "day", "forward"), ("subsequent_to", 1, 1, "day", "forward")], None), ([("won", 9, 9, "day", "forward"), ("won", 0, 0, "day", "forward")], "independent"),
    ([("parallel_to", 0, 4, "day", "forward"), ("won", 4, 6, "day", "forward")], "parallel"), ([("parallel_to", 0, 4, "day", "forward"), ("won", 5, 6, "day", "forward")], None), ([("parallel_to", 0, 4, "month", "forward"), ("won", 4, 6, "day", "forward")], None),
])
def test_modes(spark, edges, want):
    rows = [(r, DAY + dt.timedelta(days=a), DAY + dt.timedelta(days=b), p, d) for r, a, b, p, d in edges]
    df = spark.createDataFrame([(rows,)], "e array<struct<relation:string,start:date,end:date,precision:string,direction:string>>")
    assert df.select(P.path_mode(F.col("e"))).first()[0] == want


def test_starts_follow_the_weights(spark):
    nodes = spark.createDataFrame([(f"n{k}", d, 0) for k, d in enumerate((1, 2, 3, 4, 90))], "node string, degree long, typed long")
    n = 4000
    for power in (0.0, 1.0, 0.5):
        got = Counter(r.node for r in P.weighted_starts(nodes, n, power).collect())
        w = [d**power for d in (1, 2, 3, 4, 90)]
        assert sum(got.values()) == n
        for k, x in enumerate(w):
            p = x / sum(w)
            assert abs(got[f"n{k}"] / n - p) < 4 * math.sqrt(p * (1 - p) / n) + 1e-3
    assert P.weighted_starts(nodes.limit(0), 5).count() == 0


def test_paths_are_simple_accepted_and_follow_edges(spark):
    data = town()
    of = {e[0]: e for e in data}
    kinds = types(spark, data)
    type_of = {r.node: r.type for r in kinds.collect()}
    df = spark.createDataFrame(data, EDGES)
    for hops in (2, 5):
        rows = P.sample_paths(df, kinds, hops, 80).collect()
        assert len(rows) > (30 if hops == 2 else 15) and len({r.path_id for r in rows}) == len(rows)
        for r in rows:
            assert len(set(r.nodes)) == hops + 1 and len(r.edges) == hops and r.reference_date == max(e.end for e in r.edges)
            for a, b, e in zip(r.nodes, r.nodes[1:], r.edges):
                assert (of[e.id][1], of[e.id][3]) == ((a, b) if e.direction == "forward" else (b, a))
            assert r.strategy in ("temporal_synchronization", "person_identity_fusion", "geospatial_coincidence", "institutional_affiliation", "genealogical_linkage", "event_causality", "role_parallelism")
            if r.strategy == "person_identity_fusion":
                assert any(type_of[n] == "person" for n in r.nodes)
    only = P.sample_paths(df, kinds, 2, 60, strategy="genealogical_linkage").collect()
    assert only and all(r.strategy == "genealogical_linkage" and any(e.relation == "married_to" for e in r.edges) for r in only)
    assert P.sample_paths(df.limit(0), kinds, 3, 5).count() == 0


def test_all_edges_of_a_hub_are_walked(spark):
    data = [edge(f"e{k:03d}", "hub", f"n{k:03d}") for k in range(120)]
    rows = P.sample_paths(spark.createDataFrame(data, EDGES), types(spark, data), 2, 1500).collect()
    assert len({e.id for r in rows for e in r.edges}) > 110


def test_typed_bias(spark):
    data = town(3, nodes=40, more=400)
    df = spark.createDataFrame(data, EDGES)
    kind = {e[0]: e[7] for e in data}
    share = {}
    for bias in (0.0, 0.8, 1.0):
        rows = P.typed_walks(df, 3, 150, typed_bias=bias).collect()
        assert len(rows) > 100 and all(len(set(r.nodes)) == 4 and r.typed_edges == sum(kind[e.id] == "typed" for e in r.edges) for r in rows)
        share[bias] = sum(r.typed_edges for r in rows) / (3 * len(rows))
    assert share[0.0] < 0.65 < 0.8 < share[0.8] < share[1.0]


@pytest.fixture
def rows_cut(monkeypatch):
    """Rows of each table that is written to the shared folder."""
    counts, real = [], P.cut

    def counted(df):
        out = real(df)
        counts.append(out.count())
        return out

    monkeypatch.setattr(P, "cut", counted)
    monkeypatch.setattr(R, "cut", counted)
    return counts


def test_samples_write_the_edges_of_visited_nodes_only(spark, rows_cut):
    data = [edge(f"e{k:04d}", f"n{k % 60}", f"n{(k * 7 + k // 60) % 60}") for k in range(3000)]
    rows = P.sample_paths(spark.createDataFrame(data, EDGES), types(spark, data), 3, 3, tries=1).collect()
    assert rows and 0 < max(rows_cut) < 600


def test_typed_samples_write_the_edges_of_visited_nodes_only(spark, rows_cut):
    data = [edge(f"e{k:04d}", f"n{k % 60}", f"n{(k * 7 + k // 60) % 60}", kind="typed" if k % 3 else "mention") for k in range(3000)]
    df = spark.createDataFrame(data, EDGES)
    rows = P.typed_walks(df, 3, 3, restarts=1).collect()
    assert rows and 0 < max(rows_cut) < 600
    got = P.typed_samples(df, (2, 4), 20)
    assert sorted(map(tuple, got.collect())) == sorted((h, *r) for h in (2, 4) for r in P.typed_walks(df, h, 20).collect())


def test_samples_of_several_lengths_are_those_of_each(spark):
    data = town(5)
    df, kinds = spark.createDataFrame(data, EDGES), types(spark, data)
    got = P.samples(df, kinds, (2, 4), 40)
    assert sorted(map(tuple, got.collect())) == sorted((h, *r) for h in (2, 4) for r in P.sample_paths(df, kinds, h, 40).collect())
    by_node = F.element_at(F.create_map(*(F.lit(x) for r in kinds.collect() for x in r)), F.col("node"))
    assert sorted(map(tuple, P.samples(df, by_node, [2, 4], 40).collect())) == sorted(map(tuple, got.collect()))


def brute_ranked(data, seed, hops, fan, most_gap, most_span, budget):
    freq = Counter(r for _, _, r, _, _ in data)
    adj = {}
    for i, a, r, b, m in data:
        adj.setdefault(a, []).append((b, i, r, m, "forward"))
        adj.setdefault(b, []).append((a, i, r, m, "reverse"))
    live = [([seed], [], None)]
    for _ in range(hops):
        new = []
        for nodes, es, last in live:
            options = [o for o in adj.get(nodes[-1], []) if o[0] not in nodes]
            options.sort(key=lambda o: (o[3] is None, abs(o[3] - last) if o[3] is not None and last is not None else 10**6, freq[o[2]], o[1], o[4]))
            new += [([*nodes, o[0]], [*es, o], o[3]) for o in options[:fan]]
        live = new
    seen = {}
    for nodes, es, _ in live:
        ms = sorted(o[3] for o in es if o[3] is not None)
        if len(ms) < 2 or min(b - a for a, b in zip(ms, ms[1:])) > most_gap or ms[-1] - ms[0] > most_span:
            continue
        key = (tuple(sorted(nodes)), tuple(sorted(o[2] for o in es)))
        rank = (min(b - a for a, b in zip(ms, ms[1:])), ms[-1] - ms[0], "|".join(nodes), "|".join(f"{o[1]}:{o[4]}" for o in es))
        if key not in seen or rank < seen[key][0]:
            seen[key] = (rank, nodes)
    return [n for _, n in sorted(seen.values())[:budget]]


def test_ranked_paths_equal_a_search(spark):
    rng = random.Random(9)
    data = []
    for k in range(140):
        a, b = "hub" if rng.random() < 0.4 else f"n{rng.randrange(14)}", f"n{rng.randrange(14)}"
        if a != b:
            data.append((f"e{k:03d}", a, rng.choice("rrrst"), b, None if rng.random() < 0.2 else 24240 + rng.randrange(30)))
    text = lambda m: None if m is None else f"{(m - 1) // 12:04d}-{(m - 1) % 12 + 1:02d}-07"
    df = spark.createDataFrame([(*e[:4], text(e[4])) for e in data], "id string, head string, relation string, tail string, date string")
    seeds = spark.createDataFrame([("hub",), ("n3",), ("nowhere",)], "node string")
    for hops in (2, 3):
        got = {}
        for r in P.ranked_paths(df, seeds, hops, budget=10, fan=3, most_gap=6, most_span=20).collect():
            got.setdefault(r.seed, []).append(tuple(r.nodes))
        want = {s: {tuple(n) for n in brute_ranked(data, s, hops, 3, 6, 20, 10)} for s in ("hub", "n3")}
        assert {s: set(v) for s, v in got.items()} == want
    rare = spark.createDataFrame([("n1",), ("n2",)], "node string")
    assert all({"n1", "n2"} & set(r.nodes) for r in P.ranked_paths(df, seeds, 2, rare_nodes=rare, least_rare=1).collect())


@pytest.mark.parametrize("round_, hub", [(10**9, 10**9), (40, 10**9), (10**9, 1)])
def test_ranked_paths_read_all_edges_and_write_none(spark, rows_cut, monkeypatch, round_, hub):
    """In one round or several, with hubs or without: equal to a search also where many edges of a month lead back, and no table of edges is written."""
    monkeypatch.setattr(P, "ROUND", round_)
    monkeypatch.setattr(P, "HUB", hub)
    monkeypatch.setattr(P, "SOME", 1)
    back = [(f"a{k:02d}", "n1", "r", "n2", 24241) for k in range(12)] + [(f"b{k}", "n2", "r", f"n{k + 3}", 24241) for k in range(4)]
    rng = random.Random(4)
    data = back + [(f"c{k:02d}", f"n{rng.randrange(3, 9)}", rng.choice("rs"), f"n{rng.randrange(9, 14)}", 24240 + rng.randrange(9)) for k in range(40)]
    df = spark.createDataFrame([(*e[:4], e[4]) for e in data], "id string, head string, relation string, tail string, month int")
    got = {}
    for r in P.ranked_paths(df, spark.createDataFrame([("n1",), ("n5",)], "node string"), 3, budget=8, fan=3, most_gap=6, most_span=20).collect():
        got.setdefault(r.seed, set()).add(tuple(r.nodes))
    want = {s: {tuple(n) for n in brute_ranked(data, s, 3, 3, 6, 20, 8)} for s in ("n1", "n5")}
    assert want["n1"] and got == want
    assert max(rows_cut) < len(data) / 4
