import pytest
from pyspark.sql import functions as F

from veridelta.operators import adapt as A
from veridelta.operators import stages as S


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize("name, want", [("安徽省", True), ("和节省", False), ("北京市", True), ("某某区", False), ("郊区", False), ("丽江古城区", False), ("大理白族自治州", True), ("全国城市", False), ("有关县", False)])
def test_places(spark, name, want):
    assert one(spark, name, A.place_ok) is want


def test_swap_pools(spark):
    texts = ["在南京市和芜湖市", "南京市民政", "芜湖市有人", "苏州市一次", "青云大学和海河大学", "青云大学", "海河大学", None, ""]
    got = {(r.kind, r.suffix): r.names for r in A.swap_pools(spark.createDataFrame([(t,) for t in texts], "claim string")).collect()}
    assert all(len(v) >= 2 for v in got.values()) and ("organisation", "河大学") not in got
    assert A.swap_pools(spark.createDataFrame([], "claim string")).count() == 0


@pytest.mark.parametrize("text, want", [("on 4 May 2011", 3), ("May 4, 2011", 3), ("2011-05-04.", 3), ("in may 2011", 2), ("in 1899", 1), ("in 1799", 0), ("12011", 0), ("2011年", 0), ("", 0)])
def test_evidence_rank(spark, text, want):
    assert one(spark, text, A.evidence_rank) == want


def test_upgrades_need_a_quote_and_a_finer_date(spark):
    facts = spark.createDataFrame([(k, "It rained on 4 May 2011", "2011", "year") for k in range(6)] + [(9, "x", "2011-05-04", "day")], "fact int, t string, date string, precision string")
    answers = spark.createDataFrame([(0, "2011-05-04", "day", "4 May 2011"), (1, "2011-05-04", "day", "5 May 2011"), (2, "2011", "year", "2011"), (3, "May 2011", "month", "May 2011"), (4, "2011-05", "month", " "), (9, "2011-05", "month", "x")], "fact int, new_date string, new_precision string, quote string")
    got = {r.fact: (r.date, r.precision, r.upgraded) for r in A.upgrade_dates(facts, answers, "fact", F.col("t")).collect()}
    assert got[0] == ("2011-05-04", "day", True) and all(got[k] == ("2011", "year", False) for k in (1, 2, 3, 4, 5)) and got[9] == ("2011-05-04", "day", False)
    assert [r.fact for r in A.upgradable(facts, F.col("t"), "precision").orderBy("fact").collect()] == list(range(6))


def test_checked_join_names_what_is_lost(spark):
    a, b = spark.createDataFrame([("x", 1), ("y", 2)], "id string, a int"), spark.createDataFrame([("x", 3)], "id string, b int")
    with pytest.raises(ValueError, match="y"):
        A.checked_join(a, b, "id")
    assert [tuple(r) for r in A.checked_join(a.where("id = 'x'"), b, "id").collect()] == [("x", 1, 3)]


def test_labels(spark):
    first = spark.createDataFrame([("A", "a2", 2), ("A", "a1", 1), (None, "n", 0)], "label string, id string, ord long")
    second = spark.createDataFrame([("A", "z", 0), ("B", "b", 9)], "label string, id string, ord long")
    ids = A.label_ids([first, second])
    assert {r.label: r.id for r in ids.collect()} == {"A": "a1", "B": "b"}
    edges = spark.createDataFrame([("e", "B"), ("f", "C")], "e string, tail string")
    assert {r.e: r.tail_id for r in A.resolved(edges, ids).collect()} == {"e": "b", "f": None}
    found = spark.createDataFrame([(" a",), ("D",), ("d ",), (None,), (" ",)], "label string")
    assert [r.label for r in A.new_labels(found, first).collect()] == ["D"]


def test_listings(spark):
    rows = spark.createDataFrame([(1, "u", "c1", "<b>T</b> ", "2023-01-02 10:00"), (2, "u", "c2", "T2", "2023-01-03"), (3, "https://b.example/x", "c1", "X", "yesterday"), (4, None, "c1", None, None)], "o long, url string, c string, title string, day_text string")
    got = {r.url: r for r in A.merge_listings(rows.where("url is not null"), "url", "c", "o").collect()}
    assert got["u"].columns == ["c1", "c2"] and got["u"].o == 1 and got["u"].c == "c1"
    some = spark.createDataFrame([("https://a.example/1", " <i>T</i>", "2023-01-02T1"), ("https://b.example/1", "T", "2023-01-02"), ("https://a.example/2", "T", "1999-01-02"), (None, None, None)], "url string, title string, p string")
    out = A.listing_rows(some, "url", "title", "p", F.array(F.lit("a.example"))).collect()
    assert [r.skipped for r in out] == [False, True, True, True] and out[0].title == "T" and out[0].day == "2023-01-02"


def test_expansion(spark):
    own = "the mill burned down in March"
    parents = spark.createDataFrame([("p", own), ("q", own), ("r", own)], "id string, claim string")
    answers = spark.createDataFrame([
        ("p", '{"perturbations": [{"claim": " the mill burned down in April ", "edit": "month"}, {"claim": "the mill burned down in  April"}, {"claim": "a third one is not read"}], "truth": {"statement": "the mill stands", "basis": "b"}}'),
        ("q", '{"perturbations": [{"claim": "the mill burned down in March "}, {"claim": "x"}], "truth": {"statement": "too few"}}'), ("r", "{broken"),
    ], "id string, response string")
    got = {(r.parent, r.place): r for r in A.expand_answers(parents, answers).collect()}
    assert got[("p", 0)].claim == "the mill burned down in April" and got[("p", 0)].label is False and got[("p", 0)].id.startswith("llm_") and got[("p", 0)].edit == "month"
    assert got[("p", 1)].problem == "repeated" and got[("p", 1)].id is None and got[("p", 2)].label is True and ("p", 3) not in got
    assert {got[("q", k)].problem for k in (0, 1)} == {"invalid_perturbation"} and got[("q", 2)].problem == "invalid_statement" and got[("r", 2)].problem == "invalid_statement"
    assert {tuple(r) for r in A.retag(parents, split="hard", n=1).select("id", "split", "n").collect()} == {("p", "hard", 1), ("q", "hard", 1), ("r", "hard", 1)}


def test_adapter(spark):
    kind = "ord long, id string, claim string, label boolean, hop_count int, time_window struct<start:string,end:string>, path_nodes array<string>, evidence_chain array<struct<relation:string,date:string,fact_id:string,fact:string>>, evidence string, date string"
    w, chain = ("2020-02", "2021"), [("won", "2020-02", "f1", "told"), ("hosted", "2021", "f2", "own words"), ("won", None, "f1", "again")]
    base = ("a", " c ", True, 3, w, ["x", "y", "z", "u"], chain, "e", "2021-01-01")
    rows = [base, base, ("b", "", *base[2:]), ("c", "c", True, 3, (None, "2021"), *base[5:]), ("d", "c", True, 3, w, [], chain, "e", None), ("e", "c", True, 3, ("2022", "2021"), *base[5:]), ("f", "c", True, 3, w, ["x", "y"], chain, "e", None), ("g", "c", True, 1, w, ["x", "y"], [("won", "2020", None, None)], "own text", "2021-01"), ("h", "c", True, 3, ("soon", "2021"), *base[5:]), (None, *base[1:])]
    facts = spark.createDataFrame([("f1", "from the table", "https://s.example/1", "2020-02-03")], "id string, fact string, url string, date string")
    got = A.adapt_gold(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], kind), facts).orderBy("ord").collect()
    assert [r.failure for r in got] == [None, "bad_or_duplicate_id", "empty_claim", "no_window", "no_graph", "window_reversed", "hops_differ", None, "bad_window", "bad_or_duplicate_id"]
    a, g = got[0], got[7]
    assert a.claim == "c" and str(a.time_window.start) == "2020-02-01" and str(a.time_window.end) == "2021-12-31" and a.reference_date == "2021-01-01"
    assert [(e.id, e.text, e.timestamp) for e in a.evidence] == [("f1", "from the table", "2020-02-03"), ("f2", "own words", "2021")]
    assert [(e.head, e.tail, str(e.start), str(e.end)) for e in a.reasoning_graph.edges][:2] == [("n0", "n1", "2020-02-01", "2020-02-29"), ("n1", "n2", "2021-01-01", "2021-12-31")]
    assert [(e.id, e.text) for e in g.evidence] == [("g-ev0", "own text")] and g.reference_date is None


def test_months(spark):
    assert one(spark, "2024-03-31", lambda c: A.months_back(c.cast("date"), 3)) == ["2024-02", "2024-01", "2023-12"]
    s = spark.createDataFrame([("m", "https://m.example/", True), ("h", "https://h.example/", False)], "source string, home string, monthly boolean")
    got = [tuple(r) for r in A.month_seeds(spark, s, "2023-12-30", "2024-01-01").orderBy("turn", "source").collect()]
    assert got == [(0, "h", "https://h.example/"), (0, "m", "https://m.example/2024/01/"), (1, "m", "https://m.example/2023/12/")]
    assert A.month_seeds(spark, s, "2024-02-01", "2024-01-01").count() == 1


def test_repair(spark):
    src = spark.createDataFrame([(1, "图"), (2, "图"), (3, "c")], "id int, t string")
    have = spark.createDataFrame([(1, "a"), (2, "还图"), (2, None)], "id int, t string")
    got = {r.id: (r.t, r.status) for r in A.repaired(src, have, "id", "t", ~F.col("t").rlike("[一-鿿]")).collect()}
    assert got == {1: ("a", "kept"), 2: ("图", "redo"), 3: ("c", "redo")}


HISTORY = "map<string,struct<status:string>>"


def test_stage_inputs(spark):
    rows = spark.createDataFrame([(1, "a", "c", True, "2020-01-01", None), (2, "a", "c", True, None, None), (3, " ", "c", True, None, None), (4, "b", " ", True, None, None), (5, "d", "c", True, None, S.DRAFT), (6, "e", "c", True, "2020-01", None)], "ord long, id string, claim string, label boolean, reference_date string, status string").withColumn("queries", F.lit("[]"))
    got = S.inputs(rows)
    assert got.columns == ["ord", "id", "claim", "reference_date", "queries", "reason"]
    assert [r.reason for r in got.orderBy("ord").collect()] == [None, "duplicate_id", "id", "claim", "draft", "reference_date"]
    assert [r.ord for r in S.inputs(rows, 2).collect()] == [1, 2]


def test_reruns_and_gates(spark):
    h = {s: ("ok",) for s in S.STAGES} | {"retrieval": ("error",)}
    df = spark.createDataFrame([("q", "e", True, "why", h)], f"queries string, explanation string, predicted_label boolean, verdict_reason string, history {HISTORY}")
    r = S.invalidate(df, "retrieval").first()
    assert (r.queries, r.explanation, r.predicted_label, r.verdict_reason, set(r.history)) == ("q", None, None, None, {"queries"})
    assert S.invalidate(df, "queries").first().queries is None and S.invalidate(df, "verdict").first().explanation == "e"
    g = S.gate(df, "verdict").first()
    assert g.status == "skipped" and g.reason == "earlier stage failed: retrieval" and S.gate(df, "retrieval").first().status is None and S.gate(df, "queries").first().status is None


def test_stage_report(spark):
    rows = spark.createDataFrame([("verdict", "ok", 1, 0, None), ("verdict", "ok", 2, 0, True), ("verdict", "skipped", 0, 0, None), ("queries", "ok", 1, 0, None)], "stage string, status string, model_calls int, search_calls int, predicted_label boolean")
    got = {r.stage: r for r in S.stage_report(rows).collect()}
    assert tuple(got["verdict"])[1:] == (3, 2, 0, 1, False, 3, 0, 1) and got["queries"].complete and got["queries"].abstentions == 0


@pytest.mark.parametrize("a, b, runner, ok", [(20, 5, True, True), (21, 5, True, False), (32, 20, False, True), (33, 5, False, False), (0, 5, True, False), (True, 5, True, False), (5, 21, True, False)])
def test_options(a, b, runner, ok):
    if ok:
        assert S.options(a, b, runner)["max_queries"] == a
    else:
        with pytest.raises(ValueError):
            S.options(a, b, runner)


def test_generator_is_required():
    assert S.require_generator({"llm": {"generator": {"provider": "p", "model": "m"}}})["model"] == "m"
    for bad in ({}, {"llm": {"generator": {"provider": "p", "model": " "}}}, {"llm": {"generator": None}}):
        with pytest.raises(ValueError):
            S.require_generator(bad)


def test_recorded_dates(spark):
    triples = spark.createDataFrame([("k1", "a", "born", "x", "1950", "year"), ("k2", "a", "won", "p", "1950", "year"), ("k3", "a", "won", "q", "1950", "year"), ("k4", "a", "made", "f", None, None), ("k5", "a", "born", "x", "1950-01-02", "day"), ("k6", "b", "won", "p", "1950", "year")], "key string, head string, relation string, tail string, date string, precision string")
    statements = spark.createDataFrame([("a", "P1", None, "1950-03-04"), ("a", "P1", None, "1949-03"), ("a", "P2", "p", "1960-05"), ("a", "P2", "q", "1960"), ("a", "P2", "q", "1961-01-01"), ("f", "P577", None, "1970-02-03"), ("f", "P577", None, "soon"), ("p", "P577", None, "1955-06-07")], "entity string, property string, tail string, date string")
    props = spark.createDataFrame([("born", "P1", True), ("won", "P2", False)], "relation string, property string, once boolean")
    got = {r.key: (r.date, r.precision, r.origin) for r in A.recorded_dates(triples, statements, props).collect()}
    assert got == {"k1": ("1949-03", "month", "once"), "k2": ("1960-05", "month", "statement"), "k3": ("1950", "year", None), "k4": ("1970-02-03", "day", "release"), "k5": ("1950-01-02", "day", None), "k6": ("1955-06-07", "day", "release")}
