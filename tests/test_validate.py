import pytest
from pyspark.sql import functions as F

from veridelta.operators import validate as V


def test_audit(spark):
    kind = "struct<accepted:boolean,confidence:double,entity_accuracy:boolean,temporal_grounding:boolean,verdict_consistent:boolean,evidence_support:boolean>"
    rows = [(True, 0.95, True, True, True, True), (True, 0.5, True, True, True, True), (True, 0.95, None, True, True, True), (False, 0.95, True, True, True, True), (True, 1.5, True, True, True, True), None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, a {kind}")
    assert [r[1] for r in df.select("i", V.audit_reason(F.col("a"))).orderBy("i").collect()] == [None, "confidence", "entity_accuracy", "accepted", "confidence", "missing"]


def test_drafts(spark):
    A = lambda *x: F.array(*map(F.lit, x))
    reason = lambda *c: spark.range(1).select(V.positive_reason(*c)).first()[0]
    assert reason(F.lit("c"), A("e1", "e2"), A("a"), A("e2", "e1"), A("a")) is None
    assert reason(F.lit(" "), A("e1"), A("a"), A("e1"), A("a")) == "no_claim"
    assert reason(F.lit("c"), A("e1", "e1"), A("a"), A("e1"), A("a")) == "edge_list"
    assert reason(F.lit("c"), A("e1"), A("a"), A("e1", "e2"), A("a")) == "edges"
    assert reason(F.lit("c"), A("e1"), A("b"), A("e1"), A("a")) == "entities"
    base = {"claim": "Eve won in 2021", "parent": "Ada won in 2021", "field": "head", "before": "Ada", "original": "Ada", "after": "Eve", "kb": "person", "ka": "person", "quote": "Eve won"}

    def neg(**k):
        v = base | k
        L = {n: F.lit(x) for n, x in v.items()}
        return spark.range(1).select(V.negative_reason(L["claim"], L["parent"], L["field"], A("head", "tail"), L["before"], L["original"], L["after"], L["kb"], L["ka"], L["quote"])).first()[0]

    assert neg() is None and neg(field="date") == "field" and neg(before="Bob") == "before" and neg(after="A da") == "after" and neg(ka="place") == "kind" and neg(quote="Ada won") == "quote"
    assert neg(parent="Eve won in 2021") == "unchanged"


def test_batches(spark):
    items = spark.createDataFrame([("b", 0), ("b", 1), ("b", 2)], "batch string, index int")
    res = spark.createDataFrame([("b", 0, 1, "old"), ("b", 0, 2, "new"), ("b", 1, 1, " ")], "batch string, index int, result_ord int, t string")
    assert [(r.t, r.reason) for r in V.batch_results(items, res, ["batch"], "index", ["t"]).orderBy("index").collect()] == [("new", None), (" ", "t"), (None, "missing")]


def test_response_facts(spark):
    f = [("The mill burned", "2020-02-30", "mill"), ("The  mill burned", "2020", "x"), ("Ada led it", "2020-02", "Ada led"), ("abc", None, None), (None, None, None)]
    df = spark.createDataFrame([(1, "Ada led the mill", f)], "k int, t string, f array<struct<fact:string,date:string,evidence:string>>")
    got = V.response_facts(df, "k", "t", "f").orderBy("fact").collect()
    assert [tuple(r)[1:] for r in got] == [("Ada led it", "2020-02", "month", True), ("The mill burned", None, None, True)]


def test_category_and_subtlety(spark):
    c = V.category(F.col("p"), [("person", ["Q5"]), ("place", ["Q2", "Q3"])], F.lit("other"))
    df = spark.createDataFrame([(["Q3", "Q5"],), (["Q2"],), ([],)], "p array<string>").select(c.alias("c"))
    assert [r.c for r in df.collect()] == ["person", "place", "other"]
    s = spark.range(1).select(V.subtlety(F.lit("In 2019 it drew 1,000 people"), F.lit("In 2021 it drew 1,250 people")).alias("s")).first().s
    assert s.years == 2 and s.numbers == 0.25
    s = spark.range(1).select(V.subtlety(F.lit("none"), F.lit("none")).alias("s")).first().s
    assert s.years is None and s.numbers is None


def test_statements_and_sections(spark, rows):
    st = spark.createDataFrame([("a", "born", "2001"), ("a", "born", "2000-01"), ("a", "won", "2010"), ("b", "won", "2011"), ("b", "won", "2012"), ("c", "won", "soon")], "q string, p string, date string")
    assert rows(V.statement_date(st, ["q"], "p", ["born"])) == [("a", "born", "2000-01"), ("a", "won", "2010")]
    df = spark.createDataFrame([(1, "Intro here.\nThe numbers\nTen people came.\n- a list item\nBackground\n"), (2, None), (3, "")], "k int, t string")
    assert rows(V.sections(df, "k", "t")) == [(1, 0, None, "Intro here."), (1, 1, "The numbers", "Ten people came.\n- a list item"), (1, 2, "Background", "")]


def test_window_reason(spark):
    r = lambda a, b, c: spark.createDataFrame([(a, b, c)], "a string, b string, c string").select(V.window_reason(F.col("a"), F.col("b"), F.col("c"))).first()[0]
    assert r("2020-01-01", "2020-02-01", "2020-01-15") is None
    assert [r(None, "x", None), r("x", "2020-01-01", None), r("2020-02-01", "2020-01-01", None), r("2020-02-01", "2020-03-01", "2020-01-01"), r("1800-01-01", "2020-01-01", None)] == ["missing", "invalid", "reversed", "after_reference", "too_long"]


@pytest.mark.parametrize("claim, years, want", [("in 1990 and 2005", [1992, 2005], 2), ("in 1990", [], None), ("in 2005", [2005], None), ("no year 20055", [2005], None), (None, [1], None)])
def test_year_delta(spark, claim, years, want):
    df = spark.createDataFrame([(claim, years)], "c string, y array<int>")
    assert df.select(V.year_delta(F.col("c"), F.col("y"))).first()[0] == want


@pytest.mark.parametrize("claim, facts, want", [("12 men of 30", ["10 men", "of 30"], 0.2), ("10 men", ["10 men"], None), ("5 men", ["no number"], None), ("2.5", ["2"], 0.25), ("7 men", [None, "8"], 0.125)])
def test_number_delta(spark, claim, facts, want):
    df = spark.createDataFrame([(claim, facts)], "c string, f array<string>")
    assert df.select(V.number_delta(F.col("c"), F.col("f"))).first()[0] == (want if want is None else pytest.approx(want))


def test_entity_change(spark):
    claims = spark.createDataFrame([(1, "Ada Oll met Jon Ask", ["Ada Oll"]), (2, "Ada Oll met Port Vale", ["Ada Oll"]), (3, "Ada Oll", ["Ada Oll"]), (4, "Jon Ask", ["nobody"])], "k int, c string, n array<string>")
    known = spark.createDataFrame([("Ada Oll", "person", 8), ("Jon Ask", "person", 2), ("Port Vale", "city", 16)], "name string, category string, views int")
    got = {r.k: (r.same_category, r.views_ratio) for r in V.entity_change(claims, known, "k", "c", "n").collect()}
    assert got == {1: (True, 0.25), 2: (False, 2.0), 4: (False, None)}


def test_subtlety_of_edits(spark):
    """The spread of edits against a loop over the same variants."""
    import re

    df = spark.createDataFrame([("In 2010, 40 of 50 came", "In 2013, 40 of 50 came"), ("40 of 50", "44 of 25"), ("1,000 men", "1,100 men"), ("none", "nothing")], "a string, b string")
    for a, b, s in df.select("a", "b", V.subtlety(F.col("a"), F.col("b"))).collect():
        year = r"(?<!\d)(?:19|20)\d{2}(?!\d)"
        ys = [abs(int(x) - int(y)) for x, y in zip(re.findall(year, a), re.findall(year, b)) if x != y]
        ns = lambda t: [float(x.replace(",", "")) for x in re.findall(r"\d+(?:,\d{3})*(?:\.\d+)?", re.sub(year, "#", t))]
        rs = [abs(x - y) / max(abs(x), 1) for x, y in zip(ns(a), ns(b)) if x != y]
        assert s.years == (min(ys) if ys else None) and s.numbers == (pytest.approx(max(rs)) if rs else None)
