"""Eight claims about a harbour, with recorded judgements; the expected scores are worked out beside the cases."""

import json

import pytest
from pyspark.sql import functions as F

from veridelta.operators import evaluate as E

GOLD = "id string, ord long, hop_count int, label boolean, time_window struct<start:string,end:string>, query_time_windows map<string,struct<start:string,end:string>>"
MARCH = ("2019-03-01", "2019-03-31")


def page(name, day="2019-03-10", url=None):
    return {"id": name, "url": url or f"https://harbour.example/{name}", "text": f"about {name}", "timestamp": day}


def ask(*documents, name="a", after=()):
    return {"id": name, "text": f"what about {name}?", "depends_on": list(after), "retrieved_documents": list(documents)}


class Case:
    """One claim: what was predicted and what the judge said of it."""

    def __init__(self, label, hops=2, queries=None, text=None, verdict=None, dc=1, sr=1, times=(), relevant=(), gate=None, quality=None):
        self.label, self.hops, self.queries, self.text, self.verdict = label, hops, queries, text, verdict
        self.answers = []
        if times:
            rated = [{"query_id": q["id"], "kind": kind, "correct": ok} for q, (kind, ok) in zip(queries, times)]
            self.answers.append(("queries", 0, {"gold_sufficient": True, "s_dc": dc, "s_sr": sr, "temporal_ratings": rated}))
        for call, marks in enumerate(relevant):
            self.answers.append(("retrieval", call, {"relevance": [{"rank_id": f"q{call}:r{rank}", "relevant": mark} for rank, mark in marks.items()]}))
        if gate is not None:
            self.answers.append(("explanation", 0, {"i_align": gate}))
        if quality:
            self.answers.append(("explanation", 1, {"gold_sufficient": True} | dict(zip(("sufficiency", "factual_correctness", "temporal_plausibility"), quality))))


RIGHT, HALF, WRONG = ("absolute", True), ("relative", True), ("absolute", False)
CASES = {
    # queries .3 + .3 + .4 = 1; two of five ranks hit (the page before March and the repeated one don't count): .4; explanation 2.4 / 3 = .8; right verdict
    "pier": Case(True, 2, [ask(page("crane"), page("gull"), page("rope"), page("mast", "2019-02-28"), page("crane", url="https://harbour.example/other"))], "the pier opened", True,
                 times=[RIGHT], relevant=[{1: True, 2: False, 3: True, 4: True}], gate=1, quality=(1, 0.5, 0.9)),
    # queries .3 + .3 + .2 = .8; the last day of March counts, no day doesn't: 1 / 5; not aligned: 0; wrong verdict
    "lock": Case(False, 3, [ask(page("gate", "2019-03-31"), page("key", None))], "the lock broke", True, times=[HALF], relevant=[{1: True, 2: True}], gate=0),
    # queries 0 + .3 + .4 = .7; hits in the first and the third query, where another spelling of the URL is the same page: 2 / 15; explanation 1.5 / 3 = .5; no verdict
    "tram": Case(True, 3, [ask(page("rail")), ask(name="b", after=["a"]), ask(page("bell", url="https://harbour.example/bell"), page("bell2", url="HTTPS://Harbour.example:443/bell#top"), name="c", after=["b"])], "the tram ran", None,
                 dc=0, times=[RIGHT, RIGHT, RIGHT], relevant=[{1: True}, {}, {1: True}], gate=1, quality=(0.6, 0.7, 0.2)),
    # queries .3 + .15 + .4 * .25 = .55; nothing relevant in March: 0; explanation .5; right verdict
    "buoy": Case(False, 4, [ask(page("paint")), ask(page("salt", "2020-03-10"), name="b", after=["a"])], "the buoy stayed", False, sr=0.5, times=[HALF, WRONG], relevant=[{1: False}, {1: True}], gate=1, quality=(0.5, 0.5, 0.5)),
    # queries 0 + .15 + .4 * .25 = .25; no page: 0; blank explanation: 0; wrong verdict
    "dock": Case(True, 5, [ask(), ask(name="b")], " ", False, dc=0, sr=0.5, times=[HALF, ("missing", False)]),
    # an empty list, broken JSON and no prediction at all: 0 everywhere
    "net": Case(True, 2, [], "", None),
    "reef": Case(False, 4, "[{", None, True),
    "fog": Case(True, 5),
}
# The four scores that an evaluation of this kind is known by.
GOLDEN = {"queries": 0.4125, "retrieval": 0.0916667, "explanation": 0.225, "verdict": 0.25}


def tables(spark, cases=CASES, without=(), instead=None):
    """(aligned, judged); ``without`` leaves answers out, ``instead`` replaces some."""
    gold = spark.createDataFrame([(i, k, c.hops, c.label, MARCH, None) for k, (i, c) in enumerate(cases.items())], GOLD)
    text = lambda q: q if isinstance(q, str) else json.dumps(q)
    preds = spark.createDataFrame([(i, k, text(c.queries), c.text, c.verdict) for k, (i, c) in enumerate(cases.items()) if i != "fog"], "id string, ord long, queries string, explanation string, predicted_label boolean")
    said = {(i, s, k): a for i, c in cases.items() for s, k, a in c.answers if (i, s) not in without} | (instead or {})
    judged = spark.createDataFrame([(i, s, k, json.dumps(a)) for (i, s, k), a in said.items()], "id string, stage string, call_index int, response string")
    return E.align(gold, E.parse_queries(preds)), judged


def test_golden_scores(spark):
    al, j = tables(spark)
    stages = {"queries": E.judged_queries(al, j), "retrieval": E.judged_retrieval(al, j), "explanation": E.judged_explanation(al, j), "verdict": E.judged_verdict(al)}
    got = {r.stage: r for r in E.all_stages(stages).where("scope = 'all'").collect()}
    assert {k: r.score for k, r in got.items()} == pytest.approx(GOLDEN, abs=1e-6)
    assert all(r.complete and r.n == 8 and r.coverage == 1 for r in got.values())


def test_scores_of_each_case(spark):
    al, j = tables(spark)
    of = lambda df: {r.id: r.score for r in df.collect()}
    rest = {"net": 0, "reef": 0, "fog": 0}
    assert of(E.judged_queries(al, j)) == pytest.approx({"pier": 1, "lock": 0.8, "tram": 0.7, "buoy": 0.55, "dock": 0.25} | rest)
    assert of(E.judged_retrieval(al, j)) == pytest.approx({"pier": 0.4, "lock": 0.2, "tram": 2 / 15, "buoy": 0, "dock": 0} | rest)
    assert of(E.judged_explanation(al, j)) == pytest.approx({"pier": 0.8, "lock": 0, "tram": 0.5, "buoy": 0.5, "dock": 0} | rest)
    assert of(E.judged_verdict(al)) == {"pier": 1, "lock": 0, "tram": 0, "buoy": 1, "dock": 0} | rest


def test_missing_judgement_makes_the_headline_null(spark):
    al, j = tables(spark, without={("tram", "queries")})
    rows = {r.id: r for r in E.judged_queries(al, j).collect()}
    assert rows["tram"].score is None and rows["tram"].status == "evaluation_error" and rows["fog"].status == "missing_output" and rows["reef"].status == "invalid_output"
    s = E.summary(E.judged_queries(al, j)).first()
    assert s.score is None and s.errors == 1 and s.scored_mean == pytest.approx(2.6 / 7)


@pytest.mark.parametrize(
    "text, want",
    [(None, "missing_output"), ("[]", "missing_output"), ("{", "invalid_output"), ('{"a":1}', "invalid_output"), ("[1]", "invalid_output"), ('[{"id":1,"text":"a","depends_on":[],"retrieved_documents":[]}]', "invalid_output"),
     ('[{"id":"q","text":"a","depends_on":[1],"retrieved_documents":[]}]', "invalid_output"), ('[{"id":"q","text":"a","depends_on":[],"retrieved_documents":[]}]', "ok"), ('[{"id":"q","text":"a","depends_on":["x"],"retrieved_documents":[{"id":"d"}]}]', "ok")],
)
def test_untrusted_shapes(spark, text, want):
    df = spark.createDataFrame([("i", text)], "id string, queries string")
    assert E.parse_queries(df).first().q_status == want


def test_ill_typed_flags_are_not_numbers(spark):
    al, j = tables(spark, instead={("pier", "explanation", 0): {"i_align": True}})
    assert {r.id: r.status for r in E.judged_explanation(al, j).collect()}["pier"] == "evaluation_error"


def test_own_windows(spark):
    """A query's own window replaces the claim's; a day is read in the offset that it is written in."""
    q = [ask(page("tide", "2019-03-04T23:30:00-09:00"), page("wave", "2019-03-20"), page("foam", "2019-03-04T23:30:00"), name="q7")]
    gold = spark.createDataFrame([("g", 1, 2, True, MARCH, {"q7": ("2019-03-02", "2019-03-04")})], GOLD)
    preds = spark.createDataFrame([("g", 1, json.dumps(q), "e", True)], "id string, ord long, queries string, explanation string, predicted_label boolean")
    j = spark.createDataFrame([("g", "retrieval", 0, json.dumps({"relevance": [{"rank_id": f"q0:r{k}", "relevant": True} for k in (1, 2, 3)]}))], "id string, stage string, call_index int, response string")
    assert E.judged_retrieval(E.align(gold, E.parse_queries(preds)), j).first().score == pytest.approx(1 / 5)


def test_alignment_takes_first_rows(spark):
    gold = spark.createDataFrame([("a", 2, True), ("a", 1, False)], "id string, ord long, label boolean")
    pred = spark.createDataFrame([("a", 5, True), ("a", 4, None)], "id string, ord long, predicted_label boolean")
    r = E.align(gold, pred).select("label", "p_predicted_label", F.col("has_prediction")).collect()
    assert [tuple(x) for x in r] == [(False, None, True)]


def test_hits_in_the_row(spark):
    pages = [page("ebb"), page("ebb", url="https://harbour.example/z"), page("flow", url="HTTPS://harbour.example/ebb"), page("spring", "2019-04-01"), page("neap", None), page("slack")]
    kind = "array<struct<id:string,url:string,text:string,timestamp:string>>"
    df = spark.createDataFrame([([tuple(d.values()) for d in pages], MARCH), ([], MARCH), ([tuple(page("x").values())], None)], f"d {kind}, w struct<start:string,end:string>")
    hits = lambda k: [r[0] for r in df.select(E.query_hits(F.col("d"), F.col("w"), lambda d: d["id"] != "q", k)).collect()]
    assert hits(5) == [1, 0, 0] and hits(6) == [2, 0, 0]
