import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from veridelta.functions import dates as D
from veridelta.operators import build as B

ENTITY = "struct<id:string,label:string,type:string,domain:string,disambiguation:string>"
FACT = "struct<head:string,relation:string,tail:string,start:string,end:string,time_precision:string,temporal_kind:string,polarity:string,evidence_quote:string,time_evidence_quotes:array<string>,temporal_anchor:struct<quote:string,date:string,offset_days:int>>"
DRAFT = f"struct<time_sensitive:boolean,claim:string,source_verdict:string,verdict_evidence_quote:string,entities:array<{ENTITY}>,facts:array<{FACT}>>"
AUDIT = "struct<accepted:boolean,confidence:double,entity_accuracy:boolean,temporal_grounding:boolean,verdict_consistent:boolean,evidence_support:boolean>"
SCHEMA = f"ord long, id string, language string, text string, source_verdict string, pre_extracted {DRAFT}, pre_audit {AUDIT}"

TEXT = "Mira Oll founded the Quay Press on 4 May 2011. Two days later it hired Jon Ask. The claim is false. In 2014 it closed."
PEOPLE = [{"id": "m", "label": "Mira Oll", "type": "person", "domain": "civic"}, {"id": "q", "label": "Quay Press", "type": "organization", "domain": "civic", "disambiguation": "printer"}, {"id": "y", "label": "2014", "type": "time", "domain": "time"}, {"id": "c", "label": "closure", "type": "event", "domain": "civic"}]
FOUNDED = {"head": "m", "relation": "founded", "tail": "q", "start": "2011-05-04", "end": "2011-05-04", "time_precision": "day", "polarity": "positive", "evidence_quote": "Mira Oll founded the Quay Press on 4 May 2011"}
CLOSED = {"head": "c", "relation": "occurred_during", "tail": "y", "start": "2014-01-01", "end": "2014-12-31", "time_precision": "year", "temporal_kind": "event", "polarity": "positive", "evidence_quote": "In 2014 it closed"}
GOOD = {"accepted": True, "confidence": 0.95, "entity_accuracy": True, "temporal_grounding": True, "verdict_consistent": True, "evidence_support": True}


def article(o, i, facts=(FOUNDED,), audit=GOOD, given="False", drafted="false", sensitive=True, text=TEXT, entities=PEOPLE, **draft):
    return {"ord": o, "id": i, "language": "en", "text": text, "source_verdict": given, "pre_extracted": {"time_sensitive": sensitive, "claim": "c", "source_verdict": drafted, "entities": entities, "facts": list(facts)} | draft, "pre_audit": audit}


def graph(spark, rows, **options):
    schema = spark.createDataFrame([], SCHEMA).schema
    df = spark.createDataFrame([(json.dumps(r),) for r in rows], "j string").select(F.from_json("j", schema).alias("r")).select("r.*")
    return B.build(df, "pre_audit", **options)


ANCHOR = {"head": "q", "relation": "appointed_to", "tail": "m", "start": "2011-05-06", "end": "2011-05-06", "time_precision": "day", "polarity": "positive", "evidence_quote": "Two days later it hired Jon Ask", "temporal_anchor": {"quote": "on 4 May 2011", "date": "2011-05-04", "offset_days": 2}}
FAULTS = {
    "endpoint": FOUNDED | {"tail": "x"}, "relation": FOUNDED | {"relation": "likes"}, "polarity": FOUNDED | {"polarity": "maybe"}, "kind": FOUNDED | {"temporal_kind": "mood"}, "date": FOUNDED | {"start": "4 May 2011"},
    "reversed": FOUNDED | {"end": "2011-05-03"}, "precision": FOUNDED | {"time_precision": "hour"}, "year_bounds": CLOSED | {"start": "2014-02-01"}, "month_bounds": FOUNDED | {"time_precision": "month"},
    "quote": FOUNDED | {"evidence_quote": "Mira Oll founded it"}, "time_quote": FOUNDED | {"time_evidence_quotes": ["on 5 May 2011"]}, "grounding": FOUNDED | {"start": "2011-05-03"},
    "occurrence": CLOSED | {"head": "m"}, "time_node": FOUNDED | {"tail": "y"}, "outside_time_node": CLOSED | {"start": "2014-01-01", "end": "2015-12-31", "evidence_quote": "In 2014 it closed", "time_evidence_quotes": ["in 2015"]},
}


def test_reasons(spark):
    rows = [article(k, n, [CLOSED, f], text=TEXT + " Reopened in 2015.") for k, (n, f) in enumerate(FAULTS.items())]
    rows[-1]["text"] = TEXT + " It was remembered in 2015."
    got = {r.id: (r.status, r.reason) for r in graph(spark, rows).records.collect()}
    assert got == {n: ("rejected", n) for n in FAULTS}


def test_acceptance_of_articles(spark):
    rows = [
        article(1, "a", [FOUNDED, CLOSED, ANCHOR]), article(2, "a"), article(3, "b", given="nonsense"), article(4, "c", drafted="true"), article(5, "d", given=None), article(6, "e", given=None, verdict_evidence_quote="The claim is false"),
        article(7, "f", audit=GOOD | {"confidence": 0.89}), article(8, "g", audit=None), article(9, "h", sensitive=False), article(10, "i", sensitive=None), article(11, "j", []), article(12, "k", text=" "),
        article(13, "l", entities=[*PEOPLE, PEOPLE[0]]), article(14, "m", entities=[*PEOPLE, {"id": "z", "label": " ", "type": "person", "domain": "civic"}]), article(15, "n", sensitive=False, audit=GOOD | {"evidence_support": False}), article(16, "o", entities=[*PEOPLE, {"id": "z", "label": "May 2011", "type": "time", "domain": "time"}]),
    ]
    g = graph(spark, rows)
    got = {r.ord: (r.status, r.reason) for r in g.records.collect()}
    no = lambda r: ("rejected", r)
    assert got == {
        1: ("accepted", None), 2: no("duplicate_source"), 3: no("unknown_verdict"), 4: no("verdict_disagrees"), 5: no("missing_verdict"), 6: ("accepted", None), 7: no("audit"), 8: no("audit"), 9: ("time_robust", None),
        10: no("no_classification"), 11: no("no_facts"), 12: no("no_text"), 13: no("entity_twice"), 14: no("entity"), 15: no("audit"), 16: no("time_label"),
    }
    assert [r.id for r in g.time_robust.collect()] == ["h"]
    edges = {r.relation: r for r in g.edges.collect()}
    assert g.edges.count() == 4 and edges["occurred_during"].tail == "temporal:2014" and edges["appointed_to"].sources == ["a"]
    # the founder has no disambiguation, so each article has its own; the press is one node
    press = g.nodes.where("label = 'Quay Press'").collect()
    assert len(press) == 1 and press[0].source_ids == ["a", "e"] and g.nodes.where("label = 'Mira Oll'").count() == 2


def test_merging_and_quarantine(spark):
    told = [e | {"disambiguation": "x"} if e["type"] != "time" else e for e in PEOPLE]
    other = FOUNDED | {"time_evidence_quotes": ["on 4 May 2011"]}
    denied = CLOSED | {"relation": "founded", "head": "m", "tail": "q", "polarity": "negative"}
    stays = CLOSED | {"relation": "founded", "head": "m", "tail": "q", "start": "2014-01-01", "polarity": "positive"}
    g = graph(spark, [article(1, "a", [FOUNDED, stays], entities=told), article(2, "b", [other], entities=told, given="True", drafted="correct")])
    e = g.edges.where("start = '2011-05-04'").first()
    assert e.sources == ["a", "b"] and e.verdicts == {"a": "false", "b": "true"} and [(c.source_id, c.kind) for c in e.evidence] == [("a", "fact"), ("b", "fact"), ("b", "temporal")]
    assert g.edges.count() == 2 and g.contradictions.count() == 0
    g = graph(spark, [article(1, "a", [FOUNDED, stays], entities=told), article(2, "b", [denied], entities=told)])
    assert g.contradictions.count() == 1 and [r.start for r in g.edges.collect()] == ["2011-05-04"] and g.nodes.count() == 2
    empty = graph(spark, [])
    assert empty.edges.count() == empty.nodes.count() == empty.records.count() == 0


@pytest.mark.parametrize("precision, text, want", [
    ("day", "on 2011-05-04.", True), ("day", "May 4th, 2011", True), ("day", "04 MAY 2011", True), ("day", "2011年5月4号", True), ("day", "12011-05-04", False), ("day", "May 2011", False), ("day", "04/05/11", False), ("day", None, None),
    ("month", "2011-05", True), ("month", "in May 2011", True), ("month", "2011年 05月", True), ("month", "2011", False), ("year", "in 2011,", True), ("year", "20110", False), (None, "2011", None),
])
def test_grounded_as(spark, precision, text, want):
    df = spark.createDataFrame([(dt.date(2011, 5, 4), precision, text)], "d date, p string, t string")
    assert df.select(D.grounded_as(F.col("d"), F.col("p"), F.col("t"))).first()[0] is want


@pytest.mark.parametrize("offset, quote, want", [(2, "two days after", True), (2, "2 days later", True), (2, "2天后", True), (2, "two days before", False), (3, "three days after", False), (-2, "two days before", False)])
def test_relative_grounded(spark, offset, quote, want):
    df = spark.createDataFrame([(dt.date(2011, 5, 6), dt.date(2011, 5, 4), offset, quote)], "d date, a date, o int, q string")
    assert df.select(D.relative_grounded(F.col("d"), F.col("a"), F.col("o"), F.lit("on 4 May 2011"), F.col("q"))).first()[0] is want


def test_contexts_need_quotes_and_an_audit(spark):
    nodes = spark.createDataFrame([(f"n{k}",) for k in range(5)], "node_id string")
    good = (True, 0.95, True, True, True, True)
    rows = [("n0", "A press in Port Vale.", "s", "a press", ["press in"], good), ("n1", "A press.", "s", "a press", ["mill"], good), ("n2", "A press.", "s", " ", ["press"], good), ("n3", "A press.", "s", "a press", ["press"], (True, 0.5, True, True, True, True)), ("n3", "A press.", "s", "a press", [], good)]
    got = {r.node_id: r.context for r in B.contexts(nodes, spark.createDataFrame(rows, f"node_id string, extract string, source string, summary string, quotes array<string>, pre_audit {AUDIT}")).collect()}
    assert got["n0"].summary == "a press" and [got[f"n{k}"] for k in range(1, 5)] == [None] * 4


def test_trusted_ids(spark):
    """An id counts only where the article links the label or the local id to the same one."""
    kind = "struct<id:string,label:string,type:string,canonical_id:string,disambiguation:string>"
    rows = [(("m", "Mira Oll", "person", "Q12", None), {"Mira Oll": "Q12"}), (("m", "Mira Oll", "person", "Q12", None), {"m": "Q12"}), (("m", "Mira Oll", "person", "Q12", None), {"Mira Oll": "Q13"}), (("m", "Mira Oll", "person", "Q0", None), {"m": "Q0"}), (("m", "Mira Oll", "person", None, None), None), (("y", "2014", "time", "Q7", None), {"y": "Q7"})]
    got = [r[0] for r in spark.createDataFrame(rows, f"e {kind}, l map<string,string>").select(B.node_id(F.col("e"), F.lit("en"), F.lit("a"), F.col("l"))).collect()]
    assert got[0] == got[1] == "wikidata:Q12" and got[5] == "temporal:2014" and all(x.startswith("entity:") for x in got[2:5])
