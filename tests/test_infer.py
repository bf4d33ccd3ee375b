import json

from veridelta.operators import infer as I

# Who built the mill (m) leads to when it burned (w) and who owned it then (o), and both to who was paid (p).
DIAMOND = {"queries": [{"id": "m", "text": "who built the mill?", "depends_on": []}, {"id": "w", "text": "when did their mill burn?", "depends_on": ["m"]}, {"id": "o", "text": "who owned their mill?", "depends_on": ["m"]}, {"id": "p", "text": "who was paid?", "depends_on": ["w", "o"]}]}
FOUND = {
    "who built the mill?": ("page1", "The mill was built by Orla Finch in 1871."),
    "mill of Orla Finch fire": ("page2", "Fire took the mill on 4 May 1902."),
    "mill of Orla Finch owner": ("page3", "In 1902 the guild of bakers owned it."),
    "payment to the guild of bakers 1902": ("page4", "The insurer paid the guild 900 crowns."),
}
QUOTES = ["Orla Finch", "4 May 1902", "guild of bakers", "paid the guild"]


def answered(k):
    return {"status": "answered", "answer": QUOTES[k], "citations": [{"document_id": f"page{k + 1}", "quote": QUOTES[k]}]}


def resolved(query):
    return {"resolved": True, "search_query": query}


def searches(*queries):
    return [{"query": q, "response": {"documents": [{"id": FOUND[q][0], "text": FOUND[q][1]}] if q in FOUND else []}} for q in queries]


def closing(stance, label, quotes=(), gaps=()):
    cited = [{"document_id": f"page{k + 1}", "quote": QUOTES[k]} for k in quotes]
    return {"explanation": [{"explanation": "as found", "stance": stance, "citations": cited, "evidence_gaps": list(gaps)}], "verdict": [{"predicted_label": label}]}


ALL = list(FOUND)
WHOLE = {"queries": [DIAMOND], "retrieval": [answered(0), resolved(ALL[1]), answered(1), resolved(ALL[2]), answered(2), resolved(ALL[3]), answered(3)]} | closing("supported", True, range(4))
# The owner can't be told from what is found, so nobody is asked who was paid; the fire alone refutes the claim.
PARTLY = {"queries": [DIAMOND], "retrieval": [answered(0), resolved(ALL[1]), answered(1), resolved("owner in 1902")]} | closing("refuted", False, [1], ["owner"])
# The step to the fire can't even be put into words.
STUCK = {"queries": [DIAMOND], "retrieval": [answered(0), {"resolved": False}, resolved(ALL[2]), answered(2)]} | closing("insufficient_evidence", None, (), ["when"])


def run(spark, records):
    claims = spark.createDataFrame([(i,) for i in records], "id string")
    resp = [(i, s, k, json.dumps(a)) for i, (r, _) in records.items() for s, answers in r.items() for k, a in enumerate(answers)]
    found = [(i, k, s["query"], json.dumps(s["response"])) for i, (_, ss) in records.items() for k, s in enumerate(ss)]
    out = I.run(claims, spark.createDataFrame(resp, "id string, stage string, call_index int, response string"), spark.createDataFrame(found, "id string, call_index int, query string, response string"))
    return {r.id: r for r in out.collect()}


def test_whole_and_partial_traces(spark):
    got = run(spark, {"whole": (WHOLE, searches(*ALL)), "partly": (PARTLY, searches(ALL[0], ALL[1], "owner in 1902")), "stuck": (STUCK, searches(ALL[0], ALL[2]))})
    w, p, s = got["whole"], got["partly"], got["stuck"]
    assert (w.status, w.predicted_label, w.evidence_status, w.query_count, w.citations) == ("ok", True, "supported", 4, 4)
    assert w.document_counts == [1, 1, 1, 1] and set(w.query_statuses) == {"answered"}
    assert (p.status, p.predicted_label) == ("ok", False) and p.document_counts == [1, 1, 0, 0]
    assert p.query_statuses == ["answered", "answered", "insufficient_evidence", "skipped_dependency"]
    assert (s.status, s.predicted_label) == ("ok", None) and s.query_statuses == ["answered", "insufficient_evidence", "answered", "skipped_dependency"]


def test_one_broken_record_leaves_the_others(spark):
    misquoted = json.loads(json.dumps(WHOLE))
    misquoted["retrieval"][4]["citations"][0]["quote"] = "guild of brewers"
    bold = PARTLY | closing("supported", True, [1])
    flipped = WHOLE | {"verdict": [{"predicted_label": None}]}
    cyclic = WHOLE | {"queries": [{"queries": DIAMOND["queries"][::-1]}]}
    short = WHOLE | {"retrieval": WHOLE["retrieval"][:-1]}
    records = {"whole": (WHOLE, searches(*ALL)), "misquoted": (misquoted, searches(*ALL)), "bold": (bold, searches(ALL[0], ALL[1], "owner in 1902")), "flipped": (flipped, searches(*ALL)), "cyclic": (cyclic, searches(*ALL)), "short": (short, searches(*ALL)), "silent": ({}, [])}
    got = run(spark, records | {"other": (WHOLE, searches(*ALL[::-1]))})
    assert got.pop("whole").status == "ok"
    assert {k: r.reason for k, r in got.items()} == {
        "misquoted": "citations: not in the document", "bold": "explanation: support with gaps", "flipped": "verdict: another label than the stance", "cyclic": "plan: a dependency that doesn't come first",
        "short": "retrieval: no answer left", "silent": "queries: no answer left", "other": "search: another query than recorded",
    }
