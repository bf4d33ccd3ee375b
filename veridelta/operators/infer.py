"""The inference trace over recorded responses: plan, retrieve, explain, verdict.

Inside a record the queries are sequential (a query waits for the answers of those it depends on), so a record is one group of
``applyInPandas``; records are independent. A record has at most MOST_QUERIES queries, so a group is small."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_QUERIES = 32
STANCES = {"supported": True, "refuted": False, "insufficient_evidence": None}
TRACE = (
    "id string, status string, reason string, predicted_label boolean, evidence_status string, query_count int, document_counts array<int>, query_statuses array<string>, citations int, explanation string"
)


class _Fault(Exception):
    """A response that breaks its contract; the text is the reason."""


def _need(ok: bool, reason: str) -> None:
    if not ok:
        raise _Fault(reason)


def _plan(answer: dict) -> list[dict]:
    qs = answer.get("queries") if isinstance(answer, dict) else None
    _need(isinstance(qs, list) and 0 < len(qs) <= MOST_QUERIES, "plan: no list of queries")
    ids: list[str] = []
    for q in qs:
        _need(isinstance(q, dict) and isinstance(q.get("id"), str) and isinstance(q.get("text"), str) and q["text"].strip() != "", "plan: a query without id or text")
        _need(isinstance(q.get("depends_on"), list) and all(d in ids for d in q["depends_on"]), "plan: a dependency that doesn't come first")
        _need(q["id"] not in ids, "plan: an id twice")
        ids.append(q["id"])
    return qs


def _cited(citations: object, texts: dict[str, str]) -> int:
    """Citations must be exact pieces of the documents they name."""
    _need(isinstance(citations, list), "citations: no list")
    for c in citations:
        _need(isinstance(c, dict) and isinstance(c.get("quote"), str) and c["quote"] != "" and c["quote"] in texts.get(c.get("document_id"), ""), "citations: not in the document")
    return len(citations)


def trace(responses: dict[str, list], searches: list[dict]) -> dict:
    """Walk one record. ``responses``: stage -> answers in order of calls; ``searches``: query and response in order."""
    calls = {k: iter(v) for k, v in responses.items()}
    found = iter(searches)

    def take(stage: str) -> dict:
        out = next(calls.get(stage, iter(())), None)
        _need(isinstance(out, dict), f"{stage}: no answer left")
        return out

    qs = _plan(take("queries"))
    texts: dict[str, str] = {}
    state: dict[str, str] = {}
    counts: list[int] = []
    for q in qs:
        if any(state[d] != "answered" for d in q["depends_on"]):
            state[q["id"]] = "skipped_dependency"
            counts.append(0)
            continue
        text = q["text"]
        if q["depends_on"]:
            resolved = take("retrieval")
            if resolved.get("resolved") is not True:
                state[q["id"]] = "insufficient_evidence"
                counts.append(0)
                continue
            text = resolved.get("search_query")
        s = next(found, None)
        _need(isinstance(s, dict) and s.get("query") == text, "search: another query than recorded")
        docs = (s.get("response") or {}).get("documents") or []
        for d in docs:
            _need(isinstance(d.get("id"), str) and isinstance(d.get("text"), str) and texts.get(d["id"], d["text"]) == d["text"], "documents: one id, two texts")
            texts[d["id"]] = d["text"]
        counts.append(len(docs))
        if not docs:
            state[q["id"]] = "insufficient_evidence"
            continue
        a = take("retrieval")
        _need(a.get("status") in ("answered", "insufficient_evidence"), "answer: unknown status")
        if a["status"] == "answered":
            _need(_cited(a.get("citations"), texts) > 0, "answer: nothing cited")
        state[q["id"]] = a["status"]
    e = take("explanation")
    n = _cited(e.get("citations"), texts)
    stance = e.get("stance")
    _need(stance in STANCES, "explanation: unknown stance")
    if stance == "supported":
        _need(not e.get("evidence_gaps") and all(s == "answered" for s in state.values()), "explanation: support with gaps")
    _need(n > 0 if stance != "insufficient_evidence" else bool(e.get("evidence_gaps")), "explanation: citations don't fit the stance")
    v = take("verdict")
    _need("predicted_label" in v and v["predicted_label"] is STANCES[stance], "verdict: another label than the stance")
    return {"predicted_label": STANCES[stance], "evidence_status": stance, "query_count": len(qs), "document_counts": counts, "query_statuses": [state[q["id"]] for q in qs], "citations": n, "explanation": e.get("explanation")}


def run(claims: DataFrame, responses: DataFrame, searches: DataFrame) -> DataFrame:
    """One row a claim (TRACE). ``responses``: id, stage, call_index, response (JSON text); ``searches``: id, call_index, query,
    response. A claim without responses, or with a broken one, is failed with its reason; the others aren't touched by it."""
    r = responses.select("id", "stage", F.col("call_index").cast("int").alias("call_index"), F.lit(None).cast("string").alias("query"), "response")
    s = searches.select("id", F.lit("search").alias("stage"), F.col("call_index").cast("int").alias("call_index"), "query", "response")
    blank = claims.select("id", F.lit("").alias("stage"), F.lit(-1).alias("call_index"), F.lit(None).cast("string").alias("query"), F.lit(None).cast("string").alias("response"))
    rows = r.unionByName(s).join(claims.select("id"), "id", "left_semi").unionByName(blank)

    def one(pdf):
        import pandas as pd

        own, found = {}, []
        out = {"id": pdf["id"].iloc[0], "status": "ok", "reason": None, "predicted_label": None, "evidence_status": None, "query_count": 0, "document_counts": [], "query_statuses": [], "citations": 0, "explanation": None}
        try:
            for row in pdf.sort_values(["stage", "call_index"]).itertuples(index=False):
                if row.stage == "search":
                    found.append({"query": row.query, "response": json.loads(row.response)})
                elif row.stage:
                    own.setdefault(row.stage, []).append(json.loads(row.response))
            out |= trace(own, found)
        except (_Fault, ValueError, AttributeError, TypeError) as e:
            out |= {"status": "failed", "reason": str(e)}
        return pd.DataFrame([out])

    return rows.groupBy("id").applyInPandas(one, TRACE)
