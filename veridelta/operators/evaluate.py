"""The four metrics over gold and untrusted predictions. Faults are data: a status column, never an exception."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridelta.functions.dates import source_day
from veridelta.functions.text import let, scoring_url

K = 5
QUERIES = "array<struct<id:string,text:string,depends_on:array<string>,retrieved_documents:array<struct<id:string,url:string,text:string,timestamp:string>>>>"


def parse_queries(predictions: DataFrame, column: str = "queries") -> DataFrame:
    """Adds q (the queries, typed) and q_status: missing_output (null or an empty list), invalid_output (no JSON, no list, or a
    query that isn't an object with text id and text, list depends_on of texts and list retrieved_documents), ok. Types are looked
    at before casting, so a wrong type is never taken for a null."""
    v = F.try_parse_json(F.col(column))
    typ = lambda x: F.schema_of_variant(x)
    items = F.try_variant_get(v, "$", "array<variant>")
    field = lambda q, name: F.try_variant_get(q, f"$.{name}", "variant")
    text = lambda q, name: F.coalesce(typ(field(q, name)) == "STRING", F.lit(False))
    listed = lambda q, name: F.coalesce(F.startswith(typ(field(q, name)), F.lit("ARRAY")), F.lit(False))
    deps = lambda q: F.coalesce(typ(field(q, "depends_on")).isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(False))
    good = lambda q: F.coalesce(F.startswith(typ(q), F.lit("OBJECT")), F.lit(False)) & text(q, "id") & text(q, "text") & deps(q) & listed(q, "retrieved_documents")
    status = (
        F.when(F.col(column).isNull(), "missing_output").when(v.isNull() | ~F.startswith(typ(v), F.lit("ARRAY")), "invalid_output")
        .when(F.size(items) == 0, "missing_output").when(F.forall(items, good), "ok").otherwise("invalid_output")
    )
    out = predictions.withColumn("q_status", status)
    return out.withColumn("q", F.when(F.col("q_status") == "ok", F.from_json(F.col(column), QUERIES)))


def align(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """Gold with its prediction or null; the first of several gold rows or predictions of an id by ord."""
    first = lambda df: df.withColumn("_rn", F.row_number().over(Window.partitionBy("id").orderBy("ord"))).where("_rn = 1").drop("_rn")
    p = first(predictions)
    return first(gold).join(p.select("id", F.lit(True).alias("has_prediction"), *(F.col(c).alias(f"p_{c}") for c in p.columns if c != "id")), "id", "left")


def query_hits(documents: Column, window: Column, relevant, k: int = K) -> Column:
    """Hits among the first k documents of one query. A document whose id or URL came before is a duplicate and wastes its rank; a
    hit is relevant (``relevant(document)``), dated, and inside the closed window. A query's documents stay in its row, so nothing is
    exploded or shuffled."""
    lo, hi = source_day(window["start"]), source_day(window["end"])

    def seen(d: Column) -> Column:
        good = F.coalesce(relevant(d) & source_day(d["timestamp"]).between(lo, hi), F.lit(False))
        return F.struct(d["id"].alias("id"), F.coalesce(scoring_url(d["url"]), d["url"]).alias("url"), good.alias("good"))

    def count(top: Column) -> Column:
        same = lambda x, d: F.coalesce(x["id"] == d["id"], F.lit(False)) | F.coalesce(x["url"] == d["url"], F.lit(False))
        return F.size(F.filter(F.transform(top, lambda d, i: d["good"] & ~F.exists(F.slice(top, F.lit(1), i), lambda x: same(x, d))), lambda hit: hit))

    return let(F.transform(F.slice(documents, 1, k), seen), count)


def summary(rows: DataFrame, group: str | None = None) -> DataFrame:
    """(scope, n, n_scored, errors, score, scored_mean, coverage): the whole and, in the same pass, each value of ``group``.
    score is null when any row has none."""
    aggs = [F.count(F.lit(1)).alias("n"), F.count("score").alias("n_scored"), F.avg("score").alias("scored_mean")]
    if group is None:
        out = rows.agg(*aggs).withColumn("scope", F.lit("all"))
    else:
        scope = F.when(F.grouping(group) == 1, "all").otherwise(F.coalesce(F.col(group).cast("string"), F.lit("none")))
        out = rows.rollup(group).agg(*aggs, scope.alias("scope"))
    n, s = F.col("n"), F.col("n_scored")
    return out.select("scope", "n", "n_scored", (n - s).alias("errors"), F.when(n == s, F.col("scored_mean")).alias("score"), "scored_mean", (s / n).alias("coverage"))


def query_score(dc: Column, sr: Column, tp: Column) -> Column:
    """0.3 decomposition + 0.3 sufficiency + 0.4 temporal credit."""
    return 0.3 * dc + 0.3 * sr + 0.4 * tp


def temporal_credit(kind: Column, correct: Column) -> Column:
    """1 for a right absolute time, half for a right relative one, else 0."""
    return F.when(correct & (kind == "absolute"), 1.0).when(correct & (kind == "relative"), 0.5).otherwise(0.0)


def logic_score(align_: Column, sufficiency: Column, correctness: Column, plausibility: Column) -> Column:
    """0 where the explanation isn't aligned, else the mean of three qualities."""
    return F.when(align_ == 0, 0.0).when(align_ == 1, (sufficiency + correctness + plausibility) / 3)


def verdict_status(has_prediction: Column, predicted: Column) -> Column:
    return F.when(~F.coalesce(has_prediction, F.lit(False)), "missing_output").when(predicted.isNull(), "invalid_output").otherwise("ok")


def verdict_score(has_prediction: Column, predicted: Column, label: Column) -> Column:
    return F.when(verdict_status(has_prediction, predicted) != "ok", 0.0).otherwise((predicted == label).cast("double"))


def confusion_cell(has_prediction: Column, predicted: Column, label: Column) -> Column:
    right = F.concat_ws("_", F.lit("gold"), label.cast("string"), F.lit("predicted"), predicted.cast("string"))
    return F.when(verdict_status(has_prediction, predicted) == "ok", right).otherwise("invalid_or_missing")




# --- metrics with a judge's recorded answers: a table (id, stage, call_index, response) whose response is JSON text ---


def _answer(judged: DataFrame, stage: str, call: int) -> DataFrame:
    v = F.try_parse_json("response")
    return judged.where((F.col("stage") == stage) & (F.col("call_index") == call)).select("id", v.alias(f"_{stage}{call}"))


def _number(v: Column, path: str) -> Column:
    """A JSON number in [0, 1]; null for other types, true and false included."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    x = F.try_variant_get(v, path, "double")
    return F.when((kind.isin("BIGINT", "DOUBLE") | F.startswith(kind, F.lit("DECIMAL"))) & x.between(0, 1), x)


def _flag(v: Column, path: str) -> Column:
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "BOOLEAN", F.try_variant_get(v, path, "boolean"))


def judged_queries(aligned: DataFrame, judged: DataFrame) -> DataFrame:
    """(id, hop_count, status, score) of the query metric. ``aligned`` is ``align(gold, parse_queries(predictions))``. No or
    invalid output scores 0; a judge that is missing, ill typed or doesn't rate each query once leaves the score null."""
    from veridelta.operators.graph import topology_reason

    df = aligned.join(_answer(judged, "queries", 0), "id", "left")
    v, q = F.col("_queries0"), F.col("p_q")
    ratings = F.try_variant_get(v, "$.temporal_ratings", "array<struct<query_id:string,kind:string,correct:boolean>>")
    rated = (F.size(ratings) == F.size(q)) & (F.size(F.array_except(F.transform(q, lambda x: x["id"]), F.transform(ratings, lambda r: r["query_id"]))) == 0)
    legal = F.forall(ratings, lambda r: F.coalesce(r["kind"].isin("absolute", "relative") | ((r["kind"] == "missing") & ~r["correct"]), F.lit(False)))
    tp = F.aggregate(ratings, F.lit(0.0), lambda a, r: a + temporal_credit(r["kind"], r["correct"])) / F.size(ratings)
    dc, sr = _number(v, "$.s_dc"), _number(v, "$.s_sr")
    dc = F.when(dc.isin(0.0, 1.0), F.when(topology_reason(q).isNull(), dc).otherwise(0.0))
    status = F.when(~F.coalesce("has_prediction", F.lit(False)), "missing_output").otherwise(F.col("p_q_status"))
    good = F.coalesce(_flag(v, "$.gold_sufficient") & rated & legal, F.lit(False))
    score = F.when(status != "ok", 0.0).when(good, query_score(dc, sr, tp))
    return df.select("id", "hop_count", F.when((status == "ok") & score.isNull(), "evaluation_error").otherwise(status).alias("status"), score.alias("score"))


def judged_retrieval(aligned: DataFrame, judged: DataFrame, k: int = K) -> DataFrame:
    """(id, hop_count, status, score) of temporal precision at k. The judge's call for a query rates ranks as q<query>:r<rank>;
    duplicates needn't be rated. A rank that had to be rated and wasn't leaves the score null."""
    df = aligned.select("id", "hop_count", "time_window", "query_time_windows", "has_prediction", "p_q_status", "p_q")
    each = df.where("p_q_status = 'ok'").select("id", "time_window", "query_time_windows", F.posexplode("p_q").alias("query", "x"))
    w = F.coalesce(F.try_element_at("query_time_windows", F.col("x.id")), F.col("time_window"))
    docs = each.select("id", "query", w.alias("w"), F.posexplode("x.retrieved_documents").alias("pos", "d")).where(F.col("pos") < k)
    flat = docs.select("id", "query", (F.col("pos") + 1).alias("rank"), F.col("d.id").alias("doc_id"), F.col("d.url").alias("url"), F.col("d.timestamp").alias("timestamp"), F.col("w.start").alias("start"), F.col("w.end").alias("end"))
    says = judged.where("stage = 'retrieval'").select("id", F.explode(F.try_variant_get(F.try_parse_json("response"), "$.relevance", "array<struct<rank_id:string,relevant:boolean>>")).alias("r"))
    says = says.select("id", F.col("r.rank_id").alias("rank_id"), F.col("r.relevant").alias("relevant"))
    rated = flat.withColumn("rank_id", F.concat(F.lit("q"), F.col("query"), F.lit(":r"), F.col("rank"))).join(says, ["id", "rank_id"], "left")
    url = F.coalesce(scoring_url(F.col("url")), F.col("url"))
    before = Window.partitionBy("id", "query").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    seen = lambda c: F.coalesce(F.array_contains(F.collect_set(c).over(before), F.col(c)), F.lit(False))
    marked = rated.withColumn("_url", url).withColumn("_dup", seen("doc_id") | seen("_url"))
    inside = F.coalesce(source_day(F.col("timestamp")).between(source_day(F.col("start")), source_day(F.col("end"))), F.lit(False))
    per = marked.groupBy("id").agg(F.count_if(~F.col("_dup") & inside & F.coalesce("relevant", F.lit(False))).alias("hits"), F.count_if(~F.col("_dup") & F.col("relevant").isNull()).alias("unrated"))
    status = F.when(~F.coalesce("has_prediction", F.lit(False)), "missing_output").otherwise(F.col("p_q_status"))
    bad = (status == "ok") & (F.coalesce("unrated", F.lit(0)) > 0)
    score = F.when(status != "ok", 0.0).when(~bad, F.coalesce("hits", F.lit(0)) / F.lit(float(k)) / F.size("p_q"))
    return df.join(per, "id", "left").select("id", "hop_count", F.when(bad, "evaluation_error").otherwise(status).alias("status"), score.alias("score"))


def judged_explanation(aligned: DataFrame, judged: DataFrame) -> DataFrame:
    """(id, hop_count, status, score) of logic consistency: call 0 gates by alignment (the number 0 or 1), call 1 rates quality."""
    df = aligned.join(_answer(judged, "explanation", 0), "id", "left").join(_answer(judged, "explanation", 1), "id", "left")
    a, b, e = F.col("_explanation0"), F.col("_explanation1"), F.col("p_explanation")
    gate = _number(a, "$.i_align")
    quality = [_number(b, f"$.{n}") for n in ("sufficiency", "factual_correctness", "temporal_plausibility")]
    status = F.when(~F.coalesce("has_prediction", F.lit(False)) | e.isNull() | (F.trim(e) == ""), "missing").otherwise("ok")
    enough = F.coalesce(_flag(b, "$.gold_sufficient"), F.lit(False))
    score = F.when(status != "ok", 0.0).when(gate == 0, 0.0).when((gate == 1) & enough, sum(quality[1:], quality[0]) / 3)
    return df.select("id", "hop_count", F.when((status == "ok") & score.isNull(), "evaluation_error").otherwise(status).alias("status"), score.alias("score"))


def judged_verdict(aligned: DataFrame) -> DataFrame:
    has, p = F.col("has_prediction"), F.col("p_predicted_label")
    return aligned.select("id", "hop_count", verdict_status(has, p).alias("status"), verdict_score(has, p, F.col("label")).alias("score"))


def all_stages(stages: dict[str, DataFrame]) -> DataFrame:
    """(stage, scope, n, ...): the summaries of all stages; complete when every score is there. Metrics are never averaged together."""
    out = None
    for name, rows in stages.items():
        s = summary(rows, "hop_count").withColumn("stage", F.lit(name)).withColumn("complete", F.col("errors") == 0)
        out = s if out is None else out.unionByName(s)
    return out
