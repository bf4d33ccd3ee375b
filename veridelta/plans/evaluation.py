"""Evaluation queries over gold and predictions. Judges' answers aren't part of the tables; where a metric needs one, it is
derived from the gold evidence in a way that SQL can follow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridelta.functions.text import binary_label
from veridelta.operators import evaluate as ev
from veridelta.operators import graph
from veridelta.operators.rank import first_by
from veridelta.plans.registry import query
from veridelta.session import read

# SQL shared by several queries: the typed parse of predictions, with the same tests of types.
_PARSED = """
parsed as (select *, case when json_valid(queries) then queries::json end j from predictions),
items as (select p.ord, p.id, u.i, json_extract(j, '$[' || (u.i - 1) || ']') q from parsed p, unnest(generate_series(1, cast(coalesce(json_array_length(case when json_type(j) = 'ARRAY' then j end), 0) as bigint))) u(i)),
fine as (select ord, bool_and(coalesce(json_type(q) = 'OBJECT' and json_type(q, '$.id') = 'VARCHAR' and json_type(q, '$.text') = 'VARCHAR' and json_type(q, '$.depends_on') = 'ARRAY'
   and json_type(q, '$.retrieved_documents') = 'ARRAY' and len(list_filter(from_json(json_extract(q, '$.depends_on'), '["JSON"]'), lambda d: json_type(d) <> 'VARCHAR')) = 0, false)) ok from items group by 1),
stat as (select p.*, case when p.queries is null then 'missing_output' when j is null or json_type(j) <> 'ARRAY' then 'invalid_output' when json_array_length(j) = 0 then 'missing_output'
   when f.ok then 'ok' else 'invalid_output' end q_status from parsed p left join fine f on p.ord = f.ord)
"""
_ALIGNED = """
g as (select * from (select *, row_number() over (partition by id order by ord) rn from gold) where rn = 1),
pr as (select * from (select *, row_number() over (partition by id order by ord) rn from predictions) where rn = 1)
"""


def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.parse_queries(read(spark, sf_dir, "predictions"))


@query("with " + _PARSED + "select q_status, count(*) n from stat group by 1")
def prediction_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many predictions are well formed, missing or ill typed."""
    return _statuses(spark, sf_dir).groupBy("q_status").agg(F.count(F.lit(1)).alias("n"))


@query("select p.id, count(*) n from predictions p where not exists (select 1 from gold g where g.id = p.id) group by 1")
def predictions_without_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "predictions").join(read(spark, sf_dir, "gold").select("id"), "id", "left_anti").groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("select distinct g.id from gold g where not exists (select 1 from predictions p where g.id = p.id)")
def gold_without_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "gold").join(read(spark, sf_dir, "predictions").select("id"), "id", "left_anti").select("id").distinct()


@query("select id, count(*) n, min(ord) first_ord from gold group by 1 having count(*) > 1")
def gold_duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "gold").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord")).where("n > 1")


@query("select coalesce(g.demo, false) gold_demo, coalesce(p.demo, false) prediction_demo, count(*) n from gold g join predictions p on g.id = p.id group by 1, 2")
def demo_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demo and live rows must not be mixed: how the two sides pair."""
    g, p = read(spark, sf_dir, "gold"), read(spark, sf_dir, "predictions")
    pairs = g.select("id", F.coalesce("demo", F.lit(False)).alias("gold_demo")).join(p.select("id", F.coalesce("demo", F.lit(False)).alias("prediction_demo")), "id")
    return pairs.groupBy("gold_demo", "prediction_demo").agg(F.count(F.lit(1)).alias("n"))


def _precision_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, hop_count, score) of every gold id. A document is relevant when its URL is that of a gold evidence."""
    g = ev.align(read(spark, sf_dir, "gold"), _statuses(spark, sf_dir))
    q = F.when(F.col("p_q_status") == "ok", F.col("p_q"))
    rows = g.select("id", "hop_count", "time_window", "query_time_windows", F.transform("evidence", lambda e: e["url"]).alias("urls"), q.alias("q"))
    own = lambda x: F.coalesce(F.try_element_at("query_time_windows", x["id"]), F.col("time_window"))
    hits = F.aggregate("q", F.lit(0), lambda a, x: a + ev.query_hits(x["retrieved_documents"], own(x), lambda d: F.array_contains("urls", d["url"])))
    score = F.when(F.size("q") > 0, hits / F.lit(float(ev.K)) / F.size("q")).otherwise(F.lit(0.0))
    return rows.select("id", "hop_count", score.alias("score"))


_TP = (
    "with "
    + _PARSED
    + """,
g as (select * from (select *, row_number() over (partition by id order by ord) rn from gold) where rn = 1),
p1 as (select * from (select *, row_number() over (partition by id order by ord) rn from stat) where rn = 1),
al as (select g.id, g.hop_count, g.time_window w0, g.query_time_windows ws, list_transform(g.evidence, lambda e: e.url) urls, case when p1.q_status = 'ok' then p1.j end j from g left join p1 on g.id = p1.id),
qs as (select id, urls, w0, ws, u.i query, json_extract(j, '$[' || (u.i - 1) || ']') q from al, unnest(generate_series(1, cast(json_array_length(j) as bigint))) u(i) where j is not null),
ds as (select id, query, urls, coalesce(case when ws is not null then ws[q->>'$.id'] end, w0) w, u.i as rnk, json_extract(q, '$.retrieved_documents[' || (u.i - 1) || ']') d from qs, unnest(generate_series(1, cast(json_array_length(q, '$.retrieved_documents') as bigint))) u(i)),
fl as (select *, d->>'$.id' did, d->>'$.url' url, d->>'$.timestamp' ts from ds where rnk <= 5),
h as (select a.id, a.query, a.rnk, coalesce(list_contains(urls, url), false)
   and not exists (select 1 from fl b where b.id = a.id and b.query = a.query and b.rnk < a.rnk and (b.did = a.did or b.url = a.url))
   and coalesce(try_cast(ts as date) between try_cast(w.start as date) and try_cast(w."end" as date), false) hit from fl a),
hs as (select id, count(*) filter (where hit) hits from h group by 1),
sc as (select al.id, al.hop_count, case when json_array_length(al.j) > 0 then coalesce(hs.hits, 0) / 5e0 / json_array_length(al.j) else 0e0 end score from al left join hs on al.id = hs.id)
"""
)


@query(_TP + "select id, hop_count, round(score, 6) score from sc")
def tp_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temporal precision at 5 of every gold id; no or invalid output scores 0."""
    return _precision_rows(spark, sf_dir).select("id", "hop_count", F.round("score", 6).alias("score"))


_SUMMARY = """select case when grouping(hop_count) = 1 then 'all' else coalesce(cast(hop_count as varchar), 'none') end as scope, count(*) n, count(score) n_scored, count(*) - count(score) errors,
round(case when count(*) = count(score) then avg(score) end, 6) score, round(avg(score), 6) scored_mean, count(score) / cast(count(*) as double) coverage from {rows} group by rollup(hop_count)"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6)).withColumn("scored_mean", F.round("scored_mean", 6))


@query(_TP + _SUMMARY.format(rows="sc"))
def tp_at_k_by_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: temporal precision at 5, overall and by hop, in one pass."""
    return _rounded(ev.summary(_precision_rows(spark, sf_dir), "hop_count"))


_VERDICT = (
    "with "
    + _ALIGNED
    + """, v as (select g.id, g.hop_count, case when pr.id is null then 'missing_output' when pr.predicted_label is null then 'invalid_output' else 'ok' end status,
case when pr.predicted_label is null then 0e0 else cast(pr.predicted_label = g.label as double) end score, g.label, pr.predicted_label from g left join pr on g.id = pr.id)
"""
)


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ev.align(read(spark, sf_dir, "gold"), read(spark, sf_dir, "predictions").select("id", "ord", "predicted_label"))
    has, p, y = F.col("has_prediction"), F.col("p_predicted_label"), F.col("label")
    return g.select("id", "hop_count", ev.verdict_status(has, p).alias("status"), ev.verdict_score(has, p, y).alias("score"), ev.confusion_cell(has, p, y).alias("cell"))


@query(_VERDICT + "select id, hop_count, status, score from v")
def verdict_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every gold id: missing and null predictions score 0 and keep their status."""
    return _verdicts(spark, sf_dir).drop("cell")


@query(_VERDICT + _SUMMARY.format(rows="v"))
def verdict_by_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ev.summary(_verdicts(spark, sf_dir), "hop_count"))


@query(_VERDICT + "select case when status = 'ok' then 'gold_' || label || '_predicted_' || predicted_label else 'invalid_or_missing' end cell, count(*) n from v group by 1")
def verdict_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


@query(_VERDICT + "select status, count(*) n from v group by 1")
def verdict_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


_TOPOLOGY = (
    "with recursive "
    + _PARSED
    + """,
qs as (select i.ord, i.i, i.q->>'$.id' id, from_json(json_extract(i.q, '$.depends_on'), '["VARCHAR"]') deps from items i join stat s on i.ord = s.ord where s.q_status = 'ok'),
ds as (select ord, i, id, unnest(deps) dep from qs),
up(ord, id, anc) as (select ord, id, dep from ds union select u.ord, u.id, d.dep from up u join ds d on u.ord = d.ord and u.anc = d.id),
r as (select q.ord, case when count(distinct id) <> count(*) then 'duplicate_id' when bool_or(len(deps) <> len(list_distinct(deps))) then 'duplicate_dependency' when bool_or(list_contains(deps, id)) then 'self_dependency'
  when exists (select 1 from ds d where d.ord = q.ord and not exists (select 1 from qs k where k.ord = d.ord and k.id = d.dep)) then 'unknown_dependency'
  when exists (select 1 from up where up.ord = q.ord and up.id = up.anc) then 'cycle'
  when exists (select 1 from ds d join qs k on k.ord = d.ord and k.id = d.dep where d.ord = q.ord and k.i > d.i) then 'not_topological' end reason from qs q group by q.ord)
"""
)


@query(_TOPOLOGY + "select coalesce(reason, 'ok') reason, count(*) n from r group by 1")
def query_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First fault of each prediction's dependency graph."""
    ok = _statuses(spark, sf_dir).where("q_status = 'ok'")
    return ok.select(F.coalesce(graph.topology_reason(F.col("q")), F.lit("ok")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(_TOPOLOGY + ", a as (select ord, id, anc from up where ord in (select ord from r where reason is null)) select ord, id query_id, string_agg(anc, ',' order by anc) ancestors from a group by 1, 2")
def query_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that each query depends on, directly or not."""
    ok = _statuses(spark, sf_dir).where("q_status = 'ok'").where(graph.topology_reason(F.col("q")).isNull())
    each = ok.select("ord", F.explode(graph.ancestors(F.col("q"))).alias("query_id", "a"))
    return each.where(F.size("a") > 0).select("ord", "query_id", F.array_join("a", ",").alias("ancestors"))


_SCORES = (
    _TOPOLOGY
    + """, s as (select st.ord, st.id, st.q_status, case when st.q_status = 'ok' and r.reason is null then 1e0 else 0e0 end dc,
 case when st.q_status = 'ok' then (select avg(case when json_array_length(i.q, '$.retrieved_documents') > 0 then 1e0 else 0e0 end) from items i where i.ord = st.ord) else 0e0 end sr,
 case when st.q_status = 'ok' then (select avg(case when regexp_matches(i.q->>'$.text', '[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}年') then 1e0 when regexp_matches(i.q->>'$.text', '[0-9]{4}') then 0.5e0 else 0e0 end) from items i where i.ord = st.ord) else 0e0 end tp
 from stat st left join r on st.ord = r.ord)
"""
)


@query(_SCORES + "select ord, q_status, round(0.3 * dc + 0.3 * sr + 0.4 * tp, 6) score from s")
def query_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query score of every prediction: decomposition is right where the dependency graph is, a query suffices where it found
    documents, a day counts as an absolute time and a bare year as a relative one."""
    rows = _statuses(spark, sf_dir)
    q = F.col("q")
    mean = lambda f: F.aggregate(q, F.lit(0.0), lambda a, x: a + f(x)) / F.size(q)
    kind = lambda x: F.when(x["text"].rlike("[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}年"), "absolute").when(x["text"].rlike("[0-9]{4}"), "relative").otherwise("missing")
    ok = F.col("q_status") == "ok"
    dc = F.when(ok & graph.topology_reason(q).isNull(), 1.0).otherwise(0.0)
    sr = F.when(ok, mean(lambda x: F.when(F.size(x["retrieved_documents"]) > 0, 1.0).otherwise(0.0))).otherwise(0.0)
    tp = F.when(ok, mean(lambda x: ev.temporal_credit(kind(x), kind(x) != "missing"))).otherwise(0.0)
    return rows.select("ord", "q_status", F.round(ev.query_score(dc, sr, tp), 6).alias("score"))


_LOGIC = (
    "with "
    + _ALIGNED
    + """, x as (select g.id, g.hop_count, pr.explanation e, g.evidence ev from g left join pr on g.id = pr.id),
l as (select id, hop_count, case when e is null or trim(e) = '' then 0 else 1 end al, coalesce(len(list_filter(ev, lambda v: contains(e, v.text))) > 0, false) cites, coalesce(length(e) >= 40, false) long_, coalesce(regexp_matches(e, '[0-9]{4}'), false) dated from x)
"""
)


@query(_LOGIC + "select id, hop_count, round(case when al = 0 then 0e0 else (cast(cites as double) + cast(long_ as double) + cast(dated as double)) / 3 end, 6) score from l")
def logic_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explanations: aligned where there is one, sufficient where it quotes a gold evidence, correct in length, plausible where dated."""
    g = ev.align(read(spark, sf_dir, "gold"), read(spark, sf_dir, "predictions").select("id", "ord", "explanation"))
    e = F.col("p_explanation")
    al = F.when(e.isNull() | (F.trim(e) == ""), 0).otherwise(1)
    num = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    score = ev.logic_score(al, num(F.exists("evidence", lambda v: F.contains(e, v["text"]))), num(F.length(e) >= 40), num(e.rlike("[0-9]{4}")))
    return g.select("id", "hop_count", F.round(score, 6).alias("score"))


@query("select g.ord, coalesce(g.query_time_windows['q1'], g.time_window).start q1_start, coalesce(g.query_time_windows['q1'], g.time_window).\"end\" q1_end from gold g")
def query_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window of a record's first query: its own or the record's."""
    w = F.coalesce(F.try_element_at("query_time_windows", F.lit("q1")), F.col("time_window"))
    return read(spark, sf_dir, "gold").select("ord", w["start"].alias("q1_start"), w["end"].alias("q1_end"))


@query("select predicted, count(*) n from (select case lower(trim(cast(predicted_label as varchar))) when 'true' then true when 'false' then false end predicted from predictions) group by 1")
def label_normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "predictions").select(binary_label(F.col("predicted_label").cast("string")).alias("predicted"))
    return p.groupBy("predicted").agg(F.count(F.lit(1)).alias("n"))


@query(
    """select split, source, count(*) claims, count(*) filter (where label) true_claims, count(distinct hop_count) hops, min(reference_date) first_date, max(reference_date) last_date from gold group by 1, 2"""
)
def gold_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "gold").groupBy("split", "source").agg(
        F.count(F.lit(1)).alias("claims"), F.count_if("label").alias("true_claims"), F.count_distinct("hop_count").alias("hops"), F.min("reference_date").alias("first_date"), F.max("reference_date").alias("last_date")
    )


@query("select id, ord, predicted_label from (select *, row_number() over (partition by id order by ord desc) rn from predictions) where rn = 1")
def last_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch results by key where the last duplicate wins."""
    return first_by(read(spark, sf_dir, "predictions").select("id", "ord", "predicted_label"), ["id"], [F.desc("ord")])


@query(
    """select ord, reference_date, case when reference_date is null then 'missing' when not regexp_matches(reference_date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') or try_cast(reference_date as date) is null then 'invalid'
when time_window.start > time_window."end" then 'reversed' when reference_date < time_window."end" then 'before_window_end' else 'ok' end status from gold"""
)
def gold_window_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window and reference date of gold, first fault by record."""
    from veridelta.functions.dates import iso_day

    r, w = F.col("reference_date"), F.col("time_window")
    status = F.when(r.isNull(), "missing").when(iso_day(r).isNull(), "invalid").when(w["start"] > w["end"], "reversed").when(r < w["end"], "before_window_end").otherwise("ok")
    return read(spark, sf_dir, "gold").select("ord", "reference_date", status.alias("status"))


@query("select ord, row_number() over (partition by id order by ord) - 1 as copy, lag(ord) over (partition by id order by ord) as before from gold")
def gold_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("id").orderBy("ord")
    return read(spark, sf_dir, "gold").select("ord", (F.row_number().over(w) - 1).cast("long").alias("copy"), F.lag("ord").over(w).alias("before"))
