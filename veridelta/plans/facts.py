"""Temporal facts: from recorded extractions to a merged graph, and the graphs of gold records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridelta.functions import dates as D
from veridelta.functions import text as X
from veridelta.functions.nums import gaps
from veridelta.operators import graph as G
from veridelta.operators import kg
from veridelta.operators import rank as R
from veridelta.plans.registry import query
from veridelta.session import read


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "raw_demo").where("pre_extracted is not null").select("ord", "id", "language", "text", "source_verdict", "pre_extracted")


_FACTS = """
a as (select ord, id, language, text, pre_extracted p from raw_demo where pre_extracted is not null),
f as (select ord, id, language, text, u.i i, p.facts[u.i] f, p.entities e from a, unnest(generate_series(1, cast(len(p.facts) as bigint))) u(i)),
x as (select ord, id, language, i, f.relation relation, f.head head, f.tail tail, f.start s, f."end" t, f.time_precision prec, f.temporal_kind kind, f.polarity polarity, f.evidence_quote quote,
 list_filter(e, lambda z: z.id = f.head)[1] h, list_filter(e, lambda z: z.id = f.tail)[1] l, contains(text, f.evidence_quote) grounded from f)
"""
_REASON = """case when h is null or l is null then 'unknown_entity' when polarity not in ('positive', 'negative') then 'polarity' when prec not in ('day', 'month', 'year') then 'precision'
 when try_cast(s as date) is null or try_cast(t as date) is null then 'date' when s > t then 'reversed' when not coalesce(grounded, false) then 'quote' end"""


@query("with " + _FACTS + f"select coalesce({_REASON}, 'ok') reason, count(*) n from x group by 1")
def fact_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted facts by the first reason to reject them."""
    return kg.facts(_articles(spark, sf_dir)).groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("with " + _FACTS + f", r as (select ord, i, {_REASON} reason from x) select ord, count(*) facts, count(reason) bad, min(struct_pack(i := i, reason := reason)) filter (where reason is not null).reason first_reason from r group by 1".replace("min(struct_pack(i := i, reason := reason)) filter (where reason is not null).reason first_reason", "arg_min(reason, i) filter (where reason is not null) first_reason"))
def article_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bad fact rejects its article: the counts and the first reason."""
    f = kg.facts(_articles(spark, sf_dir))
    return f.groupBy("ord").agg(F.count(F.lit(1)).alias("facts"), F.count("reason").alias("bad"), F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("pos"))).alias("first_reason"))


_NODE = "'entity:' || substr(sha256(z.type || '|' || coalesce(language, '') || '|' || z.label || '|' || coalesce(z.disambiguation, '')), 1, 20)"


@query(f"""with a as (select ord, id, language, unnest(pre_extracted.entities) z from raw_demo where pre_extracted is not null), n as (select ord, id source_id, {_NODE} node_id, z.label, z.type, z.domain from a)
select node_id, arg_min(label, ord) "label", arg_min(type, ord) "type", list_sort(list(distinct domain)) domains, list_sort(list(distinct source_id)) source_ids from n group by 1""")
def kg_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged nodes: the first attributes, and the sorted sets of domains and sources."""
    return kg.nodes(_articles(spark, sf_dir))


_EDGES = (
    "with "
    + _FACTS
    + f""", ok as (select *, {_REASON.replace("or not", "or not")} reason from x),
e as (select ord, id source_id, i, {_NODE.replace("z.", "h.")} hn, {_NODE.replace("z.", "l.")} tn, relation, s, t, prec, polarity, kind, quote from ok where reason is null),
k as (select *, 'edge:' || substr(sha256(hn || '|' || relation || '|' || tn || '|' || s || '|' || t || '|' || prec || '|' || polarity || '|' || kind), 1, 20) edge_id from e)
"""
)


@query(_EDGES + "select edge_id, hn head, relation, tn tail, s \"start\", t \"end\", polarity, list_sort(list(distinct source_id)) sources, count(distinct quote) quotes from k group by all")
def kg_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged facts with their sources and the number of their distinct quotes."""
    e = kg.edges(_articles(spark, sf_dir))
    merged = G.merge_edges(e, "ord", ["edge_id", "head", "relation", "tail", "start", "end", "polarity"], "source_id", "quote")
    return merged.select("edge_id", "head", "relation", "tail", "start", "end", "polarity", "sources", F.size("evidence").cast("long").alias("quotes"))


@query(_EDGES + ", d as (select distinct edge_id, hn, relation, tn, s, t, polarity from k) select a.edge_id key_a, b.edge_id key_b from d a join d b on a.hn = b.hn and a.relation = b.relation and a.tn = b.tn and a.polarity < b.polarity and a.s <= b.t and b.s <= a.t")
def kg_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of one triple and opposite polarity whose days meet; both are quarantined."""
    e = kg.edges(_articles(spark, sf_dir)).select("edge_id", "head", "relation", "tail", "start", "end", "polarity").distinct()
    return G.contradictions(e, ["head", "relation", "tail"], "edge_id", "polarity", "start", "end")


@query(_EDGES + ", v as (select unnest([hn, tn]) node from (select distinct edge_id, hn, tn from k)) select node, count(*) degree from v group by 1 order by degree desc, node limit 25")
def kg_degrees_top25(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = kg.edges(_articles(spark, sf_dir)).select("edge_id", "head", "tail").distinct()
    return G.hubs(e, 25)


@query("with recursive e as (select distinct z1.label a, z2.label b from (select ord, unnest(pre_extracted.entities) z1 from raw_demo where pre_extracted is not null) join (select ord, unnest(pre_extracted.entities) z2 from raw_demo where pre_extracted is not null) using (ord) where z1.label <> z2.label), n as (select distinct unnest([a, b]) node from e), c(node, r) as (select node, node from n union select e.b, c.r from c join e on c.node = e.a) select node, min(r) component from c group by 1")
def kg_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of entities that stand in one article, named by their least label. The articles' stars link them."""
    e = _articles(spark, sf_dir).select(F.explode("pre_extracted.entities").alias("z"), "ord").groupBy("ord").agg(F.collect_set("z.label").alias("s")).where("size(s) > 1")
    pairs = e.select(F.array_min("s").alias("src"), F.explode("s").alias("dst")).where("src <> dst")
    return G.components(pairs)


@query("""select ord, min(e.start) "start", max(e."end") "end", count(*) edges from (select ord, unnest(reasoning_graph.edges) e from gold) group by 1""")
def gold_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least start and the largest end over a record's path."""
    w = G.path_window(F.col("reasoning_graph.edges"))
    df = read(spark, sf_dir, "gold").where("size(reasoning_graph.edges) > 0")
    return df.select("ord", w["start"].alias("start"), w["end"].alias("end"), F.size("reasoning_graph.edges").cast("long").alias("edges"))


_ADJ = """e as (select ord, u.i i, reasoning_graph.edges[u.i] x, reasoning_graph.edges[u.i + 1] y from gold, unnest(generate_series(1, cast(len(reasoning_graph.edges) as bigint))) u(i)),
p as (select ord, bool_and(coalesce(x.start <= y.start, true)) seq, bool_and(coalesce(x.start >= y.start, true)) rev, bool_and(coalesce(greatest(x.start, y.start) <= least(x."end", y."end"), true)) par from e where y is not null or i = 1 group by 1)"""


@query("with " + _ADJ + " select case when par then 'parallel' when seq then 'sequence' when rev then 'reverse_sequence' else 'independent' end \"mode\", count(*) n from p group by 1")
def gold_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the edges of each record lie in time, by neighbours."""
    df = read(spark, sf_dir, "gold").where("size(reasoning_graph.edges) > 0")
    return df.select(G.temporal_mode(F.col("reasoning_graph.edges")).alias("mode")).groupBy("mode").agg(F.count(F.lit(1)).alias("n"))


@query("with e as (select ord, unnest(reasoning_graph.edges) e, reasoning_graph.nodes ns from gold) select ord, count(*) n from e where not list_contains(list_transform(ns, lambda z: z.id), e.head) or not list_contains(list_transform(ns, lambda z: z.id), e.tail) group by 1")
def gold_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with edges whose ends aren't among their nodes."""
    ids = F.transform("reasoning_graph.nodes", lambda z: z["id"])
    bad = F.size(F.filter("reasoning_graph.edges", lambda e: ~F.array_contains(ids, e["head"]) | ~F.array_contains(ids, e["tail"])))
    return read(spark, sf_dir, "gold").select("ord", bad.cast("long").alias("n")).where("n > 0")


@query("""with e as (select ord, unnest(reasoning_graph.edges) e, evidence ev from gold), v as (select ord, e.id eid, unnest(e.evidence_ids) vid, ev from e)
select ord, count(*) cited, cast(sum(case when list_contains(list_transform(ev, lambda z: z.id), vid) then 0 else 1 end) as bigint) missing from v group by 1""")
def gold_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence that a record's edges cite, and what of it the record doesn't hold."""
    have = F.transform("evidence", lambda z: z["id"])
    cited = F.flatten(F.transform("reasoning_graph.edges", lambda e: e["evidence_ids"]))
    df = read(spark, sf_dir, "gold").select("ord", cited.alias("c"), have.alias("h")).where("size(c) > 0")
    return df.select("ord", F.size("c").cast("long").alias("cited"), F.size(F.filter("c", lambda x: ~F.array_contains("h", x))).cast("long").alias("missing"))


@query("""with e as (select unnest(reasoning_graph.edges) e from gold), c as (select e.relation relation, count(*) n from e group by 1) select relation, n, round(n / cast(sum(n) over () as double), 6) prior from c""")
def relation_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations with their share of all edges."""
    c = read(spark, sf_dir, "gold").select(F.explode("reasoning_graph.edges").alias("e")).groupBy("e.relation").agg(F.count(F.lit(1)).alias("n"))
    return c.select("relation", "n", F.round(F.col("n") / c.agg(F.sum("n")).scalar(), 6).alias("prior"))


@query("""with e as (select ord, hop_count, unnest(reasoning_graph.edges) e from gold), m as (select ord, hop_count, cast(substr(e.start, 1, 4) as integer) * 12 + cast(substr(e.start, 6, 2) as integer) v from e),
g as (select ord, hop_count, v, v - lag(v) over (partition by ord order by v) gap from m) select ord, any_value(hop_count) hops, min(gap) least_gap, max(v) - min(v) span from g group by 1""")
def gap_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least gap and span in months between the edges of each record."""
    v = F.transform("reasoning_graph.edges", lambda e: D.month_number(e["start"]))
    df = read(spark, sf_dir, "gold").select("ord", F.col("hop_count").alias("hops"), v.alias("v")).where("size(v) > 0")
    return df.select("ord", "hops", F.array_min(gaps(F.col("v"))).alias("least_gap"), (F.array_max("v") - F.array_min("v")).alias("span"))


@query("""with e as (select ord, hop_count, unnest(reasoning_graph.edges) e from gold), c as (select e.relation relation, count(*) n from e group by 1), t as (select sum(n) t from c),
m as (select ord, hop_count, cast(substr(e.start, 1, 4) as integer) * 12 + cast(substr(e.start, 6, 2) as integer) v, n / cast(t as double) prior from e join c on c.relation = e.relation, t),
g as (select *, v - lag(v) over (partition by ord order by v) gap from m), p as (select ord, any_value(hop_count) hops, min(gap) gap, max(v) - min(v) span, avg(prior) prior from g group by 1),
sc as (select ord, hops, round(40 / (1e0 + gap) + 20 / (1 + span / 12e0) + 20 / (1 + 1000 * prior) + 10 * hops / 5e0 + 5 + 5, 6) score from p where gap <= 48 and span <= 300), f as (select *, row_number() over (partition by hops <= 3 order by score desc, ord) rn from sc) select ord, hops, score from f where hops > 3 or rn <= 100 order by score desc, ord limit 300""")
def hard_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 300 hardest paths by gap, span, rarity of relations and hops, at most 100 of two or three hops."""
    from veridelta.functions.nums import hard_path_score

    gold = read(spark, sf_dir, "gold")
    each = gold.select("ord", F.col("hop_count").alias("hops"), F.explode("reasoning_graph.edges").alias("e"))
    p = each.select("ord", "hops", F.col("e.relation").alias("relation"), D.month_number(F.col("e.start")).alias("v"))
    n = p.groupBy("relation").agg(F.count(F.lit(1)).alias("n"))
    prior = n.select("relation", (F.col("n") / n.agg(F.sum("n")).scalar()).alias("prior"))
    g = p.join(prior, "relation").groupBy("ord").agg(F.first("hops").alias("hops"), F.array_sort(F.collect_list("v")).alias("v"), F.avg("prior").alias("prior"))
    g = g.select("ord", "hops", F.array_min(gaps(F.col("v"))).alias("gap"), (F.array_max("v") - F.array_min("v")).alias("span"), "prior")
    score = F.round(hard_path_score(F.col("gap").cast("double"), F.col("span").cast("double"), F.col("prior"), F.col("hops").cast("double"), F.lit(1.0), F.lit(0.0)), 6)
    scored = g.where("gap <= 48 and span <= 300").select("ord", "hops", score.alias("score"))
    best = lambda df, n: df.orderBy(F.desc("score"), "ord").limit(n)
    return best(best(scored.where("hops <= 3"), 100).unionByName(best(scored.where("hops > 3"), 300)), 300)


@query("""with c as (select ord, list_transform(reasoning_graph.edges, lambda e: case when e.relation = 'has_value' then substr(e.start, 1, 4) when e.relation = 'won' then substr(e.start, 1, 7) else e.start end) d from gold),
m as (select ord, list_transform(d, lambda x: case when length(x) = 4 then x || '-01' else substr(x, 1, 7) end) lo, list_transform(d, lambda x: case when length(x) = 4 then x || '-12' else substr(x, 1, 7) end) hi from c)
select ord, list_min(lo) "start", list_max(hi) "end" from m""")
def month_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month windows of chains whose dates have mixed precision."""
    d = F.transform("reasoning_graph.edges", lambda e: F.when(e["relation"] == "has_value", F.substring(e["start"], 1, 4)).when(e["relation"] == "won", F.substring(e["start"], 1, 7)).otherwise(e["start"]))
    return read(spark, sf_dir, "gold").select("ord", D.month_window(d).alias("w")).select("ord", "w.start", "w.end")


@query("""with p as (select ord, time_window.start s0, time_window."end" e0, list_min(list_transform(reasoning_graph.edges, lambda e: e.start)) s1, list_max(list_transform(reasoning_graph.edges, lambda e: e."end")) e1 from gold)
select case when s0 = s1 and e0 = e1 then 'same' when s1 <= s0 and e1 >= e0 then 'widened' when s1 >= s0 and e1 <= e0 then 'narrowed' else 'moved' end change, count(*) n from p group by 1""")
def window_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What recomputing the windows of gold from its edges would change."""
    w = G.path_window(F.col("reasoning_graph.edges"))
    df = read(spark, sf_dir, "gold").select(F.col("time_window.start").alias("s0"), F.col("time_window.end").alias("e0"), w["start"].alias("s1"), w["end"].alias("e1"))
    c = F.when((F.col("s0") == F.col("s1")) & (F.col("e0") == F.col("e1")), "same").when((F.col("s1") <= F.col("s0")) & (F.col("e1") >= F.col("e0")), "widened").when((F.col("s1") >= F.col("s0")) & (F.col("e1") <= F.col("e0")), "narrowed").otherwise("moved")
    return df.select(c.alias("change")).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query("""select g.ord, list_sort(list_distinct(list_transform(g.evidence, lambda e: e.url))) urls, len(list_filter(g.evidence, lambda e: e.timestamp is not null and e.timestamp between g.time_window.start and g.time_window."end")) inside from gold g""")
def gold_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence URLs of each record, and how much evidence lies in its window."""
    inside = F.size(F.filter("evidence", lambda e: F.coalesce(e["timestamp"].between(F.col("time_window.start"), F.col("time_window.end")), F.lit(False)))).cast("long")
    return read(spark, sf_dir, "gold").select("ord", F.array_sort(F.array_distinct(F.transform("evidence", lambda e: e["url"]))).alias("urls"), inside.alias("inside"))


@query("""with n as (select ord, list_distinct(list_transform(reasoning_graph.nodes, lambda x: x.type)) ts, list_transform(reasoning_graph.nodes, lambda x: x.label) own from gold), pool as (select distinct z.type t, z.label l from (select unnest(reasoning_graph.nodes) z from gold)),
r as (select n.ord, t, l, row_number() over (partition by n.ord order by l, t) rn from n join pool on list_contains(n.ts, pool.t) where not list_contains(n.own, l)) select ord, rn place, l replacement from r where rn <= 5""")
def replacement_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five labels of the types of each record that don't stand in it. Of a type only as many first labels can be drawn as five and the largest record's nodes, so that the pool
    of a type is that small whatever the number of its labels."""
    g = read(spark, sf_dir, "gold")
    labels = lambda f: F.transform("reasoning_graph.nodes", lambda z: z[f])
    most = g.agg(F.coalesce(F.max(F.size("reasoning_graph.nodes")), F.lit(0))).first()[0]
    pool = g.select(F.explode("reasoning_graph.nodes").alias("z")).select(F.col("z.type").alias("t"), F.col("z.label").alias("l")).distinct()
    small = R.top_per_group(pool, ["t"], ["l"], 5 + most).groupBy("t").agg(F.sort_array(F.collect_list("l")).alias("ls"))
    each = g.select("ord", labels("label").alias("own"), F.explode(F.array_distinct(labels("type"))).alias("t")).join(small, "t")
    own = each.groupBy("ord").agg(F.first("own").alias("own"), F.flatten(F.collect_list(F.transform("ls", lambda x: F.struct(x.alias("l"), F.col("t").alias("t"))))).alias("all"))
    drawn = F.slice(F.array_sort(F.filter("all", lambda x: ~F.array_contains("own", x["l"]))), 1, 5)
    return own.select("ord", F.posexplode(drawn).alias("p", "x")).select("ord", (F.col("p") + 1).cast("long").alias("place"), F.col("x.l").alias("replacement"))


# Perturbations of a true claim, and the fields that each may change.
PERTURBATIONS = {
    "entity_hallucination": ("head", "tail"), "chronological_distortion": ("time",), "relational_corruption": ("relation",), "contextual_contradiction": ("premise",), "data_perturbation": ("value",),
    "sentiment_inversion": ("polarity",),
}


@query("""with p as (select unnest(['entity_hallucination', 'chronological_distortion', 'relational_corruption', 'contextual_contradiction', 'data_perturbation', 'sentiment_inversion']) strategy, unnest(['head tail', 'time', 'relation', 'premise', 'value', 'polarity']) fields),
c as (select g.ord, p.strategy, p.fields, case when p.strategy = 'data_perturbation' then list_filter(g.reasoning_graph.edges, lambda e: e.relation = 'has_value') else g.reasoning_graph.edges end es from gold g, p)
select ord, 'negative_plan_' || substr(sha256('[' || ord || ', "' || strategy || '"]'), 1, 20) plan_id, strategy, fields, list_transform(es, lambda e: e.id) candidates from c where len(es) > 0""")
def negative_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The perturbations planned for each record, with the fields they may change and the edges they may start from: value changes only at edges with a value."""
    s = F.array(*(F.struct(F.lit(k).alias("strategy"), F.lit(" ".join(v)).alias("fields")) for k, v in PERTURBATIONS.items()))
    df = read(spark, sf_dir, "gold").select("ord", F.col("reasoning_graph.edges").alias("es"), F.explode(s).alias("s"))
    es = F.when(F.col("s.strategy") == "data_perturbation", F.filter("es", lambda e: e["relation"] == "has_value")).otherwise(F.col("es"))
    plan_id = F.concat(F.lit("negative_plan_"), F.substring(F.sha2(F.concat(F.lit("["), F.col("ord").cast("string"), F.lit(', "'), "s.strategy", F.lit('"]')), 256), 1, 20))
    return df.select("ord", plan_id.alias("plan_id"), "s.strategy", "s.fields", F.transform(es, lambda e: e["id"]).alias("candidates")).where("size(candidates) > 0")


@query("""select ord, array_to_string(list_transform(reasoning_graph.edges, lambda e: e.head || ' ' || e.relation || ' ' || e.tail || ' (' || e.start || '..' || e."end" || ')'), ' | ') chain from gold""")
def evidence_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of each record in one line."""
    return read(spark, sf_dir, "gold").select("ord", X.chain(F.col("reasoning_graph.edges")).alias("chain"))


@query("""with v as (select g.ord, g.split, unnest(list_transform(g.reasoning_graph.nodes, lambda z: z.label)) l from gold g) select l "label", count(distinct ord) records, count(distinct split) splits from v group by 1 having count(distinct split) > 1""")
def leaked_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that stand in records of more than one split."""
    v = read(spark, sf_dir, "gold").select("ord", "split", F.explode(F.array_distinct(F.transform("reasoning_graph.nodes", lambda z: z["label"]))).alias("label"))
    per = v.groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("label").agg(F.sum("n").alias("records"), F.count(F.lit(1)).alias("splits")).where("splits > 1")


@query("""select ord, case when length(d) = 4 then make_date(cast(d as bigint), 1, 1) when length(d) = 7 then try_cast(d || '-01' as date) else try_cast(d as date) end first_day,
case when length(d) = 4 then make_date(cast(d as bigint), 12, 31) when length(d) = 7 then last_day(try_cast(d || '-01' as date)) else try_cast(d as date) end final_day, case length(d) when 4 then 'year' when 7 then 'month' else 'day' end "precision"
from (select ord, substr(reference_date, 1, case ord % 3 when 0 then 4 when 1 then 7 else 10 end) d from gold where reference_date is not null)""")
def time_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds and precision of partial dates."""
    d = F.expr("substring(reference_date, 1, case ord % 3 when 0 then 4 when 1 then 7 else 10 end)")
    n = D.time_node(F.col("d"))
    df = read(spark, sf_dir, "gold").where("reference_date is not null").select("ord", d.alias("d"))
    return df.select("ord", n["start"].alias("first_day"), n["end"].alias("final_day"), n["precision"].alias("precision"))


@query("""with x as (select ord, substr(time_window.start, 1, case ord % 3 when 0 then 4 when 1 then 7 else 10 end) old, time_window.start as new from gold where time_window.start is not null)
select length(old) old_length, length(case when length(new) > length(old) then new else old end) new_length, count(*) n from x group by 1, 2""")
def date_upgrades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision before and after taking the strictly finer date."""
    old = F.expr("substring(time_window.start, 1, case ord % 3 when 0 then 4 when 1 then 7 else 10 end)")
    df = read(spark, sf_dir, "gold").where("time_window.start is not null").select(old.alias("old"), F.col("time_window.start").alias("new"))
    up = D.finer(F.col("old"), F.col("new"))
    return df.select(F.length("old").cast("long").alias("old_length"), F.length(up).cast("long").alias("new_length")).groupBy("old_length", "new_length").agg(F.count(F.lit(1)).alias("n"))




@query("""select min(ord) ord, count(*) n from (select ord, array_to_string(list_sort(list_transform(reasoning_graph.edges, lambda e: (list_filter(reasoning_graph.nodes, lambda z: z.id = e.head)[1].label) || '|' || e.relation || '|' || (list_filter(reasoning_graph.nodes, lambda z: z.id = e.tail)[1].label) || '|' || e.start)), '#') k from gold where len(reasoning_graph.edges) > 0) group by k""")
def edge_set_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each set of facts, whatever their order."""
    name = lambda i: F.get(F.filter("reasoning_graph.nodes", lambda z: z["id"] == i), 0)["label"]
    facts = F.transform("reasoning_graph.edges", lambda e: F.concat(name(e["head"]), F.lit("|"), e["relation"], F.lit("|"), name(e["tail"]), F.lit("|"), e["start"]))
    df = read(spark, sf_dir, "gold").where("size(reasoning_graph.edges) > 0").select("ord", F.sha2(F.array_join(F.array_sort(facts), "#"), 256).alias("k"))
    return df.groupBy("k").agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("n")).select("ord", "n")


@query("""with v as (select l, count(distinct ord) views from (select ord, unnest(reasoning_graph.nodes).label l from gold) group by 1), e as (select ord, unnest(reasoning_graph.edges).relation r from gold), c as (select r, count(*) / cast((select count(*) from e) as double) prior from e group by 1),
p as (select ord, avg(prior) prior from e join c using (r) group by 1), n as (select ord, min(views) least, avg(views) mean from (select ord, unnest(reasoning_graph.nodes).label l from gold) join v using (l) group by 1)
select g.ord, n.least least_views, round(n.mean, 6) mean_views, round(p.prior, 6) prior, case when claim is null then 0 else len(regexp_extract_all(claim, '[^\\s\\p{Z}]+')) end words from gold g left join n on g.ord = n.ord left join p on g.ord = p.ord""")
def difficulty_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What makes a record hard: how rarely its entities (records that hold them stand for views) and its relations occur, and the words of its claim."""
    g = read(spark, sf_dir, "gold")
    node = g.select("ord", F.explode("reasoning_graph.nodes").alias("z")).select("ord", F.col("z.label").alias("l"))
    views = node.distinct().groupBy("l").agg(F.count(F.lit(1)).alias("views"))
    n = node.join(views, "l").groupBy("ord").agg(F.min("views").alias("least_views"), F.round(F.avg("views"), 6).alias("mean_views"))
    e = g.select("ord", F.explode("reasoning_graph.edges").alias("e")).select("ord", F.col("e.relation").alias("r"))
    c = e.groupBy("r").agg(F.count(F.lit(1)).alias("n"))
    p = e.join(c.select("r", (F.col("n") / c.agg(F.sum("n")).scalar()).alias("prior")), "r").groupBy("ord").agg(F.round(F.avg("prior"), 6).alias("prior"))
    words = F.coalesce(F.regexp_count("claim", F.lit(r"[^\s\p{Z}]+")), F.lit(0)).cast("long")
    return g.select("ord", words.alias("words")).join(n, "ord", "left").join(p, "ord", "left").select("ord", "least_views", "mean_views", "prior", "words")
