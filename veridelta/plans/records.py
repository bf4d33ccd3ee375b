"""Joins and aggregates that prepare, audit and enrich records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridelta.functions import dates as D
from veridelta.functions import text as X
from veridelta.functions.nums import same_set
from veridelta.operators import evaluate as ev
from veridelta.operators import rank as R
from veridelta.operators import validate as V
from veridelta.plans.evaluation import _PARSED
from veridelta.plans.registry import query
from veridelta.session import read


@query("""with u as (select 0 p, ord, url, title from raw union all select 1, ord, url, title from raw_demo union all select 2, ord, url, title from raw_with_extraction)
select url, arg_min(p, struct_pack(p := p, ord := ord)) first_table, arg_min(ord, struct_pack(p := p, ord := ord)) first_ord, count(distinct p) tables, count(*) n from u group by 1""")
def listing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs of three listings: the first that has one wins, and how many hold it."""
    parts = [read(spark, sf_dir, t).select(F.lit(i).alias("p"), "ord", "url") for i, t in enumerate(("raw", "raw_demo", "raw_with_extraction"))]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    first = F.struct("p", "ord")
    return u.groupBy("url").agg(F.min_by("p", first).alias("first_table"), F.min_by("ord", first).alias("first_ord"), F.count_distinct("p").alias("tables"), F.count(F.lit(1)).alias("n"))


@query("select title, max(n_chars) chars, count(*) n from documents where title is not null and title not like 'A%' group by 1 order by chars desc nulls last, title limit 100")
def title_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred titles with the longest document, those of one prefix left out."""
    df = read(spark, sf_dir, "documents").where("title is not null and title not like 'A%'")
    return df.groupBy("title").agg(F.max("n_chars").alias("chars"), F.count(F.lit(1)).alias("n")).orderBy(F.desc_nulls_last("chars"), "title").limit(100)


_ENDS = """ends as (select ord, e.relation relation, e.start s, e."end" t, list_filter(ns, lambda z: z.id = e.head)[1].label "label" from (select ord, unnest(reasoning_graph.edges) e, reasoning_graph.nodes ns from gold)),
anchors as (select "label", relation, min(s) first_day, max(t) last_day, count(*) n from ends where "label" is not null group by 1, 2)"""


def _anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = read(spark, sf_dir, "gold").select("ord", F.col("reasoning_graph.nodes").alias("ns"), F.explode("reasoning_graph.edges").alias("e"))
    label = F.get(F.filter("ns", lambda z: z["id"] == F.col("e.head")), 0)["label"]
    rows = each.select("ord", label.alias("label"), F.col("e.relation").alias("relation"), F.col("e.start").alias("s"), F.col("e.end").alias("t")).where("label is not null")
    return rows.groupBy("label", "relation").agg(F.min("s").alias("first_day"), F.max("t").alias("last_day"), F.count(F.lit(1)).alias("n"))


@query("with " + _ENDS + " select * from anchors")
def entity_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last day of each entity and relation."""
    return _anchors(spark, sf_dir)


@query("with " + _ENDS + """, n as (select distinct ord, z.label "label" from (select ord, unnest(reasoning_graph.nodes) z from gold)), w as (select n.ord, min(first_day) s, max(last_day) t from n join anchors using ("label") group by 1)
select g.ord, coalesce(g.time_window.start, w.s) "start", coalesce(g.time_window."end", w.t) "end", w.s anchor_start, w.t anchor_end from gold g left join w on w.ord = g.ord""")
def anchor_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of records from the anchors of their entities; a stored window stays."""
    n = read(spark, sf_dir, "gold").select("ord", F.explode(F.array_distinct(F.transform("reasoning_graph.nodes", lambda z: z["label"]))).alias("label"))
    w = n.join(_anchors(spark, sf_dir), "label").groupBy("ord").agg(F.min("first_day").alias("anchor_start"), F.max("last_day").alias("anchor_end"))
    g = read(spark, sf_dir, "gold").select("ord", "time_window").join(w, "ord", "left")
    return g.select("ord", F.coalesce("time_window.start", "anchor_start").alias("start"), F.coalesce("time_window.end", "anchor_end").alias("end"), "anchor_start", "anchor_end")


@query("with " + _ENDS + """, single as (select relation, "label", first_day from anchors where n = 1) select relation, count(*) entities, min(first_day) earliest from single group by 1""")
def singleton_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with exactly one statement of a relation, by relation."""
    return _anchors(spark, sf_dir).where("n = 1").groupBy("relation").agg(F.count(F.lit(1)).alias("entities"), F.min("first_day").alias("earliest"))


@query("""with e as (select ord, id, unnest(pre_extracted.entities) z from raw_demo where pre_extracted is not null), d as (select distinct ord, id, z.label l from e)
select a.l a, b.l b, count(*) n, arg_min(a.id, a.ord) first_article from d a join d b on a.ord = b.ord and a.l < b.l group by 1, 2""")
def co_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of entities of one article with their count and first article; an article holds few entities, so its pairs are made
    from its own array."""
    ls = F.array_sort(F.array_distinct(F.transform("pre_extracted.entities", lambda z: z["label"])))
    df = read(spark, sf_dir, "raw_demo").where("pre_extracted is not null").select("ord", "id", ls.alias("ls"))
    pairs = F.flatten(F.transform("ls", lambda a: F.transform(F.filter("ls", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return df.select("ord", "id", F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n"), F.min_by("id", "ord").alias("first_article"))


@query("""with n as (select distinct z.type t, z.label l from (select unnest(reasoning_graph.nodes) z from gold)), k as (select t, lower(regexp_extract(l, '([^ ]+)$', 1)) suffix, l from n)
select t "type", suffix, count(*) names, min(l) first_name from k where suffix <> '' group by 1, 2 having count(*) >= 2""")
def name_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by type and last word, pools of two or more."""
    n = read(spark, sf_dir, "gold").select(F.explode("reasoning_graph.nodes").alias("z")).select(F.col("z.type").alias("type"), F.col("z.label").alias("l")).distinct()
    k = n.select("type", F.lower(F.regexp_extract("l", "([^ ]+)$", 1)).alias("suffix"), "l").where("suffix <> ''")
    return k.groupBy("type", "suffix").agg(F.count(F.lit(1)).alias("names"), F.min("l").alias("first_name")).where("names >= 2")


@query("""with f as (select ord, unnest(pre_extracted.facts) f from raw_demo where pre_extracted is not null), c as (select ord, f.head head, count(*) n, count(*) filter (where f.start = f."end") day_n from f group by 1, 2)
select count(*) entities, min(n) least, max(n) most, round(avg(n), 6) mean, cast(sum(day_n) as bigint) day_facts from c""")
def facts_per_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of each local entity, and their spread."""
    f = read(spark, sf_dir, "raw_demo").where("pre_extracted is not null").select("ord", F.explode("pre_extracted.facts").alias("f"))
    c = f.groupBy("ord", "f.head").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("f.start") == F.col("f.end")).alias("days"))
    return c.agg(F.count(F.lit(1)).alias("entities"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"), F.sum("days").alias("day_facts"))


@query("""with k as (select ord, array_to_string(list_sort(list_transform(reasoning_graph.nodes, lambda z: z.label)), '|') || '#' || array_to_string(list_sort(list_transform(reasoning_graph.edges, lambda e: e.relation)), '|') k from gold)
select min(ord) ord, count(*) n from k group by k""")
def path_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each set of entities and relations, whatever their order."""
    k = F.concat(F.array_join(F.array_sort(F.transform("reasoning_graph.nodes", lambda z: z["label"])), "|"), F.lit("#"), F.array_join(F.array_sort(F.transform("reasoning_graph.edges", lambda e: e["relation"])), "|"))
    df = read(spark, sf_dir, "gold").select("ord", F.sha2(k, 256).alias("k"))
    return df.groupBy("k").agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("n")).select("ord", "n")


@query("""select ord, len(list_filter(reasoning_graph.nodes, lambda z: contains(claim, z.label))) named, len(reasoning_graph.nodes) nodes from gold where claim is not null""")
def named_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a record's entities its claim names."""
    named = F.size(F.filter("reasoning_graph.nodes", lambda z: F.contains("claim", z["label"]))).cast("long")
    return read(spark, sf_dir, "gold").where("claim is not null").select("ord", named.alias("named"), F.size("reasoning_graph.nodes").cast("long").alias("nodes"))


@query("""select ord, len(list_filter(list_distinct(regexp_extract_all(claim, '[0-9]+')), lambda d: not contains(text, d))) = 0 kept from raw_demo where claim is not null and text is not null""")
def digits_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every number of the claim stands in the text."""
    return read(spark, sf_dir, "raw_demo").where("claim is not null and text is not null").select("ord", X.digits_preserved(F.col("claim"), F.col("text")).alias("kept"))


@query("with " + _PARSED + """, d as (select s.ord, json_extract_string(x, '$.id') did, json_extract_string(x, '$.text') t from (select i.ord, unnest(from_json(json_extract(i.q, '$.retrieved_documents'), '["JSON"]')) x from items i join stat k on k.ord = i.ord where k.q_status = 'ok') s)
select ord, did doc_id, count(distinct t) texts from d group by 1, 2 having count(distinct t) > 1""")
def document_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieved documents of a prediction that have one id and several texts."""
    ok = ev.parse_queries(read(spark, sf_dir, "predictions")).where("q_status = 'ok'")
    d = ok.select("ord", F.explode(F.flatten(F.transform("q", lambda x: x["retrieved_documents"]))).alias("d"))
    return d.groupBy("ord", F.col("d.id").alias("doc_id")).agg(F.count_distinct("d.text").alias("texts")).where("texts > 1")


@query("""with w as (select ord, hop_count >= 5 many_hops, len(list_distinct(list_transform(reasoning_graph.edges, lambda e: substr(e.start, 1, 7)))) = 1 one_month, len(list_filter(reasoning_graph.edges, lambda e: e.start = e."end")) = len(reasoning_graph.edges) all_days,
 len(evidence) < hop_count little_evidence, provenance is null no_provenance from gold), r as (select ord, list_filter([case when many_hops then 'many_hops' end, case when one_month then 'one_month' end, case when all_days then 'all_days' end, case when little_evidence then 'little_evidence' end, case when no_provenance then 'no_provenance' end], lambda x: x is not null) rs from w)
select reason, count(*) n, count(*) filter (where len(rs) >= 2) in_hard from (select rs, unnest(rs) reason from r) group by 1""")
def hard_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons for which a record counts as hard, and how often with another."""
    e = F.col("reasoning_graph.edges")
    when = lambda c, n: F.when(c, F.lit(n))
    rs = F.array_compact(F.array(
        when(F.col("hop_count") >= 5, "many_hops"), when(F.size(F.array_distinct(F.transform(e, lambda x: F.substring(x["start"], 1, 7)))) == 1, "one_month"), when(F.forall(e, lambda x: x["start"] == x["end"]), "all_days"),
        when(F.size("evidence") < F.col("hop_count"), "little_evidence"), when(F.col("provenance").isNull(), "no_provenance"),
    ))
    df = read(spark, sf_dir, "gold").select(rs.alias("rs")).select("rs", F.explode("rs").alias("reason"))
    return df.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("rs") >= 2).alias("in_hard"))


@query("""with c as (select claim, count(*) n from gold where claim is not null group by 1)
select count(*) n, cast(sum(case when claim is null then 1 else 0 end) as bigint) no_claim, cast(sum(case when time_window.start > time_window."end" then 1 else 0 end) as bigint) reversed, cast(sum(case when reference_date is null then 1 else 0 end) as bigint) undated,
 cast(sum(case when len(evidence) = 0 then 1 else 0 end) as bigint) no_evidence, cast(sum(case when regexp_extract(claim, '[0-9]{4}') <> '' and not (regexp_extract(claim, '[0-9]{4}') between substr(time_window.start, 1, 4) and substr(time_window."end", 1, 4)) then 1 else 0 end) as bigint) year_outside, (select cast(coalesce(sum(n - 1), 0) as bigint) from c) copies from gold""")
def gold_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of gold, each counted once a record, and claims beyond their first."""
    g = read(spark, sf_dir, "gold")
    year = F.regexp_extract("claim", "[0-9]{4}", 0)
    copies = g.where("claim is not null").groupBy(F.sha2("claim", 256)).agg((F.count(F.lit(1)) - 1).alias("k")).agg(F.coalesce(F.sum("k"), F.lit(0)).cast("long"))
    return g.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("claim").isNull()).alias("no_claim"), F.count_if(F.col("time_window.start") > F.col("time_window.end")).alias("reversed"), F.count_if(F.col("reference_date").isNull()).alias("undated"),
        F.count_if(F.size("evidence") == 0).alias("no_evidence"), F.count_if((year != "") & ~year.between(F.substring("time_window.start", 1, 4), F.substring("time_window.end", 1, 4))).alias("year_outside"),
    ).withColumn("copies", copies.scalar())


@query("""select ord, list_sort(list_distinct(flatten(list_transform(reasoning_graph.edges, lambda e: e.evidence_ids)))) used, list_sort(list_distinct(list_transform(evidence, lambda v: v.id))) held, len(list_distinct(flatten(list_transform(reasoning_graph.edges, lambda e: e.evidence_ids)))) = len(list_distinct(list_transform(evidence, lambda v: v.id)))
 and len(list_filter(list_distinct(flatten(list_transform(reasoning_graph.edges, lambda e: e.evidence_ids))), lambda u: not list_contains(list_transform(evidence, lambda v: v.id), u))) = 0 same from gold""")
def prepared_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence that a record's edges use and that it holds, as sorted sets, and whether they are the same."""
    used = F.array_sort(F.array_distinct(F.flatten(F.transform("reasoning_graph.edges", lambda e: e["evidence_ids"]))))
    held = F.array_sort(F.array_distinct(F.transform("evidence", lambda v: v["id"])))
    return read(spark, sf_dir, "gold").select("ord", used.alias("used"), held.alias("held"), same_set(used, held).alias("same"))


@query("""with e as (select ord, unnest(evidence) v from gold), p as (select id, predicted_label, row_number() over (partition by id order by ord) rn from predictions)
select g.ord, count(v.id) evidence, cast(coalesce(sum(case when contains(v.text, 'fictional') then 1 else 0 end), 0) as bigint) marked, any_value(p.predicted_label) predicted from gold g left join e on e.ord = g.ord left join p on p.id = g.id and p.rn = 1 group by 1""")
def evidence_with_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of each record beside its first prediction."""
    p = R.first_by(read(spark, sf_dir, "predictions").select("id", "ord", "predicted_label"), ["id"], ["ord"]).select("id", F.col("predicted_label").alias("predicted"))
    marked = F.size(F.filter("evidence", lambda v: F.contains(v["text"], F.lit("fictional")))).cast("long")
    return read(spark, sf_dir, "gold").select("ord", "id", F.size("evidence").cast("long").alias("evidence"), marked.alias("marked")).join(p, "id", "left").select("ord", "evidence", "marked", "predicted")


@query(r"""select ord, regexp_matches(text, '(^|[^0-9])' || published_at || '($|[^0-9])') or contains(text, cast(year(d) as varchar) || '年' || cast(month(d) as varchar) || '月' || cast(day(d) as varchar) || '日')
 or regexp_matches(text, strftime(d, '%B') || ' ' || cast(day(d) as varchar) || '(st|nd|rd|th)?,? ' || cast(year(d) as varchar)) or regexp_matches(text, '(^|[^0-9])' || cast(day(d) as varchar) || '(st|nd|rd|th)? ' || strftime(d, '%B') || ',? ' || cast(year(d) as varchar)) grounded
from (select ord, text, published_at, try_cast(published_at as date) d from raw) where d is not null and text is not null""")
def grounded_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an article's day of publication stands in its text, in any of the forms in use."""
    day = D.iso_day(F.col("published_at"))
    df = read(spark, sf_dir, "raw").select("ord", "text", day.alias("d")).where("d is not null and text is not null")
    return df.select("ord", D.grounded(F.col("d"), F.col("text")).alias("grounded"))


@query("""select coalesce(case when pre_audit is null then 'missing' when not coalesce(pre_audit.accepted, false) then 'accepted' when not coalesce(pre_audit.entity_accuracy, false) then 'entity_accuracy' when not coalesce(pre_audit.temporal_grounding, false) then 'temporal_grounding'
 when not coalesce(pre_audit.verdict_consistent, false) then 'verdict_consistent' when not coalesce(pre_audit.evidence_support, false) then 'evidence_support' when not coalesce(pre_audit.confidence between 0.9 and 1, false) then 'confidence' end, 'ok') reason, count(*) n from raw_with_extraction group by 1""")
def audit_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded audits by the first reason that they don't pass."""
    df = read(spark, sf_dir, "raw_with_extraction").select(F.coalesce(V.audit_reason(F.col("pre_audit")), F.lit("ok")).alias("reason"))
    return df.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


_LINES = r"""l as (select ord, u.i pos, regexp_replace(x[u.i], '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') line from (select ord, string_split_regex(text, '\r\n|[\n\x0b\x0c\r\x{85}\x{2028}\x{2029}]') x from raw_with_extraction where text is not null), unnest(generate_series(1, cast(len(x) as bigint))) u(i)),
k as (select ord, pos, line, length(line) <= 40 and not regexp_matches(line, '[.。!?！？：:]$') and not regexp_matches(line, '^(?:[-•*›]|[0-9]+[).、])') h from l where line <> ''),
s as (select *, cast(sum(cast(h as integer)) over (partition by ord order by pos rows unbounded preceding) as bigint) sec from k)"""


@query("with " + _LINES + """ select ord, sec "section", case when sec > 0 then arg_min(line, pos) end heading, coalesce(string_agg(line, chr(10) order by pos) filter (where sec = 0 or not h), '') body from s group by ord, sec""")
def article_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages cut at their short lines: the heading and the body of each section."""
    return V.sections(read(spark, sf_dir, "raw_with_extraction"), "ord", "text")


@query()
def edit_subtlety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the perturbed claims lie from their parents, by strategy."""
    from veridelta.plans.mining import claim_edits

    e = claim_edits(spark, sf_dir).join(read(spark, sf_dir, "gold").select("ord", "claim"), "ord")
    s = e.select("strategy", V.subtlety(F.col("claim"), F.col("variant")).alias("s"))
    return s.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s.years"), 6).alias("years"), F.round(F.avg("s.numbers"), 6).alias("numbers"))


@query("""select coalesce(case when time_window.start is null or time_window."end" is null then 'missing' when try_cast(time_window.start as date) is null or try_cast(time_window."end" as date) is null then 'invalid' when time_window.start > time_window."end" then 'reversed'
 when reference_date is not null and reference_date < time_window.start then 'after_reference' end, 'ok') reason, count(*) n from gold group by 1""")
def window_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "gold").select(F.coalesce(V.window_reason(F.col("time_window.start"), F.col("time_window.end"), F.col("reference_date")), F.lit("ok")).alias("reason"))
    return df.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("""with e as (select z.label "label", e.relation relation, e.start d from (select reasoning_graph.nodes ns, unnest(reasoning_graph.edges) e from gold), lateral (select list_filter(ns, lambda q: q.id = e.tail)[1] z)), s as (select "label", relation, min(d) d, count(*) n from e where "label" is not null and d is not null group by 1, 2)
select "label", relation, d as "date" from s where relation in ('founded', 'won') or n = 1""")
def statement_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of entities by relation: the least of those that hold once, the only one of the others."""
    each = read(spark, sf_dir, "gold").select(F.col("reasoning_graph.nodes").alias("ns"), F.explode("reasoning_graph.edges").alias("e"))
    label = F.get(F.filter("ns", lambda z: z["id"] == F.col("e.tail")), 0)["label"]
    s = each.select(label.alias("label"), F.col("e.relation").alias("relation"), F.col("e.start").alias("date")).where("label is not null")
    return V.statement_date(s, ["label"], "relation", ["founded", "won"])


_KNOWN = """kn as (select l name, min(t) category, count(distinct ord) views from (select ord, z.label l, z.type t from (select ord, unnest(reasoning_graph.nodes) z from gold)) group by 1)"""


@query("with " + _KNOWN + r""", g as (select ord, claim || ' seen in 1987 with 4321 others' c, list_distinct(list_transform(reasoning_graph.edges, lambda e: cast(substr(e.start, 1, 4) as integer))) ys, list_transform(evidence, lambda v: v.text) fs from gold where claim is not null),
y as (select *, list_filter(list_distinct(list_transform(regexp_extract_all(c, '(?:^|[^\p{L}\p{N}_])(1[0-9]{3}|20[0-9]{2})(?:[^\p{L}\p{N}_]|$)', 1), lambda x: cast(x as integer))), lambda x: not list_contains(ys, x)) odd from g)
select ord, list_min(list_transform(odd, lambda x: list_min(list_transform(ys, lambda e: abs(x - e))))) "years" from y""")
def year_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the years that a claim names, and its evidence doesn't, lie from those of the evidence; every claim here gets one such year."""
    g = read(spark, sf_dir, "gold").where("claim is not null")
    ys = F.array_distinct(F.transform("reasoning_graph.edges", lambda e: F.substring(e["start"], 1, 4).cast("int")))
    return g.select("ord", V.year_delta(F.concat("claim", F.lit(" seen in 1987 with 4321 others")), ys).alias("years"))


@query("with " + _KNOWN + """, g as (select ord, list_transform(reasoning_graph.nodes, lambda z: z.label) own from gold where claim is not null),
o as (select ord, list(distinct category) of_, min(views) least from (select distinct ord, unnest(own) l from g) join kn on l = name group by 1),
p as (select g.ord, h.own[1] l, h.own[2] m, g.own from g join g h on h.ord = (g.ord * 7 + 3) % (select max(ord) + 1 from g)),
n as (select distinct ord, unnest([l, m]) l, own from p), w as (select n.ord, list(distinct category) new_, min(views) views from n join kn on n.l = name where regexp_full_match(n.l, '[A-Z][A-Za-z]+ [A-Z][A-Za-z]+') and not list_contains(own, n.l) group by 1)
select w.ord, list_has_any(new_, coalesce(of_, [])) same_category, round(case when least > 0 then views / cast(greatest(least, 1) as double) end, 6) views_ratio from w left join o on w.ord = o.ord""")
def entity_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that name two entities of another record: whether their types are among those of their own record, and how much rarer they are."""
    g = read(spark, sf_dir, "gold").where("claim is not null").select("ord", F.transform("reasoning_graph.nodes", lambda z: z["label"]).alias("own"))
    z = read(spark, sf_dir, "gold").select("ord", F.explode("reasoning_graph.nodes").alias("z")).select("ord", F.col("z.label").alias("name"), F.col("z.type").alias("category"))
    known = z.groupBy("name").agg(F.min("category").alias("category"), F.count_distinct("ord").alias("views"))
    most = g.agg(F.max("ord")).first()[0] or 0
    other = g.select(F.col("ord").alias("h"), F.slice("own", 1, 2).alias("two"))
    named = F.filter("two", lambda n: n.rlike("^[A-Z][A-Za-z]+ [A-Z][A-Za-z]+$"))
    p = g.withColumn("h", (F.col("ord") * 7 + 3) % (most + 1)).join(other, "h").select("ord", "own", F.array_join(named, " and then ").alias("claim"))
    got = V.entity_change(p, known, "ord", "claim", "own")
    return got.select("ord", "same_category", F.round("views_ratio", 6).alias("views_ratio"))


@query("""with e as (select ord, id, unnest(pre_extracted.entities) z from raw_demo where pre_extracted is not null), d as (select distinct ord, z.label l from e), p as (select a.l a, b.l b, count(*) n, min(a.ord) first_ord from d a join d b on a.ord = b.ord and a.l < b.l group by 1, 2)
select a, b, n, first_ord from p order by n desc, first_ord, a, b limit 30000""")
def co_mention_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30,000 pairs of entities that most articles name together, ties by the first article."""
    ls = F.array_sort(F.array_distinct(F.transform("pre_extracted.entities", lambda z: z["label"])))
    df = read(spark, sf_dir, "raw_demo").where("pre_extracted is not null").select("ord", ls.alias("ls"))
    pairs = F.flatten(F.transform("ls", lambda a: F.transform(F.filter("ls", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    n = df.select("ord", F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"))
    return n.orderBy(F.desc("n"), "first_ord", "a", "b").limit(30_000)


@query(r"""with u as (select 0 f, ord, claim from gold union all select 1, ord, claim from raw_demo union all select 2, ord, claim from raw), k as (select f, ord, lower(regexp_replace(claim, '[\s\p{Z}]+', '', 'g')) k from u where claim is not null),
g as (select k, f, count(*) n from k where k <> '' group by 1, 2), m as (select k, min(f) f0, sum(n) n, count(*) files, max(n) most from g group by 1)
select f0 first_file, count(*) claims, count(*) filter (where files > 1) shared, cast(sum(n - 1) as bigint) copies, max(most) most_in_a_file from m group by 1""".replace("\\\\", "\\"))
def claims_across_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims by the first of three files that holds them: how many stand in another file too, and how many copies there are."""
    u = None
    for i, t in enumerate(("gold", "raw_demo", "raw")):
        part = read(spark, sf_dir, t).select(F.lit(i).alias("f"), F.sha2(F.nullif(F.lower(X.squeeze(F.col("claim"))), F.lit("")), 256).alias("k")).where("k is not null")
        u = part if u is None else u.unionByName(part)
    m = u.groupBy("k", "f").agg(F.count(F.lit(1)).alias("n")).groupBy("k").agg(F.min("f").alias("first_file"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("files"), F.max("n").alias("most"))
    return m.groupBy("first_file").agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.col("files") > 1).alias("shared"), F.sum(F.col("n") - 1).alias("copies"), F.max("most").alias("most_in_a_file"))
