"""The graph build, strategy tags and path samples over recorded extractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridelta.operators import build as B
from veridelta.operators import paths as P
from veridelta.plans.registry import query
from veridelta.plans.star import _EDGES, _kg
from veridelta.session import read

_VERDICT = "case regexp_replace(lower(trim({c})), '[\\s_-]+', ' ', 'g') when 'true' then 'true' when 'correct' then 'true' when 'real' then 'true' when 'mostly true' then 'true' when '真实' then 'true' when '真' then 'true' when '属实' then 'true' when 'false' then 'false' when 'fake' then 'false' when 'incorrect' then 'false' when 'mostly false' then 'false' when '谣言' then 'false' when '假' then 'false' when '不实' then 'false' when '虚假' then 'false' when 'mixed' then 'mixed' when 'mixture' then 'mixed' when 'misleading' then 'mixed' when 'partly true' then 'mixed' when '部分属实' then 'mixed' when '误导' then 'mixed' end"
_RELATIONS = "('is_barred_from', 'endorsed', 'subsequent_to', 'member_of', 'held_office', 'won', 'located_in', 'headquartered_in', 'hosted', 'voiced', 'adapted_from', 'married_to', 'relative_of', 'caused_by', 'parallel_to', 'has_value', 'has_outcome', 'participated_in', 'appointed_to', 'elected_to', 'resigned_from', 'occurred_during', 'founded', 'released')"
_BLANK = "coalesce(regexp_replace({c}, '[\\s\\p{{Z}}]+', '', 'g') = '', true)"
# the days of an end of a fact, as a pattern that its quote must hold
_STANDS = """regexp_matches(f.evidence_quote, '(?i)' || case f.time_precision when 'year' then '(?:^|[^0-9])' || {y} || '(?:[^0-9]|$)'
 when 'month' then '(?:^|[^0-9])' || strftime({d}, '%Y-%m') || '(?:[^0-9]|$)|\\b' || {w} || '[\\s\\p{{Z}}]+' || {y} || '\\b|' || {y} || '年[\\s\\p{{Z}}]*0?' || {m} || '月'
 when 'day' then '(?:^|[^0-9])' || strftime({d}, '%Y-%m-%d') || '(?:[^0-9]|$)|\\b' || {w} || '[\\s\\p{{Z}}]+0?' || {n} || '(?:st|nd|rd|th)?,?[\\s\\p{{Z}}]+' || {y} || '\\b|\\b0?' || {n} || '(?:st|nd|rd|th)?[\\s\\p{{Z}}]+' || {w} || ',?[\\s\\p{{Z}}]+' || {y} || '\\b|' || {y} || '年[\\s\\p{{Z}}]*0?' || {m} || '月[\\s\\p{{Z}}]*0?' || {n} || '[日号]' end)"""


def _stands(d: str) -> str:
    name = f"strftime({d}, '%B')"
    word = f"('(?:' || {name} || '|' || case when month({d}) = 9 then 'Sept?\\.?' else substr({name}, 1, 3) || '\\.?' end || ')')"
    return _STANDS.format(d=d, y=f"cast(year({d}) as varchar)", m=f"cast(month({d}) as varchar)", n=f"cast(day({d}) as varchar)", w=word)


def _checked(table: str, audit: bool, ground: bool) -> str:
    """CTEs of the articles of a table with their reason: first by fact, then by article."""
    blank = lambda c: _BLANK.format(c=c)
    passed = "coalesce(pre_audit.accepted and pre_audit.confidence between 0.9 and 1 and pre_audit.entity_accuracy and pre_audit.temporal_grounding and pre_audit.verdict_consistent and pre_audit.evidence_support, false)" if audit else "true"
    grounded = f"when not coalesce({_stands('s')} and {_stands('t')}, false) then 'grounding'" if ground else ""
    return f"""src as (select *, {blank('text')} or {blank('id')} nothing, row_number() over (partition by id, {blank('text')} or {blank('id')} order by ord) turn from {table}),
fx as (select ord, u.i i, text, pre_extracted.entities es, pre_extracted.facts[u.i] f from src, unnest(generate_series(1, cast(len(pre_extracted.facts) as bigint))) u(i)),
fy as (select *, try_cast(f.start as date) s, try_cast(f."end" as date) t, list_filter(es, lambda z: z.id = f.head)[1] h, list_filter(es, lambda z: z.id = f.tail)[1] l from fx),
fz as (select ord, i, f, h, l, case when h is null or l is null then 'endpoint' when not coalesce(f.relation in {_RELATIONS}, false) then 'relation' when not coalesce(f.polarity in ('positive', 'negative'), false) then 'polarity'
 when coalesce(f.temporal_kind, 'event') not in ('event', 'state') then 'kind' when s is null or t is null then 'date' when s > t then 'reversed' when not coalesce(f.time_precision in ('day', 'month', 'year'), false) then 'precision'
 when f.time_precision = 'year' and not (strftime(s, '%m-%d') = '01-01' and strftime(t, '%m-%d') = '12-31') then 'year_bounds' when f.time_precision = 'month' and not (day(s) = 1 and t = last_day(t)) then 'month_bounds'
 when {blank('f.evidence_quote')} or not coalesce(contains(text, f.evidence_quote), false) then 'quote' {grounded} end reason from fy),
ff as (select ord, arg_min(reason, i) filter (where reason is not null) reason from fz group by 1),
given as (select *, {_VERDICT.format(c='source_verdict')} gv, {_VERDICT.format(c='pre_extracted.source_verdict')} dv, {passed} passed from src),
checked as (select g.*, case when nothing then 'no_text' when turn > 1 then 'duplicate_source' when not {blank('source_verdict')} and gv is null then 'unknown_verdict' when pre_extracted is null then 'no_extraction'
 when gv is null then 'missing_verdict' when gv is not null and dv is distinct from gv then 'verdict_disagrees' when not pre_extracted.time_sensitive and not passed then 'audit' when not pre_extracted.time_sensitive then null
 when pre_extracted.time_sensitive is null then 'no_classification' when pre_extracted.entities is null or coalesce(len(pre_extracted.facts), 0) < 1 then 'no_facts'
 when len(list_filter(pre_extracted.entities, lambda z: coalesce(trim(z.id) = '', true) or coalesce(trim(z.label) = '', true) or coalesce(trim(z.type) = '', true) or coalesce(trim(z.domain) = '', true))) > 0 then 'entity'
 when len(list_distinct(list_transform(pre_extracted.entities, lambda z: z.id))) <> len(pre_extracted.entities) then 'entity_twice' when ff.reason is not null then ff.reason when not passed then 'audit' end reason
 from given g left join ff on g.ord = ff.ord)"""


_STATUS = "case when reason is not null then 'rejected' when pre_extracted.time_sensitive then 'accepted' else 'time_robust' end status"


@query("with " + _checked("raw_demo", False, True) + f" select ord, {_STATUS}, reason from checked")
def graph_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of every article when the graph is built, with the first fault."""
    return B.check(read(spark, sf_dir, "raw_demo")).select("ord", "status", "reason")


@query("with " + _checked("raw_with_extraction", True, False) + f" select ord, {_STATUS}, reason from checked")
def graph_records_audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of pages with a recorded audit; times needn't stand in the quotes."""
    return B.check(read(spark, sf_dir, "raw_with_extraction"), "pre_audit", ground=False).select("ord", "status", "reason")


_ID = "'entity:' || substr(sha256({z}.type || '|' || coalesce(language, 'und') || '|' || {z}.label || '|' || case when coalesce(trim({z}.disambiguation), '') = '' then id else trim({z}.disambiguation) end), 1, 20)"
_GRAPH = (
    "with " + _checked("raw_demo", False, False) + f""", good as (select * from checked where reason is null and pre_extracted.time_sensitive),
e as (select g.ord, g.id source, g.gv verdict, {_ID.format(z='h')} head, f.relation relation, {_ID.format(z='l')} tail, f.start s, f."end" t, f.time_precision prec, f.polarity polarity, coalesce(f.temporal_kind, 'event') kind, f.evidence_quote quote from fz join good g using (ord)),
k as (select *, 'edge:' || substr(sha256(head || '|' || relation || '|' || tail || '|' || s || '|' || t || '|' || prec || '|' || polarity || '|' || kind), 1, 20) edge_id from e),
d as (select distinct edge_id, head, relation, tail, s, t, polarity from k),
bad as (select a.edge_id a, b.edge_id b from d a join d b on a.head = b.head and a.relation = b.relation and a.tail = b.tail and a.polarity < b.polarity and a.s <= b.t and b.s <= a.t),
kept as (select * from k where edge_id not in (select a from bad) and edge_id not in (select b from bad))
"""
)


def _graph(spark: SparkSession, sf_dir: str) -> B.Graph:
    return B.build(read(spark, sf_dir, "raw_demo"), ground=False)


@query(_GRAPH + "select edge_id, head, relation, tail, s \"start\", t \"end\", prec \"precision\", polarity, kind, list_sort(list(distinct source)) sources, list_sort(list(distinct source || '=' || verdict)) verdicts, count(distinct source || quote) evidence from kept group by all")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the accepted articles, merged, without those that contradict one another."""
    e = _graph(spark, sf_dir).edges
    said = F.array_sort(F.transform(F.map_entries("verdicts"), lambda x: F.concat(x["key"], F.lit("="), x["value"])))
    return e.withColumn("verdicts", said).withColumn("evidence", F.size("evidence").cast("long"))


@query(_GRAPH + f""", n as (select ord, id, language, {_ID.format(z='z')} node_id, z.label, z.type, z.domain from (select ord, id, language, unnest(pre_extracted.entities) z from good))
select node_id, arg_min(label, ord) "label", arg_min(type, ord) "type", arg_min(domain, ord) "domain", arg_min(coalesce(language, 'und'), ord) "language", list_sort(list(distinct domain)) domains, list_sort(list(distinct id)) source_ids from n
where node_id in (select head from kept union select tail from kept) group by 1""")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of the accepted articles that a fact is left of."""
    return _graph(spark, sf_dir).nodes


@query(_GRAPH + "select a key_a, b key_b from bad")
def graph_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).contradictions


@query("""with g as (select ord, list_transform(reasoning_graph.nodes, lambda z: lower(z.type)) ty, reasoning_graph.edges es from gold where len(reasoning_graph.edges) > 0),
r as (select *, list_transform(es, lambda e: e.relation) rel from g)
select ord, list_filter([case when len(list_distinct(list_concat(list_transform(es, lambda e: substr(e.start, 1, 4)), list_transform(es, lambda e: substr(e."end", 1, 4))))) = 1 then 'temporal_synchronization' end,
case when list_has_any(ty, ['person', 'human']) then 'person_identity_fusion' end, case when list_has_any(ty, ['location', 'place', 'city', 'country']) then 'geospatial_coincidence' end,
case when list_has_any(rel, ['member_of', 'headquartered_in', 'employed_by', 'founded']) then 'institutional_affiliation' end, case when list_has_any(rel, ['adapted_from']) then 'artifact_adaptation' end,
case when list_has_any(rel, ['married_to', 'relative_of']) then 'genealogical_linkage' end, case when list_has_any(rel, ['caused_by', 'causes']) then 'event_causality' end, case when list_has_any(rel, ['parallel_to']) then 'role_parallelism' end], lambda x: x is not null) strategies from r""")
def strategy_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strategies that each gold record's path may serve."""
    g = F.col("reasoning_graph")
    tags = P.strategies(F.transform(g["nodes"], lambda z: z["type"]), g["edges"])
    return read(spark, sf_dir, "gold").where(F.size(g["edges"]) > 0).select("ord", tags.alias("strategies"))


_SEED, _DRAWS = 42, 300
_DRAW = "cast('0x' || substr(md5({}), 1, 12) as bigint)"
_TYPES = "case split_part(node, ':', 1) when 'customer' then 'person' when 'supplier' then 'organization' when 'part' then 'artifact' else 'event' end"


def _numbered_sql(typed: str = "true") -> str:
    """CTEs, with the condition of a typed edge, up to adj (node, no, nxt, degree, typed, next_degree, next_typed, id, s, t) and places (node, degree, typed)."""
    return "with " + _EDGES.replace("kg as (", "kg as materialized (") + """, both_ as (select id, s, t, """ + typed + """ ty, head node, tail nxt, 'forward' dir from kg union all select id, s, t, """ + typed + """, tail, head, 'reverse' from kg),
n as materialized (select *, row_number() over (partition by node order by case when ty then '0' else '1' end || ':' || id || ':' || dir) - 1 as no from both_),
places as materialized (select node, count(*) degree, count(*) filter (where ty) typed from n group by 1),
adj as materialized (select n.*, p.degree next_degree, p.typed next_typed from n join places p on n.nxt = p.node)"""


def _walk_sql(name: str, hops: int, bias: float | None) -> str:
    """CTEs {name}0 .. {name}{hops} of walkers: w, nodes, ids, ends, node, degree, typed, from {name} (w, node, degree, typed)."""
    out = f", {name}0 as materialized (select w, [node] nodes, cast([] as varchar[]) ids, cast([] as date[]) starts, cast([] as date[]) ends, 0 as typed_edges, node, degree, typed from {name})"
    for k in range(hops):
        among = "p.degree" if bias is None else f"case when {_DRAW.format(repr(f'{_SEED}:typed:{k}:') + ' || w')} < {int(bias * 2**48)} and p.typed > 0 then p.typed else p.degree end"
        no = _DRAW.format(repr(f"{_SEED}:step:{k}:") + " || w || ':' || j")
        out += f""", {name}{k + 1} as materialized (select w, arg_min(x, j).nodes nodes, arg_min(x, j).ids ids, arg_min(x, j).starts starts, arg_min(x, j).ends ends, arg_min(x, j).te typed_edges, arg_min(x, j).nxt node, arg_min(x, j).nd degree, arg_min(x, j).nt typed from (
select q.w, q.j, {{'nodes': list_append(q.nodes, a.nxt), 'ids': list_append(q.ids, a.id), 'starts': list_append(q.starts, a.s), 'ends': list_append(q.ends, a.t), 'te': q.typed_edges + case when a.ty then 1 else 0 end, 'nxt': a.nxt, 'nd': a.next_degree, 'nt': a.next_typed}} x
from (select p.*, j, {no} % ({among}) as no from {name}{k} p, (select unnest([0, 1, 2, 3]) j)) q join adj a on a.node = q.node and a.no = q.no where not list_contains(q.nodes, a.nxt)) group by w)"""
    return out


def _sample_sql(hops: int) -> str:
    starts = f"""line{hops} as (select *, sum(degree) over (order by node) - degree lo, sum(degree) over () total from places),
d{hops} as (select i, {_DRAW.format(repr(f'{_SEED}:start:') + ' || i')} % (select any_value(total) from line{hops}) u from (select unnest(generate_series(0, {_DRAWS - 1})) i)),
s{hops} as (select d.i * {P.TRIES} + t.t w, node, degree, typed from d{hops} d join line{hops} on lo <= u and u < lo + degree, (select unnest(generate_series(0, {P.TRIES - 1})) t) t)"""
    last = f"s{hops}{hops}"
    return f""", {starts}{_walk_sql(f"s{hops}", hops, None)},
g{hops} as (select *, list_filter([case when len(list_distinct(list_concat(list_transform(starts, lambda x: year(x)), list_transform(ends, lambda x: year(x))))) = 1 then 'temporal_synchronization' end, case when len(list_filter(nodes, lambda n: n like 'customer:%')) > 0 then 'person_identity_fusion' end], lambda x: x is not null) tags from {last}),
a{hops} as (select w, nodes, ids, ends, tags[1 + {_DRAW.format(repr(f'{_SEED}:strategy:') + ' || w')} % len(tags)] strategy from g{hops} where len(tags) > 0),
b{hops} as (select min(w) w from a{hops} group by w // {P.TRIES}),
c{hops} as (select arg_min(w, w) w, arg_min(nodes, w) nodes, arg_min(strategy, w) strategy, arg_min(list_aggregate(ends, 'max'), w) reference_date, 'path_' || substr(sha256(array_to_string(list_sort(ids), '|')), 1, 20) path_id from a{hops} where w in (select w from b{hops}) group by array_to_string(list_sort(ids), '|'))"""


_HOPS = (2, 3, 4, 5)


@query(_numbered_sql() + "".join(map(_sample_sql, _HOPS)) + " " + " union all ".join(f"select {h} hops, path_id, w draw, array_to_string(nodes, ' ') nodes, strategy, 'independent' \"mode\", reference_date from c{h}" for h in _HOPS))
def path_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted paths of two to five edges through orders, customers, parts and suppliers, starts drawn by degree."""
    got = P.samples(_kg(spark, sf_dir, by_order=True), F.expr(_TYPES), _HOPS, _DRAWS, seed=_SEED)
    return got.select("hops", "path_id", "draw", F.array_join("nodes", " ").alias("nodes"), "strategy", "mode", "reference_date")


def _typed_sql(hops: int) -> str:
    n = _DRAWS * P.TRIES
    return f""", q{hops} as (select i w, {_DRAW.format(repr(f'{_SEED}:pool:') + ' || i')} < {int(0.8 * 2**48)} ft, {_DRAW.format(repr(f'{_SEED}:start:') + ' || i')} h from (select unnest(generate_series(0, {n - 1})) i)),
t{hops} as (select w, node, degree, typed from q{hops} join pools on pools.ft = q{hops}.ft and pools.u = q{hops}.h % pools.n){_walk_sql(f"t{hops}", hops, 0.8)},
u{hops} as (select * from t{hops}{hops} where w in (select min(w) from t{hops}{hops} group by w // {P.TRIES})),
v{hops} as (select min(w) w from u{hops} group by array_to_string(list_sort(nodes), '|') || '|' || array_to_string(list_sort(ids), '|'))"""


@query(
    _numbered_sql("relation = 'placed_by'") + """, pools as materialized (select false ft, row_number() over (order by node) - 1 u, node, degree, typed, count(*) over () n from places union all select true, row_number() over (order by node) - 1, node, degree, typed, count(*) over () from places where typed > 0)"""
    + "".join(map(_typed_sql, (2, 4))) + " " + " union all ".join(f"select {h} hops, w draw, array_to_string(nodes, ' ') nodes, cast(typed_edges as bigint) typed_edges from u{h} where w in (select w from v{h})" for h in (2, 4))
)
def typed_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks of two and four edges that prefer who placed an order to what it holds."""
    edges = _kg(spark, sf_dir, by_order=True).withColumn("kind", F.when(F.col("relation") == "placed_by", "typed").otherwise("mention"))
    return P.typed_samples(edges, (2, 4), _DRAWS, seed=_SEED).select("hops", "draw", F.array_join("nodes", " ").alias("nodes"), "typed_edges")


def _ranked_sql(hops: int, fan: int, gap: int, span: int, budget: int) -> str:
    out = "with " + _EDGES.replace("kg as (", "kg as materialized (") + """, fr as (select relation, count(*) freq from kg group by 1),
adj as materialized (select id, relation, freq, year(s) * 12 + month(s) m, head node, tail nxt, 'forward' dir from kg join fr using (relation) union all select id, relation, freq, year(s) * 12 + month(s), tail, head, 'reverse' from kg join fr using (relation)),
p0 as (select 'customer:' || c_custkey seed, ['customer:' || c_custkey] nodes, cast([] as varchar[]) names, cast([] as varchar[]) rels, cast([] as bigint[]) ms, 'customer:' || c_custkey node, cast(null as bigint) last, '' k from customer)"""
    for i in range(hops):
        out += f""", p{i + 1} as materialized (select seed, list_append(nodes, nxt) nodes, list_append(names, id || ':' || dir) names, list_append(rels, relation) rels, list_append(ms, m) ms, nxt node, m last, k || '/' || id || ':' || dir k from (
select p.*, a.nxt, a.id, a.dir, a.relation, a.m, row_number() over (partition by seed, k order by coalesce(abs(a.m - p.last), 1000000), freq, a.id, a.dir) rn from p{i} p join adj a using (node) where not list_contains(p.nodes, a.nxt)) where rn <= {fan})"""
    return out + f""", x as (select *, list_sort(ms) z from p{hops}), y as (select *, list_min(list_transform(generate_series(1, len(z) - 1), lambda i: z[i + 1] - z[i])) gap, z[-1] - z[1] span from x),
w as (select *, {{'g': gap, 's': span, 'n': array_to_string(nodes, '|'), 'e': array_to_string(names, '|')}} o from y where gap <= {gap} and span <= {span}),
v as (select seed, min(o) o from w group by seed, array_to_string(list_sort(nodes), '|') || '|' || array_to_string(list_sort(rels), '|'))
select seed, replace(o.n, '|', ' ') nodes, cast(o.g as integer) least_gap, cast(o.s as integer) span from (select *, row_number() over (partition by seed order by o) rn from v) where rn <= {budget}"""


@query(_ranked_sql(3, 3, 12, 60, 2))
def ranked_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two tightest paths of three edges from each customer, prolonged by the three best edges at each step."""
    edges = _kg(spark, sf_dir, by_order=True).select("id", "head", "relation", "tail", (F.year("start") * 12 + F.month("start")).alias("month"))
    seeds = read(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("node"))
    got = P.ranked_paths(edges, seeds, 3, budget=2, fan=3, most_gap=12, most_span=60)
    return got.select("seed", F.array_join("nodes", " ").alias("nodes"), "least_gap", "span")
