"""Queries over the steps between stages: pools, upgrades, listings, label maps, repairs, expansions, the gold adapter, and the stages of inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridelta.functions import text as X
from veridelta.operators import adapt as A
from veridelta.operators import evaluate as ev
from veridelta.operators import stages as S
from veridelta.plans.evaluation import _PARSED
from veridelta.plans.registry import query
from veridelta.session import read

_PLACE = "[\\x{4e00}-\\x{9fa5}]{2,8}(?:省|市|县|区|州|盟|旗)"
_ORG = "[\\x{4e00}-\\x{9fa5}]{2,10}(?:公司|集团|大学|学院|医院|学校|银行|协会|研究院|研究所|机场|车站|铁路局|法院|检察院|工作室|俱乐部|基金会|事务中心)"
_BAD = "(?:地区|小区|小镇|城镇|乡村|农村|新村|景区|园区|城区|郊区|市区|灾区|山区|辖区|库区|牧区|矿区|校区|街区|社区|县区|村镇|九区|某区|各区|上市|都市|城市|集市|夜市|超市|股市|楼市|车市|菜市|早市|全市|全省|降价|涨价)$|^[该某这那多全各部一些两几]|部分|一些|某些|广大|各地|全国|多家|多个|少数|首个|市场|上市|都市|超市|股市|楼市|集市|车市|夜市|菜市|早市|节约|节省|省份|[着待援救可以节能会要把被让给了的是在有定格]"
_PROVINCE = "('河北省', '山西省', '辽宁省', '吉林省', '黑龙江省', '江苏省', '浙江省', '安徽省', '福建省', '江西省', '山东省', '河南省', '湖北省', '湖南省', '广东省', '海南省', '四川省', '贵州省', '云南省', '陕西省', '甘肃省', '青海省', '台湾省')"


@query(f"""with t as (select text from raw union all select text from documents), p as (select unnest(regexp_extract_all(text, '{_PLACE}')) name from t), o as (select unnest(regexp_extract_all(text, '{_ORG}')) name from t),
n as (select 'place' kind, name, right(name, 1) suffix from p where length(name) between 3 and 9 and case when name like '%省' then name in {_PROVINCE} else not regexp_matches(name, '{_BAD}') end union all select 'organisation', name, right(name, 3) from o where length(name) between 3 and 12),
k as (select kind, suffix, name from n group by all having count(*) >= 2) select kind, suffix, list_sort(list(name)) names from k group by 1, 2 having count(*) >= 2""")
def swap_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chinese names of places and organisations in all texts that can stand for one another."""
    return A.swap_pools(read(spark, sf_dir, "raw").select("text").unionByName(read(spark, sf_dir, "documents").select("text")), "text")


_M = "January|February|March|April|May|June|July|August|September|October|November|December"
_L, _R = "(?:^|[^\\p{L}\\p{N}_])", "(?:[^\\p{L}\\p{N}_]|$)"  # word boundaries where letters of all scripts are word characters
_RANK = f"""case when regexp_matches(q, '(?i){_L}(?:{_M})[\\s\\p{{Z}}]+\\d{{1,2}},?[\\s\\p{{Z}}]+\\d{{4}}{_R}|{_L}\\d{{1,2}}[\\s\\p{{Z}}]+(?:{_M})[\\s\\p{{Z}}]+\\d{{4}}{_R}|{_L}\\d{{4}}-\\d{{2}}-\\d{{2}}{_R}') then 3 when regexp_matches(q, '(?i){_L}(?:{_M})[\\s\\p{{Z}}]+\\d{{4}}{_R}') then 2 when regexp_matches(q, '{_L}(?:1[89]\\d{{2}}|20\\d{{2}}){_R}') then 1 else 0 end"""
_QUOTES = "f as (select ord, u.i i, pre_extracted.facts[u.i].evidence_quote q, pre_extracted.facts[u.i].time_precision prec, pre_extracted.facts[u.i].start d from raw_demo, unnest(generate_series(1, cast(len(pre_extracted.facts) as bigint))) u(i))"


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = read(spark, sf_dir, "raw_demo").where("pre_extracted is not null").select("ord", F.posexplode("pre_extracted.facts").alias("i", "f"))
    return f.select(F.concat_ws(":", "ord", F.col("i") + 1).alias("fact"), F.col("f.evidence_quote").alias("q"), F.col("f.time_precision").alias("precision"), F.col("f.start").alias("date"))


@query(f"with {_QUOTES}, r as (select *, {_RANK} found from f) select prec \"precision\", found, count(*) n, count(*) filter (where found > case prec when 'day' then 3 when 'month' then 2 when 'year' then 1 else 0 end) upgradable from r group by 1, 2")
def evidence_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The finest date in the quotes of facts against the precision of the facts."""
    f = _quotes(spark, sf_dir).select("precision", A.evidence_rank(F.col("q")).alias("found"))
    from veridelta.functions.dates import precision_rank

    return f.groupBy("precision", "found").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("found") > precision_rank(F.col("precision"))).alias("upgradable"))


@query(f"""with {_QUOTES}, a as (select *, nullif(regexp_extract(q, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}'), '') nd from f)
select ord || ':' || i fact, case when nd is not null and prec <> 'day' then nd else d end "date", case when nd is not null and prec <> 'day' then 'day' else prec end "precision", coalesce(nd is not null and prec <> 'day', false) upgraded from a""")
def upgraded_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with the finer date that an answer quotes from their evidence; answers here name the first ISO day of a quote, or something that no quote holds."""
    f = _quotes(spark, sf_dir)
    day = F.regexp_extract("q", "[0-9]{4}-[0-9]{2}-[0-9]{2}", 0)
    right = f.where(day != "").select("fact", day.alias("new_date"), F.lit("day").alias("new_precision"), day.alias("quote"))
    wrong = f.where(day == "").select("fact", F.lit("2020-01-01").alias("new_date"), F.lit("day").alias("new_precision"), F.lit("no such words").alias("quote"))
    return A.upgrade_dates(f, right.unionByName(wrong), "fact", F.col("q")).select("fact", "date", "precision", "upgraded")


@query("""with l as (select 'raw' col, 0 p, ord, url, title, published_at from raw union all select 'raw_demo', 1, ord, url, title, published_at from raw_demo union all select 'raw_with_extraction', 2, ord, url, title, published_at from raw_with_extraction),
k as (select *, p * 10000000000 + ord o from l where regexp_matches(coalesce(published_at, ''), '^20[0-9]{2}-[0-9]{2}-[0-9]{2}'))
select url, arg_min(title, o) title, substr(arg_min(published_at, o), 1, 10) "day", list(col order by o) columns from k where title is not null group by url having substr(arg_min(published_at, o), 1, 10) between '2020-01-01' and '2023-12-31'""")
def merged_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated rows of three listings, one a URL: the first listing's row, all listings in order, in a range of days."""
    rows = None
    for p, t in enumerate(("raw", "raw_demo", "raw_with_extraction")):
        r = read(spark, sf_dir, t).select(F.lit(t).alias("column"), (F.lit(p) * 10_000_000_000 + F.col("ord")).alias("o"), "url", "title", "published_at")
        rows = r if rows is None else rows.unionByName(r)
    dated = rows.where("title is not null and published_at rlike '^20[0-9]{2}-[0-9]{2}-[0-9]{2}'")
    got = A.merge_listings(dated, "url", "column", "o").withColumn("day", F.substring("published_at", 1, 10)).where("day between '2020-01-01' and '2023-12-31'")
    return got.select("url", "title", "day", "columns")


@query("""with r as (select ord, source, url, published_at, trim(regexp_replace(title, '<[^>]+>', '', 'g')) title from raw), s as (select domain from sources where language = 'en')
select source, count(*) n, count(*) filter (where not coalesce(regexp_matches(substr(published_at, 1, 10), '^20[0-9]{2}-[0-9]{2}-[0-9]{2}$') and lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) in (select domain from s), false)) skipped,
min(substr(published_at, 1, 10)) filter (where regexp_matches(substr(published_at, 1, 10), '^20[0-9]{2}-[0-9]{2}-[0-9]{2}$') and lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) in (select domain from s)) first_day from r group by 1""")
def listing_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each source's listing that are skipped when only English hosts are in scope, and the first day of the rest."""
    hosts = [r.domain for r in read(spark, sf_dir, "sources").where("language = 'en'").select("domain").limit(10_000).collect()]
    rows = A.listing_rows(read(spark, sf_dir, "raw").select("source", "url", "title", "published_at"), "url", "title", "published_at", F.array(*map(F.lit, hosts)) if hosts else F.array().cast("array<string>"))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if("skipped").alias("skipped"), F.min(F.when(~F.col("skipped"), F.col("day"))).alias("first_day"))


_LABELS = """d as (select z.label "label", 'demo:' || ord || ':' || z.id id, ord from (select ord, unnest(pre_extracted.entities) z from raw_demo where pre_extracted is not null)),
g as (select z.label "label", 'gold:' || ord || ':' || z.id id, ord * 100 + cast(substr(z.id, 2) as bigint) ord from (select ord, unnest(reasoning_graph.nodes) z from gold))"""


def _labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = read(spark, sf_dir, "raw_demo").where("pre_extracted is not null").select("ord", F.posexplode("pre_extracted.entities").alias("i", "z"))
    g = read(spark, sf_dir, "gold").select("ord", F.explode("reasoning_graph.nodes").alias("z"))
    name = lambda kind: F.concat(F.lit(kind), F.col("ord").cast("string"), F.lit(":"), F.col("z.id"))
    first = d.select(F.col("z.label").alias("label"), name("demo:").alias("id"), F.struct("ord", "i").alias("ord"))
    second = g.select(F.col("z.label").alias("label"), name("gold:").alias("id"), F.struct("ord", F.substring("z.id", 2, 9).cast("int").alias("i")).alias("ord"))
    return first, second


@query("with " + _LABELS.replace("|| z.id id, ord from", "|| z.id id, ord * 1000 + i ord from").replace("select ord, unnest(pre_extracted.entities) z from raw_demo where pre_extracted is not null", "select ord, u.i i, pre_extracted.entities[u.i] z from raw_demo, unnest(generate_series(1, cast(len(pre_extracted.entities) as bigint))) u(i)") + """, a as (select *, 0 p from d union all select *, 1 from g),
m as (select "label", arg_min(id, struct_pack(p := p, o := ord)) id from a where "label" is not null group by 1),
e as (select relation, list_filter(ns, lambda z: z.id = tail)[1].label "label" from (select e.relation relation, e.tail tail, ns from (select unnest(reasoning_graph.edges) e, reasoning_graph.nodes ns from gold)))
select relation, count(*) n, count(m.id) resolved, count(*) filter (where m.id like 'demo:%') by_first, min(m.id) least_id from e left join m using ("label") group by 1""")
def resolved_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tails of gold edges found by their label among the entities of articles, else among the nodes of gold."""
    e = read(spark, sf_dir, "gold").select(F.col("reasoning_graph.nodes").alias("ns"), F.explode("reasoning_graph.edges").alias("e"))
    e = e.select(F.col("e.relation").alias("relation"), F.get(F.filter("ns", lambda z: z["id"] == F.col("e.tail")), 0)["label"].alias("tail"))
    got = A.resolved(e, A.label_ids(list(_labels(spark, sf_dir))))
    return got.groupBy("relation").agg(F.count(F.lit(1)).alias("n"), F.count("tail_id").alias("resolved"), F.count_if(F.startswith("tail_id", F.lit("demo:"))).alias("by_first"), F.min("tail_id").alias("least_id"))


@query("with " + _LABELS + """, k as (select min("label") "label", lower(trim("label")) n from d where "label" is not null group by lower(trim("label"))) select "label" from k where n <> '' and n not in (select lower(trim("label")) from g where "label" is not null)""")
def new_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of articles that gold doesn't know."""
    first, second = _labels(spark, sf_dir)
    return A.new_labels(first, second)


@query("""with h as (select ord, pre_extracted.claim c from raw_demo where pre_extracted is not null and not regexp_matches(coalesce(pre_extracted.claim, '一'), '[\\x{4e00}-\\x{9fff}]'))
select r.ord, coalesce(h.c, r.claim) claim, case when h.c is not null then 'kept' else 'redo' end status from raw_demo r left join h on r.ord = h.ord""")
def repaired_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims taken from the recorded extraction where that has no Chinese character; the rest must be done again."""
    r = read(spark, sf_dir, "raw_demo")
    have = r.where("pre_extracted is not null").select("ord", F.col("pre_extracted.claim").alias("claim"))
    return A.repaired(r.select("ord", "claim"), have, "ord", "claim", ~F.col("claim").rlike("[一-鿿]")).select("ord", "claim", "status")


@query("""with p as (select id, max(ord) last from predictions where id in (select id from gold) group by 1) select p.id, p.last, min(g.ord) first_gold from p join gold g on p.id = g.id group by 1, 2""")
def paired_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last prediction of every known id beside the first gold row; an id without one would be an error."""
    gold = read(spark, sf_dir, "gold").groupBy("id").agg(F.min("ord").alias("first_gold"))
    p = read(spark, sf_dir, "predictions").groupBy("id").agg(F.max("ord").alias("last"))
    return A.checked_join(p.join(gold.select("id"), "id", "left_semi"), gold, "id").select("id", "last", "first_gold")


@query("""with r as (select ord, id, claim from raw_demo where claim is not null), c as (select ord, claim own, 0 place, trim('No: ' || claim) c, false l, 6 least from r union all select ord, claim, 1, case when ord % 2 = 0 then trim(claim) else 'No:' || claim end, false, 6 from r union all select ord, claim, 2, trim(substr(claim, 1, 40)), true, 8 from r),
v as (select *, regexp_replace(c, '[\\s\\p{Z}]+', '', 'g') k, length(c) between 6 and 90 and length(c) >= least and regexp_replace(c, '[\\s\\p{Z}]+', '', 'g') <> regexp_replace(own, '[\\s\\p{Z}]+', '', 'g') and not regexp_matches(c, '[{}<>]|\\.\\.\\.|……|\\bN/A\\b') ok from c),
f as (select ord, k, min(place) p from v where ok and not l group by 1, 2), j as (select v.*, f.p from v left join f on v.ord = f.ord and v.k = f.k)
select l "label", case when not ok then case when l then 'invalid_statement' else 'invalid_perturbation' end when not l and p < place then 'repeated' else 'ok' end outcome, count(*) n, cast(sum(length(c)) as bigint) chars from j group by 1, 2""")
def expanded_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims made of recorded answers, two perturbations and a true statement a claim, by what becomes of them."""
    r = read(spark, sf_dir, "raw_demo").where("claim is not null").select(F.col("ord").cast("string").alias("id"), "ord", "claim")
    edit = lambda c: F.struct(c.alias("claim"), F.lit("e").alias("edit"))
    second = F.when(F.col("ord") % 2 == 0, F.col("claim")).otherwise(F.concat(F.lit("No:"), "claim"))
    answer = F.to_json(F.struct(F.array(edit(F.concat(F.lit("No: "), "claim")), edit(second), edit(F.lit("beyond the first two"))).alias("perturbations"), F.struct(F.substring("claim", 1, 40).alias("statement"), F.lit("b").alias("basis")).alias("truth")))
    got = A.expand_answers(r, r.select("id", answer.alias("response")))
    return got.groupBy("label", F.coalesce("problem", F.lit("ok")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("claim")).alias("chars"))


_ADAPT = """src as (select ord, id, claim, label, hop_count, time_window w, list_transform(reasoning_graph.nodes, lambda z: z.label) ns, reasoning_graph.edges es, evidence ev, reference_date d from gold),
turn as (select id, min(ord) f from src where coalesce(trim(id), '') <> '' group by 1),
x as (select s.*, case when t.f is null or t.f < s.ord then 'bad_or_duplicate_id' when coalesce(trim(claim), '') = '' then 'empty_claim' when coalesce(w.start, '') = '' or coalesce(w."end", '') = '' then 'no_window' when coalesce(len(ns), 0) < 1 or coalesce(len(es), 0) < 1 then 'no_graph'
 when try_cast(w.start as date) > try_cast(w."end" as date) then 'window_reversed' when len(ns) <> len(es) + 1 then 'hops_differ' end failure from src s left join turn t on s.id = t.id)"""


def _adapted(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = read(spark, sf_dir, "gold")
    fact = lambda e: F.concat(F.col("ord").cast("string"), F.lit(":"), F.get(e["evidence_ids"], 0))
    size = F.when(F.col("ord") % 3 == 0, 4).when(F.col("ord") % 3 == 1, 7).otherwise(10)
    chain = F.transform("reasoning_graph.edges", lambda e: F.struct(e["relation"].alias("relation"), F.substr(e["start"], F.lit(1), size).alias("date"), F.when(F.col("ord") % 4 != 0, fact(e)).alias("fact_id"), e["relation"].alias("fact")))
    claims = g.select("ord", "id", "claim", "label", "hop_count", "time_window", F.transform("reasoning_graph.nodes", lambda z: z["label"]).alias("path_nodes"), chain.alias("evidence_chain"), F.get("evidence", 0)["text"].alias("evidence"), F.col("reference_date").alias("date"))
    facts = g.select("ord", F.explode("evidence").alias("v")).select(F.concat(F.col("ord").cast("string"), F.lit(":"), F.col("v.id")).alias("id"), F.col("v.text").alias("fact"), F.col("v.url").alias("url"), F.col("v.timestamp").alias("date")).where("length(fact) % 2 = 0").dropDuplicates(["id"])
    return A.adapt_gold(claims, facts)


@query("with " + _ADAPT + " select coalesce(failure, 'ok') outcome, count(*) n, count(*) filter (where label) true_claims from x group by 1")
def adapter_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold records that the adapter makes of claims, and why it makes none of the others."""
    return _adapted(spark, sf_dir).groupBy(F.coalesce("failure", F.lit("ok")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.count_if("label").alias("true_claims"))


@query("with " + _ADAPT + """, c as (select ord, id, claim, es, ns, ev, w, d from x where failure is null),
i as (select ord, u.i i, es[u.i] e from c, unnest(generate_series(1, cast(len(es) as bigint))) u(i)),
k as (select ord, e.evidence_ids[1] v, min(i) i, arg_min(e.relation, i) fact from i where ord % 4 <> 0 and coalesce(e.evidence_ids[1], '') <> '' group by 1, 2),
t as (select ord, z.id v, any_value(z.text) txt from (select ord, unnest(ev) z from c) where length(z.text) % 2 = 0 group by 1, 2),
h as (select k.ord, list(coalesce(nullif(t.txt, ''), k.fact) order by k.i) texts from k left join t on k.ord = t.ord and k.v = t.v group by 1)
select c.ord, c.id, trim(c.claim) claim, coalesce(h.texts, [coalesce(c.ev[1].text, '')]) texts, case when length(d) = 10 then d end reference_date, len(ns) nodes,
list_transform(es, lambda e: case c.ord % 3 when 0 then substr(e.start, 1, 4) || '-01-01' when 1 then substr(e.start, 1, 7) || '-01' else e.start end) starts, list_transform(es, lambda e: cast(case c.ord % 3 when 0 then cast(substr(e.start, 1, 4) || '-12-31' as date) when 1 then last_day(cast(substr(e.start, 1, 7) || '-01' as date)) else cast(e.start as date) end as varchar)) ends
from c left join h on c.ord = h.ord""")
def adapted_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gold records themselves: evidence from the fact table, the chain or the record, and the bounds of partial dates."""
    r = _adapted(spark, sf_dir).where("failure is null")
    edges = F.col("reasoning_graph.edges")
    return r.select("ord", "id", "claim", F.transform("evidence", lambda x: x["text"]).alias("texts"), "reference_date", F.size("reasoning_graph.nodes").cast("long").alias("nodes"), F.transform(edges, lambda e: e["start"].cast("string")).alias("starts"), F.transform(edges, lambda e: e["end"].cast("string")).alias("ends"))


@query("""with s as (select source, home, language = 'en' monthly from sources), m as (select unnest(generate_series(date '2024-02-01', date '2023-11-01', interval '-1 month')) d, unnest(generate_series(0, 3)) turn)
select cast(turn as integer) turn, source, home || strftime(d, '%Y/%m') || '/' url from s, m where monthly union all select 0, source, home from s where not monthly""")
def month_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses to begin with: the months of English sources from the last to the first, the home pages of others."""
    s = read(spark, sf_dir, "sources").select("source", "home", (F.col("language") == "en").alias("monthly"))
    return A.month_seeds(spark, s, "2023-11-15", "2024-02-03")


@query("select ord, strftime(date_trunc('month', cast(published_at as date)) - interval 1 month, '%Y-%m') latest, strftime(date_trunc('month', cast(published_at as date)) - interval 14 month, '%Y-%m') earliest from raw where try_cast(published_at as date) is not null and regexp_matches(published_at, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$')")
def month_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and the last of the fourteen months before each article."""
    from veridelta.functions.dates import iso_day

    m = A.months_back(iso_day(F.col("published_at")), 14)
    return read(spark, sf_dir, "raw").where(iso_day(F.col("published_at")).isNotNull()).select("ord", m[0].alias("latest"), m[13].alias("earliest"))


@query("""with r as (select ord, id, claim, case when ord % 5 = 0 then substr(reference_date, 1, 7) else reference_date end ref, ord % 7 = 0 draft from gold), f as (select id, min(ord) f from r group by 1)
select coalesce(case when coalesce(trim(r.id), '') = '' then 'id' when f.f < ord then 'duplicate_id' when coalesce(trim(claim), '') = '' then 'claim' when draft then 'draft' when ref is not null and (try_cast(ref as date) is null or length(ref) <> 10) then 'reference_date' end, 'ok') reason, count(*) n from r join f on r.id = f.id group by 1""")
def inference_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that inference may take, by the first fault; their answers are left behind."""
    g = read(spark, sf_dir, "gold")
    ref = F.when(F.col("ord") % 5 == 0, F.substring("reference_date", 1, 7)).otherwise(F.col("reference_date"))
    rows = S.inputs(g.withColumn("reference_date", ref).withColumn("status", F.when(F.col("ord") % 7 == 0, S.DRAFT)))
    if {"label", "evidence", "reasoning_graph"} & set(rows.columns):
        raise AssertionError("an answer came through")
    return rows.groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("with " + _PARSED + """, s as (select ord, q_status = 'ok' q, coalesce(trim(explanation), '') <> '' x, predicted_label p from stat),
h as (select *, case when q then 'ok' else 'error' end a, case when not q then 'skipped' when not x then 'error' else 'ok' end b from s),
r as (select 'queries' stage, a status, p from h union all select 'explanation', b, p from h union all select 'verdict', case when b <> 'ok' then 'skipped' else 'ok' end, p from h)
select stage, count(*) n_inputs, count(*) filter (where status = 'ok') ok, count(*) filter (where status = 'error') "error", count(*) filter (where status = 'skipped') skipped, count(*) filter (where status = 'ok') = count(*) complete, cast(count(*) filter (where status <> 'skipped') as bigint) model_calls, cast(0 as bigint) search_calls,
count(*) filter (where stage = 'verdict' and status = 'ok' and p is null) abstentions from r group by 1""")
def stage_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of three stages over the predictions: a stage after a failed one is skipped, a verdict without a label is an abstention."""
    p = ev.parse_queries(read(spark, sf_dir, "predictions").select("ord", "queries", "explanation", "predicted_label"))
    entry = lambda s: F.struct(s.alias("status"))
    first = F.when(F.col("q_status") == "ok", "ok").otherwise("error")
    h = p.withColumn("history", F.create_map(F.lit("queries"), entry(first)))
    e = S.gate(h, "explanation").withColumn("status", F.coalesce("status", F.when(F.coalesce(X.strip(F.col("explanation")) == "", F.lit(True)), "error").otherwise("ok")))
    e = e.withColumn("history", F.map_concat("history", F.create_map(F.lit("explanation"), entry(F.col("status")))))
    v = S.gate(e, "verdict").withColumn("status", F.coalesce("status", F.lit("ok")))
    row = lambda df, s, stage: df.select(F.lit(stage).alias("stage"), s.alias("status"), (s != "skipped").cast("long").alias("model_calls"), F.lit(0).cast("long").alias("search_calls"), "predicted_label")
    return S.stage_report(row(h, first, "queries").unionByName(row(e, F.col("status"), "explanation")).unionByName(row(v, F.col("status"), "verdict")))


@query("""with e as (select g.ord || ':' || u.i as key, list_filter(g.reasoning_graph.nodes, lambda z: z.id = g.reasoning_graph.edges[u.i].head)[1].label head, g.reasoning_graph.edges[u.i].relation relation, list_filter(g.reasoning_graph.nodes, lambda z: z.id = g.reasoning_graph.edges[u.i].tail)[1].label tail, g.reasoning_graph.edges[u.i].start d from gold g, unnest(generate_series(1, cast(len(g.reasoning_graph.edges) as bigint))) u(i)),
o as (select head, relation, min(d) d from e where relation in ('founded', 'won') group by 1, 2), n as (select head, relation, tail, min(d) d from e where relation not in ('founded', 'won') group by 1, 2, 3 having count(*) = 1), r as (select head entity, min(d) d from e where relation = 'hosted' group by 1)
select e.key, coalesce(o.d, n.d, r.d, substr(e.d, 1, 4)) "date", case when coalesce(o.d, n.d, r.d) is not null then 'day' else 'year' end "precision", case when o.d is not null then 'once' when n.d is not null then 'statement' when r.d is not null then 'release' end origin
from e left join o on e.head = o.head and e.relation = o.relation left join n on e.head = n.head and e.relation = n.relation and e.tail = n.tail left join r on e.tail = r.entity""")
def recorded_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges known by the year, with the day that recorded statements give: here the edges themselves are the statements, two relations hold once, and 'hosted' stands for a release."""
    g = read(spark, sf_dir, "gold").select("ord", F.col("reasoning_graph.nodes").alias("ns"), F.posexplode("reasoning_graph.edges").alias("i", "e"))
    label = lambda side: F.get(F.filter("ns", lambda z: z["id"] == F.col(f"e.{side}")), 0)["label"]
    e = g.select(F.concat_ws(":", "ord", F.col("i") + 1).alias("key"), label("head").alias("head"), F.col("e.relation").alias("relation"), label("tail").alias("tail"), F.col("e.start").alias("d"))
    triples = e.select("key", "head", "relation", "tail", F.substring("d", 1, 4).alias("date"), F.lit("year").alias("precision"))
    statements = e.select(F.col("head").alias("entity"), F.col("relation").alias("property"), "tail", F.col("d").alias("date"))
    props = e.select("relation").distinct().select("relation", F.col("relation").alias("property"), F.col("relation").isin("founded", "won").alias("once"))
    return A.recorded_dates(triples, statements, props, release="hosted").select("key", "date", "precision", "origin")
