"""Assembling, sampling and splitting data sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridelta.functions import text as X
from veridelta.operators import rank as R
from veridelta.operators import split as S
from veridelta.plans.registry import query
from veridelta.session import read

QUOTAS = {"fact_check": 40, "profile": 25, "digest": 30, "timeline": 10_000_000}


@query("""with b as (select *, row_number() over (partition by source, title order by n_chars desc nulls last, doc_id) r0 from documents where title is not null and source is not null), k as (select * from b where r0 = 1)
select doc_id, kind, rank from (select doc_id, kind, row_number() over (partition by kind order by n_chars desc nulls last, doc_id) rank from k where kind in ('fact_check', 'profile', 'digest', 'timeline'))
where rank <= case kind when 'fact_check' then 40 when 'profile' then 25 when 'digest' then 30 else 10000000 end""".replace("row_number() over (partition by kind", "cast(row_number() over (partition by kind").replace("doc_id) rank from k", "doc_id) as integer) rank from k"))
def kind_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest document of each source and title, then so many of each kind as its quota."""
    df = read(spark, sf_dir, "documents").where("title is not null and source is not null").select("doc_id", "kind", "n_chars", F.concat_ws("\x1f", "source", "title").alias("k"))
    return R.quota(df, "k", "kind", [F.desc_nulls_last("n_chars"), F.col("doc_id")], QUOTAS).select("doc_id", "kind", "rank")


@query("""select k.kind kind, k.quota quota, count(d.doc_id) have, greatest(k.quota - count(d.doc_id), 0) missing from (values ('fact_check', cast(40 as bigint)), ('profile', cast(25 as bigint)), ('digest', cast(30 as bigint)), ('timeline', cast(10000000 as bigint))) k(kind, quota) left join documents d on d.kind = k.kind group by 1, 2""")
def quota_shortfalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.shortfalls(read(spark, sf_dir, "documents"), "kind", QUOTAS)


@query("""select doc_id, source, rn <= 20 is_floor from (select doc_id, source, row_number() over (partition by source order by n_chars, doc_id) rn, n_chars from documents where n_chars is not null) order by (rn <= 20) desc, n_chars, doc_id limit 500""")
def floor_then_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty short documents of each source, then the shortest of the rest up to 500."""
    df = read(spark, sf_dir, "documents").where("n_chars is not null").select("doc_id", "source", "n_chars")
    return R.floor_fill(df, "source", [F.col("n_chars"), F.col("doc_id")], 20, 500).select("doc_id", "source", "is_floor")


@query(r"""with u as (select 0 prio, ord, claim, published_at from raw where claim is not null and source_verdict is not null union all select 1, ord, claim, published_at from raw_demo where claim is not null union all select 2, ord, claim, reference_date from gold where claim is not null),
k as (select prio, ord, regexp_replace(claim, '[\s\p{Z}]+', '', 'g') || '|' || coalesce(published_at, '') k from u where regexp_replace(claim, '[\s\p{Z}]+', '', 'g') <> ''), f as (select *, row_number() over (partition by k order by prio, ord) rn from k)
select prio, ord from f where rn = 1 order by prio, ord limit 900""")
def assembled_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims filled up to 900 from three sources in order of priority, each claim of a day once."""
    part = lambda t, date: read(spark, sf_dir, t).where("claim is not null").select("ord", "claim", F.col(date).alias("published_at"))
    raw = read(spark, sf_dir, "raw").where("claim is not null and source_verdict is not null").select("ord", "claim", "published_at")
    norm = X.squeeze(F.col("claim"))
    key = F.when(norm == "", "").otherwise(F.sha2(F.concat(norm, F.lit("|"), F.coalesce("published_at", F.lit(""))), 256))
    return R.fill_to_target([raw, part("raw_demo", "published_at"), part("gold", "reference_date")], key, "ord", 900).select("prio", "ord")


@query("""with d as (select doc_id, source, kind, row_number() over (partition by source, kind order by doc_id) k, case kind when 'fact_check' then 1 when 'rumor_note' then 2 else 0 end m, min(doc_id) over (partition by source) place from documents)
select doc_id, case when k = 1 and m > 0 then 0 else 1 end tier, case when k = 1 and m > 0 then m else 0 end turn, place from d""")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns by source and kind: one fact check and one rumour note of each source first."""
    df = read(spark, sf_dir, "documents").select("doc_id", "source", "kind")
    return R.round_robin(df, "source", "kind", "doc_id", ["fact_check", "rumor_note"]).select("doc_id", "tier", "turn", "place")


@query("""select ord, cast(turn as integer) turn from (select ord, row_number() over (partition by split, hop_count, label order by sha256('42:' || ord), ord) turn, sha256('42:' || ord) h from gold) order by turn, h, ord limit 200""")
def review_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """200 gold rows for review, taken in turn from the strata of split, hop and label."""
    return R.stratified_sample(read(spark, sf_dir, "gold").select("ord", "split", "hop_count", "label"), ["split", "hop_count", "label"], "ord", 42, 200).select("ord", "turn")


@query("""select source, chunk, count(*) n, min(doc_id) first_id, max(doc_id) last_id from (select source, doc_id, (row_number() over (partition by source order by doc_id) - 1) // 25 chunk from documents) group by 1, 2""")
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 25 documents of each source in order."""
    df = R.chunked(read(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], "doc_id", 25)
    return df.groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query("""select source, doc_id, n_chars, cast(total as bigint) total from (select source, doc_id, n_chars, row_number() over (partition by source order by n_chars desc nulls last, doc_id) rn, count(*) over (partition by source) total from documents) where rn <= 10""")
def partition_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten longest documents of each source, with the full count of the source."""
    df = read(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    n = df.groupBy("source").agg(F.count(F.lit(1)).alias("total"))
    return R.top_per_group(df, ["source"], [F.desc_nulls_last("n_chars"), F.col("doc_id")], 10).join(n, "source")


@query(r"""with recursive s as (select ord, id, regexp_replace(claim, '[\s\p{Z}]+', '', 'g') c, row_number() over (order by ord) rn from gold where claim is not null),
w as (select cast(0 as bigint) rn, cast([] as varchar[]) ka, cast([] as varchar[]) kb, cast(null as bigint) ord, cast(null as varchar) id
union all select s.rn, case when list_contains(w.ka, s.id) or list_contains(w.kb, s.c) then w.ka else list_append(w.ka, s.id) end, case when list_contains(w.ka, s.id) or list_contains(w.kb, s.c) then w.kb else list_append(w.kb, s.c) end,
case when not (list_contains(w.ka, s.id) or list_contains(w.kb, s.c)) then s.ord end, s.id from w join s on s.rn = w.rn + 1) select ord, id from w where ord is not null""")
def or_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold rows kept by a sequential dedup on id or claim: a row goes if either was kept before."""
    df = read(spark, sf_dir, "gold").where("claim is not null").select("ord", "id", X.squeeze(F.col("claim")).alias("claim"))
    return R.or_dedup(df, "id", "claim", "ord").select("ord", "id")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.array_distinct(F.transform("reasoning_graph.nodes", lambda z: F.concat_ws("|", z["type"], z["label"])))
    return read(spark, sf_dir, "gold").select("ord", "hop_count", tokens.alias("tokens"))


_COMP = """with recursive t as (select ord, unnest(list_transform(reasoning_graph.nodes, lambda z: z.type || '|' || z.label)) t from gold), e as (select distinct a.ord x, b.ord y from t a join t b using (t)),
c(x, r) as (select ord, ord from gold union select e.y, c.r from c join e on c.x = e.x), k as (select x ord, min(r) comp from c group by 1)
"""


@query(_COMP + "select n size, count(*) components from (select comp, count(*) n from k group by 1) group by 1")
def component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the components of gold records that share an entity."""
    of = S.record_components(_records(spark, sf_dir), "ord", "tokens")
    return of.groupBy("component").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("components"))


@query()
def disjoint_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold split so that no entity is on both sides, with a test quota for each hop count."""
    out, _ = S.disjoint_split(_records(spark, sf_dir), "ord", "tokens", "hop_count", {2: 20, 3: 20, 4: 10, 5: 10})
    return out.select("ord", "split")


@query("""with q as (select unnest([2, 3, 4, 5]) hop_count, unnest([20, 20, 10, 10]) quota) select q.hop_count, q.quota, count(g.ord) records, least(q.quota, count(g.ord)) test, cast(0 as bigint) leaked from q left join gold g on g.hop_count = q.hop_count group by 1, 2""")
def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By hop count: the quota, all records, the test records (as many as the quota where the components allow it) and the entities of the hop's test records that also stand in train (none)."""
    quota = {2: 20, 3: 20, 4: 10, 5: 10}
    r = _records(spark, sf_dir)
    out, _ = S.disjoint_split(r, "ord", "tokens", "hop_count", quota)
    each = r.join(out, "ord").select("hop_count", "split", "tokens")
    leaked = S.leakage(r, out, "ord", "tokens")
    bad = each.where("split = 'test'").select("hop_count", F.explode("tokens").alias("token")).join(leaked, "token").groupBy("hop_count").agg(F.count_distinct("token").alias("leaked"))
    n = each.groupBy("hop_count").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("split") == "test").alias("test"))
    want = spark.createDataFrame(list(quota.items()), "hop_count int, quota int")
    return want.join(n, "hop_count", "left").join(bad, "hop_count", "left").fillna(0, ["records", "test", "leaked"])


@query(r"""select ord, id, split, source, claim, '' annotator_label, '' annotator_notes, list_aggregate(list_transform(reasoning_graph.nodes, lambda z: z.label), 'string_agg', '; ') entities, hop_count, label from gold where claim is not null""")
def review_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a review sheet, with blank columns for annotators."""
    blank = F.lit("")
    df = read(spark, sf_dir, "gold").where("claim is not null")
    return df.select("ord", "id", "split", "source", "claim", blank.alias("annotator_label"), blank.alias("annotator_notes"), F.array_join(F.transform("reasoning_graph.nodes", lambda z: z["label"]), "; ").alias("entities"), "hop_count", "label")
