"""Queries over crawled articles and documents: acceptance, dates, verdicts, URLs, dedup, mentions, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridelta.functions import dates as D
from veridelta.functions import text as X
from veridelta.operators import rank as R
from veridelta.plans.registry import query
from veridelta.session import read

_WS = r"[\s\p{Z}\x{85}]"  # what (?U)\s is in Java, for RE2


@query(
    """with r as (select *, row_number() over (partition by id order by ord) rn from raw)
select case when title is null or trim(title) = '' then 'no_title' when text is null or length(text) < 80 then 'short_text' when published_at is null then 'no_date'
when try_cast(published_at as date) is null then 'bad_date' when try_cast(published_at as date) not between date '2022-11-01' and date '2025-12-31' then 'out_of_range' when rn > 1 then 'seen' else 'ok' end reason, count(*) n from r group by 1"""
)
def accept_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles by the first reason to reject them."""
    w = Window.partitionBy("id").orderBy("ord")
    df = read(spark, sf_dir, "raw").select("id", "ord", "title", F.length("text").alias("n_chars"), "published_at").withColumn("rn", F.row_number().over(w))
    day = D.iso_day(F.col("published_at"))
    return R.reason_counts(
        df,
        [
            ("no_title", F.col("title").isNull() | (F.trim("title") == "")), ("short_text", F.col("n_chars").isNull() | (F.col("n_chars") < 80)), ("no_date", F.col("published_at").isNull()),
            ("bad_date", day.isNull()), ("out_of_range", ~day.between(F.lit("2022-11-01").cast("date"), F.lit("2025-12-31").cast("date"))), ("seen", F.col("rn") > 1),
        ],
    )


@query(
    """select ord, id, url, retrieved_at from (select *, row_number() over (partition by id order by ord) rn from raw) where rn = 1"""
)
def first_crawls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first crawl of each article."""
    return R.first_by(read(spark, sf_dir, "raw").select("ord", "id", "url", "retrieved_at"), ["id"], ["ord"])


@query("""select ord, retrieved_at from (select ord, retrieved_at, max(retrieved_at) over (order by ord rows between 20 preceding and 1 preceding) m from raw) where retrieved_at < m and date_diff('day', cast(retrieved_at as timestamp), cast(m as timestamp)) >= 2""")
def late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows retrieved two days or more before a near predecessor. Predecessors are taken within blocks of the order, each
    block with the end of the one before it, so no task sees the whole table."""
    block = 10_000
    df = read(spark, sf_dir, "raw").select("ord", "retrieved_at")
    own = df.withColumn("b", F.floor(F.col("ord") / block)).withColumn("mine", F.lit(True))
    tail = df.where(F.col("ord") % block >= block - 40).withColumn("b", F.floor(F.col("ord") / block) + 1).withColumn("mine", F.lit(False))
    w = Window.partitionBy("b").orderBy("ord").rowsBetween(-20, -1)
    m = own.unionByName(tail).withColumn("m", F.max("retrieved_at").over(w)).where("mine and retrieved_at < m")
    seconds = F.unix_timestamp(F.to_timestamp("m")) - F.unix_timestamp(F.to_timestamp("retrieved_at"))
    days = F.datediff(F.to_date(F.substring("m", 1, 10)), F.to_date(F.substring("retrieved_at", 1, 10)))
    return m.where((days >= 2) & (seconds > 0)).select("ord", "retrieved_at")


_VERDICTS = """(values ('true', 'true'), ('correct', 'true'), ('real', 'true'), ('mostly true', 'true'), ('真实', 'true'), ('真', 'true'), ('属实', 'true'),
('false', 'false'), ('fake', 'false'), ('incorrect', 'false'), ('mostly false', 'false'), ('谣言', 'false'), ('假', 'false'), ('不实', 'false'), ('虚假', 'false'),
('mixed', 'mixed'), ('mixture', 'mixed'), ('misleading', 'mixed'), ('partly true', 'mixed'), ('部分属实', 'mixed'), ('误导', 'mixed')) v(word, verdict)"""


@query(rf"select source_verdict, v.verdict verdict, count(*) n from raw left join {_VERDICTS} on regexp_replace(lower(trim(source_verdict)), '[\s_-]+', ' ', 'g') = v.word group by 1, 2")
def verdict_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict words and what they mean."""
    df = read(spark, sf_dir, "raw").select("source_verdict", X.verdict(F.col("source_verdict")).alias("verdict"))
    return df.groupBy("source_verdict", "verdict").agg(F.count(F.lit(1)).alias("n"))


_WORDS = "True|correct|REAL|mostly_true|Mostly-True|真实|真|属实|false|Fake|incorrect|mostly  false|谣言|假|不实|虚假|mixed|mixture|misleading|partly true|部分属实|误导|accurate|half true|pants on fire|supports|supported|支持|refuted|Refutes|反驳|1|yes|no|0|"


@query(rf"""with w as (select unnest(string_split('{_WORDS}', '|')) word) select w.word word, v.verdict verdict,
case when lower(trim(w.word)) in ('true', 'supported', 'supports', 'real', '真实', '真', '支持') then true when lower(trim(w.word)) in ('false', 'refuted', 'refutes', 'fake', '虚假', '假', '反驳') then false end "label"
from w left join {_VERDICTS} on regexp_replace(lower(trim(w.word)), '[\s_-]+', ' ', 'g') = v.word""")
def verdict_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every verdict word, and some that are none, means as a verdict and as a binary label."""
    words = spark.range(1).select(F.explode(F.split(F.lit(_WORDS), "[|]")).alias("word"))
    return words.select("word", X.verdict(F.col("word")).alias("verdict"), X.binary_label(F.col("word")).alias("label"))


@query(r"""with t as (select ord, trim(title) t, claim, source from raw where title is not null), u as (select ord, case ord % 4 when 0 then source || '｜' || t when 1 then source || ' | ' || t when 2 then t || '｜' || source when 3 then t || ': ' || source end t from t)
select ord, case when strpos(t, '｜') > 0 then case when strpos(t, '｜') - 1 <= 24 then trim(substr(t, strpos(t, '｜') + 1)) else t end when strpos(t, '|') > 0 and strpos(t, '|') - 1 <= 24 then trim(substr(t, strpos(t, '|') + 1)) else t end title from u""")
def clean_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles with the source set before or after them, without what counts as a banner."""
    df = read(spark, sf_dir, "raw").where("title is not null").select("ord", X.strip(F.col("title")).alias("t"), "source")
    bar = F.when(F.col("ord") % 4 == 0, F.concat("source", F.lit("｜"), "t")).when(F.col("ord") % 4 == 1, F.concat("source", F.lit(" | "), "t")).when(F.col("ord") % 4 == 2, F.concat("t", F.lit("｜"), "source")).otherwise(F.concat("t", F.lit(": "), "source"))
    return df.select("ord", X.clean_title(bar).alias("title"))


@query("select source, coalesce(metadata.extraction_method, 'none') \"method\", metadata.date_status date_status, count(*) n, sum(metadata.invalid_jsonld_blocks) bad_blocks from raw_with_extraction group by 1, 2, 3".replace("sum(", "cast(sum(").replace("blocks) bad", "blocks) as bigint) bad"))
def extraction_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "raw_with_extraction")
    m = df.select("source", F.coalesce("metadata.extraction_method", F.lit("none")).alias("method"), F.col("metadata.date_status").alias("date_status"), F.col("metadata.invalid_jsonld_blocks").alias("b"))
    return m.groupBy("source", "method", "date_status").agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("bad_blocks"))


@query("""select ord, u.claim review_claim, u.rating rating, u.published from (select ord, unnest(list_transform(metadata.claim_reviews, lambda r: {claim: r.claimReviewed, rating: r.reviewRating.alternateName, published: r.datePublished})) u from raw where metadata.claim_reviews is not null)""")
def claim_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review objects of each article, one a row."""
    df = read(spark, sf_dir, "raw").select("ord", F.explode("metadata.claim_reviews").alias("r"))
    return df.select("ord", F.col("r.claimReviewed").alias("review_claim"), F.col("r.reviewRating.alternateName").alias("rating"), F.col("r.datePublished").alias("published"))


@query("""select ord, regexp_replace(url, '#.*$', '') plain_url, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) host, case when lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) = s.domain then true else false end own_host
from raw left join sources s on raw.source = s.source""")
def article_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs without fragment, their host, and whether it is the source's."""
    s = read(spark, sf_dir, "sources").select("source", "domain")
    df = read(spark, sf_dir, "raw").select("ord", "url", "source").join(s, "source", "left")
    host = X.url_host(F.col("url"))
    return df.select("ord", X.without_fragment(F.col("url")).alias("plain_url"), host.alias("host"), F.coalesce(host == F.col("domain"), F.lit(False)).alias("own_host"))


@query("""select ord, case when regexp_matches(url, '^https?://[^/?#@\\s]+') then lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), case when url like 'http://%' then ':80$' else ':443$' end, '')
 || case when regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) = '' then '/' else regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) end || regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1) end scoring_url from raw_demo""")
def scoring_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "raw_demo").select("ord", X.scoring_url(F.col("url")).alias("scoring_url"))


@query("""select source, cast(extract(year from try_cast(published_at as date)) as integer) "year", count(*) n, count(claim) with_claim, count(source_verdict) with_verdict, grouping(source) gs, grouping(cast(extract(year from try_cast(published_at as date)) as integer)) gy
from raw group by grouping sets ((), (source), (cast(extract(year from try_cast(published_at as date)) as integer)))""")
def article_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters over all, by source and by year in one pass."""
    df = read(spark, sf_dir, "raw").select("source", F.year(D.iso_day(F.col("published_at"))).alias("year"), "claim", "source_verdict")
    return df.groupingSets([[], ["source"], ["year"]], "source", "year").agg(
        F.count(F.lit(1)).alias("n"), F.count("claim").alias("with_claim"), F.count("source_verdict").alias("with_verdict"), F.grouping("source").cast("long").alias("gs"), F.grouping("year").cast("long").alias("gy")
    )


@query(r"""select doc_id from (select doc_id, row_number() over (partition by regexp_replace(text, '[\s\p{Z}]+', '', 'g') order by doc_id) rn, text from documents) where rn = 1 and text is not null and regexp_replace(text, '[\s\p{Z}]+', '', 'g') <> ''""")
def dedup_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First document of each text without white space; hashes are shuffled, not texts."""
    df = read(spark, sf_dir, "documents").select("doc_id", X.squeeze(F.col("text")).alias("t")).where("t <> ''").select("doc_id", F.sha2("t", 256).alias("h"))
    return df.groupBy("h").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query(r"""select doc_id from (select doc_id, row_number() over (partition by source, coalesce(regexp_replace(text, '[\s\p{Z}]+', '', 'g'), '') order by case kind when 'fact_check' then 0 else 1 end, doc_id) rn from documents) where rn = 1""")
def dedup_two_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First document of each source and text, fact checks before other kinds."""
    prio = F.when(F.col("kind") == "fact_check", 0).otherwise(1)
    df = read(spark, sf_dir, "documents").select("doc_id", "source", prio.alias("p"), F.sha2(F.coalesce(X.squeeze(F.col("text")), F.lit("")), 256).alias("h"))
    return df.groupBy("source", "h").agg(F.min_by("doc_id", F.struct("p", "doc_id")).alias("doc_id")).select("doc_id")


@query("select lang, p, case p when 10 then v[cast(round_even((n - 1) * 10 / 100e0, 0) as bigint) + 1] when 50 then v[cast(round_even((n - 1) * 50 / 100e0, 0) as bigint) + 1] else v[cast(round_even((n - 1) * 90 / 100e0, 0) as bigint) + 1] end as \"value\" from (select lang, count(*) n, list(n_chars order by n_chars) v from documents where n_chars is not null group by 1), (select unnest([10, 50, 90]) p)")
def length_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles with half to even, by language."""
    return R.percentiles(read(spark, sf_dir, "documents").select("lang", "n_chars"), ["lang"], "n_chars", [10, 50, 90])


@query("select source, p, v[cast(least(n - 1, n * p // 100) as bigint) + 1] as \"value\" from (select source, count(*) n, list(n_chars order by n_chars) v from documents where n_chars is not null group by 1), (select unnest([5, 25, 75, 95]) p)")
def length_percentiles_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.percentiles(read(spark, sf_dir, "documents").select("source", "n_chars"), ["source"], "n_chars", [5, 25, 75, 95], "floor")


@query("""select kind, lang, count(*) n, count(text) with_text, count(title) with_title, sum(n_chars) chars from documents group by grouping sets ((), (kind), (lang), (kind, lang))""".replace("sum(n_chars) chars", "cast(sum(n_chars) as bigint) chars"))
def document_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "documents")
    return df.cube("kind", "lang").agg(F.count(F.lit(1)).alias("n"), F.count("text").alias("with_text"), F.count("title").alias("with_title"), F.sum("n_chars").alias("chars"))


@query(r"""with g as (select doc_id, regexp_extract_all(text, '[\p{L}\p{N}_''’-]+') t from documents where text is not null),
s as (select doc_id, u.i i, list_slice(t, u.i, u.i + n.n - 1) w, n.n n, len(t) m from g, unnest(generate_series(1, len(t))) u(i), (select unnest([1, 2, 3]) n) n)
select array_to_string(w, ' ') phrase, count(distinct doc_id) docs from s where len(w) = n and len(list_filter(w, lambda x: not regexp_matches(x, '^\p{Lu}'))) = 0 group by 1 having count(distinct doc_id) >= 5""")
def capital_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised phrases of up to three words that five or more documents hold."""
    df = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.explode(F.array_distinct(X.capital_ngrams(F.col("text"), 3))).alias("phrase"))
    return df.groupBy("phrase").agg(F.count(F.lit(1)).alias("docs")).where("docs >= 5")


@query(r"""select ord, round(len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]')) / cast(greatest(length(text), 1) as double), 6) ratio from raw where text is not null""")
def han_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "raw").where("text is not null").select("ord", F.round(X.han_ratio(F.col("text")), 6).alias("ratio"))


@query(r"""select ord, array_to_string(list_filter(list_transform(string_split_regex(text, '\r\n|[\n\x0b\f\r\x{85}\x{2028}\x{2029}]'), lambda l: regexp_replace(regexp_replace(l, '[\s\p{Z}]+', ' ', 'g'), '^ | $', '', 'g')), lambda l: l <> ''), chr(10)) clean from raw where text is not null""")
def clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with single spaces and without empty lines."""
    return read(spark, sf_dir, "raw").where("text is not null").select("ord", X.clean_lines(F.col("text")).alias("clean"))


@query("""select r.ord from raw r where claim is not null and not exists (select 1 from raw q where q.url = r.url and q.source_verdict is not null)""")
def unlabelled_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with a claim whose URL no labelled row has."""
    r = read(spark, sf_dir, "raw").select("ord", "url", "claim", "source_verdict")
    return r.where("claim is not null").join(r.where("source_verdict is not null").select("url"), "url", "left_anti").select("ord")


@query("""select source, domain, language, n, rank() over (partition by language order by n desc, source) as place from (select s.source, s.domain, s.language, count(r.ord) n from sources s left join raw r on r.source = s.source group by 1, 2, 3)""")
def source_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by articles within their language; sources without one count 0."""
    n = read(spark, sf_dir, "raw").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    s = read(spark, sf_dir, "sources").join(n, "source", "left").fillna(0, ["n"])
    return s.select("source", "domain", "language", "n", F.rank().over(Window.partitionBy("language").orderBy(F.desc("n"), "source")).cast("long").alias("place"))


@query("""select published_at from raw where published_at is not null intersect select published_at from documents where published_at is not null""")
def shared_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which both tables published."""
    a, b = (read(spark, sf_dir, t).where("published_at is not null").select("published_at") for t in ("raw", "documents"))
    return a.intersect(b)


@query("""select source from sources except select source from documents""")
def silent_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "sources").select("source").exceptAll(read(spark, sf_dir, "documents").select("source").distinct())


@query(r"""select ord, 'raw_' || substr(sha256(source || ':' || url), 1, 20) article_id, 'claim_' || substr(sha256('["' || replace(source, '"', '\"') || '","' || replace(url, '"', '\"') || '"]'), 1, 20) compact_id, 'c_' || substr(sha256('["' || source || '", "' || url || '"]'), 1, 20) spaced_id from raw""")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash ids by the three recipes in use."""
    s, u = F.col("source"), F.col("url")
    plain = F.concat(F.lit("raw_"), F.substring(F.sha2(F.concat(s, F.lit(":"), u), 256), 1, 20))
    return read(spark, sf_dir, "raw").select("ord", plain.alias("article_id"), X.stable_id("claim_", s, u, compact=True).alias("compact_id"), X.stable_id("c_", s, u).alias("spaced_id"))


_SP = r"[\s\p{Z}]*"
_HAN = f"20[0-9]{{2}}{_SP}年{_SP}[0-9]{{1,2}}{_SP}月(?:{_SP}[0-9]{{1,2}}{_SP}[日号])?"


@query(f"""with a as (select ord, list_distinct(regexp_extract_all(text, '{_HAN}')) han, regexp_replace(text, '{_HAN}', ' ', 'g') left_ from raw where text is not null),
b as (select *, list_filter(list_distinct(regexp_extract_all(left_, '20[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}')), lambda x: try_cast(x as date) is not null) iso, regexp_replace(left_, '20[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}', ' ', 'g') rest from a)
select ord, len(list_filter(han, lambda x: regexp_matches(x, '[日号]$'))) han_days, len(list_filter(han, lambda x: not regexp_matches(x, '[日号]$'))) han_months, len(iso) iso_days, len(list_distinct(regexp_extract_all(rest, '[0-9]{{1,2}}{_SP}月{_SP}[0-9]{{1,2}}{_SP}[日号]'))) month_days, list_min(iso) first_iso from b""")
def date_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct dates of all articles by kind, each looked for in what the kinds before it left over."""
    df = read(spark, sf_dir, "raw").where("text is not null").select("ord", D.date_mentions(F.col("text")).alias("d"))
    n = lambda test: F.size(F.filter("d", test)).cast("long")
    iso = lambda x: x["raw"].eqNullSafe(x["iso"])
    return df.select(
        "ord", n(lambda x: (x["precision"] == "day") & ~iso(x)).alias("han_days"), n(lambda x: x["precision"] == "month").alias("han_months"), n(iso).alias("iso_days"), n(lambda x: x["precision"] == "month_day").alias("month_days"),
        F.array_min(F.transform(F.filter("d", iso), lambda x: x["iso"])).alias("first_iso"),
    )
