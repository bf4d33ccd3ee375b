"""Mining, rewriting and page extraction over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridelta.operators import articles as A
from veridelta.operators import claims as C
from veridelta.operators import edits as E
from veridelta.plans.registry import query
from veridelta.session import read
from veridelta.sources import pages



@query()
def claim_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perturbed variants of every gold claim: numbers, years, words and names, singly, in pairs and in threes."""
    df = read(spark, sf_dir, "gold").where("claim is not null").select("ord", "claim", F.transform("reasoning_graph.nodes", lambda z: z["label"]).alias("pool"))
    return C.span_edits(df, "ord", "claim", F.col("pool"))


@query()
def chinese_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edited variants of the claims of the short articles by eleven strategies for Chinese text, by strategy."""
    e = E.chinese_edits(read(spark, sf_dir, "raw_demo").select("ord", "claim"), "ord", "claim")
    return e.groupBy("strategy", "edits").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ord").alias("claims"))


@query()
def relation_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations found by rule in the sentences of the articles, with counts. The rules are English phrases, so the text itself
    says whether it is English; labels are missing, misspelt or wrong too often."""
    s = read(spark, sf_dir, "raw").where("text is not null").select("ord", F.explode(C.sentences(F.col("text"))).alias("s"))
    got = s.select("ord", C.relation(F.col("s")).alias("r")).where("r is not null")
    return got.groupBy("r.relation").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ord").alias("articles"), F.count_distinct("r.object").alias("objects"))


@query()
def relation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations that claims of articles state, with their objects found among the entities of all articles, by relation."""
    df = read(spark, sf_dir, "raw_demo").where("pre_extracted is not null")
    z = df.select(F.explode("pre_extracted.entities").alias("z")).select("z.label").distinct()
    names = C.distinctive_names(z, key="label", label="label")
    facts = df.select("ord", F.explode(C.sentences(F.col("text"))).alias("text"), F.get("pre_extracted.entities", 0)["label"].alias("head")).withColumn("id", F.sha2(F.concat_ws(":", "ord", "text"), 256)).dropDuplicates(["id"])
    e = C.relation_edges(facts.withColumn("date", F.lit(None).cast("string")).withColumn("precision", F.lit(None).cast("string")), names)
    return e.groupBy("relation", "tail_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("tail_label").alias("tails"), F.count("date").alias("dated"), F.count_if("ambiguous").alias("ambiguous"))


@query(r"""select coalesce(case when text is null or trim(text) = '' then 'no_text' when not regexp_matches(concat_ws(' ', title, text), '(?i)\b(?:false|fake|debunk|mislead|no evidence|not true)|谣言|不实|虚假|辟谣|误导') then 'no_refutation' else 'refuting' end, 'none') reason, count(*) n from raw group by 1""")
def refuting_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles by whether they refute something at all."""
    t, x = F.col("title"), F.col("text")
    reason = F.when(x.isNull() | (F.trim(x) == ""), "no_text").when(~F.concat_ws(" ", t, x).rlike(C.REFUTES), "no_refutation").otherwise("refuting")
    return read(spark, sf_dir, "raw").select(reason.alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query()
def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity labels that stand in the short articles as token runs, longest first, by label."""
    df = read(spark, sf_dir, "raw_demo")
    names = df.select(F.explode("pre_extracted.entities").alias("z")).select(F.col("z.label").alias("name"))
    m = C.mentions(df.where("text is not null").select("ord", "text"), names, "ord", "text")
    return m.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ord").alias("articles"))


_TEXT = r"array_to_string(list_filter(list_transform(string_split_regex(text, '\r\n|[\n\x0b\x0c\r\x{85}\x{2028}\x{2029}]'), lambda l: regexp_replace(regexp_replace(l, '[\s\p{Z}\x1c-\x1f\x{85}]+', ' ', 'g'), '^ | $', '', 'g')), lambda l: l <> ''), chr(10))"


@query(f"""select ord, title, {_TEXT} as "text", 'html.article_container' as "method" from raw_with_extraction where text is not null and title is not null""")
def page_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles written as HTML pages with menus and scripts around them, and extracted again: title and text come back."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    body = F.concat(F.lit("<p>"), F.array_join(F.transform(F.split(F.col("text"), r"\R"), esc), "</p><p>"), F.lit("</p>"))
    html = F.concat(F.lit("<html><head><title>x</title><script>var a = '<p>no</p>';</script></head><body><nav><a href='/'>Home</a></nav><h1>"), esc(F.col("title")), F.lit("</h1><article>"), body, F.lit("</article><footer>end</footer></body></html>"))
    df = read(spark, sf_dir, "raw_with_extraction").where("text is not null and title is not null").select("ord", "url", html.alias("html"))
    return pages.extract_pages(df, "ord").select("ord", "title", "text", "method")


@query("""with r as (select ord, claim, source_verdict from raw_demo), l as (select ord, arg_max(c, k) c from (select ord, claim c, 1 k from raw_demo where ord % 2 = 0 union all select ord, 'changed: ' || claim, 2 from raw_demo where source_verdict is not null) where c is not null group by 1)
select r.ord, coalesce(l.c, r.claim) claim from r left join l on r.ord = l.ord""")
def applied_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims with the last recorded answer put in."""
    r = read(spark, sf_dir, "raw_demo").select("ord", "claim", "source_verdict")
    first = r.where("ord % 2 = 0").select("ord", "claim", F.lit(1).alias("k"))
    second = r.where("source_verdict is not null").select("ord", F.concat(F.lit("changed: "), "claim").alias("claim"), F.lit(2).alias("k"))
    return C.apply_responses(r, first.unionByName(second).where("claim is not null"), ["ord"], "k", "claim").select("ord", "claim")


_STRIP = "regexp_replace({c}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
_Q = "[“『「]([^”』」]{6,400})[”』」]"
_CUE = "(?:称|声称|发布|流传|传言|网传|写道|显示|提到|表示|配文|发帖|帖文|消息|援引|爆料|反映|说|询问|疑问|关于|出现|传出|曝出|曝|涉及|题为|名为|消息称)\\s*[:：，,]?\\s*$"
_REFUTES = "辟谣|不实|谣言|虚假|假的|误读|不属实|纯属虚构|澄清|求证|真相|误区|捏造|不准确|并无|未发生|系伪"


@query(f"""with a as (select 'raw' tab, ord, title, text from raw union all select 'raw_demo', ord, title, '网传：“' || claim || '”。' || coalesce(text, '') || ' 该说法不实。' from raw_demo), b as (select tab, ord, coalesce(title, '') head, {_STRIP.format(c='text')} body from a),
h as (select *, list_filter(list_zip(regexp_extract_all(body, '([^“『「”』」]{{0,18}}){_Q}', 1), regexp_extract_all(body, '([^“『「”』」]{{0,18}}){_Q}', 2)), lambda z: length({_STRIP.format(c='z[2]')}) >= 8 and regexp_matches(z[1], '{_CUE}')) hits from b),
q as (select *, list_transform(hits, lambda z: {_STRIP.format(c='z[2]')}) qs, {_STRIP.format(c=f"regexp_extract(head, '{_Q}', 1)")} first from h),
o as (select *, list_filter(qs, lambda x: len(list_filter(qs, lambda y: y <> x and contains(y, x))) = 0) outer_ from q),
r as (select *, list_transform(list_sort(list_transform(list_zip(outer_, generate_series(1, len(outer_))), lambda z: {{'n': -length(z[1]), 'i': z[2], 'q': z[1]}})), lambda z: z.q)[1:3] best from o),
c as (select *, case when first <> '' and not list_contains(best, first) then list_concat([first], best) else best end cs, case when strpos({_STRIP.format(c='head')}, '｜') > 0 then case when strpos({_STRIP.format(c='head')}, '｜') <= 25 then {_STRIP.format(c="substr(" + _STRIP.format(c='head') + ", strpos(" + _STRIP.format(c='head') + ", '｜') + 1)")} else {_STRIP.format(c='head')} end
 when strpos({_STRIP.format(c='head')}, '|') > 0 and strpos({_STRIP.format(c='head')}, '|') <= 25 then {_STRIP.format(c="substr(" + _STRIP.format(c='head') + ", strpos(" + _STRIP.format(c='head') + ", '|') + 1)")} else {_STRIP.format(c='head')} end question from r),
d as (select *, case when len(cs) > 0 then cs when regexp_matches(question, '[？?]$') and length(question) between 8 and 90 then [question] else [] end claims from c)
select tab, ord, case when coalesce(body, '') = '' then [] when not regexp_matches(head || ' ' || body, '{_REFUTES}') then [] else claims end claims,
case when coalesce(body, '') = '' then 'no_text' when not regexp_matches(head || ' ' || body, '{_REFUTES}') then 'no_refutation_cue' when len(claims) = 0 then 'no_claim_pattern' end reason from d""")
def mined_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rumours that articles quote and refute, or why there are none; the short articles are put as refutations of their claims."""
    told = F.concat(F.lit("网传：“"), F.col("claim"), F.lit("”。"), F.coalesce("text", F.lit("")), F.lit(" 该说法不实。"))
    part = lambda t, text: read(spark, sf_dir, t).select(F.lit(t).alias("tab"), "ord", "title", text.alias("text"))
    m = part("raw", F.col("text")).unionByName(part("raw_demo", told)).select("tab", "ord", A.mine(F.col("title"), F.col("text")).alias("m"))
    return m.select("tab", "ord", F.transform("m.claims", lambda c: c["claim"]).alias("claims"), "m.reason")
