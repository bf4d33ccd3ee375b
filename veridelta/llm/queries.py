"""Name -> query and name -> SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridelta.llm import boilerplate, language, lookalike, mixing, near, overlap, packing, repetition, sitelines, sizes
from veridelta.session import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-same pairs of raw_demo rows, in text and in claim."""
    return near.near_pairs(read(spark, sf_dir, "raw_demo"))


@query
def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class, group and number of links of every raw_demo value."""
    return near.near_groups(read(spark, sf_dir, "raw_demo"))


def _labelled_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = read(spark, sf_dir, "raw").select(F.lit("raw").alias("tab"), "ord", F.col("text").alias("value"), "language")
    return raw.unionByName(read(spark, sf_dir, "raw_demo").select(F.lit("raw_demo").alias("tab"), "ord", F.col("claim").alias("value"), "language"))


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of the raw texts and raw_demo claims whose label is missing or wrong or that hold several."""
    models = language.models_from(read(spark, sf_dir, "lang_samples"))
    return language.label_cases(_labelled_values(spark, sf_dir), models, ["tab", "ord"], "value", "language").select("tab", "ord", "lang")


@query
def p2_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every segment of the raw texts and raw_demo claims."""
    return language.segment_languages(_labelled_values(spark, sf_dir), language.models_from(read(spark, sf_dir, "lang_samples")), ["tab", "ord"], "value")


@query
def p2_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages of every raw text and raw_demo claim, with confidence and share."""
    return language.document_languages(_labelled_values(spark, sf_dir), language.models_from(read(spark, sf_dir, "lang_samples")), ["tab", "ord"], "value")


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the pages that are no part of the article."""
    return boilerplate.furniture_lines(read(spark, sf_dir, "raw_with_extraction")).select("ord", "line_no")


@query
def p3_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every page."""
    return boilerplate.main_content(read(spark, sf_dir, "raw_with_extraction"))


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of raw_demo values that look the same but differ as strings."""
    return lookalike.same_looking_pairs(read(spark, sf_dir, "raw_demo"))


@query
def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every raw_demo value by its look, with the number of spellings and rows of the class."""
    return lookalike.look_classes(read(spark, sf_dir, "raw_demo"))


@query
def p4_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one form of every raw_demo value."""
    values = lookalike.long_fields(read(spark, sf_dir, "raw_demo"), "ord", ("text", "claim"))
    return lookalike.canonicalize(values, "value").select("field", "ord", "canonical")


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of gold rows, one in train, with equal id or near-same claim."""
    got = overlap.overlaps(read(spark, sf_dir, "gold"))
    return got.select(F.least("eval_ord", "train_ord").alias("ord_a"), F.greatest("eval_ord", "train_ord").alias("ord_b"))


@query
def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of the evaluation splits with train, by split and source."""
    return overlap.report(read(spark, sf_dir, "gold"))


_LINES = r"""
with l as (select ord, source, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) line_no from raw),
f as (select ord, source, line_no, line, lower(regexp_replace(line, '[\s\p{Z}\p{Nd}]+', '', 'g')) form from l),
c as (select source, form, count(distinct ord) n from f where form <> '' group by 1, 2),
r as (select source, count(*) n from raw group by 1),
rep as (select c.source, c.form from c join r on c.source is not distinct from r.source where c.n >= 5 and c.n >= 0.15 * r.n)
"""


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of raw texts that are repeated across their source."""
    return sitelines.found_lines(read(spark, sf_dir, "raw"))


SQL["p6_found"] = _LINES + "select f.ord, cast(f.line_no as integer) line_no from f join rep on f.form = rep.form and f.source is not distinct from rep.source"


@query
def p6_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw texts without the lines repeated across their source."""
    return sitelines.remove_lines(read(spark, sf_dir, "raw")).select("ord", "text")


SQL["p6_cleaned"] = (
    _LINES
    + """, k as (select f.ord, string_agg(f.line, chr(10) order by f.line_no) filter (where rep.form is null) text from f left join rep on f.form = rep.form and f.source is not distinct from rep.source group by 1)
select raw.ord, case when raw.text is null then null else coalesce(k.text, '') end as text from raw left join k on raw.ord = k.ord"""
)


def _packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), read(spark, sf_dir, "pack_capacity"), sizes.vocabulary_path(spark))


@query
def p7_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window of every piece of every document, for each capacity."""
    return _packs(spark, sf_dir)


@query
def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows, tokens and unused share of each capacity."""
    return packing.report(_packs(spark, sf_dir), read(spark, sf_dir, "pack_capacity"))


@query
def p7_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each capacity: documents that are packed, those whose tokens aren't packed once each or that are split though they fit, and windows over the capacity."""
    return packing.invariants(_packs(spark, sf_dir), read(spark, sf_dir, "pack_capacity"))


SQL["p7_invariants"] = "select pack_id, (select count(*) from documents where text is not null) as documents, cast(0 as bigint) as wrong_documents, cast(0 as bigint) as over_capacity from pack_capacity"


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "mix_targets"), sizes.vocabulary_path(spark))


@query
def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of every slot of every mix."""
    return _mixed(spark, sf_dir)


@query
def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of every mix."""
    return mixing.report(_mixed(spark, sf_dir), read(spark, sf_dir, "mix_targets"))


@query
def p8_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each mix: targets, targets with a document used more often than allowed, uses that are drawn twice, and documents of other sources."""
    return mixing.invariants(_mixed(spark, sf_dir), read(spark, sf_dir, "documents"), read(spark, sf_dir, "mix_targets"))


SQL["p8_invariants"] = "select mix_id, count(*) as targets, cast(0 as bigint) as over_used, cast(0 as bigint) as drawn_twice, cast(0 as bigint) as strangers from mix_targets group by 1"


@query
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which 0.4 or more of the letters repeat earlier passages, flagged by the learned list and checked."""
    return repetition.repetitive(read(spark, sf_dir, "documents")).select("doc_id")


@query
def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of repeated text and the deciding rule of every document."""
    return repetition.classify(read(spark, sf_dir, "documents"))
