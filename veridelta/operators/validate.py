"""Validators: each gives the first reason to refuse a draft, a batch or an audit, as a column; null when it is fine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridelta.functions.dates import iso_day, month_gap, precision
from veridelta.functions.nums import non_blank_distinct, same_set
from veridelta.functions.text import squeeze, strip

AUDIT_FLAGS = ("accepted", "entity_accuracy", "temporal_grounding", "verdict_consistent", "evidence_support")


def audit_reason(audit: Column, threshold: float = 0.9) -> Column:
    """Why an audit doesn't pass: missing, the first flag that isn't true, or confidence out of [threshold, 1]."""
    out = F.when(audit.isNull(), "missing")
    for flag in AUDIT_FLAGS:
        out = out.when(~F.coalesce(audit[flag], F.lit(False)), flag)
    return out.when(~F.coalesce(audit["confidence"].between(threshold, 1.0), F.lit(False)), "confidence")


def positive_reason(claim: Column, used_edges: Column, used_entities: Column, edges: Column, entities: Column) -> Column:
    """A draft must use every edge and every entity of its path, once each, and be a text."""
    return (
        F.when(claim.isNull() | (strip(claim) == ""), "no_claim").when(~non_blank_distinct(used_edges), "edge_list").when(~same_set(used_edges, edges), "edges")
        .when(~non_blank_distinct(used_entities), "entity_list").when(~same_set(used_entities, entities), "entities")
    )


def negative_reason(claim: Column, parent: Column, field: Column, allowed: Column, before: Column, original: Column, after: Column, kind_before: Column, kind_after: Column, quote: Column) -> Column:
    """A perturbation must change an allowed field from what it was to another value of the same kind, in an exact quote of a claim
    that isn't its parent."""
    return (
        F.when(claim.isNull() | (strip(claim) == ""), "no_claim").when(~F.coalesce(F.array_contains(allowed, field), F.lit(False)), "field").when(~before.eqNullSafe(original), "before")
        .when(after.isNull() | (squeeze(after) == squeeze(before)), "after").when(~kind_after.eqNullSafe(kind_before), "kind").when(~F.coalesce(F.contains(claim, quote), F.lit(False)), "quote")
        .when(squeeze(claim) == squeeze(parent), "unchanged")
    )


def batch_results(items: DataFrame, results: DataFrame, keys: list[str], index: str, fields: list[str], least: int = 1) -> DataFrame:
    """Items with the last result of their index and a reason: missing, or the first field that is shorter than ``least``."""
    last = results.groupBy(*keys, index).agg(*(F.max_by(f, "result_ord").alias(f) for f in fields), F.lit(True).alias("_hit"))
    out = items.join(last, [*keys, index], "left")
    reason = F.when(F.col("_hit").isNull(), "missing")
    for f in fields:
        reason = reason.when(F.length(strip(F.coalesce(f, F.lit("")))) < least, f)
    return out.withColumn("reason", reason).drop("_hit")


def response_facts(articles: DataFrame, key: str, text: str, facts: str, least: int = 6, most: int = 300) -> DataFrame:
    """(key, fact, date, date_precision, evidence_in_text) of facts ARRAY<STRUCT<fact, date, evidence>>: facts of fit length, each text
    once an article, dates that don't exist dropped and precision taken from the date's form."""
    e = articles.select(key, text, F.posexplode(facts).alias("pos", "f")).where(F.length(strip(F.col("f.fact"))).between(least, most))
    w = Window.partitionBy(key, squeeze(F.col("f.fact"))).orderBy("pos")
    once = e.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    p = precision(F.col("f.date"))
    return once.select(key, strip(F.col("f.fact")).alias("fact"), F.when(p.isNotNull(), F.col("f.date")).alias("date"), p.alias("date_precision"), F.coalesce(F.contains(text, F.col("f.evidence")), F.lit(False)).alias("evidence_in_text"))


def category(types: Column, classes: list[tuple[str, list[str]]], assumed: Column | None = None) -> Column:
    """The first class one of whose types is among ``types``; else the assumed one."""
    out = F
    for name, ids in classes:
        out = out.when(F.arrays_overlap(types, F.array(*map(F.lit, ids))), F.lit(name))
    return out.otherwise(assumed if assumed is not None else F.lit(None).cast("string"))


def subtlety(before: Column, after: Column) -> Column:
    """Struct of how far a perturbed claim is from its parent: least difference of years, largest relative difference of numbers that
    aren't years, both null where there is none. Numbers are compared in order of place."""
    year = r"(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])"
    nums = lambda c, p: F.transform(F.regexp_extract_all(c, F.lit(p), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double"))
    pairs = lambda p, strip_: F.filter(F.zip_with(nums(strip_(before), p), nums(strip_(after), p), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x: x["a"].isNotNull() & x["b"].isNotNull() & (x["a"] != x["b"]))
    same = lambda c: c
    rest = lambda c: F.regexp_replace(c, year, "#")
    years = F.array_min(F.transform(pairs(year, same), lambda x: F.abs(x["a"] - x["b"])))
    share = F.array_max(F.transform(pairs(r"[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?", rest), lambda x: F.abs(x["a"] - x["b"]) / F.greatest(F.abs(x["a"]), F.lit(1.0))))
    return F.struct(years.alias("years"), share.alias("numbers"))


def statement_date(statements: DataFrame, keys: list[str], prop: str, singletons: list[str]) -> DataFrame:
    """(keys, prop, date): of properties that hold once the least date, of others the date of the only dated statement. Statements:
    keys, prop, date (partial ISO text)."""
    s = statements.where(precision(F.col("date")).isNotNull()).groupBy(*keys, prop).agg(F.min("date").alias("date"), F.count(F.lit(1)).alias("_n"))
    return s.where(F.col(prop).isin(*singletons) | (F.col("_n") == 1)).drop("_n")


def sections(articles: DataFrame, key: str, text: str, most: int = 40) -> DataFrame:
    """(key, section, heading, body): articles cut at their headings: short lines without closing punctuation or a list mark. Section 0
    is what stands before the first heading. Lines of an article stay in its row until they are grouped."""
    mark = r"^(?:[-•*›]|[0-9]+[).、])"
    heading = lambda x: (F.length(x) <= most) & ~x.rlike(r"[.。!?！？：:]$") & ~x.rlike(mark)
    lines = F.filter(F.transform(F.split(text, r"\R"), strip), lambda x: x != "")
    e = articles.where(F.col(text).isNotNull()).select(key, F.posexplode(lines).alias("pos", "line"))
    n = F.sum(heading(F.col("line")).cast("int")).over(Window.partitionBy(key).orderBy("pos"))
    g = e.withColumn("section", n).groupBy(key, "section").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("ls"))
    first = F.get("ls", 0)["line"]
    body = F.transform("ls", lambda x: x["line"])
    return g.select(key, "section", F.when(F.col("section") > 0, first).alias("heading"), F.array_join(F.when(F.col("section") > 0, F.slice(body, 2, 1_000_000)).otherwise(body), "\n").alias("body"))


def window_reason(start: Column, end: Column, reference: Column, most_months: int = 1200) -> Column:
    """Why a window can't be used: missing, invalid, reversed, too_long, after_reference."""
    s, e = iso_day(start), iso_day(end)
    return (
        F.when(start.isNull() | end.isNull(), "missing").when(s.isNull() | e.isNull(), "invalid").when(s > e, "reversed").when(month_gap(start, end) > most_months, "too_long")
        .when(reference.isNotNull() & (iso_day(reference) < s), "after_reference")
    )


YEARS, NUMBERS = r"\b(?:1[0-9]{3}|20[0-9]{2})\b", r"\b[0-9]+(?:\.[0-9]+)?\b"


def year_delta(claim: Column, evidence: Column) -> Column:
    """The least distance of a year of the claim that the evidence (an array of years) doesn't hold to one that it holds; null for none."""
    years = F.array_distinct(F.transform(F.regexp_extract_all(claim, F.lit(YEARS), F.lit(0)), lambda y: y.cast("int")))
    odd = F.filter(years, lambda y: ~F.array_contains(evidence, y))
    return F.array_min(F.transform(odd, lambda y: F.array_min(F.transform(evidence, lambda e: F.abs(y - e)))))


def number_delta(claim: Column, facts: Column) -> Column:
    """The least relative distance of a number of the claim that the facts (an array of texts) don't hold to one that they hold; null for none."""
    found = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(NUMBERS), F.lit(0)))
    held = F.array_distinct(F.flatten(F.transform(facts, lambda f: F.coalesce(found(f), F.array().cast("array<string>")))))
    odd = F.array_except(found(claim), held)
    near = lambda x: F.array_min(F.transform(held, lambda e: F.abs(x.cast("double") - e.cast("double")) / F.greatest(F.abs(e.cast("double")), F.lit(1e-9))))
    return F.array_min(F.transform(odd, near))


def entity_change(claims: DataFrame, entities: DataFrame, key: str, claim: str, nodes: str) -> DataFrame:
    """(key, same_category, views_ratio) of the claims that name an entity (name, category, views) beside their own ``nodes``: whether one of these is of a category that the nodes have, and the
    least views of such a name against the least of the nodes'. Names are the capitalised runs of a claim, looked up in the table."""
    from veridelta.functions.text import capital_ngrams

    known = entities.groupBy("name").agg(F.min_by(F.struct("category", "views"), F.struct("category", "views")).alias("e")).select("name", "e.*")
    own = claims.select(key, F.explode(F.array_distinct(nodes)).alias("name")).join(known, "name").groupBy(key).agg(F.collect_set("category").alias("of"), F.min("views").alias("least"))
    names = claims.select(key, F.col(nodes).alias("_n"), F.explode(F.array_distinct(capital_ngrams(F.col(claim)))).alias("name")).where(~F.array_contains("_n", F.col("name")))
    new = names.join(known, "name").groupBy(key).agg(F.collect_set("category").alias("new"), F.min("views").alias("views"))
    got = new.join(own, key, "left")
    same = F.arrays_overlap("new", F.coalesce("of", F.array().cast("array<string>")))
    return got.select(key, same.alias("same_category"), F.when(F.col("least") > 0, F.col("views") / F.greatest("least", F.lit(1))).alias("views_ratio"))
