"""The temporal graph of recorded extractions as one operator: which articles are accepted, and the nodes and facts that they give.

An article is accepted whole or not at all. Its verdict, its classification, its entities and every fact are looked at inside its row, with the first fault as the reason, so
that acceptance needs no join. Facts of accepted articles are merged by id: sources, verdicts by source and evidence are united. Facts of one triple and opposite
polarity whose days meet are quarantined, both of them; nodes that no fact is left of are dropped. Articles of claims that don't depend on time are given apart."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridelta.functions import dates as D
from veridelta.functions.text import let, strip, verdict
from veridelta.operators import graph as G
from veridelta.session import cut

# Relations that facts may have.
RELATIONS = (
    "is_barred_from", "endorsed", "subsequent_to", "member_of", "held_office", "won", "located_in", "headquartered_in", "hosted", "voiced", "adapted_from", "married_to",
    "relative_of", "caused_by", "parallel_to", "has_value", "has_outcome", "participated_in", "appointed_to", "elected_to", "resigned_from", "occurred_during", "founded", "released",
)
# What an audit must find true, and the least confidence.
AUDITED = ("entity_accuracy", "temporal_grounding", "verdict_consistent", "evidence_support")
LEAST_CONFIDENCE = 0.9


class Graph(NamedTuple):
    """records: ord, id, status (accepted, time_robust, rejected), reason, verdict. time_robust: ord, id, claim, verdict. nodes: node_id, label, type, domain, domains, language,
    source_ids. edges: edge_id, head, relation, tail, start, end, precision, polarity, kind, sources, verdicts, evidence. contradictions: key_a, key_b."""

    records: DataFrame
    time_robust: DataFrame
    nodes: DataFrame
    edges: DataFrame
    contradictions: DataFrame


def _blank(c: Column) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def _fields(kind: T.DataType, name: str) -> set[str]:
    """Names of the fields of an array of structs inside a struct."""
    inner = kind[name].dataType if name in kind.names else None
    return set(inner.elementType.names) if isinstance(inner, T.ArrayType) else set()


def _grounded(f: Column, text: Column, has: set[str]) -> tuple[Column, Column]:
    """(whether the quotes for the time are pieces of the text, whether both ends stand in the quotes, or the day by its distance to an anchor)."""
    day = lambda n: D.iso_day(f[n])
    quotes = F.coalesce(f["time_evidence_quotes"], F.array().cast("array<string>")) if "time_evidence_quotes" in has else F.array().cast("array<string>")
    pieces = F.forall(quotes, lambda q: F.coalesce(~_blank(q) & F.contains(text, q), F.lit(False)))
    where = F.array_join(F.concat(F.array(f["evidence_quote"]), quotes), "\n")
    good = D.grounded_as(day("start"), f["time_precision"], where) & D.grounded_as(day("end"), f["time_precision"], where)
    if "temporal_anchor" in has:
        a = f["temporal_anchor"]
        near = (f["time_precision"] == "day") & (f["start"] == f["end"]) & ~_blank(a["quote"]) & F.contains(text, a["quote"])
        good = good | (near & D.relative_grounded(day("start"), D.iso_day(a["date"]), a["offset_days"], a["quote"], f["evidence_quote"]))
    return pieces, F.coalesce(good, F.lit(False))


def fact_reason(f: Column, entities: Column, text: Column, relations: Sequence[str], ground: bool, has: set[str] = frozenset()) -> Column:
    """The first fault of a fact, null for none."""
    start, end = D.iso_day(f["start"]), D.iso_day(f["end"])
    of = lambda side: F.get(F.filter(entities, lambda e: e["id"] == f[side]), 0)
    kind = F.coalesce(f["temporal_kind"], F.lit("event"))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    pieces, grounded = _grounded(f, text, has)
    h, t = of("head"), of("tail")
    lo, hi = D.first_day(t["label"]), D.last_day(t["label"])
    timed = f["relation"] == "occurred_during"
    out = (
        F.when(h.isNull() | t.isNull(), "endpoint").when(no(f["relation"].isin(*relations)), "relation").when(no(f["polarity"].isin("positive", "negative")), "polarity")
        .when(~kind.isin("event", "state"), "kind").when(start.isNull() | end.isNull(), "date").when(start > end, "reversed").when(no(f["time_precision"].isin("day", "month", "year")), "precision")
        .when((f["time_precision"] == "year") & ~(f["start"].endswith("-01-01") & f["end"].endswith("-12-31")), "year_bounds")
        .when((f["time_precision"] == "month") & ~(f["start"].endswith("-01") & (end == F.last_day(end))), "month_bounds")
        .when(_blank(f["evidence_quote"]) | no(F.contains(text, f["evidence_quote"])), "quote").when(~pieces, "time_quote")
    )
    if ground:
        out = out.when(~grounded, "grounding")
    out = out.when(timed & ((h["type"] != "event") | (t["type"] != "time") | (kind != "event") | (f["polarity"] != "positive")), "occurrence")
    return out.when(timed & no((lo <= start) & (end <= hi)), "outside_time_node").when(~timed & ((h["type"] == "time") | (t["type"] == "time")), "time_node")


def audit_passes(audit: Column, least: float = LEAST_CONFIDENCE) -> Column:
    """Accepted, confident enough and true in all that is audited."""
    ok = audit["accepted"] & audit["confidence"].between(least, 1)
    for name in AUDITED:
        ok = ok & audit[name]
    return F.coalesce(ok, F.lit(False))


def check(articles: DataFrame, audit: str | None = None, relations: Sequence[str] = RELATIONS, ground: bool = True, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """``articles`` (ord, id, language, text, source_verdict, pre_extracted, and ``audit`` if it is named) with status, reason and verdict. Of several articles of one id the first
    that has a text is looked at, the others are rejected as duplicates."""
    e = F.col("pre_extracted")
    kind = articles.schema["pre_extracted"].dataType
    has = _fields(kind, "facts")
    nothing = _blank(F.col("id").cast("string")) | _blank(F.col("text"))
    turns = articles.select("ord", "id", nothing.alias("_nothing")).withColumn("_turn", F.row_number().over(Window.partitionBy("id", "_nothing").orderBy("ord"))).where("_turn > 1 and not _nothing").select("ord", F.lit(True).alias("_again"))
    given, drafted = verdict(F.col("source_verdict")), verdict(e["source_verdict"])
    quote = e["verdict_evidence_quote"] if "verdict_evidence_quote" in kind.names else F.lit(None).cast("string")
    quoted = F.coalesce(~_blank(quote) & F.contains("text", quote), F.lit(False))
    entities = F.coalesce(e["entities"], F.array().cast(kind["entities"].dataType))
    bad_entity = F.exists(entities, lambda x: _blank(x["id"]) | _blank(x["label"]) | _blank(x["type"]) | _blank(x["domain"]))
    bad_time = F.exists(entities, lambda x: (x["type"] == "time") & D.precision(x["label"]).isNull())
    twice = F.size(F.array_distinct(F.transform(entities, lambda x: x["id"]))) != F.size(entities)
    first = F.get(F.filter(F.transform(e["facts"], lambda f: fact_reason(f, entities, F.col("text"), relations, ground, has)), lambda r: r.isNotNull()), 0)
    passed = audit_passes(F.col(audit), least) if audit else F.lit(True)
    sensitive = F.coalesce(e["time_sensitive"], F.lit(None).cast("boolean"))
    written = ~_blank(F.col("source_verdict"))
    reason = (
        F.when(nothing, "no_text").when(F.coalesce("_again", F.lit(False)), "duplicate_source").when(written & given.isNull(), "unknown_verdict").when(e.isNull(), "no_extraction")
        .when(given.isNull() & (drafted.isNull() | ~quoted), "missing_verdict").when(given.isNotNull() & ~drafted.eqNullSafe(given), "verdict_disagrees")
        .when(~sensitive & ~passed, "audit").when(~sensitive, None).when(sensitive.isNull(), "no_classification").when(e["entities"].isNull() | (F.coalesce(F.size(e["facts"]), F.lit(0)) < 1), "no_facts")
        .when(bad_entity, "entity").when(twice, "entity_twice").when(bad_time, "time_label").when(first.isNotNull(), first).when(~passed, "audit")
    )
    out = articles.join(turns, "ord", "left").withColumn("reason", reason).withColumn("verdict", F.coalesce(given, drafted)).drop("_again")
    status = F.when(F.col("reason").isNotNull(), "rejected").when(e["time_sensitive"], "accepted").otherwise("time_robust")
    return out.withColumn("status", status)


def node_id(entity: Column, language: Column, source: Column, links: Column | None = None) -> Column:
    """The label for a time node; a Wikidata id that the article's own links (MAP<label or local id, id>) give for the entity too; else a hash of type, language, label and what tells the
    entity apart: its disambiguation, or the article that it stands in."""
    scope = F.when(_blank(entity["disambiguation"]), source).otherwise(strip(entity["disambiguation"]))
    parts = F.concat_ws("|", entity["type"], F.coalesce(language, F.lit("und")), entity["label"], scope)
    out = F.when(entity["type"] == "time", F.concat(F.lit("temporal:"), entity["label"]))
    if links is not None:
        known = entity["canonical_id"]
        linked = lambda k: F.coalesce(F.try_element_at(links, k) == known, F.lit(False))
        trusted = F.coalesce(known.rlike("^Q[1-9][0-9]*$"), F.lit(False)) & (linked(entity["label"]) | linked(entity["id"]))
        out = out.when(trusted, F.concat(F.lit("wikidata:"), known))
    return out.otherwise(F.concat(F.lit("entity:"), F.substring(F.sha2(parts, 256), 1, 20)))


def build(articles: DataFrame, audit: str | None = None, **options: object) -> Graph:
    """The graph of ``articles``; see ``check`` for their columns and the options. Entities with a ``canonical_id`` are known by it where the article's ``entity_links`` agree."""
    kind = articles.schema["pre_extracted"].dataType
    has = _fields(kind, "facts")
    checked = check(articles, audit, **options)
    records = checked.select("ord", "id", "status", "reason", "verdict")
    robust = checked.where("status = 'time_robust'").select("ord", "id", F.col("pre_extracted.claim").alias("claim"), "verdict")
    trusted = "entity_links" in articles.columns and "canonical_id" in _fields(kind, "entities")
    links = F.col("entity_links") if trusted else F.lit(None).cast("map<string,string>")
    good = cut(checked.where("status = 'accepted'").select("ord", "id", "language", "verdict", "pre_extracted.entities", "pre_extracted.facts", links.alias("links")))
    named = lambda e: node_id(e, F.col("language"), F.col("id"), F.col("links") if trusted else None)
    z = good.select("ord", "id", "language", "links", F.explode("entities").alias("z"))
    flat = z.select(named(F.col("z")).alias("node_id"), "ord", F.col("z.label").alias("label"), F.col("z.type").alias("type"), F.col("z.domain").alias("domain"), F.when(F.col("z.type") == "time", "und").otherwise(F.coalesce("language", F.lit("und"))).alias("language"), F.array("z.domain").alias("domains"), F.array("id").alias("source_ids"))
    nodes = G.merge_nodes(flat, "ord", "node_id", ["label", "type", "domain", "language"], ["domains", "source_ids"])
    facts = good.select("ord", "id", "language", "verdict", "links", "entities", F.posexplode("facts").alias("pos", "f"))
    side = lambda s: let(F.get(F.filter("entities", lambda e: e["id"] == F.col(f"f.{s}")), 0), named)
    more = F.coalesce(F.col("f.time_evidence_quotes"), F.array().cast("array<string>")) if "time_evidence_quotes" in has else F.array().cast("array<string>")
    cited = F.concat(F.array(F.struct(F.col("id").alias("source_id"), F.col("f.evidence_quote").alias("quote"), F.lit("fact").alias("kind"))), F.transform(more, lambda q: F.struct(F.col("id").alias("source_id"), q.alias("quote"), F.lit("temporal").alias("kind"))))
    e = facts.select(
        F.struct("ord", "pos").alias("at"), F.col("id").alias("source"), "verdict", side("head").alias("head"), F.col("f.relation").alias("relation"), side("tail").alias("tail"), F.col("f.start").alias("start"), F.col("f.end").alias("end"),
        F.col("f.time_precision").alias("precision"), F.col("f.polarity").alias("polarity"), F.coalesce("f.temporal_kind", F.lit("event")).alias("kind"), cited.alias("cited"),
    )
    fact = ["head", "relation", "tail", "start", "end", "precision", "polarity", "kind"]
    merged = _merged(e, fact)
    triple = ["head", "relation", "tail"]
    against = cut(G.contradictions(merged.select("edge_id", *triple, "polarity", "start", "end"), triple, "edge_id", "polarity", "start", "end"))
    out = against.select(F.explode(F.array("key_a", "key_b")).alias("edge_id")).distinct()
    edges = merged.join(out, "edge_id", "left_anti")
    used = edges.select(F.explode(F.array("head", "tail")).alias("node_id")).distinct()
    return Graph(records, robust, nodes.join(used, "node_id", "left_semi"), edges, against)


def _merged(e: DataFrame, fact: list[str]) -> DataFrame:
    """One row a fact: sorted sources, the verdict of each source, and evidence, distinct in the order in which it came. Evidence is made distinct before it is gathered, so a fact that
    many articles quote alike costs one row an article and quote."""
    key: Callable[..., Column] = lambda *cs: F.concat(F.lit("edge:"), F.substring(F.sha2(F.concat_ws("|", *cs), 256), 1, 20))
    own = e.withColumn("edge_id", key(*fact))
    once = own.select("edge_id", *fact, "source", "verdict", "at", F.explode("cited").alias("c")).groupBy("edge_id", *fact, "source", "c").agg(F.min("at").alias("at"), F.first("verdict").alias("verdict"))
    return once.groupBy("edge_id", *fact).agg(
        F.array_sort(F.collect_set("source")).alias("sources"), F.map_from_entries(F.array_sort(F.collect_set(F.struct("source", "verdict")))).alias("verdicts"),
        F.transform(F.array_sort(F.collect_list(F.struct("at", "c"))), lambda x: x["c"]).alias("evidence"),
    )


def contexts(nodes: DataFrame, answers: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """``nodes`` with ``context`` STRUCT<summary, quotes, source> from recorded answers (node_id, extract, source, summary, quotes, pre_audit) where the summary isn't blank, its quotes are
    pieces of the extract and the audit passes. Nodes without one have null; a summary never becomes a fact."""
    ok = ~_blank(F.col("summary")) & (F.coalesce(F.size("quotes"), F.lit(0)) > 0) & F.forall("quotes", lambda q: ~_blank(q) & F.contains("extract", q)) & audit_passes(F.col("pre_audit"), least)
    good = answers.where(F.coalesce(ok, F.lit(False))).groupBy("node_id").agg(F.min(F.struct("summary", "quotes", "source")).alias("context"))
    return nodes.join(good, "node_id", "left")
