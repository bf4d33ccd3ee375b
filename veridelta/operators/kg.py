"""A temporal graph from recorded extractions: facts with the first reason to reject them, nodes and edges with hash ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridelta.functions.dates import iso_day
from veridelta.operators.graph import merge_nodes

PRECISIONS, POLARITIES = ("day", "month", "year"), ("positive", "negative")


def node_id(entity: Column, language: Column) -> Column:
    parts = F.concat_ws("|", entity["type"], F.coalesce(language, F.lit("")), entity["label"], F.coalesce(entity["disambiguation"], F.lit("")))
    return F.concat(F.lit("entity:"), F.substring(F.sha2(parts, 256), 1, 20))


def facts(articles: DataFrame) -> DataFrame:
    """One row a fact of articles (ord, id, language, text, pre_extracted): the fact, its entities h and t, and the first reason to
    reject it: unknown_entity, polarity, precision, date, reversed, quote; null for none."""
    each = articles.select("ord", "id", "language", "text", F.col("pre_extracted.entities").alias("es"), F.posexplode("pre_extracted.facts").alias("pos", "f"))
    entity = lambda side: F.get(F.filter("es", lambda z: z["id"] == F.col(f"f.{side}")), 0)
    x = each.withColumn("h", entity("head")).withColumn("t", entity("tail"))
    reason = (
        F.when(F.col("h").isNull() | F.col("t").isNull(), "unknown_entity").when(~F.coalesce(F.col("f.polarity").isin(*POLARITIES), F.lit(False)), "polarity")
        .when(~F.coalesce(F.col("f.time_precision").isin(*PRECISIONS), F.lit(False)), "precision").when(iso_day(F.col("f.start")).isNull() | iso_day(F.col("f.end")).isNull(), "date")
        .when(F.col("f.start") > F.col("f.end"), "reversed").when(~F.coalesce(F.contains("text", F.col("f.evidence_quote")), F.lit(False)), "quote")
    )
    return x.withColumn("reason", reason).drop("text", "es")


def nodes(articles: DataFrame) -> DataFrame:
    """(node_id, label, type, domains, source_ids)."""
    z = articles.select("ord", F.col("id").alias("source_id"), "language", F.explode("pre_extracted.entities").alias("z"))
    flat = z.select(node_id(F.col("z"), F.col("language")).alias("node_id"), "ord", F.col("z.label").alias("label"), F.col("z.type").alias("type"), F.array("z.domain").alias("domains"), F.array("source_id").alias("source_ids"))
    return merge_nodes(flat, "ord", "node_id", ["label", "type"], ["domains", "source_ids"])


def edges(articles: DataFrame) -> DataFrame:
    """(edge_id, head, relation, tail, start, end, polarity, source_id, quote, ord) of the facts without a reason."""
    f = facts(articles).where("reason is null")
    e = f.select(
        "ord", F.col("id").alias("source_id"), node_id(F.col("h"), F.col("language")).alias("head"), F.col("f.relation").alias("relation"), node_id(F.col("t"), F.col("language")).alias("tail"), F.col("f.start").alias("start"),
        F.col("f.end").alias("end"), F.col("f.time_precision").alias("precision"), F.col("f.polarity").alias("polarity"), F.col("f.temporal_kind").alias("kind"), F.col("f.evidence_quote").alias("quote"),
    )
    key = F.sha2(F.concat_ws("|", "head", "relation", "tail", "start", "end", "precision", "polarity", "kind"), 256)
    return e.withColumn("edge_id", F.concat(F.lit("edge:"), F.substring(key, 1, 20)))
