"""Recorded answers of models and searches: a request is known by the hash of its canonical JSON, hits are joined and misses listed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def request_key(*parts: Column) -> Column:
    """SHA-256 of the JSON array of the parts; nulls are written, so they count."""
    return F.sha2(F.to_json(F.array(*(p.cast("string") for p in parts))), 256)


def latest(records: DataFrame, order: str = "recorded_at") -> DataFrame:
    """(request, response): the last answer of each request."""
    return records.groupBy("request").agg(F.max_by("response", order).alias("response"))


def hits(requests: DataFrame, records: DataFrame, key: str = "request") -> DataFrame:
    """Requests with their response, null for none."""
    return requests.join(latest(records).withColumnRenamed("request", key), key, "left")


def misses(requests: DataFrame, records: DataFrame, key: str = "request") -> DataFrame:
    """Distinct requests without an answer: what a connector would have to fetch."""
    return requests.select(key).distinct().join(records.select(F.col("request").alias(key)), key, "left_anti")


def search_rows(responses: DataFrame, key: str, most_chars: int = 6000, response: str = "response") -> DataFrame:
    """(key, rank, doc_id, url, text, cut, timestamp) from the JSON results of a search: raw_content if it isn't blank, else content,
    of at most ``most_chars`` characters; rank is the place in the list; results without a text are dropped and keep their place."""
    schema = "results array<struct<url:string,title:string,content:string,raw_content:string,published_date:string>>"
    each = responses.select(key, F.posexplode(F.from_json(response, schema)["results"]).alias("pos", "r"))
    raw = F.trim(F.coalesce("r.raw_content", F.lit("")))
    text = F.when(raw != "", F.col("r.raw_content")).otherwise(F.coalesce("r.content", F.lit("")))
    out = each.select(key, (F.col("pos") + 1).alias("rank"), F.col("r.url").alias("url"), text.alias("t"), F.col("r.published_date").alias("timestamp")).where(F.trim("t") != "")
    return out.select(key, "rank", F.concat(F.lit("doc_"), F.substring(F.sha2(F.concat_ws("\n", "url", "t"), 256), 1, 20)).alias("doc_id"), "url", F.substring("t", 1, most_chars).alias("text"), (F.length("t") > most_chars).alias("cut"), "timestamp")


def batches(rows: DataFrame, group: Sequence[str], order: str, size: int, fields: Sequence[str]) -> DataFrame:
    """Requests of up to ``size`` rows of a group in order: group, batch, items."""
    from veridelta.operators.rank import chunked

    df = chunked(rows, group, order, size).withColumnRenamed("chunk", "batch")
    item = F.struct(order, *(f for f in fields if f != order))
    return df.groupBy(*group, "batch").agg(F.array_sort(F.collect_list(item)).alias("items"))
