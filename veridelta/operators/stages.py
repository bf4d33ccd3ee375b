"""Stages of inference over many records: which rows may enter, what a rerun makes stale, which records wait for a failed stage, and the counts of a stage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridelta.functions.dates import iso_day
from veridelta.functions.text import strip

# The stages in order, the states of one, and the fields of a record that stages write.
STAGES = ("queries", "retrieval", "explanation", "verdict")
STATES = ("ok", "error", "skipped")
WRITTEN = {"queries": ("queries",), "explanation": ("explanation", "explanation_citations", "evidence_status", "evidence_gaps"), "verdict": ("predicted_label", "verdict_reason")}
DRAFT = "draft_only_requires_final_model"
#: Most queries of a plan: of a stage by itself and of the runner; most documents of a search.
MOST_STAGE_QUERIES, MOST_RUN_QUERIES, MOST_DOCUMENTS = 32, 20, 20


def options(max_queries: int, max_results: int, runner: bool = True) -> dict[str, int]:
    """The limits of a run, checked."""
    most = MOST_RUN_QUERIES if runner else MOST_STAGE_QUERIES
    for name, value, limit in (("max_queries", max_queries, most), ("max_results", max_results, MOST_DOCUMENTS)):
        if not isinstance(value, int) or isinstance(value, bool) or not 1 <= value <= limit:
            raise ValueError(f"{name} must be a whole number from 1 to {limit}")
    return {"max_queries": max_queries, "max_results": max_results}


def require_generator(config: dict, role: str = "generator") -> dict:
    """The part of a configuration that names the generating model; an error if a field is missing or blank."""
    got = config.get("llm", {}).get(role)
    missing = [k for k in ("provider", "model") if not isinstance(got, dict) or not isinstance(got.get(k), str) or not got[k].strip()]
    if missing:
        raise ValueError(f"llm.{role} needs {', '.join(missing)}")
    return got


def inputs(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """What of the records (ord, id, claim, reference_date and what stages write) inference may see: these columns only, so no answer of a gold record goes on. ``reason`` is the first fault: id,
    duplicate_id, claim, draft, reference_date. ``limit`` takes the first rows by ord."""
    have = set(rows.columns)
    keep = ["ord", "id", "claim", *(["reference_date"] if "reference_date" in have else []), *(c for cs in WRITTEN.values() for c in cs if c in have)]
    first = rows.groupBy(F.col("id").alias("_id")).agg(F.min("ord").alias("_first"))
    blank = lambda c: F.coalesce(strip(c) == "", F.lit(True))
    ref = F.col("reference_date") if "reference_date" in have else F.lit(None).cast("string")
    draft = F.col("status") == DRAFT if "status" in have else F.lit(False)
    reason = (
        F.when(blank(F.col("id")), "id").when(F.col("_first") < F.col("ord"), "duplicate_id").when(blank(F.col("claim")), "claim").when(F.coalesce(draft, F.lit(False)), "draft")
        .when(ref.isNotNull() & iso_day(ref).isNull(), "reference_date")
    )
    out = rows.join(first, F.col("id") == F.col("_id"), "left").select(*keep, reason.alias("reason"))
    return out.orderBy("ord").limit(limit) if limit is not None else out


def invalidate(rows: DataFrame, stage: str) -> DataFrame:
    """``rows`` without what ``stage`` and the stages after it wrote, and without their history (``history`` MAP<stage, STRUCT<status, ...>>). An explanation also goes when queries or
    retrieval run again."""
    index = STAGES.index(stage)
    gone = [c for s, cs in WRITTEN.items() if STAGES.index(s) >= index for c in cs]
    out = rows
    for c in gone:
        if c in rows.columns:
            out = out.withColumn(c, F.lit(None).cast(rows.schema[c].dataType))
    if "history" in rows.columns:
        out = out.withColumn("history", F.map_filter("history", lambda k, _: ~k.isin(*STAGES[index:])))
    return out


def failed_before(history: Column, stage: str) -> Column:
    """The stages before ``stage`` that ended in an error or were skipped, in order."""
    return F.filter(F.array(*map(F.lit, STAGES[: STAGES.index(stage)])) if STAGES.index(stage) else F.array().cast("array<string>"), lambda s: F.coalesce(F.try_element_at(history, s)["status"].isin("error", "skipped"), F.lit(False)))


def gate(rows: DataFrame, stage: str) -> DataFrame:
    """``rows`` with status 'skipped' and the reason where a stage before failed, else null."""
    failed = failed_before(F.col("history"), stage)
    return rows.withColumn("status", F.when(F.size(failed) > 0, "skipped")).withColumn("reason", F.when(F.size(failed) > 0, F.concat(F.lit("earlier stage failed: "), F.array_join(failed, ", "))))


def stage_report(results: DataFrame, stages: Sequence[str] = STAGES) -> DataFrame:
    """(stage, n_inputs, ok, error, skipped, complete, model_calls, search_calls, abstentions) of results (stage, status, model_calls, search_calls, predicted_label), one row a record and
    stage. A verdict that ended well without a label is an abstention."""
    s = F.col("status")
    out = results.where(F.col("stage").isin(*stages)).groupBy("stage").agg(
        F.count(F.lit(1)).alias("n_inputs"), *(F.count_if(s == x).alias(x) for x in STATES), F.sum("model_calls").alias("model_calls"), F.sum("search_calls").alias("search_calls"),
        F.count_if((F.col("stage") == "verdict") & (s == "ok") & F.col("predicted_label").isNull()).alias("abstentions"),
    )
    return out.select("stage", "n_inputs", *STATES, (F.col("ok") == F.col("n_inputs")).alias("complete"), "model_calls", "search_calls", "abstentions")
