"""Problem 8: mixing sources to target weights.

The mix is a row of slots of BLOCK tokens, at any size of the mix. Slot i takes the point frac((i + 1/2) / golden ratio); the cumulated weights map the
point to a source, so every stretch of the mix has its shares nearly right. Slots are ranked within their source. A source's
documents, shuffled anew for each repeat, form one stream that is cut into blocks of equal tokens; the k-th slot of a source
takes its k-th block. The mix is as long as the scarcest source allows: no document is used more than max_repeats times.

A document stands in the slot that it begins in; one that is longer fills the slots after it too, in which then no document begins. ``spans`` counts
the slots that it reaches into.

Ranks and running sums are taken in two levels, within chunks of bounded size and over the chunks' totals, so a source that
holds a third of all rows is spread over many tasks.

Defined results: sources without a token get no slot and their weight is shared out among the others (the report shows 0);
null and empty texts have no tokens and are never drawn; documents of no target source take no part; weights must not be
negative; a mix of which no source has tokens is empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridelta.llm.sizes import count_tokens
from veridelta.session import cut

#: Tokens of a slot.
BLOCK = 256
GOLDEN = (math.sqrt(5) - 1) / 2
#: Rows of a chunk in which ranks and sums are taken by one task.
CHUNK = 65_536
#: Most rows of the table of targets, which is read to the driver.
TARGETS = 10_000
#: Parts of 0..1 by which a point finds its source.
CELLS = 1024


def token_sizes(df: DataFrame, vocabulary: str, key: str, source: str, text: str) -> DataFrame:
    """(key, source, tokens) of the documents with a token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("source"), pa.array(count_tokens(b.column(text).to_pylist(), vocabulary), pa.int64())], names=[key, "source", "tokens"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(source).alias("source"), text).mapInArrow(run, f"`{key}` {kind}, source string, tokens long").where("tokens > 0")


def plan(targets: list[tuple[str, str, float, int]], have: dict[str, int], block: int) -> dict[str, tuple[int, list[tuple[str, float, float]]]]:
    """mix_id -> (slots, [(source, from, to)]): the weights of the sources that have tokens, cumulated over 0..1."""
    of: dict[str, list[tuple[str, float, int]]] = {}
    for m, s, w, r in targets:
        if have.get(s, 0) > 0 and w > 0 and r > 0:
            of.setdefault(m, []).append((s, w, r))
    out = {}
    for m in sorted(of):
        own = sorted(of[m])
        total = sum(w for _, w, _ in own)
        cum, at = [], 0.0
        for k, (s, w, _) in enumerate(own):
            to = 1.0 if k == len(own) - 1 else at + w / total
            cum.append((s, at, to))
            at = to
        # the golden-ratio points give a source at most a few slots more than its share
        slots = int(min(have[s] * r * total / w for s, w, r in own) // block)
        while slots > 1 and any(math.ceil(slots * (b - a)) + 2 > have[s] * r // block for (s, a, b), (_, _, r) in zip(cum, own, strict=True)):
            slots -= max(1, slots // 500)
        out[m] = (max(slots, 1), cum)
    return out


def schedule(spark: SparkSession, mixes: dict[str, tuple[int, list[tuple[str, float, float]]]]) -> DataFrame:
    """(mix_id, slot, source, k): the source of each slot and the slot's rank among those of the source, from 0. A point looks its source up among the few that
    reach into its part of 0..1; that table has at most CELLS rows a mix and one a target more."""
    rows = spark.createDataFrame([(m, n, -(-n // CHUNK)) for m, (n, _) in mixes.items()], "mix_id string, slots long, chunks long")
    chunks = rows.select("mix_id", "slots", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")).repartition("mix_id", "chunk")
    points = chunks.select("mix_id", "slots", "chunk", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least((F.col("chunk") + 1) * CHUNK, "slots") - 1)).alias("slot")).drop("slots")
    points = points.withColumn("u", F.pmod((F.col("slot") + 0.5) * F.lit(GOLDEN), F.lit(1.0))).withColumn("cell", F.floor(F.col("u") * CELLS))
    parts = [(m, c, s, a, b) for m, (_, cum) in mixes.items() for s, a, b in cum for c in range(int(a * CELLS), min(CELLS - 1, int(b * CELLS)) + 1)]
    parts = spark.createDataFrame(parts, "mix_id string, cell long, source string, lo double, hi double")
    all_ = points.join(F.broadcast(parts), ["mix_id", "cell"]).where("lo <= u and u < hi").select("mix_id", "chunk", "slot", "source")
    totals = all_.groupBy("mix_id", "source", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = totals.withColumn("base", F.sum("n").over(Window.partitionBy("mix_id", "source").orderBy("chunk")) - F.col("n")).drop("n")
    rank = F.row_number().over(Window.partitionBy("mix_id", "source", "chunk").orderBy("slot")) - 1
    return all_.withColumn("r", rank).join(before, ["mix_id", "source", "chunk"]).select("mix_id", "slot", "source", (F.col("base") + F.col("r")).alias("k"))


def mix(df: DataFrame, targets: DataFrame, vocabulary: str, key: str = "doc_id", source: str = "source", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(mix_id, slot, place, key, source, use, tokens, spans): the documents of each slot in order; use counts a document's uses from 0.
    ``targets``: mix_id, source, target_share, max_repeats."""
    spark = df.sparkSession
    want = [tuple(r) for r in targets.select("mix_id", "source", "target_share", "max_repeats").limit(TARGETS + 1).collect()]
    if len(want) > TARGETS or any(w is None or w < 0 for _, _, w, _ in want):
        raise ValueError(f"at most {TARGETS} targets, and no share below 0")
    names = targets.select(F.col("source").alias("_wanted")).distinct()
    own = df.select(key, F.col(source).alias("source"), F.col(text).alias("text"))
    sized = cut(token_sizes(own.join(F.broadcast(names), F.col("source") == F.col("_wanted"), "left_semi"), vocabulary, key, "source", "text"))
    of = {r[0]: (r[1], r[2]) for r in sized.groupBy("source").agg(F.sum("tokens"), F.count(F.lit(1))).collect()}
    mixes = plan(want, {s: t for s, (t, _) in of.items()}, block)
    if not mixes:
        kind = df.schema[key].dataType.simpleString()
        return spark.createDataFrame([], f"mix_id string, slot long, place int, `{key}` {kind}, source string, use int, tokens long, spans long")
    slots = cut(schedule(spark, mixes))
    need = slots.groupBy("mix_id", "source").agg(F.count(F.lit(1)).alias("blocks"))
    have = spark.createDataFrame([(s, int(t), max(1, math.ceil(n / CHUNK))) for s, (t, n) in of.items()], "source string, total long, chunks int")
    uses = need.join(F.broadcast(have), "source").withColumn("uses", F.ceil(F.col("blocks") * block / F.col("total")).cast("int"))
    drawn = sized.join(F.broadcast(uses), "source").withColumn("use", F.explode(F.sequence(F.lit(0), F.col("uses") - 1)))
    drawn = drawn.withColumn("h", F.xxhash64(F.col(key).cast("string"), "use", "mix_id")).withColumn("chunk", F.pmod("h", "chunks"))
    totals = drawn.groupBy("mix_id", "source", "use", "chunk").agg(F.sum("tokens").alias("t"))
    before = totals.withColumn("base", F.sum("t").over(Window.partitionBy("mix_id", "source").orderBy("use", "chunk")) - F.col("t")).drop("t")
    own = F.sum("tokens").over(Window.partitionBy("mix_id", "source", "use", "chunk").orderBy("h", key)) - F.col("tokens")
    placed = drawn.withColumn("own", own).join(before, ["mix_id", "source", "use", "chunk"]).withColumn("at", F.col("base") + F.col("own")).withColumn("k", F.floor(F.col("at") / block)).where("k < blocks")
    spans = F.floor((F.col("at") + F.col("tokens") - 1) / block) - F.col("k") + 1
    got = placed.select("mix_id", "source", "k", "at", key, "use", "tokens", spans.alias("spans")).join(slots, ["mix_id", "source", "k"])
    place = F.row_number().over(Window.partitionBy("mix_id", "slot").orderBy("at", key))
    return got.select("mix_id", "slot", place.alias("place"), key, "source", "use", "tokens", "spans")


def report(mixed: DataFrame, targets: DataFrame, key: str = "doc_id") -> DataFrame:
    """(mix_id, source, target_share, actual_share, tokens, drawn, most_uses, spanned) of every target; 0 where nothing was drawn. spanned counts the
    slots in which no document begins since a longer one fills them."""
    uses = mixed.groupBy("mix_id", "source", key).agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.sum(F.col("spans") - 1).alias("s"))
    of = uses.groupBy("mix_id", "source").agg(F.sum("t").alias("tokens"), F.sum("n").alias("drawn"), F.max("n").alias("most_uses"), F.sum("s").alias("spanned"))
    got = targets.select("mix_id", "source", "target_share").join(of, ["mix_id", "source"], "left").fillna(0, ["tokens", "drawn", "most_uses", "spanned"])
    total = F.sum("tokens").over(Window.partitionBy("mix_id"))
    return got.select("mix_id", "source", "target_share", F.when(total > 0, F.col("tokens") / total).otherwise(F.lit(0.0)).alias("actual_share"), "tokens", "drawn", "most_uses", "spanned")


def invariants(mixed: DataFrame, df: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source") -> DataFrame:
    """(mix_id, targets, over_used, drawn_twice, strangers) of every mix; the last three are 0 where the mix is right: targets with a document used more than
    max_repeats times, uses of a document that occur more than once, and rows whose document is of another source."""
    own = targets.select("mix_id", "source", "max_repeats")
    uses = mixed.groupBy("mix_id", "source", key).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("use").alias("kinds"))
    of = uses.join(df.select(F.col(key), F.col(source).alias("_of")), key).groupBy("mix_id", "source").agg(F.max("n").alias("most"), F.sum(F.col("n") - F.col("kinds")).alias("twice"), F.count_if(~F.col("_of").eqNullSafe(F.col("source"))).alias("strange"))
    got = own.join(of, ["mix_id", "source"], "left").fillna(0, ["most", "twice", "strange"])
    return got.groupBy("mix_id").agg(F.count(F.lit(1)).alias("targets"), F.count_if(F.col("most") > F.col("max_repeats")).alias("over_used"), F.sum("twice").alias("drawn_twice"), F.sum("strange").alias("strangers"))
