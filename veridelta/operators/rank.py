"""Ranking, quotas, assembly, dedup and percentiles as DataFrame transforms.

Every 'first' needs an order column, since Spark has no file order. Ranks are always taken within a key; over a whole table
only ``orderBy().limit()`` is used, which keeps top rows per partition and never gathers the rest in one task. Ranks that only matter up to some number are limited by
it as a literal, so that the plan drops the rest of a group before the shuffle; ranks and running sums of all rows of a group are taken in two levels (``before``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridelta.session import cut, drop


def first_by(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key. A null key is a key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_per_group(df: DataFrame, group: Sequence[str | Column], order: Sequence[str | Column], most: int) -> DataFrame:
    """At most ``most`` rows of each group; the plan limits groups before and after the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn")


def quota(df: DataFrame, key: str, category: str, order: Sequence[Column], quotas: dict[str, int]) -> DataFrame:
    """The best row of each key, then so many rows of each category as its quota; other categories have none."""
    best = first_by(df, [key], order)
    most = F.element_at(F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv)), F.col(category))
    w = Window.partitionBy(category).orderBy(*order)
    ranked = best.where(F.col(category).isin(*quotas)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(quotas.values(), default=0))
    return ranked.where(F.col("rank") <= most)


def shortfalls(df: DataFrame, category: str, quotas: dict[str, int]) -> DataFrame:
    """(category, quota, have, missing) of every quota, also of categories without a row."""
    want = df.sparkSession.createDataFrame(list(quotas.items()), f"`{category}` string, quota long")
    have = df.groupBy(category).agg(F.count(F.lit(1)).alias("have"))
    out = want.join(have, category, "left").fillna(0, ["have"])
    return out.withColumn("missing", F.greatest(F.col("quota") - F.col("have"), F.lit(0)).cast("long"))


def floor_fill(df: DataFrame, category: str, order: Sequence[Column], floor: int, total: int) -> DataFrame:
    """``floor`` rows of each category first, then the best of the rest up to ``total``; ``is_floor`` says which. A row after the first floor + total of its category
    can't be among them."""
    w = Window.partitionBy(category).orderBy(*order)
    ranked = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= floor + total).withColumn("is_floor", F.col("_rn") <= floor).drop("_rn")
    return ranked.orderBy(F.col("is_floor").desc(), *order).limit(total)


def fill_to_target(parts: Sequence[DataFrame], key: Column, order: str, total: int) -> DataFrame:
    """Rows of the parts in their order, each key once and blank keys never, until there are ``total``."""
    all_ = parts[0].withColumn("prio", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        all_ = all_.unionByName(p.withColumn("prio", F.lit(i)), allowMissingColumns=True)
    kept = first_by(all_.withColumn("_key", key).where("_key <> ''"), ["_key"], ["prio", order]).drop("_key")
    return kept.orderBy("prio", order).limit(total)


def round_robin(df: DataFrame, parent: str, method: str, order: str, methods: Sequence[str]) -> DataFrame:
    """Columns tier, turn and place: first one row of each listed method and parent (methods in order, parents as first seen),
    then what is left, parent by parent. ``order`` is unique. The first rows come from an aggregate and a join, not from a window over a parent's rows."""
    firsts = df.groupBy(F.col(parent).alias("_p"), F.col(method).alias("_q")).agg(F.min(order).alias("_first"))
    seen = firsts.groupBy(F.col("_p").alias("_s")).agg(F.min("_first").alias("_seen"))
    of = firsts.join(seen, F.col("_p").eqNullSafe(F.col("_s"))).drop("_s")
    out = df.join(of, df[parent].eqNullSafe(F.col("_p")) & df[method].eqNullSafe(F.col("_q")))
    index = F.coalesce(F.array_position(F.array(*map(F.lit, methods)), df[method]), F.lit(0))
    first_turn = (df[order] == F.col("_first")) & (index > 0)
    return out.select(*(df[c] for c in df.columns), F.when(first_turn, 0).otherwise(1).alias("tier"), F.when(first_turn, index).otherwise(F.lit(0)).cast("int").alias("turn"), F.col("_seen").alias("place"))


def stratified_sample(df: DataFrame, strata: Sequence[str], key: str, seed: int, size: int) -> DataFrame:
    """Rows taken in turn from the strata, in the order of a hash of seed and key."""
    h = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)
    w = Window.partitionBy(*strata).orderBy("_h", key)
    return df.withColumn("_h", h).withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= size).orderBy("turn", "_h", key).limit(size).drop("_h")


def before(df: DataFrame, group: Sequence[str], order: Sequence[str], value: Column, to: str = "before") -> DataFrame:
    """Column ``to``: the sum of ``value`` over the rows before each row of its group (the whole table for no group) in a unique order. In two levels: rows are cut by ranges of
    group and order, summed inside a range and moved by the sums of the group's ranges before it. So a group of any size is summed by many tasks; the ranges are fixed in the
    shared folder."""
    return sums_before(df, group, order, {to: value})[0]


def sums_before(df: DataFrame, group: Sequence[str], order: Sequence[str], values: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """``before`` for several values at once, by the columns that the sums go to; and the table of the ranges in the shared folder, with the values themselves in those columns, which may
    be dropped when the sums have been read."""
    ranges = cut(df.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()).withColumns(values))
    names = {to: f"_s{i}" for i, to in enumerate(values)}
    sums = ranges.groupBy(*group, "_range").agg(*(F.sum(to).alias(s) for to, s in names.items()))
    w = Window.partitionBy(*group).orderBy("_range")
    base = sums.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), F.col("_range").alias("_r"), *((F.sum(s).over(w) - F.col(s)).alias(s) for s in names.values()))
    w = Window.partitionBy(*group, "_range").orderBy(*order)
    own = ranges.select(*df.columns, "_range", *((F.sum(to).over(w) - F.col(to)).alias(to) for to in names))
    on = F.col("_range") == F.col("_r")
    for i, g in enumerate(group):
        on = on & own[g].eqNullSafe(F.col(f"_g{i}"))
    return own.join(base, on).select(*df.columns, *((F.col(to) + F.col(s)).alias(to) for to, s in names.items())), ranges


def numbered(df: DataFrame, group: Sequence[str], order: str, to: str = "number") -> DataFrame:
    """Column ``to``: the place of each row in its group, from 0."""
    return before(df, group, [order], F.lit(1).cast("long"), to)


def chunked(df: DataFrame, group: Sequence[str], order: str, size: int) -> DataFrame:
    """Chunks of ``size`` rows of each group in order: column chunk, from 0."""
    return numbered(df, group, order, "_number").withColumn("chunk", F.floor(F.col("_number") / size)).drop("_number")


def percentiles(df: DataFrame, group: Sequence[str], value: str, points: Sequence[int], method: str = "nearest") -> DataFrame:
    """(group, p, value): exact percentiles per group by counting values, so no task holds a group's rows but only its distinct
    values. 'nearest' takes the place round-half-even((n - 1) p / 100), 'floor' min(n - 1, floor(n p / 100)), both from 0."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*group)
    cum = counts.withColumn("_to", F.sum("_n").over(w.orderBy(value))).withColumn("_all", F.sum("_n").over(w))
    p = F.explode(F.array(*(F.lit(x) for x in points))).alias("p")
    if method == "nearest":
        place = F.bround((F.col("_all") - 1) * F.col("p") / F.lit(100)).cast("long")
    else:
        place = F.least(F.col("_all") - 1, F.floor(F.col("_all") * F.col("p") / F.lit(100)))
    at = cum.select(*group, F.col(value).alias("value"), "_n", "_to", "_all", p).withColumn("_at", place)
    return at.where((F.col("_at") >= F.col("_to") - F.col("_n")) & (F.col("_at") < F.col("_to"))).select(*group, "p", "value")


def reason_counts(df: DataFrame, reasons: Sequence[tuple[str, Column]]) -> DataFrame:
    """(reason, n): the first condition that holds of each row, 'ok' for none."""
    out = F
    for name, cond in reasons:
        out = out.when(F.coalesce(cond, F.lit(False)), F.lit(name))
    return df.select(out.otherwise(F.lit("ok")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def or_dedup(df: DataFrame, first: str, second: str, order: str) -> DataFrame:
    """Sequential dedup on two keys in a unique order: a row goes if its first or second key was *kept* before; null keys are keys. All rows are looked at at once, in rounds: a row
    that comes first among the undecided ones of both its keys is kept, and rows of a kept key go. That decides each row as the sequence would. Rows whose order is random settle
    in a few rounds; what is left of long chains is walked once it is at most WALKED rows. No key's rows are gathered in one task."""
    node = F.struct(F.col(first).alias("v"))
    left = cut(df.select(F.col(order).alias("o"), node.alias("a"), F.struct(F.col(second).alias("v")).alias("b")))
    kept = []
    while True:
        la, lb = (left.groupBy(k).agg(F.min("o").alias(f"m{k}")) for k in ("a", "b"))
        win = cut(left.join(la, "a").join(lb, "b").where("o = ma and o = mb").select("o", "a", "b"))
        kept.append(win.select("o"))
        last, left = left, cut(left.join(win.select("a"), "a", "left_anti").join(win.select("b"), "b", "left_anti").select("o", "a", "b"))
        drop(last)
        n = left.count()
        if n == 0:
            break
        if n <= WALKED:
            kept.append(df.sparkSession.createDataFrame([(o,) for o in _walk(left)], df.select(F.col(order).alias("o")).schema))
            break
    out = kept[0]
    for k in kept[1:]:
        out = out.unionByName(k)
    return df.join(out.withColumnRenamed("o", order), order, "left_semi")


#: Rows of a two-key dedup that are walked on the driver once no more are undecided.
WALKED = 10_000


def _walk(left: DataFrame) -> list:
    seen_a, seen_b, keep = set(), set(), []
    for o, x, y in left.orderBy("o").collect():
        if x not in seen_a and y not in seen_b:
            seen_a.add(x)
            seen_b.add(y)
            keep.append(o)
    return keep
