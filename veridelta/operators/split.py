"""Entity-disjoint splits: components of records that share an entity or a family, and the choice of test components."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridelta.operators.graph import components
from veridelta.session import cut

#: Sums up to which all are looked at, in one array; beyond it the search keeps the best so many.
ALL_STATES, MOST_STATES = 20_000_000, 20_000


def record_components(records: DataFrame, key: str, tokens: str) -> DataFrame:
    """(key, component): records linked by the tokens (entities, family ids) they share. Links run record - token, so a token of a
    third of all records costs its records, not their pairs."""
    r = F.concat(F.lit("r:"), F.col(key).cast("string"))
    links = records.select(r.alias("src"), F.explode_outer(tokens).alias("t")).select("src", F.coalesce(F.concat(F.lit("t:"), F.col("t")), F.col("src")).alias("dst"))
    comp = components(links).where(F.startswith("node", F.lit("r:")))
    kind = records.schema[key].dataType.simpleString()
    return cut(comp.select(F.substring("node", 3, 1_000_000).cast(kind).alias(key), "component"))


def with_families(records: DataFrame, key: str, tokens: str, record_id: str, parent: str) -> tuple[DataFrame, DataFrame]:
    """(records, missing). ``tokens`` gets the family of each record, its parent's id or its own, so that a record and what was made of it stay together. missing: key and parent of the
    records whose parent isn't there."""
    family = F.concat(F.lit("family:"), F.coalesce(parent, record_id))
    own = records.withColumn(tokens, F.array_distinct(F.array_compact(F.concat(F.coalesce(tokens, F.array().cast("array<string>")), F.array(family)))))
    ids = records.select(F.col(record_id).alias(parent)).distinct()
    return own, records.where(F.col(parent).isNotNull()).select(key, parent).join(ids, parent, "left_anti").select(key, parent)


def component_vectors(records: DataFrame, of: DataFrame, key: str, hop: str, hops: list[int]) -> DataFrame:
    """(component, n, h<hop>...): the size of each component and its records by hop."""
    return records.select(key, hop).join(of, key).groupBy("component").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(hop) == h).alias(f"h{h}") for h in hops))


def choose(kinds: list[tuple[tuple[int, ...], int]], quota: tuple[int, ...]) -> tuple[dict[tuple[int, ...], int], tuple[int, ...]]:
    """How many components of each vector kind the test set takes, so that no hop goes over its quota and first the sum is
    largest, then the sum of squared gaps least. A search over kinds, not over components. Returns the numbers and the sum."""
    return search(kinds, quota)[:2]


def search(kinds: list[tuple[tuple[int, ...], int]], quota: tuple[int, ...]) -> tuple[dict[tuple[int, ...], int], tuple[int, ...], bool]:
    """What ``choose`` returns, and whether sums were dropped on the way, so that a better choice may exist. Where the quotas allow at most ALL_STATES sums none is; else larger kinds
    come first and the best MOST_STATES sums are kept."""
    if math.prod(q + 1 for q in quota) <= ALL_STATES:
        return *_search_all(kinds, quota), False
    pruned = False
    score = lambda v: (sum(v), -sum((q - x) ** 2 for x, q in zip(v, quota, strict=True)))
    states: dict[tuple[int, ...], dict] = {tuple(0 for _ in quota): {}}
    for vec, n in sorted(kinds, key=lambda k: (-sum(k[0]), k[0])):
        if not any(vec) or any(x > q for x, q in zip(vec, quota, strict=True)):
            continue
        new = dict(states)
        for s, took in states.items():
            for k in range(1, n + 1):
                t = tuple(a + k * b for a, b in zip(s, vec, strict=True))
                if any(x > q for x, q in zip(t, quota, strict=True)):
                    break
                if t not in new:
                    new[t] = took | {vec: k}
        pruned |= len(new) > MOST_STATES
        states = dict(sorted(new.items(), key=lambda kv: score(kv[0]), reverse=True)[:MOST_STATES]) if len(new) > MOST_STATES else new
    best = max(states, key=lambda s: (score(s), s))
    return states[best], best, pruned


def _search_all(kinds: list[tuple[tuple[int, ...], int]], quota: tuple[int, ...]) -> tuple[dict[tuple[int, ...], int], tuple[int, ...]]:
    """The search over an array of all sums: which kind, and how many of it, reached each first."""
    shape = tuple(q + 1 for q in quota)
    by, count = np.full(shape, -1, np.int32), np.zeros(shape, np.int32)
    reached = np.zeros(shape, bool)
    reached[(0,) * len(quota)] = True
    order = [(v, n) for v, n in sorted(kinds, key=lambda k: (-sum(k[0]), k[0])) if any(v) and all(x <= q for x, q in zip(v, quota, strict=True))]
    for i, (vec, n) in enumerate(order):
        if reached[quota]:
            break
        before = reached.copy()
        for k in range(1, min(n, *(q // x for x, q in zip(vec, quota, strict=True) if x)) + 1):
            to, of = tuple(slice(k * x, None) for x in vec), tuple(slice(0, m - k * x) for x, m in zip(vec, shape, strict=True))
            new = before[of] & ~reached[to]
            by[to][new], count[to][new] = i, k
            reached[to] |= new
    at = np.argwhere(reached)
    best = tuple(int(x) for x in at[np.lexsort((*at.T[::-1], -((np.array(quota) - at) ** 2).sum(axis=1), at.sum(axis=1)))[-1]])
    took: dict[tuple[int, ...], int] = {}
    state = best
    while any(state):
        vec, k = order[by[state]][0], int(count[state])
        took[vec] = took.get(vec, 0) + k
        state = tuple(a - k * b for a, b in zip(state, vec, strict=True))
    return took, best


def disjoint_split(records: DataFrame, key: str, tokens: str, hop: str, quota: dict[int, int]) -> tuple[DataFrame, dict]:
    """(key, component, split) and a report. The distinct vectors of components that fit into the quota, and how many there are of each, reach the driver: all of them, and no
    more than the quota has vectors below it. A quota that is missed is a ``quota_shortfall`` only where no sum was left out of the search, else
    ``quota_shortfall_search_cut``."""
    hops = sorted(quota)
    of = record_components(records, key, tokens)
    vec = component_vectors(records, of, key, hop, hops)
    cols = [f"h{h}" for h in hops]
    total = sum(F.col(c) for c in cols)
    fits = (F.col("n") == total) & (total > 0)
    for h in hops:
        fits = fits & (F.col(f"h{h}") <= quota[h])
    kinds = [(tuple(r[c] for c in cols), r["k"]) for r in vec.where(fits).groupBy(*cols).agg(F.count(F.lit(1)).alias("k")).collect()]
    want = tuple(quota[h] for h in hops)
    # a kind never gives more components than its quota can hold
    took, got, pruned = search([(v, min(n, max([0, *(q // x for x, q in zip(v, want, strict=True) if x)]))) for v, n in kinds], want)
    spark = records.sparkSession
    fields = ", ".join(f"{c} long" for c in cols) + ", take int"
    plan = spark.createDataFrame([(*v, k) for v, k in took.items()], fields) if took else spark.createDataFrame([], fields)
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(*cols).orderBy("component"))
    test = vec.where(F.col("n") == total).join(F.broadcast(plan), cols).withColumn("rn", rank).where(F.col("rn") <= max(took.values(), default=0)).where("rn <= take").select("component", F.lit("test").alias("split"))
    out = of.join(test, "component", "left").select(key, "component", F.coalesce("split", F.lit("train")).alias("split"))
    status = "exact_quotas_met" if got == want else "quota_shortfall_search_cut" if pruned else "quota_shortfall"
    return out, {"quota": dict(zip(hops, want, strict=True)), "test": dict(zip(hops, got, strict=True)), "status": status, "kinds": len(kinds), "taken": sum(Counter(took).values())}


def leakage(records: DataFrame, of: DataFrame, key: str, tokens: str) -> DataFrame:
    """Tokens that stand in both splits; empty when the split is right."""
    t = records.select(key, F.explode(tokens).alias("token")).join(of.select(key, "split"), key)
    return t.where("split = 'test'").select("token").intersect(t.where("split = 'train'").select("token"))
