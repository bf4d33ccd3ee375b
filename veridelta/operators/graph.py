"""Temporal graph operators over edge tables (id, head, relation, tail, start, end, ...)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridelta.operators.rank import top_per_group
from veridelta.session import cut, drop

#: Rounds after which label propagation gives up; the labels of a path of n nodes settle in about log2(n) rounds.
MOST_ROUNDS = 60


def adjacency(edges: DataFrame, head: str = "head", tail: str = "tail", keep: Sequence[str] = ()) -> DataFrame:
    """Both directions of each edge: node, next, direction."""
    f, r = (F.struct(F.col(a).alias("node"), F.col(b).alias("next"), F.lit(d).alias("direction")) for a, b, d in ((head, tail, "forward"), (tail, head, "reverse")))
    return edges.select(*keep, F.explode(F.array(f, r)).alias("_x")).select(*keep, "_x.*")


def degrees(edges: DataFrame, head: str = "head", tail: str = "tail") -> DataFrame:
    return edges.select(F.explode(F.array(head, tail)).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def hubs(edges: DataFrame, n: int, head: str = "head", tail: str = "tail") -> DataFrame:
    """The ``n`` nodes of largest degree; ties by name."""
    return degrees(edges, head, tail).orderBy(F.desc("degree"), "node").limit(n)


def without_hubs(edges: DataFrame, n: int, head: str = "head", tail: str = "tail") -> DataFrame:
    top = hubs(edges, n, head, tail).select("node")
    out = edges
    for c in (head, tail):
        out = out.join(F.broadcast(top.withColumnRenamed("node", c)), c, "left_anti")
    return out.select(*edges.columns)


def dangling(edges: DataFrame, nodes: DataFrame, head: str = "head", tail: str = "tail") -> DataFrame:
    """(node, n): ends of edges that aren't in ``nodes``."""
    ends = edges.select(F.explode(F.array(head, tail)).alias("node"))
    return ends.join(nodes.select(F.col("id").alias("node")), "node", "left_anti").groupBy("node").agg(F.count(F.lit(1)).alias("n"))


def merge_nodes(nodes: DataFrame, order: str, key: str = "id", first: Sequence[str] = (), sets: Sequence[str] = ()) -> DataFrame:
    """One row a key: attributes of the first row, sorted unions of array columns. Both are partial aggregates."""
    aggs = [F.min_by(c, order).alias(c) for c in first] + [F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in sets]
    return nodes.groupBy(key).agg(*aggs)


def merge_edges(edges: DataFrame, order: str, key: Sequence[str], source: str, evidence: str) -> DataFrame:
    """One row a fact: sorted distinct sources, and evidence distinct in the order in which it came."""
    once = edges.groupBy(*key, evidence).agg(F.min(order).alias("_o"), F.collect_set(source).alias("_s"))
    return once.groupBy(*key).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_s")))).alias("sources"),
        F.transform(F.array_sort(F.collect_list(F.struct("_o", evidence))), lambda x: x[evidence]).alias("evidence"),
    )


def contradictions(edges: DataFrame, triple: Sequence[str], key: str, polarity: str, start: str, end: str) -> DataFrame:
    """(key_a, key_b): facts of one triple with opposite polarity whose closed intervals meet. An equi-join on the triple with a
    range condition; triples of one polarity are dropped before it."""
    both = edges.groupBy(*triple).agg(F.min(polarity).alias("_p"), F.max(polarity).alias("_q")).where("_p <> _q").select(*triple)
    kept = edges.join(both, list(triple), "left_semi").select(*triple, key, polarity, start, end)
    a, b = kept.alias("a"), kept.alias("b")
    on = [F.col(f"a.{t}") == F.col(f"b.{t}") for t in triple]
    on += [F.col(f"a.{polarity}") < F.col(f"b.{polarity}"), F.col(f"a.{start}") <= F.col(f"b.{end}"), F.col(f"b.{start}") <= F.col(f"a.{end}")]
    return a.join(b, on).select(F.col(f"a.{key}").alias("key_a"), F.col(f"b.{key}").alias("key_b"))


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): connected components, named by their least node. Nodes are numbered once, so that rounds shuffle numbers; alternating large-star and small-star steps then
    link nodes to smaller ones, and components shrink to stars. Rounds are cut in the shared folder, the last one's files deleted; a hub's neighbours are aggregated, never listed."""
    both = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.col(src).alias("s"), F.col(dst).alias("d"))
    nodes = cut(both.select(F.explode(F.array("s", "d")).alias("node")).distinct().withColumn("n", F.monotonically_increasing_id()))  # the numbers are those of the files
    of = lambda side, to: nodes.select(F.col("node").alias(side), F.col("n").alias(to))
    pairs = both.where("s <> d").join(of("s", "a"), "s").join(of("d", "b"), "d")
    e = cut(pairs.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    ends = nodes if both.where("s = d").limit(1).count() == 0 else e.select(F.explode(F.array("u", "v")).alias("n")).distinct()
    linked = ends.count()
    for _ in range(MOST_ROUNDS):
        count, roots = e.agg(F.count(F.lit(1)), F.count_distinct("u")).first()
        if count + roots == linked:  # every other node has one edge, which leads to a root
            break
        sym = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.*")
        least = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.join(least, "u").where("v > u and m <> v").select(F.col("m").alias("u"), "v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        star = large.join(low, "v")
        small = star.select(F.explode(F.array(F.struct(F.col("m").alias("u"), "v"), F.struct(F.col("m").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.*").where("u <> v")
        last, e = e, cut(small.distinct())
        drop(last)
    else:
        raise RuntimeError(f"components didn't settle in {MOST_ROUNDS} rounds")
    star = nodes.join(e.select(F.col("v").alias("n"), F.col("u").alias("c")), "n", "left").select("node", F.coalesce("c", "n").alias("c"))
    name = star.groupBy("c").agg(F.min("node").alias("component"))
    return star.join(name, "c").select("node", "component")


def depth_layers(edges: DataFrame, roots: DataFrame, most: int, head: str = "head", tail: str = "tail") -> DataFrame:
    """(node, depth) within ``most`` steps of the roots, either way along edges: a frontier join and an anti join a level."""
    adj = cut(adjacency(edges, head, tail).select("node", "next"))
    seen = roots.select("node").distinct().withColumn("depth", F.lit(0))
    front = seen.select("node")
    for d in range(1, most + 1):
        new = front.join(adj, "node").select(F.col("next").alias("node")).distinct().join(seen, "node", "left_anti")
        front = cut(new)
        if front.limit(1).count() == 0:
            break
        seen = seen.unionByName(front.withColumn("depth", F.lit(d)))
    return seen


def simple_paths(edges: DataFrame, seeds: DataFrame, hops: int, width: int | None = None, seed: int = 42) -> DataFrame:
    """(nodes, edges): simple paths of ``hops`` edges from the seeds, walked either way, no node twice. ``width`` cuts a
    hub before the joins: each node offers so many of its edges, the first by a hash of seed and edge, the same ones to every
    path through it. That is no weighted sample of paths."""
    adj = adjacency(edges, keep=["id", "relation", "start", "end"])
    if width is not None:
        adj = top_per_group(adj.withColumn("_h", F.sha2(F.concat_ws(":", F.lit(str(seed)), "id"), 256)), ["node"], ["_h", "id"], width).drop("_h")
    edge = F.struct("id", "relation", "start", "end", "direction")
    paths = seeds.select(F.array("node").alias("nodes"), F.array().cast("array<struct<id:string,relation:string,start:date,end:date,direction:string>>").alias("edges"), F.col("node").alias("at"))
    for _ in range(hops):
        step = paths.join(adj, F.col("at") == F.col("node")).where(~F.array_contains("nodes", F.col("next")))
        paths = step.select(F.array_append("nodes", F.col("next")).alias("nodes"), F.array_append("edges", edge).alias("edges"), F.col("next").alias("at"))
    return paths.select("nodes", "edges")


def path_window(edges: Column) -> Column:
    """Struct of the least start and the largest end over a path's edges."""
    return F.struct(F.array_min(F.transform(edges, lambda e: e["start"])).alias("start"), F.array_max(F.transform(edges, lambda e: e["end"])).alias("end"))


def _pairs(edges: Column, test) -> Column:
    n = F.size(edges)
    return F.when(n < 2, F.lit(True)).otherwise(F.forall(F.zip_with(F.slice(edges, 1, n - 1), F.slice(edges, 2, n - 1), test), lambda ok: F.coalesce(ok, F.lit(False))))


def in_sequence(edges: Column) -> Column:
    """Starts don't fall along the path."""
    return _pairs(edges, lambda a, b: a["start"] <= b["start"])


def in_reverse(edges: Column) -> Column:
    return _pairs(edges, lambda a, b: a["start"] >= b["start"])


def in_parallel(edges: Column) -> Column:
    """Each edge's closed interval meets the next one's."""
    return _pairs(edges, lambda a, b: F.greatest(a["start"], b["start"]) <= F.least(a["end"], b["end"]))


def temporal_mode(edges: Column) -> Column:
    """The first that holds of parallel, sequence, reverse_sequence, independent."""
    return F.when(in_parallel(edges), "parallel").when(in_sequence(edges), "sequence").when(in_reverse(edges), "reverse_sequence").otherwise("independent")


# Relations that say which of two events came first, as the sign of their direction.
ORDERING = {"caused_by": -1, "subsequent_to": -1, "causes": 1, "predecessor_of": 1}


def relation_mode(edges: Column) -> Column:
    """The order that the relations themselves state: 'sequence', 'reverse_sequence', 'parallel', 'none', or null if they conflict."""
    sign = lambda e: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in ORDERING.items() for x in kv)), e["relation"]), F.lit(0)) * F.when(e["direction"] == "reverse", -1).otherwise(1)
    signs = F.array_distinct(F.filter(F.transform(edges, sign), lambda x: x != 0))
    par = F.exists(edges, lambda e: e["relation"] == "parallel_to")
    return F.when(F.size(signs) > 1, None).when(par, "parallel").when(F.size(signs) == 0, "none").when(signs[0] > 0, "sequence").otherwise("reverse_sequence")


def topology_reason(queries: Column) -> Column:
    """First fault of a list of (id, depends_on): duplicate_id, duplicate_dependency, self_dependency, unknown_dependency,
    cycle, not_topological; null for none. A cycle is found by letting reachability grow n times."""
    ids = F.transform(queries, lambda q: q["id"])
    n = F.size(queries)
    dup_dep = F.exists(queries, lambda q: F.size(q["depends_on"]) != F.size(F.array_distinct(q["depends_on"])))
    own = F.exists(queries, lambda q: F.array_contains(q["depends_on"], q["id"]))
    unknown = F.exists(queries, lambda q: F.size(F.array_except(q["depends_on"], ids)) > 0)
    # queries whose dependencies are all settled, taken n times: what never settles is on or behind a cycle
    settled = F.aggregate(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        F.array().cast("array<string>"),
        lambda acc, _: F.array_union(acc, F.transform(F.filter(queries, lambda q: F.size(F.array_except(q["depends_on"], acc)) == 0), lambda q: q["id"])),
    )
    cycle = F.size(settled) < n
    late = F.exists(F.transform(queries, lambda q, i: F.exists(q["depends_on"], lambda d: F.array_position(ids, d) > i)), lambda x: x)
    return (
        F.when(F.size(F.array_distinct(ids)) != n, "duplicate_id").when(dup_dep, "duplicate_dependency").when(own, "self_dependency")
        .when(unknown, "unknown_dependency").when(cycle, "cycle").when(late, "not_topological")
    )


def ancestors(queries: Column) -> Column:
    """Map from each query id to all that it depends on, directly or not, sorted; for lists without a cycle."""
    direct = F.map_from_entries(F.transform(queries, lambda q: F.struct(q["id"], q["depends_on"])))
    grow = lambda m: F.map_from_entries(F.transform(F.map_entries(m), lambda e: F.struct(e["key"], F.array_distinct(F.concat(e["value"], F.flatten(F.transform(e["value"], lambda v: F.coalesce(direct[v], F.array().cast("array<string>")))))))))
    full = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(queries), F.lit(1))), direct, lambda acc, _: grow(acc))
    return F.map_from_entries(F.transform(F.map_entries(full), lambda e: F.struct(e["key"], F.array_sort(e["value"]))))
