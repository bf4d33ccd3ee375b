"""Samples of paths: starts drawn by a power of the degree, self-avoiding walks, acceptance by strategy and by order in time, and best-first paths.

A step of a walk reads the edges once and keeps those at the nodes where walkers stand. They are numbered, in two levels, and a walker looks up the number that a hash of seed, draw and step
gives it; a hub of a third of all edges is numbered by many tasks, and every edge of it can be walked. No table of all edges is ever written. All draws are hashes, so a sample is the same on
every cluster, and a walk of few edges is the beginning of that of more from the same start: one walk serves samples of several lengths."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridelta.functions.dates import month_number
from veridelta.operators import graph as G
from veridelta.operators.rank import sums_before
from veridelta.session import cut, drop, setting, small, stored, unstore

# Which paths each strategy may join, by node types or relations.
BY_TYPE = {"person_identity_fusion": ("person", "human"), "geospatial_coincidence": ("location", "place", "city", "country")}
BY_RELATION = {
    "institutional_affiliation": ("member_of", "headquartered_in", "employed_by", "founded"), "artifact_adaptation": ("adapted_from",), "genealogical_linkage": ("married_to", "relative_of"),
    "event_causality": ("caused_by", "causes"), "role_parallelism": ("parallel_to",),
}
EDGE = ("id", "relation", "start", "end", "precision", "direction")
#: Lookups by which a walker finds an unvisited neighbour in one step before it is given up, and walkers for each draw.
LOOKUPS, TRIES = 4, 16
#: Lookups of a step up to which walkers are sent to all tasks; more are shuffled.
WALKERS = 200_000
#: Of best-first paths: edges of a round, one edge in how many is looked at to guess their number, how many of these make a hub, and words of 64 bits that mark nodes.
ROUND, SOME, HUB, MARKS = 30_000_000, 4096, 8, 1 << 18
#: Shuffle files go as soon as the query that wrote them has ended, not when the driver happens to collect its garbage; lists are collected from rows in order.
REMOVED, SORTED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}, {"spark.sql.execution.useObjectHashAggregateExec": "false"}


def strategies(types: Column, edges: Column) -> Column:
    """The strategies that a path of nodes of ``types`` and ``edges`` (relation, start, end) may serve, in a fixed order."""
    low = F.transform(types, lambda t: F.lower(t))
    relations = F.transform(edges, lambda e: e["relation"])
    year = lambda c: F.substring(c.cast("string"), 1, 4)
    first = year(F.get(edges, 0)["start"])
    one_year = (F.size(edges) > 0) & F.forall(edges, lambda e: (year(e["start"]) == first) & (year(e["end"]) == first))
    tags = [F.when(one_year, "temporal_synchronization")]
    tags += [F.when(F.arrays_overlap(low, F.array(*map(F.lit, v))), k) for k, v in BY_TYPE.items()]
    tags += [F.when(F.arrays_overlap(relations, F.array(*map(F.lit, v))), k) for k, v in BY_RELATION.items()]
    return F.array_compact(F.array(*tags))


def path_mode(edges: Column) -> Column:
    """The order in time that the relations of a path state, if the days agree with it: 'sequence', 'reverse_sequence', 'parallel', else 'independent'. Null where relations state
    both orders or the days don't agree; parallel edges must be known by the day and meet their neighbours."""
    table = F.create_map(*(F.lit(x) for kv in G.ORDERING.items() for x in kv))
    sign = lambda e: F.element_at(table, e["relation"]) * F.when(e["direction"] == "reverse", -1).otherwise(1)
    signs = F.array_distinct(F.array_compact(F.transform(edges, sign)))
    said = F.exists(edges, lambda e: e["relation"] == "parallel_to")
    meets = F.forall(edges, lambda e: F.coalesce(e["precision"] == "day", F.lit(False))) & G.in_parallel(edges)
    return (
        F.when(F.size(signs) > 1, None).when(said & ~meets, None).when(F.size(signs) == 0, F.when(said, "parallel").otherwise("independent"))
        .when((signs[0] > 0) & G.in_sequence(edges), "sequence").when((signs[0] < 0) & G.in_reverse(edges), "reverse_sequence")
    )


def draw(*parts: Column | str | int) -> Column:
    """A whole number below 2^48 from a hash of the parts."""
    text = F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def _plain(edges: DataFrame) -> DataFrame:
    """(id, head, tail, relation, start, end, precision, kind) without loops; all edges are 'typed' where there is no such column."""
    kind = F.col("kind") if "kind" in edges.columns else F.lit("typed")
    precision = F.col("precision") if "precision" in edges.columns else F.lit("day")
    return edges.where(F.col("head") != F.col("tail")).select("id", "head", "tail", "relation", "start", "end", precision.alias("precision"), kind.alias("kind"))


def _counts() -> list[Column]:
    return [F.count(F.lit(1)).alias("degree"), F.count_if(F.col("kind") == "typed").alias("typed")]


def _few(rows: int) -> Callable[[DataFrame], DataFrame]:
    """A broadcast hint for tables of so many rows, unless they are more than WALKERS."""
    return F.broadcast if rows <= WALKERS else lambda df: df


def places(edges: DataFrame) -> DataFrame:
    """(node, degree, typed): all edges and the typed ones at each node, without loops."""
    return G.adjacency(_plain(edges), keep=["kind"]).groupBy("node").agg(*_counts())


def edges_at(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, next, EDGE, kind): the edges at each of ``nodes`` (node, of which some may stand several times) from there. Each direction is a branch of its own, so that nodes with a broadcast hint are joined where the edges
    are read and not after they were made."""
    plain = _plain(edges)
    ways = [plain.select(F.col(a).alias("node"), F.col(b).alias("next"), "id", "relation", "start", "end", "precision", F.lit(d).alias("direction"), "kind") for a, b, d in (("head", "tail", "forward"), ("tail", "head", "reverse"))]
    return ways[0].unionByName(ways[1]).join(nodes, "node", "left_semi")


def weighted_starts(nodes: DataFrame, draws: int, power: float = 1.0, seed: int = 42) -> DataFrame:
    """(draw, node): ``draws`` of ``nodes`` (node, degree) drawn with replacement, each with a chance in proportion to its degree to the power. Nodes lie one after another on a line, as long as
    their weights; a draw is a point of it, found by the part of the line that it falls in. Weights are whole numbers, in thousandths unless the power is 1."""
    weight = F.col("degree") if power == 1 else F.round(F.pow("degree", F.lit(float(power))) * 1000).cast("long")
    line, ranges = sums_before(nodes.select("node", weight.alias("weight")), [], ["node"], {"lo": F.col("weight")})
    total, n = ranges.agg(F.sum("weight"), F.count(F.lit(1))).first()
    spark = nodes.sparkSession
    if not total:
        return spark.createDataFrame([], nodes.select(F.lit(0).cast("long").alias("draw"), "node").schema)
    part = max(1, int(total // max(1, n)))  # about one node a part
    at = F.col("lo")
    cells = line.withColumn("cell", F.explode(F.sequence(F.expr(f"lo div {part}"), F.expr(f"(lo + weight - 1) div {part}"))))
    points = spark.range(draws).select(F.col("id").alias("draw"), F.pmod(draw(seed, "start", F.col("id")), F.lit(total)).alias("u")).withColumn("cell", F.expr(f"u div {part}"))
    out = cut(cells.join(_few(draws)(points), "cell").where((at <= F.col("u")) & (F.col("u") < at + F.col("weight"))).select("draw", "node"))
    drop(ranges)
    return out


def walks(edges: DataFrame, starts: DataFrame, hops: Sequence[int], seed: int = 42, typed_bias: float | None = None, lookups: int = LOOKUPS) -> DataFrame:
    """(hops, draw, nodes, edges, kinds): for each number of ``hops`` one self-avoiding walk of so many edges from each start (draw, node). Each step looks up the edges at ``lookups`` random
    numbers and takes the first that leads to an unvisited node; a walker without one ends. The edges of a node are numbered from 0: typed ones (``kind`` 'typed', all where there is no such
    column) before others, then by id. With ``typed_bias`` a step keeps to typed edges with that chance, where the node has any. ``kinds``: those of the edges."""
    edge = F.struct(*EDGE)
    empty = _plain(edges).withColumn("direction", F.lit("")).select(F.array(edge).alias("x")).schema["x"].dataType
    at, out = cut(starts.select("draw", F.array("node").alias("nodes"), F.array().cast(empty).alias("edges"), F.array().cast("array<string>").alias("kinds"), "node")), []
    few = _few(at.count() * lookups)
    for step in range(max(hops)):
        near = edges_at(edges, few(at.select("node")))
        key = F.concat_ws(":", F.when(F.col("kind") == "typed", "0").otherwise("1"), "id", "direction")
        by_no, near = sums_before(near.withColumn("_key", key), ["node"], ["_key"], {"no": F.lit(1).cast("long")})
        among = F.col("degree")
        if typed_bias is not None:
            keeps = draw(seed, "typed", step, F.col("draw")) < int(typed_bias * 2**48)
            among = F.when(keeps & (F.col("typed") > 0), F.col("typed")).otherwise(among)
        degrees = near.groupBy("node").agg(*_counts())
        asked = degrees.join(few(at), "node").select("draw", "nodes", "edges", "kinds", "node", among.alias("among"), F.explode(F.array(*map(F.lit, range(lookups)))).alias("try"))
        asked = asked.withColumn("no", F.pmod(draw(seed, "step", step, F.col("draw"), F.col("try")), "among")).drop("among")
        found = by_no.join(few(asked), ["node", "no"]).where(~F.array_contains("nodes", F.col("next")))
        took = found.groupBy("draw").agg(F.min_by(F.struct("nodes", "edges", "kinds", "next", edge.alias("edge"), "kind"), "try").alias("x"))
        at = cut(took.select("draw", *(F.array_append(f"x.{c}s", F.col(f"x.{x}")).alias(f"{c}s") for c, x in (("node", "next"), ("edge", "edge"), ("kind", "kind"))), F.col("x.next").alias("node")))
        drop(near)
        if step + 1 in hops:
            out.append(at.select(F.lit(step + 1).alias("hops"), "draw", "nodes", "edges", "kinds"))
    return reduce(DataFrame.unionByName, out)


def sample_paths(edges: DataFrame, types: DataFrame | Column, hops: int, paths: int, power: float = 1.0, seed: int = 42, strategy: str | None = None, tries: int = TRIES) -> DataFrame:
    """``samples`` of one number of edges."""
    return samples(edges, types, [hops], paths, power, seed, strategy, tries).drop("hops")


def samples(edges: DataFrame, types: DataFrame | Column, hops: Sequence[int], paths: int, power: float = 1.0, seed: int = 42, strategy: str | None = None, tries: int = TRIES) -> DataFrame:
    """(hops, path_id, draw, nodes, edges, strategy, mode, reference_date): for each number of ``hops`` up to ``paths`` different accepted paths. ``types``: node, type, or the type as a column of
    node. A start is drawn for each path; of its ``tries`` walks the first that serves a strategy (the one asked for, or one drawn among those it serves) and whose days agree with its relations
    is taken, as the first acceptable path of a search in random order would be. A path is known by its edges; of equal ones the first draw stays."""
    starts = weighted_starts(places(edges), paths, power, seed)
    each = starts.withColumn("draw", F.explode(F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), lambda t: F.col("draw") * tries + t)))
    first = _first(accepted(walks(edges, each, hops, seed), types, strategy, seed).withColumn("start", F.expr(f"draw div {tries}")), ["hops", "start"])
    return _first(first.drop("start"), ["hops", "path_id"])


def _first(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    cols = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*cols), "draw").alias("_x")).select(*keys, "_x.*").select(*df.columns)


def accepted(found: DataFrame, types: DataFrame | Column, strategy: str | None = None, seed: int = 42) -> DataFrame:
    """The walks of ``found`` that are accepted, with path_id, strategy, mode and reference_date."""
    each = found.select("hops", "draw", "nodes", "edges", F.explode("nodes").alias("node"))
    typed = each.withColumn("type", types) if isinstance(types, Column) else each.join(types.select("node", "type"), "node", "left")
    of = typed.groupBy("hops", "draw").agg(F.first("nodes").alias("nodes"), F.first("edges").alias("edges"), F.collect_set("type").alias("types"))
    tags = strategies(F.col("types"), F.col("edges"))
    one = F.when(F.array_contains("tags", F.lit(strategy)), F.lit(strategy)) if strategy else F.when(F.size("tags") > 0, F.get("tags", F.pmod(draw(seed, "strategy", F.col("draw")), F.size("tags"))))
    out = of.withColumn("tags", tags).withColumn("strategy", one).withColumn("mode", path_mode(F.col("edges"))).where("strategy is not null and mode is not null")
    path_id = F.concat(F.lit("path_"), F.substring(F.sha2(F.array_join(F.array_sort(F.transform("edges", lambda e: e["id"])), "|"), 256), 1, 20))
    return out.select("hops", path_id.alias("path_id"), "draw", "nodes", "edges", "strategy", "mode", F.array_max(F.transform("edges", lambda e: e["end"])).alias("reference_date"))


def typed_walks(edges: DataFrame, hops: int, paths: int, seed: int = 42, typed_bias: float = 0.8, restarts: int = TRIES) -> DataFrame:
    """``typed_samples`` of one number of edges."""
    return typed_samples(edges, [hops], paths, seed, typed_bias, restarts).drop("hops")


def typed_samples(edges: DataFrame, hops: Sequence[int], paths: int, seed: int = 42, typed_bias: float = 0.8, restarts: int = TRIES) -> DataFrame:
    """(hops, draw, nodes, edges, typed_edges): for each number of ``hops`` up to ``paths`` different walks over edges of ``kind`` 'typed' and others. Starts are nodes with a typed edge with the chance
    ``typed_bias``, else any; steps keep to typed edges with the same chance. Of the ``restarts`` walks of a path the first that gets through is taken; walks over the same nodes and edges count
    once."""
    spark, has = edges.sparkSession, (F.col("typed") > 0).cast("long")
    line, ranges = sums_before(places(edges).select("node", has.alias("has")), [], ["node"], {"all_no": F.lit(1).cast("long"), "typed_no": F.col("has")})
    n, m = ranges.agg(F.count(F.lit(1)), F.count_if(F.col("has") > 0)).first()
    points = spark.range(paths * restarts).select(F.col("id").alias("draw"), ((draw(seed, "pool", F.col("id")) < int(typed_bias * 2**48)) & F.lit(m > 0)).alias("from_typed"))
    points = points.withColumn("u", F.pmod(draw(seed, "start", F.col("draw")), F.when(F.col("from_typed"), F.lit(max(1, m))).otherwise(F.lit(max(1, n)))))
    pool = line.select("node", F.explode(F.array(F.struct(F.lit(False).alias("from_typed"), F.col("all_no").alias("u")), F.struct(F.lit(True).alias("from_typed"), F.when(F.col("has") > 0, F.col("typed_no")).alias("u")))).alias("k"))
    starts = cut(pool.select("node", "k.from_typed", "k.u").join(_few(paths * restarts)(points), ["from_typed", "u"]).select("draw", "node"))
    drop(ranges)

    through = _first(walks(edges, starts, hops, seed, typed_bias).withColumn("path", F.expr(f"draw div {restarts}")), ["hops", "path"])
    same = F.sha2(F.concat_ws("|", F.array_sort("nodes"), F.array_sort(F.transform("edges", lambda e: e["id"]))), 256)
    typed = F.size(F.filter("kinds", lambda k: k == "typed")).cast("long")
    return _first(through.withColumn("same", same), ["hops", "same"]).select("hops", "draw", "nodes", "edges", typed.alias("typed_edges"))


def ranked_paths(edges: DataFrame, seeds: DataFrame, hops: int, budget: int = 8, fan: int = 6, most_gap: int = 24, most_span: int = 120, rare_nodes: DataFrame | None = None, least_rare: int = 0) -> DataFrame:
    """(seed, nodes, edges, dated, least_gap, span): the best ``budget`` paths of ``hops`` edges from each seed (node). A path is prolonged by the ``fan`` best edges of its last node: dated ones first,
    those nearest in months to its last edge, those of rarer relations, then by id. Paths with fewer than two dates, with no two dates within ``most_gap`` months, with dates over more than
    ``most_span`` months, or with fewer than ``least_rare`` of ``rare_nodes`` are left out; paths with the same nodes and relations count once. ``date`` is a partial date or null; a column
    ``month``, months since year 0, may stand for it.

    A step reads the edges and keeps those at the nodes where paths end, each node's in one row by month, and a path picks among its node's row; so paths are never multiplied by edges. A step of
    many edges goes over the nodes in rounds, and the last one holds only the best paths so far between them: all edges are read, and the disk holds those of one round."""
    spark = edges.sparkSession
    month = F.col("month") if "month" in edges.columns else month_number(F.substring("date", 1, 7))
    plain = edges.select("id", "head", "tail", "relation", month.cast("int").alias("month"))
    ways = reduce(DataFrame.unionByName, (plain.select(F.col(a).alias("node"), F.col(b).alias("next"), "id", "relation", "month", F.lit(d).alias("direction")) for a, b, d in (("head", "tail", "forward"), ("tail", "head", "reverse"))))
    edge = "array<struct<id:string,relation:string,month:int,direction:string>>"
    with setting(spark, **REMOVED):
        some = F.collect_list(F.when(F.pmod(F.xxhash64("id"), F.lit(SOME)) == 0, F.array("head", "tail")))
        counts = cut(plain.where(F.col("head") != F.col("tail")).groupBy("relation").agg(F.count(F.lit(1)).alias("freq"), some.alias("some")))
        freq, some = small(counts.select("relation", "freq"), 10_000), counts.select(F.explode(F.flatten("some")).alias("node"))
        paths = stored(seeds.select(F.array("node").alias("nodes"), F.array().cast(edge).alias("edges")))
        best = None
        for step in range(hops):
            marked = _marked(paths.select(F.element_at("nodes", -1).alias("node")))
            near = ways.where(marked).where(F.col("node") != F.col("next"))
            rounds, hub = _rounds(some.where(marked))
            out = []
            for k in range(rounds):
                turn = F.pmod(F.shiftrightunsigned(F.xxhash64("node"), 54), F.lit(rounds)) == k
                at = _by_month((near.where(turn) if rounds > 1 else near).join(freq, "relation"), fan, hops, hub)
                here = paths.withColumn("node", F.element_at("nodes", -1))
                longer = _longer((here.where(turn) if rounds > 1 else here).withColumn("_h", F.xxhash64("node")).join(at, ["_h", "node"]), fan)
                if step + 1 < hops:
                    with setting(spark, **SORTED):
                        out.append(stored(longer))
                    continue
                found = _fitting(longer, most_gap, most_span, rare_nodes, least_rare)
                with setting(spark, **SORTED):
                    last, best = best, stored(_best(found if best is None else found.unionByName(best), budget))
                if last is not None:
                    unstore(last)
            unstore(paths)
            if out:
                paths = reduce(DataFrame.unionByName, out)
    return best.select("seed", "nodes", "edges", "dated", "least_gap", "span")


def _marked(nodes: DataFrame) -> Column:
    """Whether ``node`` may be one of ``nodes``: its two bits are set in a table of bits, at most MARKS words. It is a condition on the node alone, so the plan applies it where edges are read, before
    they are merged or shuffled; nodes whose bits are those of others are left to the join."""
    words = min(MARKS, 1 << max(0, (nodes.count() // 4).bit_length()))
    h = F.xxhash64("node")
    places = [x.bitwiseAND(F.lit(words * 64 - 1)) for x in (h, F.shiftrightunsigned(h, 30))]
    word, bit = lambda x: F.shiftright(x, 6), lambda x: x.bitwiseAND(F.lit(63)).cast("int")
    set_ = nodes.select(F.explode(F.array(*places)).alias("x")).select(word(F.col("x")).alias("id"), F.expr("shiftleft(1L, cast(x & 63 as int))").alias("w")).groupBy("id").agg(F.bit_or("w").alias("w"))
    all_ = nodes.sparkSession.range(words).join(set_, "id", "left").select(F.struct("id", F.coalesce("w", F.lit(0).cast("long")).alias("w")).alias("x"))
    bits = cut(all_.agg(F.sort_array(F.collect_list("x"))["w"].alias("bits"))).scalar()
    return reduce(lambda a, b: a & b, (F.getbit(F.get(bits, word(x).cast("int")), bit(x)) == 1 for x in places))


def _rounds(some: DataFrame) -> tuple[int, bool]:
    """How many rounds keep each under ROUND edges, and whether a node has so many that they are cut before they come together. Both are guessed from the ends of one edge in SOME; they say how the
    work is dealt out and nothing about its result."""
    n, most = some.groupBy("node").count().agg(F.sum("count"), F.max("count")).first()
    return max(1, -(-SOME * (n or 0) // ROUND)), (most or 0) >= HUB


def _by_month(near: DataFrame, fan: int, hops: int, hub: bool) -> DataFrame:
    """(_h, node, dated, undated, months): the edges of each node by month, then freq, id and direction, and the months of the dated ones. Where there are hubs, of a month only those that some path can choose, ``fan`` to one node and of
    these the first ``fan`` times ``hops``, as a path leaves out fewer nodes than ``hops``; so a hub costs its months and not its edges. The hash comes first in sorts, as names begin alike."""
    for by, n in ((("node", "month", "next"), fan), (("node", "month"), fan * hops)) if hub else ():
        near = near.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy("freq", "id", "direction"))).where(F.col("_rn") <= n).drop("_rn")
    x = F.struct("month", "freq", "id", "direction", "relation", "next")
    lists = (F.sort_array(F.collect_list(F.when(c, x))).alias(name) for c, name in ((F.col("month").isNotNull(), "dated"), (F.col("month").isNull(), "undated")))
    return near.withColumn("_h", F.xxhash64("node")).repartition("_h", "node").groupBy("_h", "node").agg(*lists).withColumn("months", F.col("dated.month"))


def _longer(at: DataFrame, fan: int) -> DataFrame:
    """(nodes, edges) of paths ``at`` nodes with their edges, each prolonged by the ``fan`` best edges. Where the month of the last edge has enough of them these are the best, in order; else the
    ``fan`` nearest months are found first and only their edges sorted."""
    let = lambda value, body: F.get(F.transform(F.array(value), body), 0)
    last = F.get(F.col("edges"), F.size("edges") - 1)["month"]
    new = lambda x: ~F.array_contains("nodes", x["next"])
    tight = lambda x: F.coalesce(F.abs(x["month"] - last), F.lit(10**6))
    order = lambda x: F.struct(x["month"].isNull().alias("un"), tight(x).alias("tight"), x["freq"].alias("freq"), x["id"].alias("id"), x["direction"].alias("direction"), x["relation"].alias("relation"), x["next"].alias("next"), x["month"].alias("month"))
    edge = lambda x: F.struct(x["id"].alias("id"), x["relation"].alias("relation"), x["month"].alias("month"), x["direction"].alias("direction"))
    near = lambda u: let(F.get(F.sort_array(F.transform(u, tight)), F.lit(fan - 1)), lambda t: F.filter(u, lambda x: t.isNull() | (tight(x) <= t)))
    whole = let(F.filter(F.concat("dated", "undated"), new), lambda u: F.slice(F.sort_array(F.transform(near(u), order)), 1, fan))
    pick = lambda xs: F.transform(xs, lambda x: F.struct(edge(x).alias("edge"), x["next"].alias("next")))
    first = F.array_position("months", last)
    month = F.when(first > 0, F.filter(F.slice("dated", F.greatest(first, F.lit(1)).cast("int"), 2 * fan + 2), lambda x: (x["month"] == last) & new(x)))
    best = F.when(F.coalesce(F.size(month), F.lit(-1)) >= fan, pick(F.slice(month, 1, fan))).otherwise(pick(whole))
    return at.select("nodes", "edges", F.explode(best).alias("x")).select(F.array_append("nodes", F.col("x.next")).alias("nodes"), F.array_append("edges", F.col("x.edge")).alias("edges"))


def _fitting(paths: DataFrame, most_gap: int, most_span: int, rare_nodes: DataFrame | None, least_rare: int) -> DataFrame:
    """(seed, nodes, edges, dated, least_gap, span) of the paths whose dates and rare nodes are as asked for."""
    months = F.sort_array(F.array_compact(F.col("edges.month")))
    out = paths.select(F.get("nodes", 0).alias("seed"), "nodes", "edges", months.alias("months")).withColumn("dated", F.size("months")).where("dated >= 2")
    gaps = F.zip_with(F.slice("months", 1, F.col("dated") - 1), F.slice("months", 2, F.col("dated") - 1), lambda a, b: b - a)
    out = out.withColumn("least_gap", F.array_min(gaps)).withColumn("span", F.element_at("months", -1) - F.col("months")[0]).where((F.col("least_gap") <= most_gap) & (F.col("span") <= most_span))
    if rare_nodes is not None and least_rare > 0:
        held = out.select("seed", "nodes", F.explode("nodes").alias("node")).join(rare_nodes.select("node").distinct(), "node", "left_semi").groupBy("seed", "nodes").agg(F.count_distinct("node").alias("rare")).where(F.col("rare") >= least_rare)
        out = out.join(held.select("seed", "nodes"), ["seed", "nodes"], "left_semi")
    return out.drop("months")


def _best(found: DataFrame, budget: int) -> DataFrame:
    """The best ``budget`` of the paths of each seed, of those with the same nodes and relations the first. The best of any parts' best are those of the whole."""
    name = F.transform("edges", lambda e: F.concat(e["id"], F.lit(":"), e["direction"]))
    same = F.concat_ws("|", F.sort_array("nodes"), F.sort_array(F.col("edges.relation")))
    of = found.withColumn("_h", F.xxhash64("seed")).repartition("_h", "seed").withColumns({"_same": same, "_n": F.array_join("nodes", "|"), "_e": F.array_join(name, "|")})
    for by, n in ((("_h", "seed", "_same"), 1), (("_h", "seed"), budget)):
        of = of.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy("least_gap", "span", "_n", "_e"))).where(F.col("_rn") <= n)
    return of.select(*found.columns)
