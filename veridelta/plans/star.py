"""Graph and interval operators over the star schema: orders, their parts and suppliers as a temporal graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridelta.functions.nums import magnitude_step
from veridelta.operators import graph as G
from veridelta.operators import rank as R
from veridelta.plans.registry import query
from veridelta.session import cut, read

_EDGES = """
kg as (select 'p:' || o_orderkey id, 'order:' || o_orderkey head, 'placed_by' relation, 'customer:' || o_custkey tail, cast(o_orderdate as date) s, cast(o_orderdate as date) t from orders
 union all select 'c:' || l_orderkey || ':' || l_partkey, 'order:' || l_orderkey, 'contains', 'part:' || l_partkey, cast(min(l_shipdate) as date), cast(max(l_shipdate) as date) from lineitem group by l_orderkey, l_partkey
 union all select 's:' || l_orderkey || ':' || l_suppkey, 'order:' || l_orderkey, 'supplied_by', 'supplier:' || l_suppkey, cast(min(l_shipdate) as date), cast(max(l_shipdate) as date) from lineitem group by l_orderkey, l_suppkey)
"""


def _kg(spark: SparkSession, sf_dir: str, by_order: bool = False) -> DataFrame:
    """(id, head, relation, tail, start, end). ``by_order``: an order's edges lie in one task, so counts at its ends combine before they are shuffled."""
    o, line = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    if by_order:
        line = line.repartition("l_orderkey")
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    placed = o.select(name("p", "o_orderkey").alias("id"), name("order", "o_orderkey").alias("head"), F.lit("placed_by").alias("relation"), name("customer", "o_custkey").alias("tail"), F.to_date("o_orderdate").alias("start"), F.to_date("o_orderdate").alias("end"))

    def grouped(key: str, short: str, relation: str, kind: str) -> DataFrame:
        g = line.groupBy("l_orderkey", key).agg(F.to_date(F.min("l_shipdate")).alias("start"), F.to_date(F.max("l_shipdate")).alias("end"))
        return g.select(F.concat(name(short, "l_orderkey"), F.lit(":"), F.col(key).cast("string")).alias("id"), name("order", "l_orderkey").alias("head"), F.lit(relation).alias("relation"), name(kind, key).alias("tail"), "start", "end")

    return placed.unionByName(grouped("l_partkey", "c", "contains", "part")).unionByName(grouped("l_suppkey", "s", "supplied_by", "supplier"))


@query("with " + _EDGES + 'select relation, count(*) n, min(s) "start", max(t) "end", cast(sum(t - s) as bigint) "days" from kg group by 1')
def star_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _kg(spark, sf_dir)
    return e.groupBy("relation").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum(F.datediff("end", "start")).alias("days"))


@query("with " + _EDGES + "select node, count(*) degree from (select unnest([head, tail]) node from kg) group by 1 order by degree desc, node limit 25")
def star_degree_top25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.hubs(_kg(spark, sf_dir), 25)


@query("with " + _EDGES + ", h as (select node from (select unnest([head, tail]) node from kg) group by 1 order by count(*) desc, node limit 15) select relation, count(*) n from kg where head not in (select node from h) and tail not in (select node from h) group by 1")
def hub_excluded_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by relation without those at the 15 largest hubs."""
    return G.without_hubs(_kg(spark, sf_dir), 15).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@query("with recursive " + _EDGES + """, adj as (select distinct head node, tail nxt from kg union select distinct tail, head from kg), top as (select node from (select unnest([head, tail]) node from kg) group by 1 order by count(*) desc, node limit 1),
d0 as (select node from top), d1 as (select distinct nxt node from d0 join adj using (node) where nxt not in (select node from d0)), d2 as (select distinct nxt node from d1 join adj using (node) where nxt not in (select node from d0) and nxt not in (select node from d1))
select depth, count(*) n from (select 0 depth, node from d0 union all select 1, node from d1 union all select 2, node from d2) group by 1""")
def depth_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by distance from the largest hub, to depth 2."""
    e = cut(_kg(spark, sf_dir).select("head", "tail"))
    return G.depth_layers(e, G.hubs(e, 1), 2).groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


_SEEDS = "seeds as (select 'customer:' || c_custkey node from customer)"


@query("with " + _EDGES.replace("kg as (", "kg as materialized (") + ", " + _SEEDS + """, adj as materialized (select id, s, t, head node, tail nxt from kg union all select id, s, t, tail, head from kg),
a as (select seeds.node n0, adj.nxt, adj.s, adj.t from seeds join adj on seeds.node = adj.node)
select n0, count(*) n, count(*) filter (where greatest(a.s, b.s) <= least(a.t, b.t)) meeting, min(least(a.s, b.s)) "start", max(greatest(a.t, b.t)) "end" from a join adj b on b.node = a.nxt where b.nxt <> a.n0 group by 1""")
def paths_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each customer the simple paths of two edges: their number, how many are of edges whose days meet, and the window over all."""
    seeds = read(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("node"))
    p = G.simple_paths(_kg(spark, sf_dir), seeds, 2)
    w = G.path_window(F.col("edges"))
    one = p.select(F.get("nodes", 0).alias("n0"), G.in_parallel(F.col("edges")).alias("meets"), w["start"].alias("start"), w["end"].alias("end"))
    return one.groupBy("n0").agg(F.count(F.lit(1)).alias("n"), F.count_if("meets").alias("meeting"), F.min("start").alias("start"), F.max("end").alias("end"))


@query("with " + _EDGES + ", " + _SEEDS + """, adj as (select * from (select *, row_number() over (partition by node order by sha256('42:' || id), id) rn from (select id, s, t, head node, tail nxt from kg union all select id, s, t, tail, head from kg)) where rn <= 6),
p as (select a.s s1, b.s s2, c.s s3, a.t t1, b.t t2, c.t t3 from seeds join adj a using (node) join adj b on b.node = a.nxt join adj c on c.node = b.nxt where b.nxt <> a.node and c.nxt <> a.node and c.nxt <> a.nxt)
select case when greatest(s1, s2) <= least(t1, t2) and greatest(s2, s3) <= least(t2, t3) then 'parallel' when s1 <= s2 and s2 <= s3 then 'sequence' when s1 >= s2 and s2 >= s3 then 'reverse_sequence' else 'independent' end "mode", count(*) n from p group by 1""")
def paths_3hop_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temporal modes of the paths of three edges from the customers, sampled by six edges a node."""
    seeds = read(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("node"))
    p = G.simple_paths(_kg(spark, sf_dir), seeds, 3, width=6)
    return p.select(G.temporal_mode(F.col("edges")).alias("mode")).groupBy("mode").agg(F.count(F.lit(1)).alias("n"))


@query("""with f as (select l_partkey, l_suppkey, l_returnflag = 'R' neg, cast(l_shipdate as date) s, cast(l_shipdate as date) + 30 t, l_orderkey || ':' || l_linenumber || ':' || l_quantity::bigint k from lineitem),
d as (select distinct l_partkey, l_suppkey, case when neg then 'negative' else 'positive' end pol, s, t, k from f)
select a.l_partkey partkey, count(*) n from d a join d b on a.l_partkey = b.l_partkey and a.l_suppkey = b.l_suppkey and a.pol < b.pol and a.s <= b.t and b.s <= a.t group by 1""")
def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments of a part by a supplier that were kept and returned within overlapping thirty days, by part."""
    k = F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("long").cast("string"))
    s = F.to_date("l_shipdate")
    d = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", F.when(F.col("l_returnflag") == "R", "negative").otherwise("positive").alias("pol"), s.alias("s"), F.date_add(s, 30).alias("t"), k.alias("k")).distinct()
    pairs = G.contradictions(d.withColumn("key", F.struct("l_partkey", "k")), ["l_partkey", "l_suppkey"], "key", "pol", "s", "t")
    return pairs.groupBy(F.col("key_a.l_partkey").alias("partkey")).agg(F.count(F.lit(1)).alias("n"))


@query()
def supply_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the components of orders and suppliers that lineitems link."""
    e = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"))
    c = G.components(e)
    return c.groupBy("component").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("components"))


@query("""select o_custkey, count(*) n, min(gap) least_gap, max(gap) most_gap from (select o_custkey, date_diff('day', lag(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey), o_orderdate) gap from orders) group by 1""")
def order_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days between consecutive orders of each customer."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    g = F.datediff(F.to_date("o_orderdate"), F.to_date(F.lag("o_orderdate").over(w))).cast("long")
    return read(spark, sf_dir, "orders").select("o_custkey", g.alias("gap")).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.min("gap").alias("least_gap"), F.max("gap").alias("most_gap"))


@query("""select l_returnflag, l_linestatus, cast(sum(l_quantity) as double) quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue, round(avg(l_discount), 6) discount, count(*) n from lineitem where l_shipdate <= date '1998-09-02' group by 1, 2""")
def line_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return df.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count(F.lit(1)).alias("n"))


@query("""select p_type, p, v[cast(round_even((n - 1) * p / 100e0, 0) as bigint) + 1] as "value" from (select p_type, count(*) n, list(p_retailprice order by p_retailprice) v from part group by 1), (select unnest([10, 50, 90]) p)""")
def price_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.percentiles(read(spark, sf_dir, "part").select("p_type", "p_retailprice"), ["p_type"], "p_retailprice", [10, 50, 90])


@query("""select l_partkey, step from (select l_partkey, case when abs(q) < 10 then 1 when abs(q) < 100 then 5 when abs(q) < 1000 then 25 else greatest(cast(floor(abs(q) / 10) as bigint), 1) end step from (select l_partkey, sum(l_quantity) q from lineitem group by 1))""")
def perturbation_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By how much the total quantity of each part would be moved when it is perturbed."""
    q = read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"))
    return q.select("l_partkey", magnitude_step(F.col("q")).alias("step"))


@query("""select n.n_name nation, count(distinct o_custkey) customers, count(*) orders, round(sum(o_totalprice), 2) total from orders o join customer c on o_custkey = c_custkey join nation n on c_nationkey = n_nationkey where o_orderdate >= date '1995-01-01' and o_orderdate < date '1996-01-01' group by 1""")
def nation_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").where((F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")))
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("nation"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("nation").agg(F.count_distinct("o_custkey").alias("customers"), F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""with l as (select l_orderkey, max(l_shipdate) done from lineitem group by 1) select o_orderpriority, count(*) n, count(l.done) shipped, count(*) filter (where l.done > o_orderdate + interval 90 days) late from orders left join l on o_orderkey = l_orderkey group by 1""")
def late_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by priority whose last shipment came more than ninety days after them."""
    done = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("done"))
    j = read(spark, sf_dir, "orders").join(done, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return j.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count("done").alias("shipped"), F.count_if(F.col("done") > F.col("o_orderdate") + F.expr("interval 90 days")).alias("late"))


@query("""select e.event_id, a.ts as_of, a.event_id as_of_id from events e asof left join (select * from events where event_type = (select min(event_type) from events)) a on e.user_id = a.user_id and e.ts > a.ts where e.event_type = (select max(event_type) from events)""")
def as_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each event of one type the user's last event of another type before it, by one window over both."""
    e = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    kept = e.withColumn("lo", e.agg(F.min("event_type")).scalar()).withColumn("hi", e.agg(F.max("event_type")).scalar()).where("event_type = lo or event_type = hi")
    left = F.when(F.col("event_type") == F.col("lo"), F.struct("ts", "event_id"))
    # rows at the same instant aren't before: the running maximum is taken over earlier rows only
    strict = Window.partitionBy("user_id").orderBy(F.col("ts"), F.when(F.col("event_type") == F.col("hi"), 0).otherwise(1), "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return kept.withColumn("a", F.max(left).over(strict)).where("event_type = hi").select("event_id", F.col("a.ts").alias("as_of"), F.col("a.event_id").alias("as_of_id"))
