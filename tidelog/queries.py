"""Queries of the incremental engine, one for each operator, and the same results as SQL.

Change logs: E are events (user, type) by day, errors retract; L are lineitems (supplier, quantity in hundredths)
by year of shipping, returned ones retract; O are orders (customer, status, price in cents) by year, filled
ones retracted a year later.  Graphs: G1 leads from each purchase's user to that of the next purchase, G2 from
each part key to its half.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.values import bucket, day_number
from .operators import nodes
from .operators.loops import Loop
from .operators.nodes import DIFF, Collection
from .plans import graph
from .plans.flow import Flow, Shard
from .sources.logs import from_table

EPOCH = "2024-01-01"
E_SQL = "e AS (SELECT user_id, event_type, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS t, CASE WHEN event_type = 'error' THEN -1 ELSE 1 END AS d FROM events)"
L_SQL = "l AS (SELECT l_suppkey, CAST(round(l_quantity * 100) AS BIGINT) AS qty, CAST(year(l_shipdate) AS BIGINT) AS t, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS d FROM lineitem)"
O_SQL = """o1 AS (SELECT o_custkey, o_orderstatus, CAST(round(o_totalprice * 100) AS BIGINT) AS price, CAST(year(o_orderdate) AS BIGINT) AS t FROM orders),
o AS (SELECT *, 1 AS d FROM o1 UNION ALL SELECT o_custkey, o_orderstatus, price, t + 1, -1 FROM o1 WHERE o_orderstatus = 'F')"""
G1_SQL = "g AS (SELECT DISTINCT user_id AS src, dst FROM (SELECT user_id, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events WHERE event_type = 'purchase') WHERE dst IS NOT NULL)"
G2_SQL = "g AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey >= 2)"
REACH_SQL = "r AS (SELECT src, dst FROM g UNION SELECT r.src, g.dst FROM r JOIN g ON r.dst = g.src)"
YEAR = 1998


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(column: str):
    return F.round(F.col(column) * 100).cast("long")


def events(spark: SparkSession, sf_dir: str) -> Collection:
    return from_table(table(spark, sf_dir, "events"), ["user_id", "event_type"], time=day_number(F.col("ts"), EPOCH), diff=F.when(F.col("event_type") == "error", -1).otherwise(1))


def shipped(spark: SparkSession, sf_dir: str) -> Collection:
    return from_table(table(spark, sf_dir, "lineitem"), ["l_suppkey", cents("l_quantity").alias("qty")], time=F.year("l_shipdate"), diff=F.when(F.col("l_returnflag") == "R", -1).otherwise(1))


def orders(spark: SparkSession, sf_dir: str) -> Collection:
    df = table(spark, sf_dir, "orders")
    step = F.explode(F.when(F.col("o_orderstatus") == "F", F.array(F.lit(1), F.lit(-1))).otherwise(F.array(F.lit(1))))
    df = df.select("o_custkey", "o_orderstatus", cents("o_totalprice").alias("price"), F.year("o_orderdate").cast("long").alias("year"), step.alias("d"))
    return from_table(df, ["o_custkey", "o_orderstatus", "price"], time=F.col("year") + F.when(F.col("d") < 0, 1).otherwise(0), diff="d")


def static(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> Collection:
    return from_table(table(spark, sf_dir, name), list(columns))


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of G1 with the day of the first of the two purchases, for each time that they occur.

    Purchases are put in order within their day, and the last of a day leads to the first of the next day that
    has any; only the first purchase of each day meets in one window.
    """
    df = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id", "ts", "event_id", day_number(F.col("ts"), EPOCH).alias("day"))
    firsts = df.groupBy("day").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("first"))
    after = firsts.select("day", F.lead("first").over(Window.orderBy("day")).alias("after"))
    within = df.withColumn("next", F.lead("user_id").over(Window.partitionBy("day").orderBy("ts", "event_id")))
    return within.join(F.broadcast(after), "day").select(F.col("user_id").alias("src"), F.coalesce("next", "after").alias("dst"), "day").where("dst IS NOT NULL")


def halves(spark: SparkSession, sf_dir: str) -> Collection:
    df = table(spark, sf_dir, "part").where("p_partkey >= 2")
    return from_table(df, [F.col("p_partkey").alias("src"), F.expr("p_partkey div 2").alias("dst")])


def closure(loop: Loop, edges: Collection) -> Collection:
    inside = loop.enter(edges)
    x = loop.variable("src long, dst long")
    step = x.map(F.col("dst").alias("mid"), F.col("src").alias("from")).join(inside.rename("mid", "to"), ["mid"]).map(F.col("from").alias("src"), F.col("to").alias("dst"))
    x.fixpoint(inside.union(step).distinct())
    return x


def bag(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed(DIFF, "diff")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q06(spark, sf_dir)


def q01(spark, d):
    return events(spark, d).to_df()


def q02(spark, d):
    return bag(events(spark, d).as_of(14))


def q03(spark, d):
    return events(spark, d).project(1).to_df()


def q04(spark, d):
    df = table(spark, d, "lineitem")
    x = from_table(df, ["l_suppkey", "l_extendedprice", "l_discount"], time=F.year("l_shipdate"))
    return x.map("l_suppkey", (cents("l_extendedprice") * (100 - cents("l_discount"))).alias("revenue")).to_df()


def q05(spark, d):
    return bag(shipped(spark, d).reduce(1, nodes.total("qty", "sum_qty"), empty_groups="drop").as_of(YEAR))


def q06(spark, d):
    """Revenue by nation and region of the supplier, as of a year: the flagship."""
    df = table(spark, d, "lineitem")
    revenue = (cents("l_extendedprice") * (100 - cents("l_discount"))).alias("revenue")
    sales = from_table(df, [F.col("l_suppkey").alias("s_suppkey"), revenue], time=F.year("l_shipdate"))
    by_nation = sales.join(static(spark, d, "supplier", "s_suppkey", "s_nationkey"), ["s_suppkey"]).project("s_nationkey", "revenue").rename("n_nationkey", "revenue")
    named = by_nation.join(static(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey"), ["n_nationkey"]).project("n_regionkey", "n_name", "revenue").rename("r_regionkey", "n_name", "revenue")
    placed = named.join(static(spark, d, "region", "r_regionkey", "r_name"), ["r_regionkey"]).project("r_name", "n_name", "revenue")
    return bag(placed.reduce(2, nodes.total("revenue", "revenue"), empty_groups="drop").as_of(YEAR)).drop("diff")


def q07(spark, d):
    customers = from_table(table(spark, d, "customer"), [F.col("c_custkey").alias("o_custkey"), "c_mktsegment"], time=F.lit(1990) + F.col("c_custkey") % 10)
    return orders(spark, d).project("o_custkey", "o_orderstatus").join(customers, 1).to_df()


def q08(spark, d):
    x = orders(spark, d).project("o_custkey", "o_orderstatus").index()
    return x.join(x, 1).rename("o_custkey", "status", "other_status").to_df()


def q09(spark, d):
    return static(spark, d, "region", "r_name").join(static(spark, d, "nation", "n_name"), 0).to_df()


def q10(spark, d):
    df = table(spark, d, "lineitem")
    x = from_table(df, ["l_partkey", "l_suppkey", "l_returnflag"], time=F.year("l_shipdate"))
    y = from_table(df, ["l_partkey", "l_suppkey", "l_linenumber"], time=F.year("l_shipdate"))
    return x.join(y, 2).to_df()


def q11(spark, d):
    return orders(spark, d).project("o_custkey").rename("custkey").union(static(spark, d, "customer", "c_custkey")).to_df()


def q12(spark, d):
    return bag(orders(spark, d).project("o_custkey").rename("custkey").union(static(spark, d, "customer", "c_custkey")).index(keep=False).distinct().as_of(1995))


def q13(spark, d):
    return orders(spark, d).project("o_custkey").distinct().to_df()


def q14(spark, d):
    return events(spark, d).distinct().to_df()


def q15(spark, d):
    x = events(spark, d).index()
    kinds = x.distinct().reduce(1, nodes.count("kinds"), empty_groups="drop")
    return bag(kinds.join(x.reduce(1, nodes.count("n"), empty_groups="drop"), 1).as_of(14))


def q16(spark, d):
    flow = Flow(spark)
    given = flow.input("user_id long, event_type string")
    out = flow.output(given.distinct())
    flow.build()
    given.push_frame(events(spark, d).changes())
    given.advance(10)
    flow.do_all_work()
    batch = out.pop()
    return batch.withColumnsRenamed({"__t0": "t", DIFF: "diff"})


def q17(spark, d):
    return shipped(spark, d).reduce(1, nodes.total("qty", "sum_qty"), empty_groups="drop").to_df()


def q18(spark, d):
    return orders(spark, d).project("o_orderstatus", "o_custkey").reduce(1, nodes.count("n"), empty_groups="drop").to_df()


def q19(spark, d):
    return orders(spark, d).project("o_custkey", "price").reduce(1, nodes.maximum("price", "max_price"), empty_groups="drop").to_df()


def q20(spark, d):
    named = static(spark, d, "customer", "c_nationkey", "c_mktsegment").join(static(spark, d, "nation", "n_nationkey", "n_name").rename("c_nationkey", "n_name"), ["c_nationkey"])
    return bag(named.project("c_mktsegment", "n_name").index(keep=False).distinct().reduce(1, nodes.concatenation("n_name", "nations"), empty_groups="drop").as_of(0)).drop("diff")


def q21(spark, d):
    return shipped(spark, d).reduce(0, nodes.total("qty", "sum_qty"), empty_groups="drop").to_df()


def q22(spark, d):
    """Customers' counts of filled orders as of a year: 0 for who has none left, and with drop no row (-1 here)."""
    x = orders(spark, d).filter("o_orderstatus = 'F'").project("o_custkey", "price")
    keep = x.reduce(1, nodes.count("n_init")).as_of(YEAR).select("o_custkey", "n_init")
    drop = x.reduce(1, nodes.count("n_drop"), empty_groups="drop").as_of(YEAR).select("o_custkey", "n_drop")
    return keep.join(drop, "o_custkey", "left").na.fill(-1, ["n_drop"])


def q23(spark, d):
    loop = Loop(spark)
    return loop.leave(closure(loop, halves(spark, d))).as_of(0).drop(DIFF)


def q24(spark, d):
    loop = Loop(spark)
    return loop.leave(closure(loop, from_table(purchases(spark, d), ["src", "dst"]))).as_of(0).drop(DIFF)


def q25(spark, d):
    """How reachability changes when all edges but those of the first day retire."""
    df = purchases(spark, d).withColumn("step", F.explode(F.when(F.col("day") == 0, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    loop = Loop(spark)
    return loop.leave(closure(loop, from_table(df, ["src", "dst"], time="step", diff=F.when(F.col("step") == 0, 1).otherwise(-1)))).to_df()


def q26(spark, d):
    """Least number of steps from the least user of G1 to each user."""
    edges = from_table(purchases(spark, d).distinct(), ["src", "dst"])
    loop = Loop(spark)
    inside = loop.enter(edges)
    start = inside.map("src").reduce(0, nodes.minimum("src", "node"), empty_groups="drop").map("node", F.lit(0).cast("long").alias("steps"))
    x = loop.variable("node long, steps long")
    step = x.join(inside.rename("node", "dst"), ["node"]).map(F.col("dst").alias("node"), (F.col("steps") + 1).alias("steps"))
    x.fixpoint(start.union(step).reduce(1, nodes.minimum("steps", "steps"), empty_groups="drop"))
    return loop.leave(x).as_of(0).drop(DIFF)


def q27(spark, d):
    """In which round each pair of G2 is found."""
    loop = Loop(spark)
    return loop.trace(closure(loop, halves(spark, d))).withColumnsRenamed({"__t0": "t", "__t1": "round", DIFF: "diff"})


def q28(spark, d):
    return events(spark, d).filter("event_type IN ('purchase', 'error')").to_df()


def q29(spark, d):
    everyone = static(spark, d, "customer", "c_custkey", "c_mktsegment")
    open_ = orders(spark, d).filter("o_orderstatus = 'O'").project("o_custkey", "price")
    semi = bag(everyone.semi_join(open_.rename("c_custkey", "price"), ["c_custkey"]).as_of(1995)).withColumn("kind", F.lit("semi"))
    anti = bag(everyone.anti_join(open_.rename("c_custkey", "price"), ["c_custkey"]).as_of(1995)).withColumn("kind", F.lit("anti"))
    return semi.union(anti)


def q30(spark, d):
    by = lambda s: orders(spark, d).filter(F.col("o_orderstatus") == s).project("o_custkey")
    both = bag(by("O").intersect(by("F")).as_of(1995)).withColumn("kind", F.lit("intersect"))
    return both.union(bag(by("O").difference(by("F")).as_of(1995)).withColumn("kind", F.lit("except")))


def q31(spark, d):
    df = table(spark, d, "events")
    hour = F.floor(F.unix_timestamp(bucket(F.col("ts"), "hour")) / 3600).cast("long").alias("hour")
    return from_table(df, ["event_type", hour]).reduce(2, nodes.count("n"), empty_groups="drop").to_df().drop("t", "diff")


def q32(spark, d):
    """Every order moves its price from its customer to one of seven accounts; the balances (row 0: all) add up to 0."""
    moves = orders(spark, d)
    df = moves.map(F.col("o_custkey").alias("src"), (-F.pmod("o_custkey", F.lit(7)) - 1).alias("dst"), "price")
    credit = df.project("dst", "price").rename("account", "price")
    debit = df.map(F.col("src").alias("account"), (-F.col("price")).alias("price"))
    balance = credit.union(debit).reduce(1, nodes.total("price", "balance"))
    whole = balance.project("balance").reduce(0, nodes.total("balance", "balance")).map(F.lit(0).cast("long").alias("account"), "balance")
    return bag(balance.union(whole).as_of(1995)).drop("diff")


def q33(spark, d):
    """The three dearest live orders of each status at each time."""
    return orders(spark, d).map("o_orderstatus", "price", "o_custkey").top(1, 3, F.desc("price")).to_df()


def q34(spark, d):
    return events(spark, d).compact(20).to_df()


def q35(spark, d):
    """Average quantity of suppliers' lines at each time, as changes."""
    out = shipped(spark, d).reduce(1, nodes.total("qty", "total"), nodes.count("n"), nodes.average("qty", "mean"), empty_groups="drop")
    return out.map("l_suppkey", "n", F.floor("mean").cast("long").alias("mean")).to_df()


def rich(spark, d):
    """Customers, and big orders as a right side."""
    big = orders(spark, d).filter("price > 40000000").map("o_custkey", "price").distinct()
    return static(spark, d, "customer", "c_custkey", "c_nationkey").filter("c_custkey % 3 <> 0").rename("o_custkey", "c_nationkey"), big


def q36(spark, d):
    left, right = rich(spark, d)
    return left.outer_join(right, 1).rename("custkey", "nation", "price").to_df()


def q37(spark, d):
    left, right = rich(spark, d)
    return bag(left.outer_join(right, 1, how="full").rename("custkey", "nation", "price").as_of(1996))


def q38(spark, d):
    """Parts whose size lies within a supplier's band, by buckets."""
    parts = static(spark, d, "part", "p_partkey", "p_size")
    bands = from_table(table(spark, d, "supplier"), ["s_suppkey", (F.col("s_suppkey") % 50).cast("int").alias("low"), (F.col("s_suppkey") % 50 + F.col("s_suppkey") % 4).cast("int").alias("high")])
    return bag(parts.range_join(bands, "p_size", "low", "high", 5).as_of(0)).drop("diff")


def second(column: str = "ts"):
    return F.unix_timestamp(F.date_trunc("second", F.col(column))).alias("sec")


def q39(spark, d):
    """Each error with the last purchase of its user before it, as known on each day."""
    kind = lambda k, n: from_table(table(spark, d, "events").where(F.col("event_type") == k), ["user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias(n)], time=day_number(F.col("ts"), EPOCH))
    return bag(kind("error", "at").as_of_join(kind("purchase", "bought"), 1, "at", "bought").as_of(20)).drop("diff")


def q40(spark, d):
    """Sliding windows: events of each type in 2 days, every day, as of days."""
    x = from_table(table(spark, d, "events"), ["event_type", second()], time=day_number(F.col("ts"), EPOCH))
    return x.windows("sec", 172_800, 86_400).project("event_type", "window").reduce(2, nodes.count("n"), empty_groups="drop").to_df()


def q41(spark, d):
    """Sessions of users with gaps of at most two days, as changes by day."""
    x = from_table(table(spark, d, "events").where("user_id % 5 = 0"), ["user_id", second()], time=day_number(F.col("ts"), EPOCH))
    return x.sessions(1, "sec", 172_800).rename("user_id", "first", "last", "n").to_df()


def q42(spark, d):
    """Tumbling windows of a week as a change stream by day."""
    x = from_table(table(spark, d, "events"), ["event_type", second()], time=day_number(F.col("ts"), EPOCH), diff=F.when(F.col("event_type") == "error", -1).otherwise(1))
    return x.windows("sec", 604_800).project("event_type", "window").reduce(2, nodes.count("n"), empty_groups="drop").to_df()


def q43(spark, d):
    x = orders(spark, d).map("o_orderstatus", (F.col("o_custkey") % 4).alias("part"), "price")
    return bag(x.rollup(2, nodes.total("price", "price"), nodes.count("n")).as_of(1996)).drop("diff")


def q44(spark, d):
    return orders(spark, d).map("price", "o_custkey").limit(5, F.desc("price")).to_df()


def q45(spark, d):
    """Row functions in Python: one row to one, and one to many."""
    x = static(spark, d, "supplier", "s_suppkey", "s_nationkey")
    one = x.map_rows(lambda r: (r[1], r[0] * 2), "nation int, twice long")
    many = x.flat_map_rows(lambda r: ((r[1], r[0] + i) for i in range(r[0] % 3)), "nation int, twice long")
    return one.union(many).to_df()


def q46(spark, d):
    """A fold in Python whose parts are merged: orders' prices modulo a prime, summed."""
    fold = nodes.PythonFold("rest", "long", 0, lambda acc, r, n: (acc + r[1] % 9973 * n), merge=lambda a, b: a + b, part=64)
    return bag(orders(spark, d).map((F.col("o_custkey") % 50).alias("k"), "price").reduce(1, fold, empty_groups="drop").as_of(1996)).drop("diff")


def q47(spark, d):
    """Reach of G1 by node specifications in a validated graph, run as a shard with pushes."""
    b = graph.GraphBuilder()
    schema = "src long, dst long"
    edges = b.add_node(0, graph.Input(schema))
    loop = b.add_subgraph(0)
    entered = b.add_node(loop, graph.TimestampPush(edges))
    turned = b.add_node(loop, graph.Map(entered, ("dst", F.col("src").alias("from"))))
    by_dst = b.add_node(loop, graph.Index(turned))
    back = b.add_node(loop, graph.TimestampIncrement(schema))
    by_src = b.add_node(loop, graph.Index(back))
    met = b.add_node(loop, graph.Join((by_dst, by_src), 1))
    step = b.add_node(loop, graph.Map(met, (F.col("from").alias("src"), F.col("dst_r").alias("dst"))))
    both = b.add_node(loop, graph.Union((entered, step)))
    index = b.add_node(loop, graph.Index(both))
    found = b.add_node(loop, graph.Distinct(index))
    b.connect_loop(found, back)
    left = b.add_node(0, graph.TimestampPop(found))
    out = b.add_node(0, graph.Output(left))
    shard = Shard(spark, b.finish())
    for r in table(spark, d, "region").select("r_regionkey").collect():
        for t in range(3):
            shard.push_input(edges, (r[0] + 10 * t, r[0] + 10 * t + 10), (0,), 1)
    shard.push_input(edges, (10, 20), (1,), -1)
    shard.flush_input(edges)
    shard.advance_input(edges, (2,))
    while shard.has_work():
        shard.do_work()
    return shard.pop_output(out).withColumnsRenamed({"__t0": "t", DIFF: "diff"})


def q48(spark, d):
    """A loop within a loop: nations reach their region's other nations' numbers by steps of one, then of regions."""
    outer = Loop(spark)
    pairs = outer.enter(static(spark, d, "nation", "n_nationkey", "n_regionkey"))
    x = outer.variable("n_nationkey int, n_regionkey int")
    inner = outer.loop()
    base, y = inner.enter(pairs.union(x)), inner.variable("n_nationkey int, n_regionkey int")
    y.fixpoint(base.union(y.filter("n_regionkey < 3").map("n_nationkey", (F.col("n_regionkey") + 1).alias("n_regionkey"))).distinct())
    x.fixpoint(inner.leave(y).filter("n_nationkey < 40").map((F.col("n_nationkey") + 5).alias("n_nationkey"), "n_regionkey").distinct())
    return bag(outer.leave(x).as_of(0)).drop("diff")


def q49(spark, d):
    """Emptied groups keep their init value inside a loop too."""
    loop = Loop(spark)
    inside = loop.enter(orders(spark, d).filter("o_orderstatus = 'F'").map((F.col("o_custkey") % 40).alias("k"), "price"))
    sums = inside.reduce(1, nodes.total("price", "total"))
    x = loop.variable("k long, total long")
    x.fixpoint(sums.union(x.filter("k < 40").map((F.col("k") + 40).alias("k"), "total")).distinct())
    return loop.leave(x).to_df()


def q50(spark, d):
    return events(spark, d).changes_for_key(7).withColumnsRenamed({"__t0": "t", DIFF: "diff"})


def q51(spark, d):
    """Pairs that reach one another but are not blocked, where the loop negates."""
    loop = Loop(spark)
    edges, blocked = loop.enter(halves(spark, d)), loop.enter(halves(spark, d).filter("src % 7 = 0"))
    x = loop.variable("src long, dst long")
    step = x.map(F.col("dst").alias("mid"), F.col("src").alias("from")).join(edges.rename("mid", "to"), ["mid"]).map(F.col("from").alias("src"), F.col("to").alias("dst"))
    x.fixpoint(edges.union(blocked.negate()).union(step.filter("src % 7 <> 0")).distinct())
    return loop.leave(x).as_of(0).drop(DIFF)


def q52(spark, d):
    return orders(spark, d).map("o_orderstatus", (F.col("o_custkey") % 10).alias("part")).rows_as_of(1996)


def q53(spark, d):
    """Changes written as Parquet and as ORC and read back."""
    from .sources.logs import read_log, write
    from .sources.storage import shared_dir

    x, out = events(spark, d), None
    for kind in ("parquet", "orc"):
        path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
        write(x.filter("event_type = 'error'" if kind == "orc" else "event_type <> 'error'"), path, kind)
        part = read_log(spark, path, kind)
        out = part if out is None else out.union(part)
    return out.to_df()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "q01_coalesce": q01, "q02_as_of": q02, "q03_project": q03, "q04_map": q04, "q05_sum_as_of": q05, "q06_revenue_by_nation": q06,
    "q07_join_times": q07, "q08_self_join": q08, "q09_cross": q09, "q10_two_keys": q10, "q11_union": q11, "q12_union_distinct": q12,
    "q13_distinct_changes": q13, "q14_distinct_negative": q14, "q15_shared_index": q15, "q16_output_upto": q16, "q17_sum_changes": q17,
    "q18_count_changes": q18, "q19_max_changes": q19, "q20_ordered_fold": q20, "q21_global_sum": q21, "q22_empty_groups": q22,
    "q23_reach": q23, "q24_reach_cyclic": q24, "q25_reach_changes": q25, "q26_distances": q26, "q27_rounds": q27, "q28_filter": q28,
    "q29_semi_anti": q29, "q30_set_operations": q30, "q31_tumbling_count": q31, "q32_ledger": q32, "q33_top": q33, "q34_compact": q34, "q35_average": q35, "q36_left_outer": q36,
    "q37_full_outer": q37, "q38_range_join": q38, "q39_as_of_join": q39, "q40_sliding_windows": q40, "q41_sessions": q41, "q42_tumbling_changes": q42,
    "q43_rollup": q43, "q44_limit": q44, "q45_python_rows": q45, "q46_python_fold": q46, "q47_graph_shard": q47, "q48_nested_loops": q48,
    "q49_init_in_loop": q49, "q50_key_changes": q50, "q51_negation_in_loop": q51, "q52_plain_rows": q52, "q53_log_files": q53,
}

_COALESCED = "SELECT {0}, t, CAST(sum(d) AS BIGINT) AS diff FROM {1} GROUP BY ALL HAVING sum(d) <> 0"
_DISTINCT = """
, c AS (SELECT {0}, t, sum(d) AS d FROM {1} GROUP BY ALL HAVING sum(d) <> 0),
n AS (SELECT {0}, t, CASE WHEN sum(d) OVER (PARTITION BY {0} ORDER BY t) <> 0 THEN 1 ELSE 0 END AS n FROM c),
s AS (SELECT {0}, t, n - lag(n, 1, 0) OVER (PARTITION BY {0} ORDER BY t) AS diff FROM n)
SELECT {0}, t, CAST(diff AS BIGINT) AS diff FROM s WHERE diff <> 0"""
_SUMS = """
, p AS (SELECT {0}, t, sum({2}) AS p, sum(d) AS n FROM {1} GROUP BY ALL),
v AS (SELECT {0}, t, sum(p) OVER w AS v, sum(n) OVER w <> 0 AS live FROM p WINDOW w AS (PARTITION BY {0} ORDER BY t)),
s AS (SELECT *, lag(v) OVER w AS v0, coalesce(lag(live) OVER w, false) AS live0 FROM v WINDOW w AS (PARTITION BY {0} ORDER BY t)),
o2 AS (SELECT {0}, v, t, 1 AS d FROM s WHERE live UNION ALL SELECT {0}, v0, t, -1 FROM s WHERE live0)
SELECT {3}CAST(v AS BIGINT) AS {4}, t, CAST(sum(d) AS BIGINT) AS diff FROM o2 GROUP BY ALL HAVING sum(d) <> 0"""

ORACLES: dict[str, str] = {
    "q01_coalesce": f"WITH {E_SQL} " + _COALESCED.format("user_id, event_type", "e"),
    "q02_as_of": f"WITH {E_SQL} SELECT user_id, event_type, CAST(sum(d) AS BIGINT) AS diff FROM e WHERE t <= 14 GROUP BY ALL HAVING sum(d) <> 0",
    "q03_project": f"WITH {E_SQL} " + _COALESCED.format("event_type", "e"),
    "q04_map": "WITH x AS (SELECT l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT)) AS revenue, CAST(year(l_shipdate) AS BIGINT) AS t, 1 AS d FROM lineitem) " + _COALESCED.format("l_suppkey, revenue", "x"),
    "q05_sum_as_of": f"WITH {L_SQL} SELECT l_suppkey, CAST(sum(qty * d) AS BIGINT) AS sum_qty, CAST(1 AS BIGINT) AS diff FROM l WHERE t <= {YEAR} GROUP BY ALL HAVING sum(d) <> 0",
    "q06_revenue_by_nation": f"""SELECT r_name, n_name, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT))) AS BIGINT) AS revenue
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE year(l_shipdate) <= {YEAR} GROUP BY ALL""",
    "q07_join_times": f"WITH {O_SQL}, x AS (SELECT o_custkey, o_orderstatus, c_mktsegment, greatest(t, 1990 + c_custkey % 10) AS t, d FROM o JOIN customer ON o_custkey = c_custkey) " + _COALESCED.format("o_custkey, o_orderstatus, c_mktsegment", "x"),
    "q08_self_join": f"WITH {O_SQL}, x AS (SELECT a.o_custkey, a.o_orderstatus AS status, b.o_orderstatus AS other_status, greatest(a.t, b.t) AS t, a.d * b.d AS d FROM o a JOIN o b ON a.o_custkey = b.o_custkey) " + _COALESCED.format("o_custkey, status, other_status", "x"),
    "q09_cross": "SELECT r_name, n_name, CAST(0 AS BIGINT) AS t, CAST(1 AS BIGINT) AS diff FROM region, nation",
    "q10_two_keys": "WITH x AS (SELECT a.l_partkey, a.l_suppkey, a.l_returnflag, b.l_linenumber, CAST(greatest(year(a.l_shipdate), year(b.l_shipdate)) AS BIGINT) AS t, 1 AS d FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey) " + _COALESCED.format("l_partkey, l_suppkey, l_returnflag, l_linenumber", "x"),
    "q11_union": f"WITH {O_SQL}, x AS (SELECT o_custkey AS custkey, t, d FROM o UNION ALL SELECT c_custkey, 0, 1 FROM customer) " + _COALESCED.format("custkey", "x"),
    "q12_union_distinct": f"WITH {O_SQL}, x AS (SELECT o_custkey AS custkey, t, d FROM o UNION ALL SELECT c_custkey, 0, 1 FROM customer) SELECT custkey, CAST(1 AS BIGINT) AS diff FROM x WHERE t <= 1995 GROUP BY custkey HAVING sum(d) <> 0",
    "q13_distinct_changes": f"WITH {O_SQL}" + _DISTINCT.format("o_custkey", "o"),
    "q14_distinct_negative": f"WITH {E_SQL}" + _DISTINCT.format("user_id, event_type", "e"),
    "q15_shared_index": f"WITH {E_SQL}, b AS (SELECT user_id, event_type, sum(d) AS d FROM e WHERE t <= 14 GROUP BY ALL HAVING sum(d) <> 0) SELECT user_id, count(*) AS kinds, CAST(sum(d) AS BIGINT) AS n, CAST(1 AS BIGINT) AS diff FROM b GROUP BY user_id HAVING sum(d) <> 0",
    "q16_output_upto": f"WITH {E_SQL}" + _DISTINCT.format("user_id, event_type", "e") + " AND t < 10",
    "q17_sum_changes": f"WITH {L_SQL}" + _SUMS.format("l_suppkey", "l", "qty * d", "l_suppkey, ", "sum_qty"),
    "q18_count_changes": f"WITH {O_SQL}" + _SUMS.format("o_orderstatus", "o", "d", "o_orderstatus, ", "n"),
    "q19_max_changes": f"""WITH {O_SQL}, k AS (SELECT DISTINCT o_custkey, t, lead(t) OVER (PARTITION BY o_custkey ORDER BY t) AS t1 FROM (SELECT DISTINCT o_custkey, t FROM (SELECT o_custkey, price, t FROM o GROUP BY ALL HAVING sum(d) <> 0))),
        b AS (SELECT k.o_custkey, k.t, k.t1, o.price FROM k JOIN o ON k.o_custkey = o.o_custkey AND o.t <= k.t GROUP BY ALL HAVING sum(o.d) <> 0),
        m AS (SELECT o_custkey, t, t1, max(price) AS max_price FROM b GROUP BY ALL),
        x AS (SELECT o_custkey, max_price, t, 1 AS d FROM m UNION ALL SELECT o_custkey, max_price, t1, -1 FROM m WHERE t1 IS NOT NULL) """ + _COALESCED.format("o_custkey, max_price", "x"),
    "q20_ordered_fold": "SELECT c_mktsegment, string_agg(n_name, '' ORDER BY strlen(n_name), n_name) AS nations FROM (SELECT DISTINCT c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY c_mktsegment",
    "q21_global_sum": f"WITH {L_SQL}, l1 AS (SELECT 0 AS k, * FROM l)" + _SUMS.format("k", "l1", "qty * d", "", "sum_qty").replace("GROUP BY ALL HAVING sum(d) <> 0", "GROUP BY v, t HAVING sum(d) <> 0"),
    "q22_empty_groups": f"WITH {O_SQL}, x AS (SELECT o_custkey, price, t, sum(d) AS d FROM o WHERE o_orderstatus = 'F' AND t <= {YEAR} GROUP BY ALL HAVING sum(d) <> 0) SELECT o_custkey, CAST(sum(d) AS BIGINT) AS n_init, CAST(coalesce(nullif(sum(d), 0), -1) AS BIGINT) AS n_drop FROM x GROUP BY o_custkey",
    "q23_reach": f"WITH RECURSIVE {G2_SQL}, {REACH_SQL} SELECT src, dst FROM r",
    "q24_reach_cyclic": f"WITH RECURSIVE {G1_SQL}, {REACH_SQL} SELECT src, dst FROM r",
    "q25_reach_changes": """WITH RECURSIVE p AS (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day FROM events WHERE event_type = 'purchase'),
        g0 AS (SELECT DISTINCT src, dst FROM p WHERE dst IS NOT NULL), g1 AS (SELECT DISTINCT src, dst FROM p WHERE dst IS NOT NULL AND day < 1),
        r0 AS (SELECT src, dst FROM g0 UNION SELECT r0.src, g0.dst FROM r0 JOIN g0 ON r0.dst = g0.src), r1 AS (SELECT src, dst FROM g1 UNION SELECT r1.src, g1.dst FROM r1 JOIN g1 ON r1.dst = g1.src)
        SELECT src, dst, CAST(0 AS BIGINT) AS t, CAST(1 AS BIGINT) AS diff FROM r0 UNION ALL SELECT src, dst, 1, -1 FROM (SELECT * FROM r0 EXCEPT SELECT * FROM r1)""",
    "q26_distances": f"WITH RECURSIVE {G1_SQL}, b AS (SELECT min(src) AS node, 0 AS steps FROM g UNION SELECT g.dst, steps + 1 FROM b JOIN g ON b.node = g.src WHERE steps < 40) SELECT node, CAST(min(steps) AS BIGINT) AS steps FROM b GROUP BY node",
    "q27_rounds": f"WITH RECURSIVE {G2_SQL}, r AS (SELECT src, dst, 1 AS round FROM g UNION ALL SELECT r.src, g.dst, round + 1 FROM r JOIN g ON r.dst = g.src) SELECT src, dst, CAST(0 AS BIGINT) AS t, CAST(round AS BIGINT) AS round, CAST(1 AS BIGINT) AS diff FROM r",
    "q28_filter": f"WITH {E_SQL} " + _COALESCED.format("user_id, event_type", "(SELECT * FROM e WHERE event_type IN ('purchase', 'error'))"),
    "q29_semi_anti": f"WITH {O_SQL}, x AS (SELECT o_custkey FROM o WHERE t <= 1995 AND o_orderstatus = 'O' GROUP BY o_custkey HAVING sum(d) <> 0) SELECT c_custkey, c_mktsegment, CAST(1 AS BIGINT) AS diff, CASE WHEN c_custkey IN (SELECT o_custkey FROM x) THEN 'semi' ELSE 'anti' END AS kind FROM customer",
    "q30_set_operations": f"""WITH {O_SQL}, a AS (SELECT o_custkey FROM o WHERE t <= 1995 AND o_orderstatus = 'O' GROUP BY 1 HAVING sum(d) <> 0), b AS (SELECT o_custkey FROM o WHERE t <= 1995 AND o_orderstatus = 'F' GROUP BY 1 HAVING sum(d) <> 0)
        SELECT o_custkey, CAST(1 AS BIGINT) AS diff, CASE WHEN o_custkey IN (SELECT o_custkey FROM b) THEN 'intersect' ELSE 'except' END AS kind FROM a""",
    "q31_tumbling_count": "SELECT event_type, CAST(epoch(date_trunc('hour', ts)) // 3600 AS BIGINT) AS hour, count(*) AS n FROM events GROUP BY ALL",
    "q32_ledger": f"""WITH {O_SQL}, x AS (SELECT -(o_custkey % 7) - 1 AS account, price, t, d FROM o UNION ALL SELECT o_custkey, -price, t, d FROM o),
        c AS (SELECT account, price, t, sum(d) AS d FROM x WHERE t <= 1995 GROUP BY ALL HAVING sum(d) <> 0), b AS (SELECT account, CAST(sum(price * d) AS BIGINT) AS balance FROM c GROUP BY account)
        SELECT account, balance FROM b UNION ALL SELECT 0, CAST(sum(balance) AS BIGINT) FROM b""",
    "q33_top": f"""WITH {O_SQL}, k AS (SELECT *, lead(t) OVER (PARTITION BY o_orderstatus ORDER BY t) AS t1 FROM (SELECT DISTINCT o_orderstatus, t FROM (SELECT o_orderstatus, price, o_custkey, t FROM o GROUP BY ALL HAVING sum(d) <> 0))),
        b AS (SELECT k.o_orderstatus, k.t, k.t1, o.price, o.o_custkey FROM k JOIN o ON k.o_orderstatus = o.o_orderstatus AND o.t <= k.t GROUP BY ALL HAVING sum(o.d) <> 0),
        m AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, t ORDER BY price DESC, o_custkey) AS r FROM b),
        x AS (SELECT o_orderstatus, price, o_custkey, t, 1 AS d FROM m WHERE r <= 3 UNION ALL SELECT o_orderstatus, price, o_custkey, t1, -1 FROM m WHERE r <= 3 AND t1 IS NOT NULL) """ + _COALESCED.format("o_orderstatus, price, o_custkey", "x"),
    "q34_compact": f"WITH {E_SQL}, x AS (SELECT user_id, event_type, greatest(t, 20) AS t, d FROM e) " + _COALESCED.format("user_id, event_type", "x"),
    "q35_average": f"WITH {L_SQL}, p AS (SELECT l_suppkey, t, sum(qty * d) AS p, sum(d) AS n FROM l GROUP BY ALL), v AS (SELECT l_suppkey, t, CAST(sum(n) OVER w AS BIGINT) AS n, CAST(CASE WHEN sum(n) OVER w <> 0 THEN floor(sum(p) OVER w / sum(n) OVER w) END AS BIGINT) AS mean, lead(t) OVER w AS t1 FROM p WINDOW w AS (PARTITION BY l_suppkey ORDER BY t)), x AS (SELECT l_suppkey, n, mean, t, 1 AS d FROM v WHERE n <> 0 UNION ALL SELECT l_suppkey, n, mean, t1, -1 FROM v WHERE n <> 0 AND t1 IS NOT NULL) " + _COALESCED.format("l_suppkey, n, mean", "x"),
    "q36_left_outer": f"""WITH {O_SQL}, b AS (SELECT o_custkey, price, t, sum(d) AS d FROM o WHERE price > 40000000 GROUP BY ALL HAVING sum(d) <> 0), n AS (SELECT o_custkey, price, t, CASE WHEN sum(d) OVER (PARTITION BY o_custkey, price ORDER BY t) <> 0 THEN 1 ELSE 0 END AS n FROM b),
        r AS (SELECT o_custkey, price, t, n - lag(n, 1, 0) OVER (PARTITION BY o_custkey, price ORDER BY t) AS d FROM n), c AS (SELECT c_custkey AS custkey, c_nationkey AS nation FROM customer WHERE c_custkey % 3 <> 0),
        k AS (SELECT o_custkey, t, sum(d) AS d FROM r GROUP BY ALL HAVING sum(d) <> 0), kn AS (SELECT o_custkey, t, CASE WHEN sum(d) OVER (PARTITION BY o_custkey ORDER BY t) <> 0 THEN 1 ELSE 0 END AS n FROM k), ks AS (SELECT o_custkey, t, n - lag(n, 1, 0) OVER (PARTITION BY o_custkey ORDER BY t) AS d FROM kn),
        x AS (SELECT custkey, nation, price, t, d FROM c JOIN r ON custkey = o_custkey UNION ALL SELECT custkey, nation, NULL, 0, 1 FROM c UNION ALL SELECT custkey, nation, NULL, t, -d FROM c JOIN ks ON custkey = o_custkey) """ + _COALESCED.format("custkey, nation, price", "x"),
    "q37_full_outer": f"""WITH {O_SQL}, r AS (SELECT o_custkey, price FROM o WHERE price > 40000000 AND t <= 1996 GROUP BY ALL HAVING sum(d) <> 0), c AS (SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey % 3 <> 0)
        SELECT coalesce(c_custkey, o_custkey) AS custkey, c_nationkey AS nation, price, CAST(1 AS BIGINT) AS diff FROM c FULL JOIN r ON c_custkey = o_custkey""",
    "q38_range_join": "SELECT p_partkey, p_size, s_suppkey, CAST(s_suppkey % 50 AS INT) AS low, CAST(s_suppkey % 50 + s_suppkey % 4 AS INT) AS high FROM part JOIN supplier ON p_size BETWEEN s_suppkey % 50 AND s_suppkey % 50 + s_suppkey % 4",
    "q39_as_of_join": """WITH e AS (SELECT user_id, event_type, epoch_us(ts) AS moment FROM events WHERE date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) <= 20)
        SELECT a.user_id, a.moment AS "at", max(b.moment) AS bought FROM (SELECT DISTINCT user_id, moment FROM e WHERE event_type = 'error') a JOIN e b ON a.user_id = b.user_id AND b.event_type = 'purchase' AND b.moment <= a.moment GROUP BY ALL""",
    "q40_sliding_windows": "WITH w0 AS (SELECT event_type, CAST(floor(epoch(ts)) AS BIGINT) AS sec, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS t FROM events), e AS (SELECT event_type, t, 1 AS d, (sec // 86400 - i) * 86400 AS \"window\" FROM w0, (SELECT unnest([0, 1]) AS i))" + _SUMS.format("event_type, \"window\"", "e", "d", "event_type, \"window\", ", "n"),
    "q41_sessions": """WITH s AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS t FROM events WHERE user_id % 5 = 0),
        k AS (SELECT user_id, t, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS t1 FROM (SELECT DISTINCT user_id, t FROM s)), b AS (SELECT k.user_id, k.t, k.t1, sec, count(*) AS n FROM k JOIN s ON k.user_id = s.user_id AND s.t <= k.t GROUP BY ALL),
        g AS (SELECT *, CASE WHEN sec - lag(sec) OVER w <= 172800 THEN 0 ELSE 1 END AS g FROM b WINDOW w AS (PARTITION BY user_id, t ORDER BY sec)), h AS (SELECT *, sum(g) OVER (PARTITION BY user_id, t ORDER BY sec ROWS UNBOUNDED PRECEDING) AS h FROM g),
        v AS (SELECT user_id, t, t1, min(sec) AS "first", max(sec) AS "last", CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY user_id, t, t1, h),
        x AS (SELECT user_id, "first", "last", n, t, 1 AS d FROM v UNION ALL SELECT user_id, "first", "last", n, t1, -1 FROM v WHERE t1 IS NOT NULL) """ + _COALESCED.format('user_id, "first", "last", n', "x"),
    "q42_tumbling_changes": "WITH e AS (SELECT event_type, CAST(floor(epoch(ts)) AS BIGINT) // 604800 * 604800 AS \"window\", CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS t, CASE WHEN event_type = 'error' THEN -1 ELSE 1 END AS d FROM events)" + _SUMS.format("event_type, \"window\"", "e", "d", "event_type, \"window\", ", "n"),
    "q43_rollup": f"WITH {O_SQL}, x AS (SELECT o_orderstatus, o_custkey % 4 AS part, price, d FROM o WHERE t <= 1996) SELECT o_orderstatus, part, CAST(grouping(o_orderstatus) + grouping(part) AS INT) AS level, CAST(sum(price * d) AS BIGINT) AS price, CAST(sum(d) AS BIGINT) AS n FROM x GROUP BY ROLLUP (o_orderstatus, part) HAVING sum(d) <> 0",
    "q44_limit": f"""WITH {O_SQL}, c AS (SELECT price, o_custkey, t, sum(d) AS d FROM o GROUP BY ALL HAVING sum(d) <> 0), k AS (SELECT t, lead(t) OVER (ORDER BY t) AS t1 FROM (SELECT DISTINCT t FROM c)), b AS (SELECT k.t, k.t1, price, o_custkey FROM k JOIN c ON c.t <= k.t GROUP BY ALL HAVING sum(d) <> 0),
        m AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY price DESC, o_custkey) AS r FROM b), x AS (SELECT price, o_custkey, t, 1 AS d FROM m WHERE r <= 5 UNION ALL SELECT price, o_custkey, t1, -1 FROM m WHERE r <= 5 AND t1 IS NOT NULL) """ + _COALESCED.format("price, o_custkey", "x"),
    "q45_python_rows": "WITH x AS (SELECT s_nationkey AS nation, s_suppkey * 2 AS twice, 0 AS t, 1 AS d FROM supplier UNION ALL SELECT s_nationkey, s_suppkey + i, 0, 1 FROM supplier, range(2) r(i) WHERE i < s_suppkey % 3) SELECT nation, twice, CAST(t AS BIGINT) AS t, CAST(sum(d) AS BIGINT) AS diff FROM x GROUP BY ALL",
    "q46_python_fold": f"WITH {O_SQL}, x AS (SELECT o_custkey % 50 AS k, price, sum(d) AS d FROM o WHERE t <= 1996 GROUP BY ALL HAVING sum(d) <> 0) SELECT k, CAST(sum(price % 9973 * d) AS BIGINT) AS rest FROM x GROUP BY k",
    "q47_graph_shard": """WITH RECURSIVE e AS (SELECT CAST(r_regionkey + 10 * i AS BIGINT) AS src, CAST(r_regionkey + 10 * i + 10 AS BIGINT) AS dst FROM region, range(3) t(i)), f AS (SELECT * FROM e WHERE NOT (src = 10 AND dst = 20)),
        r0 AS (SELECT src, dst FROM e UNION SELECT r0.src, e.dst FROM r0 JOIN e ON r0.dst = e.src), r1 AS (SELECT src, dst FROM f UNION SELECT r1.src, f.dst FROM r1 JOIN f ON r1.dst = f.src)
        SELECT src, dst, CAST(0 AS BIGINT) AS t, CAST(1 AS BIGINT) AS diff FROM r0 UNION ALL SELECT src, dst, 1, -1 FROM (SELECT * FROM r0 EXCEPT SELECT * FROM r1)""",
    "q48_nested_loops": """WITH RECURSIVE r AS (SELECT n_nationkey AS n, n_regionkey AS k, false AS x FROM nation UNION
        SELECT n + 5 * i, k + 1 - i, x OR i = 1 FROM r, (SELECT unnest([0, 1]) AS i) WHERE (i = 0 AND k < 3) OR (i = 1 AND n < 40))
        SELECT DISTINCT CAST(n AS INT) AS n_nationkey, CAST(k AS INT) AS n_regionkey FROM r WHERE x""",
    "q49_init_in_loop": f"WITH {O_SQL}, p AS (SELECT o_custkey % 40 AS k, t, sum(price * d) AS p FROM (SELECT * FROM o WHERE o_orderstatus = 'F') GROUP BY ALL), v AS (SELECT k, t, CAST(sum(p) OVER w AS BIGINT) AS total, lead(t) OVER w AS t1 FROM p WINDOW w AS (PARTITION BY k ORDER BY t)), x AS (SELECT k + i AS k, total, t, 1 AS d FROM v, (SELECT unnest([0, 40]) AS i) UNION ALL SELECT k + i, total, t1, -1 FROM v, (SELECT unnest([0, 40]) AS i) WHERE t1 IS NOT NULL) " + _COALESCED.format("k, total", "x"),
    "q50_key_changes": f"WITH {E_SQL} " + _COALESCED.format("user_id, event_type", "(SELECT * FROM e WHERE user_id = 7)"),
    "q51_negation_in_loop": f"WITH RECURSIVE {G2_SQL}, r AS (SELECT src, dst FROM g WHERE src % 7 <> 0 UNION SELECT r.src, g.dst FROM r JOIN g ON r.dst = g.src WHERE r.src % 7 <> 0) SELECT src, dst FROM r",
    "q52_plain_rows": f"WITH {O_SQL}, x AS (SELECT o_orderstatus, o_custkey % 10 AS part, sum(d) AS n FROM o WHERE t <= 1996 GROUP BY ALL HAVING sum(d) > 0) SELECT o_orderstatus, part FROM x, LATERAL (SELECT unnest(range(CAST(n AS BIGINT))))",
    "q53_log_files": f"WITH {E_SQL} " + _COALESCED.format("user_id, event_type", "e"),
}
