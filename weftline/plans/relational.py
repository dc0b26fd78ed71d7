"""General queries over the star schema and the event table: joins of every kind, grouping sets, windows, set operations, time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.plans.catalog import query
from weftline.session import table
from weftline.streaming import events


@query(
    """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2
"""
)
def r_pricing_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n")
    )


@query(
    """
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1
"""
)
def r_local_supplier(spark: SparkSession, folder: str) -> DataFrame:
    t = {n: table(spark, folder, n) for n in ("customer", "orders", "lineitem", "supplier", "nation", "region")}
    # nation and region have a fixed number of rows
    where = F.broadcast(t["nation"].join(F.broadcast(t["region"].where("r_name = 'ASIA'")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name"))
    local = t["supplier"].join(where, F.col("s_nationkey") == F.col("n_nationkey"))
    sold = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
    both = sold.join(local, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return both.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) GROUP BY 1")
def r_semi_join(spark: SparkSession, folder: str) -> DataFrame:
    big = table(spark, folder, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, folder, "orders").join(big, "o_orderkey", "left_semi").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY 1")
def r_anti_join(spark: SparkSession, folder: str) -> DataFrame:
    placed = table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, folder, "customer").join(placed, "c_custkey", "left_anti").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey, count(DISTINCT c_custkey) AS customers, count(DISTINCT s_suppkey) AS suppliers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def r_outer_join(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.countDistinct("c_custkey").alias("customers"))
    s = table(spark, folder, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.countDistinct("s_suppkey").alias("suppliers"))
    n = table(spark, folder, "nation").select("n_nationkey")
    return n.join(c, "n_nationkey", "left").join(s, "n_nationkey", "left").select("n_nationkey", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS level, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def r_cube(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def r_grouping_sets(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders")
    return rows.groupingSets([[F.col("o_orderstatus")], [F.col("o_orderpriority")], []], "o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def r_top_per_group(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, folder, "orders").withColumn("r", F.row_number().over(w)).where("r <= 3").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_custkey, lag(o_orderkey) OVER w AS before, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def r_running_window(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    running = F.round(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), 2)
    return table(spark, folder, "orders").select("o_orderkey", "o_custkey", F.lag("o_orderkey").over(w).alias("before"), running.alias("running"))


@query("SELECT s_nationkey AS nation FROM supplier INTERSECT SELECT c_nationkey FROM customer")
def r_intersect(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").select(F.col("s_nationkey").alias("nation")).intersect(table(spark, folder, "customer").select("c_nationkey"))


@query("SELECT p_partkey AS part FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 25")
def r_except(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(F.col("p_partkey").alias("part")).subtract(table(spark, folder, "lineitem").where("l_quantity > 25").select("l_partkey"))


@query("SELECT kind, count(*) AS n FROM (SELECT 'supplier' AS kind, s_acctbal AS b FROM supplier UNION ALL SELECT 'customer', c_acctbal FROM customer) WHERE b < 0 GROUP BY 1")
def r_union(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("b"))
    b = table(spark, folder, "customer").select(F.lit("customer").alias("kind"), F.col("c_acctbal").alias("b"))
    return a.unionByName(b).where("b < 0").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'O') AS O, count(*) FILTER (WHERE l_linestatus = 'F') AS F FROM lineitem GROUP BY 1")
def r_pivot(spark: SparkSession, folder: str) -> DataFrame:
    wide = table(spark, folder, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).agg(F.count(F.lit(1)))
    return wide.select("l_returnflag", F.coalesce("O", F.lit(0)).alias("O"), F.coalesce("F", F.lit(0)).alias("F"))


@query("SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS n FROM events GROUP BY 1")
def r_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.count(F.lit(1)).alias("n"))


@query()
def r_approximate(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy("event_type").agg(
        F.approx_count_distinct("user_id", 0.02).alias("users"), F.hll_sketch_estimate(F.hll_sketch_agg("user_id")).alias("sketched"), F.percentile_approx("value", F.array(F.lit(0.5), F.lit(0.95)), 10_000).alias("quantiles")
    )


@query("SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))) AS VARCHAR) AS revenue, count(*) AS n FROM lineitem GROUP BY 1")
def r_decimal(spark: SparkSession, folder: str) -> DataFrame:
    """Exact sums of decimal products, without the rounding of doubles."""
    net = F.col("l_extendedprice").cast("decimal(12,2)") * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))
    return table(spark, folder, "lineitem").groupBy("l_returnflag").agg(F.sum(net).cast("decimal(30,4)").cast("string").alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate >= o_orderdate + INTERVAL 1 MONTH AND l_shipdate < o_orderdate + INTERVAL 1 MONTH + INTERVAL 10 DAY")
def r_interval(spark: SparkSession, folder: str) -> DataFrame:
    """Lines shipped in the ten days after a month from the order."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    both = lines.join(table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    return both.where("l_shipdate >= o_orderdate + interval 1 month and l_shipdate < o_orderdate + interval 1 month + interval 10 day").select("l_orderkey", "l_linenumber")


@query(
    """
SELECT year(o_orderdate) AS y, quarter(o_orderdate) AS q, CAST(max(day(last_day(o_orderdate))) AS BIGINT) AS longest, CAST(sum(date_diff('day', CAST(date_trunc('month', o_orderdate) AS DATE), CAST(o_orderdate AS DATE))) AS BIGINT) AS days,
  count(*) FILTER (WHERE dayofweek(o_orderdate) = 0) AS sundays FROM orders GROUP BY 1, 2
"""
)
def r_calendar(spark: SparkSession, folder: str) -> DataFrame:
    """Calendar arithmetic by quarter."""
    day = F.col("o_orderdate").cast("date")
    return table(spark, folder, "orders").groupBy(F.year(day).alias("y"), F.quarter(day).alias("q")).agg(
        F.max(F.dayofmonth(F.last_day(day))).cast("long").alias("longest"), F.sum(F.datediff(day, F.trunc(day, "month"))).alias("days"), F.count_if(F.dayofweek(day) == 1).alias("sundays")
    )


@query("SELECT p_partkey, round(sqrt(p_retailprice), 6) AS root, round(ln(1 + p_size), 6) AS log, round(power(1.01, p_size), 6) AS power, CAST(p_size % 7 AS INTEGER) AS rest, CAST(ceil(p_retailprice / 3) AS BIGINT) AS up, CAST(floor(-p_retailprice / 3) AS BIGINT) AS down, CAST(sign(p_size - 25) AS DOUBLE) AS side FROM part")
def r_math(spark: SparkSession, folder: str) -> DataFrame:
    price, size = F.col("p_retailprice"), F.col("p_size")
    return table(spark, folder, "part").select(
        "p_partkey", F.round(F.sqrt(price), 6).alias("root"), F.round(F.log1p(size), 6).alias("log"), F.round(F.pow(F.lit(1.01), size), 6).alias("power"), (size % 7).alias("rest"),
        F.ceil(price / 3).alias("up"), F.floor(-price / 3).alias("down"), F.signum(size - 25).alias("side"),
    )


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def w_tumbling(spark: SparkSession, folder: str) -> DataFrame:
    return events.tumbling(table(spark, folder, "events"), "1 hour")


@query("SELECT time_bucket(INTERVAL '30 minutes', ts) - k * INTERVAL '30 minutes' AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, (VALUES (0), (1)) v(k) GROUP BY 1, 2")
def w_sliding(spark: SparkSession, folder: str) -> DataFrame:
    return events.tumbling(table(spark, folder, "events"), "1 hour", "30 minutes")


@query(
    """
WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30 minutes' THEN 1 ELSE 0 END AS cut FROM events),
s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k
"""
)
def w_session(spark: SparkSession, folder: str) -> DataFrame:
    return events.sessions(table(spark, folder, "events"), "30 minutes")


@query("SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def w_first_event(spark: SparkSession, folder: str) -> DataFrame:
    from weftline.operators.order import first_by

    return first_by(table(spark, folder, "events").select("event_id", "user_id", "event_type", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def w_streamed_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The same tumbling counts by a stream that reads what is there and ends, written through a sink that replays safely."""
    return events.streamed(spark, f"{folder}/events.parquet", "1 hour")


@query()
def w_streamed_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks cut from a stream of samples by source, with the remainder kept as state."""
    from weftline.streaming import packer

    return packer.streamed(spark, f"{folder}/prompt_solution.parquet")


@query("SELECT DISTINCT event_id, user_id, event_type FROM events")
def w_streamed_unique(spark: SparkSession, folder: str) -> DataFrame:
    """First of the events with equal ids, by a stream; all repeats lie within the watermark."""
    rows = events.source(spark, f"{folder}/events.parquet").select("event_id", "user_id", "event_type", "ts")
    out = events.unique(rows, ["event_id"], "3650 days").select("event_id", "user_id", "event_type")
    return events.result(spark, events.run_available(out), out.schema).select("event_id", "user_id", "event_type")


@query("SELECT event_id FROM events")
def w_resumed(spark: SparkSession, folder: str) -> DataFrame:
    """A stream that ends and is run again on the same checkpoint: no row twice, none missing."""
    rows = lambda: events.source(spark, f"{folder}/events.parquet").select("event_id")
    first = rows()
    place = events.run_available(first)
    events.run_available(rows(), folder=place)
    return events.result(spark, place, first.schema).select("event_id")
