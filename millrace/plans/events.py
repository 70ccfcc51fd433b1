"""Event-log queries, and the relational breadth on the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import events as E
from millrace.plans.registry import register
from millrace.plans.tables import table


@register(
    "q_tool_loop",
    """SELECT user_id, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events) GROUP BY user_id, event_type, g HAVING count(*) >= 3""",
)
def q_tool_loop(spark, sf_dir):
    return E.runs_of_equal(table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id"), "user_id", ["ts", "event_id"], "event_type").where("n >= 3")


@register("q_cursor_gap", "SELECT event_type, after, before, before - after - 1 AS missing FROM (SELECT event_type, lag(event_id) OVER (PARTITION BY event_type ORDER BY event_id) AS after, event_id AS before FROM events) WHERE before - after > 1")
def q_cursor_gap(spark, sf_dir):
    return E.gaps(table(spark, sf_dir, "events").select("event_type", "event_id"), "event_type", "event_id")


@register("q_replay", "SELECT event_id, event_type FROM events WHERE user_id = 7 AND event_id > 100 ORDER BY event_id")
def q_replay(spark, sf_dir):
    return table(spark, sf_dir, "events").where("user_id = 7 AND event_id > 100").select("event_id", "event_type").orderBy("event_id")


@register(
    "q_idempotent",
    """SELECT event_id, user_id, day, CASE WHEN event_id = first_value(event_id) OVER w THEN 'created' WHEN event_type = first_value(event_type) OVER w THEN 'same' ELSE 'conflict' END AS outcome FROM (SELECT *, strftime(ts, '%Y-%m-%d') AS day FROM events) WINDOW w AS (PARTITION BY user_id, day ORDER BY ts, event_id)""",
)
def q_idempotent(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return E.idempotent(rows, ["user_id", "day"], "event_type", ["ts", "event_id"], "event_id")


@register("q_expiry", "SELECT user_id, epoch_us(max(ts)) AS last_us, max(ts) < TIMESTAMP '2024-01-29 00:00:00' AND NOT bool_or(event_type = 'purchase') AS expired FROM events GROUP BY user_id")
def q_expiry(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last_ts"), F.max(F.col("event_type") == "purchase").alias("done")).select("user_id", F.unix_micros(F.col("last_ts").cast("timestamp")).alias("last_us"), ((F.col("last_ts") < F.expr("timestamp_ntz'2024-01-29 00:00:00'")) & ~F.col("done")).alias("expired"))


@register(
    "q_rate_limit",
    """WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    p(user_id, i, event_id, allowed, kept) AS (SELECT DISTINCT user_id, 0::BIGINT, NULL::BIGINT, NULL::BOOLEAN, []::BIGINT[] FROM o UNION ALL
    SELECT user_id, i, event_id, len(near) < 2, CASE WHEN len(near) < 2 THEN list_append(near, t) ELSE near END FROM (SELECT o.*, list_filter(p.kept, lambda x: x > o.t - 3600000000) AS near FROM p JOIN o ON o.i = p.i + 1 AND o.user_id IS NOT DISTINCT FROM p.user_id))
    SELECT user_id, event_id, allowed FROM p WHERE i > 0""",
)
def q_rate_limit(spark, sf_dir):
    return E.rate_limit(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", limit=2, seconds=3600)


@register("q_counters", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, count(*) FILTER (value <= 10) AS le_10, count(*) FILTER (value <= 50) AS le_50, count(*) FILTER (value <= 100) AS le_100 FROM events GROUP BY 1, 2")
def q_counters(spark, sf_dir):
    le = lambda x: F.count_if(F.col("value") <= x).alias(f"le_{x}")
    return table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"), le(10), le(50), le(100))


@register(
    "q_sessions",
    """SELECT user_id, epoch_us(min(ts)) AS started_us, count(*) AS n FROM (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE, true) AS gap FROM events)) GROUP BY user_id, s""",
)
def q_sessions(spark, sf_dir):
    at = F.col("ts").cast("timestamp")
    rows = table(spark, sf_dir, "events").select("user_id", at.alias("ts")).groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.unix_micros("session_window.start").alias("started_us"), "n")


@register("q_rel_pricing", "SELECT l_returnflag, l_linestatus, sum(l_quantity::BIGINT)::BIGINT AS sum_qty, sum(round(l_extendedprice * 100)::BIGINT * (100 - round(l_discount * 100)::BIGINT))::BIGINT AS revenue_e4, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def q_rel_pricing(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'")
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    revenue = F.sum(cents("l_extendedprice") * (100 - cents("l_discount")))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("long")).alias("sum_qty"), revenue.alias("revenue_e4"), F.count("*").alias("n"))


@register(
    "q_rel_join",
    """SELECT n_name, count(DISTINCT o_orderkey) AS n_orders, count(*) AS n_lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1""",
)
def q_rel_join(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    nations = t("nation").join(t("region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")
    buyers = t("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    orders = t("orders").join(buyers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "n_name")
    # Lines are counted per order first: distinct orders need no second pass.
    lines = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("c"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("n_name").agg(F.count("*").alias("n_orders"), F.sum("c").alias("n_lines"))


@register("q_rel_semi_anti", "SELECT c_custkey, c_mktsegment, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) AS large FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def q_rel_semi_anti(spark, sf_dir):
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    kept = customer.join(orders.where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    large = orders.where("o_totalprice > 400000").select(F.col("o_custkey").alias("k")).distinct()
    return kept.join(large, F.col("c_custkey") == F.col("k"), "left").select("c_custkey", "c_mktsegment", F.col("k").isNotNull().alias("large"))


@register("q_rel_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping_id(o_orderstatus, o_orderpriority)::BIGINT AS level FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def q_rel_cube(spark, sf_dir):
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@register("q_rel_windows", "SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS d, ntile(4) OVER w AS q, lag(o_orderkey) OVER w AS prev, lead(o_orderkey) OVER w AS next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def q_rel_windows(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("d"), F.ntile(4).over(w).cast("long").alias("q"), F.lag("o_orderkey").over(w).alias("prev"), F.lead("o_orderkey").over(w).alias("next"))


@register("q_rel_set_ops", "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")
def q_rel_set_ops(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    return t("customer").select(F.col("c_nationkey").alias("k")).intersect(t("supplier").select("s_nationkey")).subtract(t("nation").where("n_regionkey = 0").select("n_nationkey"))


@register("q_rel_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def q_rel_topk(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)
