"""The event operators as registered queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.runner import Runner
from tidewright.operators.order import ordered

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: Events in arrival order; times in milliseconds.
E = "(SELECT event_id, epoch_us(ts) // 1000 AS t, user_id, event_type, value, props, row_number() OVER (ORDER BY ts, event_id) - 1 AS seq FROM events)"
O = "(SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, epoch_us(o_orderdate) // 1000 AS t, o_orderpriority, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS seq FROM orders)"  # noqa: E741
HOUR, DAY = 3_600_000, 86_400_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound(spark: SparkSession, sf_dir: str, *names: str, **choices: str) -> Runner:
    """A runner with the streams and tables that the names ask for; streams of one event type are named by it."""
    e = Runner(spark, **choices)
    events = read(spark, sf_dir, "events")
    for n in names or ("events",):
        if n == "events":
            e.stream(n, events, "ts", ["event_id"])
        elif n == "orders":
            e.stream(n, read(spark, sf_dir, n), "o_orderdate", ["o_orderkey"])
        elif n == "lineitem":
            e.stream(n, read(spark, sf_dir, n), "l_shipdate", ["l_orderkey", "l_linenumber"])
        elif n in ("view", "click", "purchase", "signup", "error"):
            e.stream(n, events.where(F.col("event_type") == n), "ts", ["event_id"])
        else:
            e.table(n, read(spark, sf_dir, n))
    return e


def app(name: str, text: str, oracle: str | None, inputs: tuple[str, ...] = ("events",), out: str = "o", **choices: str) -> None:
    """Registers an application whose stream ``out`` is the result."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return bound(spark, sf_dir, *inputs, **choices).run(text)[out]

    query.__name__ = name
    QUERIES[name] = query
    if oracle is not None:
        ORACLE[name] = oracle


def plain(name: str, oracle: str | None) -> Callable[[Query], Query]:
    """Registers a query made of operators directly."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLE[name] = oracle
        return f

    return add


# Windows

app(
    "w_tumbling_having",
    "CREATE STREAM events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING);"
    "INSERT INTO o SELECT event_type, count(*) AS n, round(sum(value), 6) AS s FROM events WINDOW TUMBLING(1 HOUR) WHERE value > 1 GROUP BY event_type HAVING count(*) > 2",
    f"""WITH e AS (SELECT *, floor((t - min(t) OVER ()) / {HOUR}) AS b FROM (SELECT * FROM {E} WHERE value > 1))
SELECT event_type, count(*) AS n, round(sum(value), 6) AS s FROM e WHERE b < (SELECT max(b) FROM e) GROUP BY b, event_type HAVING count(*) > 2""",
)
for f, sql in (("sum(value)", "sum(value)"), ("avg(value)", "avg(value)"), ("min(value)", "min(value)"), ("max(value)", "max(value)"), ("count(*)", "count(*)"), ("distinctCount(event_type)", "count(DISTINCT event_type)"), ("stddev(value)", "stddev_pop(value)"), ("first(value)", "first_value(value)"), ("last(value)", "last_value(value)")):
    n = f.split("(")[0].lower()
    rounded = n in ("sum", "avg", "stddev")
    if n == "distinctcount":
        oracle = f"SELECT a.event_id, count(DISTINCT b.event_type) AS r FROM {E} a JOIN {E} b ON b.user_id = a.user_id AND b.seq BETWEEN a.seq - 49 AND a.seq GROUP BY a.event_id"
    else:
        over = "OVER (PARTITION BY user_id ORDER BY seq RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)"
        oracle = f"SELECT event_id, {f'round({sql} {over}, 9)' if rounded else f'{sql} {over}'} AS r FROM {E}"
    app(f"w_length_{n}", f"INSERT INTO o SELECT event_id, {f'round({f}, 9)' if rounded else f} AS r FROM events WINDOW('length', 50) GROUP BY user_id", oracle)
app("w_length_ungrouped", "INSERT INTO o SELECT event_id, count(*) AS n, round(avg(value), 9) AS a, min(value) AS m FROM events WINDOW('length', 200)", f"SELECT event_id, count(*) OVER w AS n, round(avg(value) OVER w, 9) AS a, min(value) OVER w AS m FROM {E} WINDOW w AS (ORDER BY seq ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)")
app("w_length_where_after", "INSERT INTO o SELECT event_id, count(*) AS n, round(sum(value), 6) AS s FROM events WHERE event_type = 'click' WINDOW('length', 100)", f"SELECT event_id, count(*) OVER w AS n, round(sum(value) OVER w, 6) AS s FROM {E} WHERE event_type = 'click' WINDOW w AS (ORDER BY seq RANGE BETWEEN 99 PRECEDING AND CURRENT ROW)", where="after_window")
app("w_length_where_before", "INSERT INTO o SELECT event_id, count(*) AS n, round(sum(value), 6) AS s FROM events WHERE event_type = 'click' WINDOW('length', 100)", f"SELECT event_id, count(*) OVER w AS n, round(sum(value) OVER w, 6) AS s FROM {E} WHERE event_type = 'click' WINDOW w AS (ORDER BY seq ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)")
app("w_length_expired", "INSERT INTO o SELECT event_id, value FROM events WINDOW('length', 500)", f"SELECT event_id, value FROM {E} WHERE seq + 500 <= (SELECT max(seq) FROM {E})", output_events="expired")
app("w_length_batch", "INSERT INTO o SELECT count(*) AS n, round(sum(value), 6) AS s, max(value) AS m FROM events WINDOW('lengthBatch', 64)", f"SELECT count(*) AS n, round(sum(value), 6) AS s, max(value) AS m FROM {E} GROUP BY seq // 64 HAVING count(*) = 64")
app("w_length_batch_group", "INSERT INTO o SELECT event_type, count(*) AS n, last(event_id) AS e FROM events WINDOW('lengthBatch', 100) GROUP BY event_type", f"WITH f AS (SELECT seq // 100 AS b FROM {E} GROUP BY 1 HAVING count(*) = 100) SELECT event_type, count(*) AS n, arg_max(event_id, seq) AS e FROM {E} JOIN f ON b = seq // 100 GROUP BY b, event_type")
app("w_length_batch_plain", "INSERT INTO o SELECT event_id, value FROM events WINDOW('lengthBatch', 37)", f"SELECT event_id, value FROM {E} WHERE seq // 37 < (SELECT (max(seq) + 1) // 37 FROM {E})")
app("w_time", "INSERT INTO o SELECT event_id, count(*) AS n, round(sum(value), 6) AS s FROM events WINDOW('time', 2 HOURS) GROUP BY event_type", f"SELECT event_id, count(*) OVER w AS n, round(sum(value) OVER w, 6) AS s FROM {E} WINDOW w AS (PARTITION BY event_type ORDER BY t RANGE BETWEEN {2 * HOUR - 1} PRECEDING AND CURRENT ROW)")
app("w_time_ungrouped", "INSERT INTO o SELECT event_id, count(*) AS n, max(value) AS m FROM events WINDOW('time', 30 MINUTES)", f"SELECT event_id, count(*) OVER w AS n, max(value) OVER w AS m FROM {E} WINDOW w AS (ORDER BY t RANGE BETWEEN {HOUR // 2 - 1} PRECEDING AND CURRENT ROW)")
app("w_external_time", "INSERT INTO o SELECT event_id, count(*) AS n FROM events WINDOW('externalTime', event_id, 1000)", f"SELECT event_id, count(*) OVER (ORDER BY event_id RANGE BETWEEN 999 PRECEDING AND CURRENT ROW) AS n FROM {E}")
app("w_time_batch", "INSERT INTO o SELECT count(*) AS n, round(avg(value), 9) AS a FROM events WINDOW('timeBatch', 6 HOURS)", f"WITH e AS (SELECT *, (t - min(t) OVER ()) // {6 * HOUR} AS b FROM {E}) SELECT count(*) AS n, round(avg(value), 9) AS a FROM e WHERE b < (SELECT max(b) FROM e) GROUP BY b")
app("w_external_time_batch", "INSERT INTO o SELECT user_id, count(*) AS n FROM events WINDOW('externalTimeBatch', event_id, 2500) GROUP BY user_id", f"WITH e AS (SELECT *, (event_id - min(event_id) OVER ()) // 2500 AS b FROM {E}) SELECT user_id, count(*) AS n FROM e WHERE b < (SELECT max(b) FROM e) GROUP BY b, user_id")
app("w_tumbling_epoch", "INSERT INTO o SELECT event_type, count(*) AS n FROM events WINDOW TUMBLING(1 DAY) GROUP BY event_type", f"SELECT event_type, count(*) AS n FROM {E} GROUP BY t // {DAY}, event_type", align="epoch")
app("w_session", "INSERT INTO o SELECT user_id, count(*) AS n, min(event_id) AS lo, round(sum(value), 6) AS s FROM events WINDOW('session', 1 HOUR, user_id) GROUP BY user_id", f"WITH a AS (SELECT *, CASE WHEN t - lag(t) OVER w <= {HOUR} THEN 0 ELSE 1 END AS x FROM {E} WINDOW w AS (PARTITION BY user_id ORDER BY seq)), b AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY seq) AS b FROM a) SELECT user_id, count(*) AS n, min(event_id) AS lo, round(sum(value), 6) AS s FROM b GROUP BY user_id, b")
app("w_session_ungrouped", "INSERT INTO o SELECT count(*) AS n, max(value) AS m FROM events WINDOW('session', 10 MINUTES)", f"WITH a AS (SELECT *, CASE WHEN t - lag(t) OVER (ORDER BY seq) <= {HOUR // 6} THEN 0 ELSE 1 END AS x FROM {E}), b AS (SELECT *, sum(x) OVER (ORDER BY seq) AS b FROM a) SELECT count(*) AS n, max(value) AS m FROM b GROUP BY b")
app("w_cron", "INSERT INTO o SELECT count(*) AS n, round(sum(value), 6) AS s FROM events WINDOW('cron', '0 0 */6 * * *')", f"WITH e AS (SELECT *, CAST(ceil(t / {6.0 * HOUR}) AS BIGINT) AS b FROM {E}) SELECT count(*) AS n, round(sum(value), 6) AS s FROM e WHERE b * {6 * HOUR} <= (SELECT max(t) FROM e) GROUP BY b")
app("w_sort", "INSERT INTO o SELECT event_id, value FROM events WINDOW('sort', 25, value, 'asc')", f"SELECT event_id, value FROM {E} ORDER BY value, seq LIMIT 25")
app("w_sort_desc", "INSERT INTO o SELECT o_orderkey, o_totalprice FROM orders WINDOW('sort', 40, o_orderpriority, 'asc', o_totalprice, 'desc')", f"SELECT o_orderkey, o_totalprice FROM {O} ORDER BY o_orderpriority, o_totalprice DESC, seq LIMIT 40", inputs=("orders",))
app("w_sliding_hop", "INSERT INTO o SELECT event_type, count(*) AS n FROM events WINDOW('sliding', 2 HOURS, 30 MINUTES) GROUP BY event_type", f"SELECT event_type, count(*) AS n FROM (SELECT *, unnest(range(CAST(floor((t - {2 * HOUR}) / {HOUR / 2}) AS BIGINT) + 1, t // {HOUR // 2} + 1)) AS b FROM {E}) GROUP BY b, event_type")
app("w_delay", "INSERT INTO o SELECT event_id, eventTimestamp() AS t FROM events WINDOW('delay', 30 SECONDS) WHERE value > 20", f"SELECT event_id, t + 30000 AS t FROM {E} WHERE value > 20")
app("w_lossy_counting", "INSERT INTO o SELECT event_id FROM events WINDOW('lossyCounting', 0.1, 0.01) WHERE event_type = 'error'", f"SELECT event_id FROM {E} WHERE event_type = 'error'")


@plain("w_sort_running", f"SELECT a.event_id, round(list_sum(list_sort(list(b.value))[1:5]), 6) AS s FROM {E} a JOIN {E} b ON b.user_id = a.user_id AND b.seq <= a.seq GROUP BY a.event_id")
def w_sort_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.operators.windows import sort_states

    top = sort_states(ordered(read(spark, sf_dir, "events"), "ts", ["event_id"]), 5, "value", False, ["user_id"])
    return top.select("event_id", F.round(F.aggregate("_top", F.lit(0.0), lambda a, x: a + x), 6).alias("s"))


# Selector and aggregates

app("s_running", "INSERT INTO o SELECT event_id, count() AS n, round(sum(value), 6) AS s, minForever(value) AS lo, maxForever(value) AS hi FROM events GROUP BY user_id", f"SELECT event_id, count(*) OVER w AS n, round(sum(value) OVER w, 6) AS s, min(value) OVER w AS lo, max(value) OVER w AS hi FROM {E} WINDOW w AS (PARTITION BY user_id ORDER BY seq)")
app("s_forever_in_window", "INSERT INTO o SELECT event_id, min(value) AS m, minForever(value) AS f FROM events WINDOW('length', 10) GROUP BY user_id", f"SELECT event_id, min(value) OVER (PARTITION BY user_id ORDER BY seq RANGE BETWEEN 9 PRECEDING AND CURRENT ROW) AS m, min(value) OVER (PARTITION BY user_id ORDER BY seq) AS f FROM {E}")
app("s_group_batch", "INSERT INTO o SELECT event_type, event_id, count(*) AS n, round(variance(value), 6) AS v FROM events GROUP BY event_type", f"SELECT event_type, arg_max(event_id, seq) AS event_id, count(*) AS n, round(var_pop(value), 6) AS v FROM {E} GROUP BY event_type", emit="batch")
app("s_having_running", "INSERT INTO o SELECT event_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 30", f"SELECT * FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY seq) AS n FROM {E}) WHERE n > 30")
app("s_aggregate_expression", "INSERT INTO o SELECT user_id, round(sum(value) / count(*) + max(value), 4) AS r FROM events GROUP BY user_id", f"SELECT user_id, round(sum(value) / count(*) + max(value), 4) AS r FROM {E} GROUP BY user_id", emit="batch")
app("s_distinct_aggregates", "INSERT INTO o SELECT event_type, COUNT(DISTINCT user_id) AS u, SUM(DISTINCT user_id) AS s FROM events GROUP BY event_type", f"SELECT event_type, count(DISTINCT user_id) AS u, CAST(sum(DISTINCT user_id) AS BIGINT) AS s FROM {E} GROUP BY event_type", emit="batch")
app("s_count_nulls", "INSERT INTO o SELECT o_orderstatus, count(nullif(o_orderpriority, '1-URGENT')) AS n, count(*) AS m, sum(CASE WHEN o_totalprice < 0 THEN o_totalprice END) AS z FROM orders GROUP BY o_orderstatus", f"SELECT o_orderstatus, count(nullif(o_orderpriority, '1-URGENT')) AS n, count(*) AS m, coalesce(sum(CASE WHEN o_totalprice < 0 THEN o_totalprice END), 0.0) AS z FROM {O} GROUP BY o_orderstatus", inputs=("orders",), emit="batch")
app("s_order_limit_batch", "INSERT INTO o SELECT event_id, value FROM events WINDOW('lengthBatch', 100) ORDER BY value DESC, event_id LIMIT 3 OFFSET 1", f"SELECT event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY seq // 100 ORDER BY value DESC, event_id) AS r, count(*) OVER (PARTITION BY seq // 100) AS c FROM {E}) WHERE c = 100 AND r BETWEEN 2 AND 4")
app("s_order_limit", "INSERT INTO o SELECT event_id, value FROM events ORDER BY value, event_id LIMIT 20 OFFSET 5", f"SELECT event_id, value FROM {E} ORDER BY value, event_id LIMIT 20 OFFSET 5")
app("s_distinct", "INSERT INTO o SELECT DISTINCT user_id, event_type FROM events", f"SELECT DISTINCT user_id, event_type FROM {E}")
app("s_star", "INSERT INTO o SELECT * FROM events WHERE event_type = 'signup'", "SELECT event_id, ts, user_id, event_type, value, props FROM events WHERE event_type = 'signup'")
app("s_chained", "INSERT INTO big SELECT event_id, user_id, value FROM events WHERE value > 5; INSERT INTO o SELECT user_id, count(*) AS n, round(sum(value), 6) AS s FROM big WINDOW('lengthBatch', 50) GROUP BY user_id", f"WITH b AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS q FROM {E} WHERE value > 5), f AS (SELECT q // 50 AS k FROM b GROUP BY 1 HAVING count(*) = 50) SELECT user_id, count(*) AS n, round(sum(value), 6) AS s FROM b JOIN f ON k = q // 50 GROUP BY k, user_id")
app("s_union_insert", "INSERT INTO o SELECT event_id AS id FROM events WHERE event_type = 'error'; INSERT INTO o SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'P'", "SELECT event_id AS id FROM events WHERE event_type = 'error' UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'", inputs=("events", "orders"))

# Rate limits, triggers, rollup, partitions

for what, keep in (("ALL", "true"), ("FIRST", "seq % 10 = 0"), ("LAST", "seq % 10 = 9 OR seq = (SELECT max(seq) FROM e)")):
    app(f"r_output_{what.lower()}", f"INSERT INTO o SELECT event_id FROM events OUTPUT {what} EVERY 10 EVENTS", f"WITH e AS (SELECT * FROM {E}) SELECT event_id FROM e WHERE {keep}")
app("r_output_time_last", "INSERT INTO o SELECT event_id FROM events OUTPUT LAST EVERY 1 HOUR", f"SELECT arg_max(event_id, seq) AS event_id FROM {E} GROUP BY t // {HOUR}")
app("r_output_snapshot", "INSERT INTO o SELECT event_type, event_id FROM events GROUP BY event_type OUTPUT SNAPSHOT EVERY 1 DAY", f"SELECT event_type, arg_max(event_id, seq) AS event_id FROM {E} GROUP BY t // {DAY}, event_type")
app("t_every", "CREATE TRIGGER tick AT EVERY 1 DAY; INSERT INTO o SELECT triggered_time FROM tick", f"SELECT unnest(range(min(t) + {DAY}, max(t) + 1, {DAY})) AS triggered_time FROM {E}")
app("t_start", "CREATE TRIGGER tick AT START; INSERT INTO o SELECT triggered_time FROM tick", f"SELECT min(t) AS triggered_time FROM {E}")
app("t_cron", "CREATE TRIGGER tick AT CRON '0 30 12 * * *'; INSERT INTO o SELECT triggered_time FROM tick", f"SELECT triggered_time FROM (SELECT unnest(range(0, 40)) * {DAY} + (min(t) // {DAY}) * {DAY} + {HOUR * 25 // 2} AS triggered_time, min(t) AS a, max(t) AS b FROM {E}) WHERE triggered_time BETWEEN a AND b")
for per, ms in (("hour", HOUR), ("day", DAY), ("month", 30 * DAY)):

    @plain(f"a_rollup_{per}", f"SELECT t - t % {ms} AS AGG_TIMESTAMP, event_type, round(sum(value), 6) AS s, round(avg(value), 9) AS a, count(*) AS n, max(value) AS m FROM {E} GROUP BY ALL")
    def rollup(spark: SparkSession, sf_dir: str, per: str = per) -> DataFrame:
        e = bound(spark, sf_dir)
        e.run("CREATE AGGREGATION agg AS SELECT event_type, sum(value) AS s, avg(value) AS a, count(*) AS n, max(value) AS m FROM events GROUP BY event_type AGGREGATE EVERY SECOND TO YEAR")
        return e.query_aggregation("agg", per).withColumn("s", F.round("s", 6)).withColumn("a", F.round("a", 9))


@plain("a_rollup_stddev", f"SELECT t - t % {DAY} AS AGG_TIMESTAMP, event_type, round(stddev_pop(value + 1000000.0), 6) AS d FROM {E} GROUP BY ALL")
def a_rollup_stddev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Far from zero, where sums of squares would lose digits of the spread."""
    from tidewright.operators.rollup import Rollup

    far = ordered(read(spark, sf_dir, "events").withColumn("value", F.col("value") + 1e6), "ts", ["event_id"])
    o = Rollup(far, ["event_type"], {"d": ("stddev", "value")}, ["MINUTE", "HOUR", "DAY"]).query("DAY")
    return o.withColumn("d", F.round("d", 6))


@plain("a_rollup_within", f"SELECT t - t % {HOUR} AS AGG_TIMESTAMP, count(*) AS n FROM {E} WHERE t >= 1704844800000 AND t < 1705449600000 GROUP BY 1")
def rollup_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = bound(spark, sf_dir)
    e.run("CREATE AGGREGATION agg AS SELECT count(*) AS n FROM events AGGREGATE EVERY MINUTE, HOUR, DAY")
    return e.query_aggregation("agg", "hours", (1704844800000, 1705449600000))


app("p_partition_length", "PARTITION WITH (user_id OF events) BEGIN INSERT INTO o SELECT event_id, count(*) AS n, round(sum(value), 6) AS s FROM events WINDOW('length', 5); END", f"SELECT event_id, count(*) OVER w AS n, round(sum(value) OVER w, 6) AS s FROM {E} WINDOW w AS (PARTITION BY user_id ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
app("p_partition_batch", "PARTITION WITH (user_id OF events) BEGIN INSERT INTO o SELECT user_id, count(*) AS n, max(value) AS m FROM events WINDOW('lengthBatch', 10); END", f"WITH e AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY seq) - 1) // 10 AS b FROM {E}) SELECT user_id, count(*) AS n, max(value) AS m FROM e GROUP BY user_id, b HAVING count(*) = 10")
app("p_partition_range", "PARTITION WITH (CASE WHEN value < 5 THEN 'low' WHEN value < 20 THEN 'mid' ELSE 'high' END OF events) BEGIN INSERT INTO o SELECT event_id, sum(user_id) AS s FROM events WINDOW('length', 20); END", f"SELECT event_id, CAST(sum(user_id) OVER (PARTITION BY CASE WHEN value < 5 THEN 'low' WHEN value < 20 THEN 'mid' ELSE 'high' END ORDER BY seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM {E}")
app("p_partition_time_batch", "PARTITION WITH (event_type OF events) BEGIN INSERT INTO o SELECT event_type, count(*) AS n FROM events WINDOW TUMBLING(1 DAY); END", f"WITH e AS (SELECT *, (t - min(t) OVER (PARTITION BY event_type)) // {DAY} AS b FROM {E}), f AS (SELECT *, max(b) OVER (PARTITION BY event_type) AS z FROM e) SELECT event_type, count(*) AS n FROM f WHERE b < z GROUP BY event_type, b")

# Joins and tables


def sides(a: str, b: str) -> str:
    """Two event types as streams l and r with one sequence."""
    return f"m AS (SELECT *, row_number() OVER (ORDER BY t, event_type = '{b}', seq) - 1 AS q FROM {E} WHERE event_type IN ('{a}', '{b}')), l AS (SELECT *, row_number() OVER (ORDER BY q) - 1 AS rk FROM m WHERE event_type = '{a}'), r AS (SELECT *, row_number() OVER (ORDER BY q) - 1 AS rk FROM m WHERE event_type = '{b}')"


PS = ("purchase", "signup")
JOIN = "INSERT INTO o SELECT a.event_id AS l, b.event_id AS r FROM purchase AS a {how} signup AS b ON a.user_id = b.user_id"
app("j_inner", JOIN.format(how="JOIN"), f"WITH {sides(*PS)} SELECT l.event_id AS l, r.event_id AS r FROM l JOIN r USING (user_id)", inputs=PS)
LONE_L = "SELECT l.event_id, NULL FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.user_id = l.user_id AND r.q < l.q)"
LONE_R = "SELECT NULL, r.event_id FROM r WHERE NOT EXISTS (SELECT 1 FROM l WHERE r.user_id = l.user_id AND l.q < r.q)"
for how, more in (("left", [LONE_L]), ("right", [LONE_R]), ("full", [LONE_L, LONE_R])):
    app(f"j_{how}_eager", JOIN.format(how=f"{how.upper()} OUTER JOIN"), f"WITH {sides(*PS)} SELECT l.event_id AS l, r.event_id AS r FROM l JOIN r USING (user_id) UNION ALL " + " UNION ALL ".join(more), inputs=PS)
app("j_left_final", JOIN.format(how="LEFT JOIN") + " AND a.value > b.value", f"WITH {sides(*PS)} SELECT l.event_id AS l, r.event_id AS r FROM l LEFT JOIN r ON l.user_id = r.user_id AND l.value > r.value", inputs=PS, outer="final")
app("j_theta", "INSERT INTO o SELECT a.event_id AS l, b.event_id AS r FROM purchase AS a JOIN error AS b ON a.user_id = b.user_id AND a.value < b.value AND a.event_id != b.event_id WHERE b.value > 10", f"WITH {sides('purchase', 'error')} SELECT l.event_id AS l, r.event_id AS r FROM l JOIN r ON l.user_id = r.user_id AND l.value < r.value WHERE r.value > 10", inputs=("purchase", "error"))
app("j_time_windows", "INSERT INTO o SELECT a.event_id AS l, b.event_id AS r FROM purchase AS a WINDOW('time', 6 HOURS) JOIN signup AS b WINDOW('time', 2 HOURS) ON a.user_id = b.user_id", f"WITH {sides(*PS)} SELECT l.event_id AS l, r.event_id AS r FROM l JOIN r ON l.user_id = r.user_id AND ((r.q > l.q AND r.t - l.t < {6 * HOUR}) OR (l.q > r.q AND l.t - r.t < {2 * HOUR}))", inputs=PS)
app("j_time_windows_left", "INSERT INTO o SELECT a.event_id AS l, b.event_id AS r FROM purchase AS a WINDOW('time', 6 HOURS) LEFT JOIN signup AS b WINDOW('time', 2 HOURS) ON a.user_id = b.user_id", f"WITH {sides(*PS)}, p AS (SELECT l.event_id AS l, r.event_id AS r, l.q AS lq, r.q AS rq FROM l JOIN r ON l.user_id = r.user_id AND ((r.q > l.q AND r.t - l.t < {6 * HOUR}) OR (l.q > r.q AND l.t - r.t < {2 * HOUR}))) SELECT l, r FROM p UNION ALL SELECT event_id, NULL FROM l WHERE event_id NOT IN (SELECT l FROM p WHERE rq < lq)", inputs=PS)
app("j_length_windows", "INSERT INTO o SELECT a.event_id AS l, b.event_id AS r FROM purchase AS a WINDOW('length', 20) JOIN signup AS b WINDOW('length', 8) ON a.value < b.value", f"WITH {sides(*PS)}, ls AS (SELECT *, (SELECT count(*) FROM r WHERE r.q < l.q) AS seen FROM l), rs AS (SELECT *, (SELECT count(*) FROM l WHERE l.q < r.q) AS seen FROM r) SELECT l.event_id AS l, r.event_id AS r FROM ls l JOIN rs r ON l.value < r.value AND ((l.q < r.q AND r.seen - l.rk <= 20) OR (r.q < l.q AND l.seen - r.rk <= 8))", inputs=PS)
app("j_tumbling", "INSERT INTO o SELECT a.event_id AS l, b.event_id AS r FROM purchase AS a WINDOW('tumbling', 1 DAY) JOIN signup AS b WINDOW('tumbling', 1 DAY) ON a.user_id = b.user_id", f"WITH {sides(*PS)} SELECT l.event_id AS l, r.event_id AS r FROM l JOIN r ON l.user_id = r.user_id AND l.t // {DAY} = r.t // {DAY}", inputs=PS)
app("j_self", "INSERT INTO o SELECT a.event_id AS l, b.event_id AS r FROM signup AS a WINDOW('time', 1 DAY) JOIN signup AS b WINDOW('time', 1 DAY) ON a.user_id = b.user_id AND a.event_id < b.event_id", f"WITH s AS (SELECT * FROM {E} WHERE event_type = 'signup') SELECT a.event_id AS l, b.event_id AS r FROM s a JOIN s b ON a.user_id = b.user_id AND a.event_id < b.event_id AND abs(a.t - b.t) < {DAY}", inputs=("signup",))
app("j_unidirectional", "INSERT INTO o SELECT a.event_id AS l, b.event_id AS r FROM purchase AS a UNIDIRECTIONAL JOIN signup AS b ON a.user_id = b.user_id", f"WITH {sides(*PS)} SELECT l.event_id AS l, r.event_id AS r FROM l JOIN r ON l.user_id = r.user_id AND r.q < l.q", inputs=PS)
app("j_three_way", "INSERT INTO o SELECT a.event_id AS x, b.event_id AS y, c.c_custkey AS z FROM purchase AS a JOIN signup AS b ON a.user_id = b.user_id JOIN customer AS c ON c.c_custkey = a.user_id", "SELECT a.event_id AS x, b.event_id AS y, c_custkey AS z FROM events a JOIN events b ON a.user_id = b.user_id JOIN customer ON c_custkey = a.user_id WHERE a.event_type = 'purchase' AND b.event_type = 'signup'", inputs=(*PS, "customer"))
app("j_table", "INSERT INTO o SELECT e.event_id, c.c_name, c.c_acctbal FROM events AS e JOIN customer AS c ON e.user_id = c.c_custkey WHERE c.c_acctbal > 0", "SELECT event_id, c_name, c_acctbal FROM events JOIN customer ON user_id = c_custkey WHERE c_acctbal > 0", inputs=("events", "customer"))
app("j_table_left", "INSERT INTO o SELECT e.event_id, c.c_name FROM events AS e LEFT JOIN customer AS c ON e.user_id = c.c_custkey AND c.c_acctbal < 0", "SELECT event_id, c_name FROM events LEFT JOIN customer ON user_id = c_custkey AND c_acctbal < 0", inputs=("events", "customer"))
app("j_table_on_left", "INSERT INTO o SELECT n.n_name, count(*) AS n FROM nation AS n JOIN events AS e ON n.n_nationkey = e.user_id GROUP BY n.n_name", "SELECT n_name, count(*) AS n FROM nation JOIN events ON n_nationkey = user_id GROUP BY n_name", inputs=("events", "nation"), emit="batch")


@plain("j_table_as_of", None)
def j_table_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with its user's last order before it; orders are shifted into the time of the events."""
    orders = read(spark, sf_dir, "orders")
    e = bound(spark, sf_dir).table_log("orders_table", orders.select("o_custkey", "o_orderkey", "o_totalprice", _shifted(orders).alias("at")), "o_custkey", "at", ("o_orderkey",))
    return e.run("INSERT INTO o SELECT e.event_id, t.o_orderkey, t.o_totalprice FROM events AS e JOIN orders_table AS t ON e.user_id = t.o_custkey")["o"]


def _shifted(orders: DataFrame):
    """Order times squeezed into the month of the events: a key's hash of minutes after its start."""
    return (F.lit(1704067200000) + (F.col("o_orderkey") * 7919) % 43200 * 60000).alias("at")


SHIFT = "(SELECT o_custkey, o_orderkey, o_totalprice, 1704067200000 + (o_orderkey * 7919) % 43200 * 60000 AS at FROM orders)"
ORACLE["j_table_as_of"] = f"SELECT event_id, o_orderkey, o_totalprice FROM (SELECT e.event_id, o.*, row_number() OVER (PARTITION BY e.event_id ORDER BY o.at DESC, o.o_orderkey DESC) AS k FROM {E} e JOIN {SHIFT} o ON e.user_id = o.o_custkey AND o.at <= e.t) WHERE k = 1"
app("x_in_table", "INSERT INTO o SELECT event_id FROM events WHERE user_id IN vip AND value > 1", "SELECT event_id FROM events WHERE value > 1 AND user_id IN (SELECT s_suppkey FROM supplier)", inputs=("events",))


def _in_table(spark: SparkSession, sf_dir: str, negated: str = "") -> DataFrame:
    e = bound(spark, sf_dir).table("vip", read(spark, sf_dir, "supplier").select("s_suppkey"))
    return e.run(f"INSERT INTO o SELECT event_id FROM events WHERE {negated} user_id IN vip AND value > 1")["o"]


QUERIES["x_in_table"] = _in_table
plain("x_not_in_table", "SELECT event_id FROM events WHERE value > 1 AND user_id NOT IN (SELECT s_suppkey FROM supplier)")(lambda s, d: _in_table(s, d, "NOT"))
app("tb_insert", "CREATE TABLE latest (u BIGINT, e BIGINT); INSERT INTO latest SELECT user_id, event_id FROM events WHERE event_type = 'signup'", "SELECT user_id AS u, event_id AS e FROM events WHERE event_type = 'signup'", out="latest")
app("tb_upsert_key", "CREATE TABLE latest (u BIGINT PRIMARY KEY, e BIGINT, v DOUBLE); INSERT INTO latest SELECT user_id, event_id, value FROM events", f"SELECT user_id AS u, arg_max(event_id, seq) AS e, arg_max(value, seq) AS v FROM {E} GROUP BY user_id", out="latest")
app("tb_cache", "CREATE TABLE recent (e BIGINT) WITH (extension = 'cache', max_size = '100'); INSERT INTO recent SELECT event_id FROM events", f"SELECT event_id AS e FROM {E} ORDER BY seq DESC LIMIT 100", out="recent")
app("tb_update", "UPDATE customer ON (c_custkey) SELECT user_id AS c_custkey, value AS c_acctbal FROM events WHERE event_type = 'purchase'", f"WITH u AS (SELECT user_id, arg_max(value, seq) AS v FROM {E} WHERE event_type = 'purchase' GROUP BY user_id) SELECT c_custkey, c_name, c_nationkey, coalesce(v, c_acctbal) AS c_acctbal, c_mktsegment FROM customer LEFT JOIN u ON user_id = c_custkey", inputs=("events", "customer"), out="customer")
app("tb_delete", "DELETE FROM customer ON (c_custkey) SELECT user_id AS c_custkey FROM events WHERE event_type = 'error'", "SELECT * FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'error')", inputs=("events", "customer"), out="customer")
app("tb_upsert", "UPSERT INTO region ON (r_regionkey) SELECT o_custkey % 8 AS r_regionkey, o_orderpriority AS r_name FROM orders", f"WITH u AS (SELECT o_custkey % 8 AS k, arg_max(o_orderpriority, seq) AS v FROM {O} GROUP BY 1) SELECT k AS r_regionkey, v AS r_name FROM u UNION ALL SELECT r_regionkey, r_name FROM region WHERE r_regionkey NOT IN (SELECT k FROM u)", inputs=("orders", "region"), out="region")

# Patterns

USER = "PARTITION WITH (user_id OF view, user_id OF click, user_id OF purchase) BEGIN {q}; END"


def chained(types: tuple[str, ...], key: bool, within: int | None = None) -> str:
    """SQL of EVERY(a -> b -> …): each start with the first next event of each step."""
    e = "SELECT *, " + ", ".join(f"min(CASE WHEN event_type = '{t}' THEN seq END) OVER ({'PARTITION BY user_id ' if key else ''}ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n_{t}" for t in types[1:]) + f" FROM {E}"
    names = "abcdefg"[: len(types)]
    out = f"WITH e AS ({e}) SELECT " + ", ".join(f"{n}.event_id AS {n}" for n in names) + " FROM e a"
    for p, n, t in zip(names, names[1:], types[1:]):
        out += f" JOIN e {n} ON {n}.seq = {p}.n_{t}"
    out += f" WHERE a.event_type = '{types[0]}'"
    return out + (f" AND {names[-1]}.t - a.t <= {within}" if within else "")


VCP = ("view", "click", "purchase")
THREE = "INSERT INTO o SELECT e1.event_id AS a, e2.event_id AS b, e3.event_id AS c FROM PATTERN ({p})"
app("pt_every_keyed", USER.format(q=THREE.format(p="EVERY(e1=view -> e2=click -> e3=purchase)")), chained(VCP, True), inputs=VCP)
app("pt_every", THREE.format(p="EVERY(e1=view -> e2=click -> e3=purchase)"), chained(VCP, False), inputs=VCP)
app("pt_once", THREE.format(p="e1=view -> e2=click -> e3=purchase"), chained(VCP, False) + " ORDER BY a.seq LIMIT 1", inputs=VCP)
app("pt_once_keyed", USER.format(q=THREE.format(p="e1=view -> e2=click -> e3=purchase")), chained(VCP, True) + " QUALIFY row_number() OVER (PARTITION BY a.user_id ORDER BY a.seq) = 1", inputs=VCP)
app("pt_within", "PARTITION WITH (user_id OF view, user_id OF purchase) BEGIN INSERT INTO o SELECT e1.event_id AS a, e2.event_id AS b FROM PATTERN (EVERY(e1=view -> e2=purchase) WITHIN 1 DAY); END", chained(("view", "purchase"), True, DAY), inputs=("view", "purchase"))
app("pt_within_events", "INSERT INTO o SELECT e1.event_id AS a, e2.event_id AS b FROM PATTERN (EVERY(e1=view -> e2=purchase) WITHIN 3 EVENTS)", f"""WITH m AS (SELECT event_id, event_type, row_number() OVER (ORDER BY seq) AS r FROM {E} WHERE event_type IN ('view', 'purchase')),
n AS (SELECT *, min(CASE WHEN event_type = 'purchase' THEN r END) OVER (ORDER BY r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM m)
SELECT n.event_id AS a, m.event_id AS b FROM n JOIN m ON m.r = n.nx WHERE n.event_type = 'view' AND n.nx - n.r < 3""", inputs=("view", "purchase"))
app("pt_filter", "PARTITION WITH (user_id OF view, user_id OF purchase) BEGIN INSERT INTO o SELECT e1.event_id AS a, e2.event_id AS b FROM PATTERN (EVERY(e1=view[value > 10] -> e2=purchase[value > 5])); END", f"WITH e AS (SELECT *, min(CASE WHEN event_type = 'purchase' AND value > 5 THEN seq END) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM {E}) SELECT a.event_id AS a, b.event_id AS b FROM e a JOIN e b ON b.seq = a.n WHERE a.event_type = 'view' AND a.value > 10", inputs=("view", "purchase"))
app("pt_cross_filter", "PARTITION WITH (user_id OF view, user_id OF purchase) BEGIN INSERT INTO o SELECT e1.event_id AS a, e2.event_id AS b FROM PATTERN (EVERY(e1=view -> e2=purchase[value > e1.value]) WITHIN 7 DAYS); END", f"SELECT a, arg_min(b, q) AS b FROM (SELECT a.event_id AS a, b.event_id AS b, b.seq AS q FROM {E} a JOIN {E} b ON a.user_id = b.user_id AND b.seq > a.seq AND b.value > a.value AND b.t - a.t <= {7 * DAY} WHERE a.event_type = 'view' AND b.event_type = 'purchase') GROUP BY a", inputs=("view", "purchase"))
app("pt_where", "PARTITION WITH (user_id OF view, user_id OF purchase) BEGIN INSERT INTO o SELECT e1.event_id AS a, e2.event_id AS b FROM PATTERN (EVERY(e1=view -> e2=purchase)) WHERE e2.value > e1.value; END", chained(("view", "purchase"), True) + " AND b.value > a.value", inputs=("view", "purchase"))
app("pt_same_stream", "PARTITION WITH (user_id OF purchase) BEGIN INSERT INTO o SELECT e1.event_id AS a, e2.event_id AS b FROM PATTERN (EVERY(e1=purchase -> e2=purchase)); END", chained(("purchase", "purchase"), True), inputs=("purchase",))
app("pt_count", "PARTITION WITH (user_id OF error, user_id OF purchase) BEGIN INSERT INTO o SELECT count(e1) AS n, e1[0].event_id AS f, e1[last].event_id AS l, round(sum(e1.value), 6) AS s, e2.event_id AS b FROM PATTERN (EVERY(e1=error{2} -> e2=purchase)); END", f"""WITH k AS (SELECT *, lead(seq) OVER (PARTITION BY user_id ORDER BY seq) AS n1, lead(event_id) OVER (PARTITION BY user_id ORDER BY seq) AS e1, lead(value) OVER (PARTITION BY user_id ORDER BY seq) AS v1 FROM {E} WHERE event_type = 'error'),
p AS (SELECT * FROM {E} WHERE event_type = 'purchase')
SELECT CAST(2 AS BIGINT) AS n, f, l, s, arg_min(b, q) AS b FROM (SELECT k.event_id AS f, k.e1 AS l, round(k.value + k.v1, 6) AS s, p.event_id AS b, p.seq AS q FROM k JOIN p ON p.user_id = k.user_id AND p.seq > k.n1) GROUP BY f, l, s""", inputs=("error", "purchase"))
app("pt_count_range", "PARTITION WITH (user_id OF error, user_id OF signup) BEGIN INSERT INTO o SELECT count(e1) AS n, e1[0].event_id AS f, e2.event_id AS b FROM PATTERN (EVERY(e1=error{1,2} -> e2=signup) WITHIN 3 DAYS); END", f"""WITH k AS (SELECT *, lead(seq) OVER (PARTITION BY user_id ORDER BY seq) AS n1 FROM {E} WHERE event_type = 'error'), p AS (SELECT * FROM {E} WHERE event_type = 'signup'),
m AS (SELECT 1 AS n, k.event_id AS f, p.event_id AS b, p.seq AS q, p.t - k.t AS d FROM k JOIN p ON p.user_id = k.user_id AND p.seq > k.seq UNION ALL SELECT 2, k.event_id, p.event_id, p.seq, p.t - k.t FROM k JOIN p ON p.user_id = k.user_id AND p.seq > k.n1)
SELECT CAST(n AS BIGINT) AS n, f, arg_min(b, q) AS b FROM m WHERE d <= {3 * DAY} GROUP BY n, f""", inputs=("error", "signup"))
app("pt_sequence", "PARTITION WITH (user_id OF view, user_id OF click) BEGIN INSERT INTO o SELECT e1.event_id AS a, e2.event_id AS b FROM SEQUENCE (e1=view -> e2=click); END", f"SELECT event_id AS a, n AS b FROM (SELECT *, lead(event_id) OVER w AS n, lead(event_type) OVER w AS nt FROM {E} WHERE event_type IN ('view', 'click') WINDOW w AS (PARTITION BY user_id ORDER BY seq)) WHERE event_type = 'view' AND nt = 'click'", inputs=("view", "click"))
app("pt_and", "INSERT INTO o SELECT e1.event_id AS a, e2.event_id AS b FROM PATTERN (e1=signup AND e2=error)", f"SELECT a.event_id AS a, b.event_id AS b FROM (SELECT *, row_number() OVER (ORDER BY seq) AS i FROM {E} WHERE event_type = 'signup') a JOIN (SELECT *, row_number() OVER (ORDER BY seq) AS i FROM {E} WHERE event_type = 'error') b USING (i)", inputs=("signup", "error"))
app("pt_or", "INSERT INTO o SELECT e1.event_id AS a, e2.event_id AS b FROM PATTERN (e1=signup OR e2=error)", "SELECT CASE WHEN event_type = 'signup' THEN event_id END AS a, CASE WHEN event_type = 'error' THEN event_id END AS b FROM events WHERE event_type IN ('signup', 'error')", inputs=("signup", "error"))
app("pt_logical_in_chain", "PARTITION WITH (user_id OF view, user_id OF click, user_id OF purchase) BEGIN INSERT INTO o SELECT e1.event_id AS a, e2.event_id AS b, e3.event_id AS c FROM PATTERN (EVERY(e1=view -> (e2=click AND e3=purchase))); END", f"WITH e AS (SELECT *, min(CASE WHEN event_type = 'click' THEN seq END) OVER w AS nc, min(CASE WHEN event_type = 'purchase' THEN seq END) OVER w AS np FROM {E} WINDOW w AS (PARTITION BY user_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) SELECT a.event_id AS a, b.event_id AS b, c.event_id AS c FROM e a JOIN e b ON b.seq = a.nc JOIN e c ON c.seq = a.np WHERE a.event_type = 'view'", inputs=VCP)
app("pt_absent_after", "PARTITION WITH (user_id OF signup, user_id OF purchase) BEGIN INSERT INTO o SELECT e1.event_id AS a FROM PATTERN (EVERY(e1=signup -> NOT purchase FOR 2 DAYS)); END", f"WITH m AS (SELECT * FROM {E} WHERE event_type IN ('signup', 'purchase')) SELECT event_id AS a FROM m WHERE event_type = 'signup' AND t + {2 * DAY} <= (SELECT max(t) FROM m) AND NOT EXISTS (SELECT 1 FROM m p WHERE p.event_type = 'purchase' AND p.user_id = m.user_id AND p.seq > m.seq AND p.t - m.t <= {2 * DAY})", inputs=("signup", "purchase"))
app("pt_absent_before", "PARTITION WITH (user_id OF click, user_id OF purchase) BEGIN INSERT INTO o SELECT e2.event_id AS b FROM PATTERN (EVERY(NOT click FOR 1 DAY -> e2=purchase)); END", f"SELECT event_id AS b FROM {E} m WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM {E} p WHERE p.event_type = 'click' AND p.user_id = m.user_id AND p.seq < m.seq AND m.t - p.t <= {DAY})", inputs=("click", "purchase"))

# Expressions and functions

app("f_arithmetic", "INSERT INTO o SELECT o_orderkey, o_orderkey / 7 AS d, o_orderkey / (o_orderkey % 2) AS z, o_orderkey % 10 AS m, -o_custkey AS neg, o_custkey * 2 + 1 AS p, o_orderkey - o_custkey AS s FROM orders", "SELECT o_orderkey, o_orderkey / 7 AS d, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_orderkey / (o_orderkey % 2) END AS z, o_orderkey % 10 AS m, -o_custkey AS neg, o_custkey * 2 + 1 AS p, o_orderkey - o_custkey AS s FROM orders", inputs=("orders",))
app("f_predicates", "INSERT INTO o SELECT o_orderkey FROM orders WHERE (o_orderstatus IN ('F', 'P') OR NOT o_totalprice BETWEEN 1000 AND 200000) AND o_orderpriority NOT LIKE '%LOW' AND o_orderpriority LIKE '_-%' AND o_custkey NOT IN (1, 2, 3) AND o_orderstatus IS NOT NULL AND o_orderkey != 5", "SELECT o_orderkey FROM orders WHERE (o_orderstatus IN ('F', 'P') OR NOT o_totalprice BETWEEN 1000 AND 200000) AND o_orderpriority NOT LIKE '%LOW' AND o_orderpriority LIKE '_-%' AND o_custkey NOT IN (1, 2, 3) AND o_orderstatus IS NOT NULL AND o_orderkey <> 5", inputs=("orders",))
app("f_null_two_valued", "INSERT INTO o SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'O') != 'F'", "SELECT o_orderkey FROM orders WHERE coalesce(nullif(o_orderstatus, 'O') <> 'F', true)", inputs=("orders",), null_mode="two_valued")
app("f_case", "INSERT INTO o SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' END AS a, CASE WHEN o_totalprice > 100000 THEN 1 WHEN o_totalprice > 50000 THEN 2 ELSE 3 END AS b FROM orders", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' END AS a, CASE WHEN o_totalprice > 100000 THEN 1 WHEN o_totalprice > 50000 THEN 2 ELSE 3 END AS b FROM orders", inputs=("orders",))
app("f_cast", "INSERT INTO o SELECT o_orderkey, CAST(o_totalprice AS INT) AS i, CAST(o_orderkey AS STRING) AS s, CAST(o_orderpriority AS INT) AS n, CAST(left(o_orderpriority, 1) AS BIGINT) AS l, CAST(o_custkey AS DOUBLE) AS d FROM orders", "SELECT o_orderkey, CAST(trunc(o_totalprice) AS INT) AS i, CAST(o_orderkey AS VARCHAR) AS s, TRY_CAST(o_orderpriority AS INT) AS n, CAST(left(o_orderpriority, 1) AS BIGINT) AS l, CAST(o_custkey AS DOUBLE) AS d FROM orders", inputs=("orders",))
app("f_math", "INSERT INTO o SELECT event_id, abs(0 - value) AS a, ceil(value) AS c, floor(value) AS f, round(value) AS r, round(value, 1) AS r1, trunc(value, 1) AS t1, truncate(value) AS t, sign(value - 10) AS sg, mod(value, 3) AS m, maximum(value, 10, 5) AS mx, minimum(value, 10) AS mn FROM events", "SELECT event_id, abs(0 - value) AS a, ceil(value) AS c, floor(value) AS f, round(value) AS r, round(value, 1) AS r1, CASE WHEN value >= 0 THEN floor(value * 10) / 10 ELSE -floor(-value * 10) / 10 END AS t1, trunc(value) AS t, CAST(sign(value - 10) AS INT) AS sg, value % 3 AS m, greatest(value, 10, 5) AS mx, least(value, 10.0) AS mn FROM events")
app("f_math_real", "INSERT INTO o SELECT event_id, round(sqrt(value), 6) AS a, round(exp(value / 100), 6) AS b, round(ln(value + 1), 6) AS c, round(log(value + 1), 6) AS d, round(log10(value + 1), 6) AS e, round(power(value, 2), 4) AS f, round(pow(value, 0.5), 6) AS g, round(sin(value) + cos(value) + tan(value / 1000), 6) AS h, round(asin(value / 1000) + acos(value / 1000) + atan(value), 6) AS i FROM events WHERE value < 900", "SELECT event_id, round(sqrt(value), 6) AS a, round(exp(value / 100), 6) AS b, round(ln(value + 1), 6) AS c, round(ln(value + 1), 6) AS d, round(log10(value + 1), 6) AS e, round(value ** 2, 4) AS f, round(value ** 0.5, 6) AS g, round(sin(value) + cos(value) + tan(value / 1000), 6) AS h, round(asin(value / 1000) + acos(value / 1000) + atan(value), 6) AS i FROM events WHERE value < 900")
DOCS = "(SELECT doc_id, coalesce(text, '') AS text, lang, source FROM documents)"


def documents(name: str, select: str, oracle: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source")
        return Runner(spark).stream("docs", docs, "doc_id").run(f"INSERT INTO o SELECT {select} FROM docs")["o"]

    QUERIES[name] = query
    ORACLE[name] = f"SELECT {oracle} FROM {DOCS}"


documents(
    "f_string",
    "doc_id, length(text) AS n, octet_length(text) AS b, upper(lang) AS u, lower(source) AS lo, concat(lang, '-', source) AS c, lang || source AS c2, substring(text, 3, 5) AS s1, substr(text, -2, 3) AS s2, substring(text, 4) AS s3, left(text, 3) AS l, right(text, 3) AS r, reverse(lang) AS rv, repeat(lang, 2) AS rp, replace(source, 'src', 's') AS re",
    "doc_id, CAST(length(text) AS INT) AS n, CAST(strlen(text) AS INT) AS b, upper(lang) AS u, lower(source) AS lo, lang || '-' || source AS c, lang || source AS c2, substring(text, 3, 5) AS s1, substring(text, 1, 3) AS s2, substring(text, 4) AS s3, left(text, 3) AS l, right(text, 3) AS r, reverse(lang) AS rv, repeat(lang, 2) AS rp, replace(source, 'src', 's') AS re",
)
documents(
    "f_string_more",
    "doc_id, trim(concat('  ', lang, '  ')) AS t, ltrim(concat('  ', lang)) AS lt, rtrim(concat(lang, '  ')) AS rt, position('the', text) AS p, locate('e', lang) AS lc, instr('n', lang) AS i, ascii(text) AS a, ascii('') AS e, chr(955) AS ch, lpad(lang, 5, '*') AS lp, rpad(lang, 5, 'ab') AS rp, lpad(lang, 4, '') AS l0, starts_with(text, 'T') AS sw, ends_with(text, '.') AS ew, contains(text, 'the') AS ct",
    "doc_id, lang AS t, lang AS lt, lang AS rt, CAST(strpos(text, 'the') AS INT) AS p, CAST(strpos(lang, 'e') AS INT) AS lc, CAST(strpos(lang, 'n') AS INT) AS i, CASE WHEN text <> '' THEN unicode(text) END AS a, NULL::INT AS e, chr(955) AS ch, lpad(lang, 5, '*') AS lp, rpad(lang, 5, 'ab') AS rp, lang AS l0, starts_with(text, 'T') AS sw, ends_with(text, '.') AS ew, contains(text, 'the') AS ct",
)
documents(
    "f_null_functions",
    "doc_id, coalesce(nullif(lang, 'en'), source, 'x') AS c, default(nullif(lang, 'en'), 'none') AS d, ifnull(nullif(doc_id, CAST(3 AS BIGINT)), 0) AS i, nullif(lang, 'de') AS n, IF(doc_id > 10, 'hi', 'lo') AS f, is_null(nullif(lang, 'fr')) AS isn, is_not_null(lang) AS inn, instanceOfString(lang) AS s, instanceOfLong(lang) AS l, instanceOfLong(doc_id) AS k",
    "doc_id, coalesce(nullif(lang, 'en'), source, 'x') AS c, coalesce(nullif(lang, 'en'), 'none') AS d, coalesce(nullif(doc_id, 3), 0) AS i, nullif(lang, 'de') AS n, CASE WHEN doc_id > 10 THEN 'hi' ELSE 'lo' END AS f, lang = 'fr' AS isn, lang IS NOT NULL AS inn, lang IS NOT NULL AS s, false AS l, true AS k",
)
app("f_date", "INSERT INTO o SELECT event_id, eventTimestamp() AS t, formatDate(eventTimestamp(), '%Y-%m-%d %H:%M:%S') AS f, parseDate(formatDate(eventTimestamp(), '%Y-%m-%d'), '%Y-%m-%d') AS p, dateAdd(eventTimestamp(), 2, 'hours') AS a, eventTimestamp() + INTERVAL '1' DAY AS i, EXTRACT(HOUR FROM eventTimestamp()) AS h, aggregateBaseTime(eventTimestamp(), 'hour') AS b FROM events", f"SELECT event_id, t, strftime(make_timestamp(t * 1000), '%Y-%m-%d %H:%M:%S') AS f, t - t % {DAY} AS p, t + {2 * HOUR} AS a, t + {DAY} AS i, t // {HOUR} % 24 AS h, t - t % {HOUR} AS b FROM {E}")


@plain("f_now_uuid", "SELECT count(*) AS n, count(*) AS u, true AS recent FROM events")
def f_now_uuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = bound(spark, sf_dir).run("INSERT INTO o SELECT event_id, uuid() AS u, now() AS t FROM events")["o"]
    return o.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("u").alias("u"), F.min(F.col("t") > 1_700_000_000_000).alias("recent"))


@plain("f_udf", "SELECT event_id, value * 2 + 1 AS r FROM events")
def f_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir).udf("twice_plus", lambda x, y: x * 2 + y, "DOUBLE").run("INSERT INTO o SELECT event_id, twice_plus(value, 1) AS r FROM events")["o"]


app("f_forms", "INSERT INTO o SELECT event_id, like(event_type, '%ick') AS l, cast(value, 'long') AS c, convert(user_id, 'string') AS s FROM events", "SELECT event_id, event_type LIKE '%ick' AS l, CAST(trunc(value) AS BIGINT) AS c, CAST(user_id AS VARCHAR) AS s FROM events")


@plain("f_rollup_helpers", f"SELECT event_id, t // 1000 * 1000 AS ms, t AS a, t + {HOUR} AS b, event_id >= t AS u, true AS zone FROM {E}")
def f_rollup_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scalars that belong to rollups: time from text, a pair of times, whether a stored time is newer, the session's zone."""
    text = f"INSERT INTO o SELECT event_id, timestampInMilliseconds(formatDate(eventTimestamp(), '%Y-%m-%d %H:%M:%S')) AS ms, startTimeEndTime(eventTimestamp(), eventTimestamp() + {HOUR}) AS ab, shouldUpdate(event_id) AS u, getTimeZone() AS zone FROM events"
    o = bound(spark, sf_dir).run(text)["o"]
    return o.select("event_id", "ms", F.col("ab")[0].alias("a"), F.col("ab")[1].alias("b"), "u", (F.col("zone") == F.current_timezone()).alias("zone"))


# Extensions and calls back


@plain("x_aggregate", f"WITH e AS (SELECT *, t // {DAY} AS b FROM {E}) SELECT user_id, round(median(value), 9) AS m FROM e GROUP BY b, user_id")
def x_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.functions.registry import aggregate

    aggregate("middle", "double", numeric=True)(F.median)
    return bound(spark, sf_dir, align="epoch").run("INSERT INTO o SELECT user_id, round(middle(value), 9) AS m FROM events WINDOW TUMBLING(1 DAY) GROUP BY user_id")["o"]


@plain("x_scalar", "SELECT event_id, value * value AS r FROM events")
def x_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.functions.registry import scalar

    scalar("squared", "double")(lambda x: x * x)
    return bound(spark, sf_dir).run("INSERT INTO o SELECT event_id, squared(value) AS r FROM events")["o"]


@plain("w_custom", f"SELECT event_id, count(*) OVER (ORDER BY seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS n, max(value) OVER (ORDER BY seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS m FROM {E}")
def w_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.operators.windows import Spec

    e = bound(spark, sf_dir).window("dozens", lambda n: Spec("length", n=10 * n))
    return e.run("INSERT INTO o SELECT event_id, count(*) AS n, max(value) AS m FROM events WINDOW('dozens', 2)")["o"]


@plain("io_callback", "SELECT event_id, value FROM events WHERE value > 20")
def io_callback(spark: SparkSession, sf_dir: str) -> DataFrame:
    got: list[DataFrame] = []
    bound(spark, sf_dir).on("o", got.append).run("INSERT INTO o SELECT event_id, value FROM events WHERE value > 20")
    return got[0]


@plain("tb_contains", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def tb_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.operators.tables import contains

    own = read(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return contains(own, read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"))


# Sources and sinks: payloads there and back


@plain("io_json", "SELECT event_id, user_id, event_type, value, CAST(props->>'$.k' AS INT) AS k FROM events")
def io_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright import types
    from tidewright.sources.formats import from_json, to_json

    rows = read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("USER_ID"), "event_type", "value", F.from_json("props", "k int").alias("props"))
    schema = types.schema((("event_id", "LONG"), ("user_id", "LONG"), ("event_type", "STRING"), ("value", "DOUBLE"), ("k", "INT")))
    return from_json(to_json(rows), schema, mappings={"k": "$.props.k"}).drop("_error")


@plain("io_csv", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def io_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright import types
    from tidewright.sources.formats import from_csv, to_csv

    rows = read(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", "o_totalprice")
    schema = types.schema((("o_orderkey", "LONG"), ("o_orderstatus", "STRING"), ("o_totalprice", "DOUBLE")))
    return from_csv(to_csv(rows, ";"), schema, delimiter=";", columns={"o_orderstatus": 0, "o_orderkey": 1, "o_totalprice": 2}).drop("_error")


@plain("io_bytes", "SELECT event_id, octet_length(encode(props)) AS n, md5(props) AS h FROM events")
def io_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.sources.formats import from_bytes

    rows = read(spark, sf_dir, "events").select("event_id", "props")
    back = from_bytes(rows.select("event_id", F.col("props").cast("binary").alias("value")), "raw")
    return back.select("event_id", F.octet_length("raw").alias("n"), F.md5("raw").alias("h"))


@plain("io_dead_letters", "SELECT event_id AS ok, NULL AS original FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT NULL, props || '!' FROM events WHERE event_id % 3 = 0")
def io_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright import types
    from tidewright.sources.errors import handled
    from tidewright.sources.formats import from_json

    text = F.when(F.col("event_id") % 3 == 0, F.concat("props", F.lit("!"))).otherwise(F.to_json(F.struct("event_id")))
    rows = read(spark, sf_dir, "events").select(text.alias("value"), text.alias("_payload"))
    broken = rows.withColumn("value", F.when(F.endswith("value", F.lit("!")), F.lit("{")).otherwise(F.col("value")))
    good, dead = handled(from_json(broken, types.schema((("event_id", "LONG"),))), "dlq", "events")
    return good.select(F.col("event_id").alias("ok"), F.lit(None).cast("string").alias("original")).unionByName(dead.select(F.lit(None).cast("bigint").alias("ok"), F.col("originalEvent").alias("original")))
