"""Registered queries over ``events``, ``labels`` and the order tables: operations, feedback, state, joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.operators import evaluation, operations, state
from weftline.tables import half_up, load, micros


def _events(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events")


def _failed():
    return F.col("event_type") == "error"


def _rating():
    """Purchases and sign-ups as likes, errors as dislikes; other events carry no rating."""
    return F.when(F.col("event_type").isin("purchase", "signup"), "like").when(F.col("event_type") == "error", "dislike")


def latency_percentiles(spark, d):
    return operations.latency_summary(_events(spark, d), "event_type", "value")


def latency_recent(spark, d):
    """The same over the newest 1000 of each type."""
    recent = operations.last_n(_events(spark, d), ["event_type"], 1000, F.desc("ts"), F.desc("event_id"))
    return operations.latency_summary(recent, "event_type", "value")


def stage_summary(spark, d):
    return operations.stage_summary(_events(spark, d).withColumn("stage", (F.col("user_id") % 7).cast("int")), "stage", _failed(), "value")


def error_counts(spark, d):
    """Errors by user as a count and the share of all."""
    rows = _events(spark, d).groupBy("user_id").agg(F.count_if(_failed()).alias("errors"), F.count(F.lit(1)).alias("events"))
    return rows.withColumn("rate", operations.share(F.col("errors"), F.col("events")))


def coverage_ratios(spark, d):
    has = lambda kind: F.count_if(F.col("event_type") == kind)
    n = F.count(F.lit(1))
    return _events(spark, d).agg(n.alias("queries"), operations.share(has("view"), n).alias("view_share"), operations.share(has("purchase"), has("click")).alias("purchase_per_click"), operations.share(has("missing"), has("none")).alias("guarded"))


def error_rate_5m_sliding(spark, d):
    return operations.sliding_errors(_events(spark, d).select("event_id", "ts", "event_type"), "ts", _failed()).select("event_id", "in_window", "failed_in_window", "error_rate", "alert")


def daily_cost_tz(spark, d):
    day = operations.local_day(F.col("ts"), "Asia/Shanghai")
    return _events(spark, d).groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("cost"))


def ops_snapshot(spark, d):
    """Totals, and the same over the newest 100 events."""
    rows = _events(spark, d)
    total = rows.agg(F.lit("all").alias("part"), F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))
    recent = rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(100).agg(F.lit("recent").alias("part"), F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return total.union(recent)


def web_vitals_last_n(spark, d):
    """Of the newest 200 events, by type: mean, extremes and count of values under 500, and ratings of all."""
    rows = _events(spark, d).orderBy(F.desc("ts"), F.desc("event_id")).limit(200)
    low = F.when(F.col("value") < 500, F.col("value"))
    return rows.groupBy("event_type").agg(F.round(F.coalesce(F.avg(low), F.lit(0.0)), 6).alias("mean"), F.coalesce(F.min(low), F.lit(0.0)).alias("low"), F.coalesce(F.max(low), F.lit(0.0)).alias("high"), F.count(low).alias("n"), F.count_if(F.col("value") < 100).alias("good"), F.count_if(F.col("value") >= 100).alias("poor"))


def feedback_latest(spark, d):
    rows = _events(spark, d).withColumn("rating", _rating()).where("rating is not null")
    return operations.latest(rows, ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "rating")


def feedback_summary(spark, d):
    return operations.feedback_summary(_events(spark, d).withColumn("rating", _rating()).where("rating is not null"), "rating", ["user_id"]).na.fill(0)


def feedback_page(spark, d):
    """The second page of 50 of the likes, newest first, with the number of all."""
    rows = _events(spark, d).withColumn("rating", _rating()).where("rating = 'like'")
    first = rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(100)
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("ts"), F.desc("event_id"))))
    return placed.where("place > 50").select("event_id", "place", rows.agg(F.count(F.lit(1))).scalar().alias("total"))


def quota_admission(spark, d):
    day = operations.local_day(F.col("ts"), "Asia/Shanghai")
    rows = operations.admitted(_events(spark, d).withColumn("day", day), ["user_id", "day"], 2, F.col("ts"), F.col("event_id"))
    return rows.select("event_id", "user_id", "day", "request", "admitted")


def rate_limit_minute(spark, d):
    """Requests of a minute (of sixty hours here, so that some are refused) against a limit of three."""
    minute = F.floor(micros(F.col("ts")) / 216_000_000_000)
    rows = operations.admitted(_events(spark, d).withColumn("minute", minute), ["minute"], 3, F.col("ts"), F.col("event_id"))
    return rows.groupBy("minute").agg(F.sum("admitted").alias("admitted"), F.count(F.lit(1)).alias("requests"))


def event_props_json(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return _events(spark, d).groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("events"), F.round(F.avg("value"), 6).alias("mean"))


def tool_latency(spark, d):
    """How many values each type has, and the one at floor(0.95 n)."""
    n = _events(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.join(operations.percentiles(_events(spark, d), "event_type", "value", {"p95": operations.floor_index(0.95)}), "event_type")


def no_progress_runs(spark, d):
    """Runs of two or more equal events in a row, by user."""
    rows = state.runs(_events(spark, d), ["user_id"], "event_type", F.col("ts"), F.col("event_id")).where("length > 1")
    return rows.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("runs"), F.max("length").alias("longest"))


def hash_state(spark, d):
    """Fields as they stand: sets by any event, deletes by errors."""
    log = _events(spark, d).withColumn("op", F.when(_failed(), "del").otherwise("set")).withColumn("field", F.get_json_object("props", "$.k"))
    return state.hash_current(log, ["user_id", "field"], "op", F.desc("ts"), F.desc("event_id")).select("user_id", "field", "event_id", "value")


def set_state(spark, d):
    log = _events(spark, d).withColumn("op", F.when(_failed(), "del").otherwise("add")).withColumn("member", F.col("event_type"))
    return state.set_members(log, "user_id", "member", "op", F.desc("ts"), F.desc("event_id"))


def list_tail(spark, d):
    """The last five entries but the very last of each user's list."""
    return state.list_range(_events(spark, d), ["user_id"], -5, -2, F.col("ts"), F.col("event_id")).select("user_id", "place", "event_id")


def age_buckets(spark, d):
    rows = _events(spark, d)
    end = rows.agg(F.max(micros(F.col("ts")))).scalar()
    aged = rows.select(state.age_bucket((end - micros(F.col("ts"))) / 1_000_000).alias("age"))
    return aged.groupBy("age").agg(F.count(F.lit(1)).alias("events"))


def session_windows(spark, d):
    """Sessions of each user with gaps under a day."""
    timed = _events(spark, d).withColumn("at", F.col("ts").cast("timestamp"))
    return timed.groupBy("user_id", F.session_window("at", "1 day").alias("s")).agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("value"))\
        .select("user_id", F.unix_micros("s.start").alias("start_us"), "events", "value")


def byte_budget(spark, d):
    """The newest events of each user whose values together stay within 1000."""
    rows = operations.within_bytes(_events(spark, d), ["user_id"], F.round(F.col("value") * 100).cast("long"), 100_000, F.desc("ts"), F.desc("event_id"))
    return rows.select("user_id", "event_id", "kept_size")


def confusion_matrix(spark, d):
    return evaluation.confusion(load(spark, d, "labels"), "quality", "toxic")


def arm_comparison(spark, d):
    """Mean value by type in the first and the second half of users, side by side."""
    rows = _events(spark, d).groupBy((F.col("user_id") % 2).alias("arm"), "event_type").agg(F.round(F.avg("value"), 6).alias("mean"))
    return evaluation.compare_arms(rows.where("arm = 0"), rows.where("arm = 1"), "event_type", "mean")


def live_title_lookup(spark, d):
    saved = load(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.lit("gone").alias("c_name"))
    titles = load(spark, d, "customer").where("c_acctbal >= 0").select("c_custkey", "c_name")
    return state.live_titles(saved, titles, "c_custkey", "c_name").select("o_orderkey", "c_custkey", "c_name")


def reconcile_union_anti(spark, d):
    orders = load(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderpriority").alias("title"))
    server = load(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("title")).where("key % 3 <> 0")
    return state.reconcile(server, orders.select(F.col("o_custkey").alias("key"), "title"), "key", ["title"]).na.fill("")


def parent_group(spark, d):
    """Lines grouped to orders: best line by discount (the first of equal ones), its number, lines in order."""
    rows = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_linenumber", F.struct("l_discount", -F.col("l_linenumber"))).alias("best_line"), F.max("l_discount").alias("score"), F.count(F.lit(1)).alias("children"))
    return rows


def pricing_summary(spark, d):
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    rows = load(spark, d, "lineitem").where("l_shipdate <= timestamp'1998-09-02'").groupBy("l_returnflag", "l_linestatus")
    return rows.agg(half_up(F.sum("l_quantity"), 2).alias("sum_qty"), (F.sum(F.round(price * 100).cast("long")) / 100).alias("sum_price"), half_up(F.avg("l_discount"), 6).alias("avg_discount"), F.count(F.lit(1)).alias("n"))


def star_join_revenue(spark, d):
    """Revenue by nation and order year."""
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    lines = load(spark, d, "lineitem").join(load(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return lines.groupBy("n_name", F.year("o_orderdate").alias("year")).agg((F.sum(F.round(price * 100).cast("long")) / 100).alias("revenue"), F.countDistinct("o_orderkey").alias("orders"))


def alert_suppressed(spark, d):
    """Of the errors of each user those that raise an alert: at least six hours after the last one that did."""
    from weftline.streaming.events import suppressed

    return suppressed(_events(spark, d).where(_failed()).select("user_id", micros(F.col("ts")).alias("us"), "event_id"), "user_id", 6 * 3600 * 1_000_000)


_R = "CASE WHEN event_type IN ('purchase', 'signup') THEN 'like' WHEN event_type = 'error' THEN 'dislike' END"
_P = "count(*) AS n, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99"
_DAY = "strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d')"

SQL = {
    "latency_percentiles": f"SELECT event_type, {_P} FROM events GROUP BY 1",
    "latency_recent": f"SELECT event_type, {_P} FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 1000 GROUP BY 1",
    "stage_summary": "SELECT (user_id % 7)::INT AS stage, count_if(event_type <> 'error')::BIGINT AS success, count_if(event_type = 'error')::BIGINT AS failure, round(sum(value), 4) AS total, floor(count_if(event_type <> 'error') * 100.0::DOUBLE / count(*) * 10 + 0.5) / 10 AS rate FROM events GROUP BY 1",
    "error_counts": "SELECT user_id, count_if(event_type = 'error')::BIGINT AS errors, count(*) AS events, round(count_if(event_type = 'error') / count(*), 4) AS rate FROM events GROUP BY 1",
    "coverage_ratios": "SELECT count(*) AS queries, round(count_if(event_type = 'view') / count(*), 4) AS view_share, round(count_if(event_type = 'purchase') / count_if(event_type = 'click'), 4) AS purchase_per_click, CASE WHEN count_if(event_type = 'none') > 0 THEN round(count_if(event_type = 'missing') / count_if(event_type = 'none'), 4) ELSE 0 END::DOUBLE AS guarded FROM events",
    "error_rate_5m_sliding": "SELECT event_id, n AS in_window, f::BIGINT AS failed_in_window, round(f / n, 6) AS error_rate, (round(f / n, 6) >= 0.1)::INT AS alert FROM (SELECT event_id, count(*) OVER w AS n, sum((event_type = 'error')::INT) OVER w AS f FROM (SELECT *, epoch_us(ts) AS us FROM events) WINDOW w AS (ORDER BY us RANGE BETWEEN 299999999 PRECEDING AND CURRENT ROW))",
    "daily_cost_tz": f"SELECT {_DAY} AS day, count(*) AS events, round(sum(value), 4) AS cost FROM events GROUP BY 1",
    "ops_snapshot": "SELECT 'all' AS part, count(*) AS n, round(sum(value), 4) AS value FROM events UNION ALL SELECT 'recent', count(*), round(sum(value), 4) FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 100)",
    "web_vitals_last_n": "SELECT event_type, round(coalesce(avg(value) FILTER (value < 500), 0), 6) AS mean, coalesce(min(value) FILTER (value < 500), 0) AS low, coalesce(max(value) FILTER (value < 500), 0) AS high, count(value) FILTER (value < 500) AS n, count_if(value < 100)::BIGINT AS good, count_if(value >= 100)::BIGINT AS poor FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 200) GROUP BY 1",
    "feedback_latest": f"SELECT user_id, event_id, rating FROM (SELECT *, {_R} AS rating, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE {_R} IS NOT NULL) WHERE k = 1",
    "feedback_summary": f"SELECT user_id, count(*) AS total, count_if(r = 'like')::BIGINT AS likes, count_if(r = 'dislike')::BIGINT AS dislikes, floor(count_if(r = 'like') * 100.0::DOUBLE / count(*) * 10 + 0.5) / 10 AS satisfaction FROM (SELECT user_id, {_R} AS r FROM events) WHERE r IS NOT NULL GROUP BY 1",
    "feedback_page": "SELECT event_id, place, total FROM (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS place, count(*) OVER () AS total FROM events WHERE event_type IN ('purchase', 'signup')) WHERE place > 50 AND place <= 100",
    "quota_admission": f"SELECT event_id, user_id, day, request, (request <= 2)::INT AS admitted FROM (SELECT event_id, user_id, {_DAY} AS day, row_number() OVER (PARTITION BY user_id, {_DAY} ORDER BY ts, event_id) AS request FROM events)",
    "rate_limit_minute": "SELECT epoch_us(ts) // 216000000000 AS minute, least(count(*), 3)::BIGINT AS admitted, count(*) AS requests FROM events GROUP BY 1",
    "event_props_json": "SELECT json_extract_string(props, '$.k')::INT AS k, count(*) AS events, round(avg(value), 6) AS mean FROM events GROUP BY 1",
    "tool_latency": "SELECT event_type, count(*) AS n, list_sort(list(value))[floor(count(*) * 0.95)::INT + 1] AS p95 FROM events GROUP BY 1",
    "no_progress_runs": "WITH n AS (SELECT user_id, event_type, ts, event_id, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT user_id, event_type, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM n), l AS (SELECT user_id, event_type, run, count(*) AS length FROM r GROUP BY 1, 2, 3) SELECT user_id, event_type, count(*) AS runs, max(length) AS longest FROM l WHERE length > 1 GROUP BY 1, 2",
    "hash_state": "SELECT user_id, field, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, field ORDER BY ts DESC, event_id DESC) AS k FROM (SELECT *, json_extract_string(props, '$.k') AS field FROM events)) WHERE k = 1 AND event_type <> 'error'",
    "set_state": "SELECT DISTINCT user_id, event_type AS member FROM events WHERE event_type <> 'error'",
    "list_tail": "SELECT user_id, place, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE place >= n - 5 AND place <= n - 2",
    "age_buckets": "SELECT CASE WHEN s < 60 THEN 'now' WHEN s < 3600 THEN 'minutes' WHEN s < 86400 THEN 'hours' WHEN s < 604800 THEN 'days' ELSE 'date' END AS age, count(*) AS events FROM (SELECT (max(epoch_us(ts)) OVER () - epoch_us(ts)) / 1000000 AS s FROM events) GROUP BY 1",
    "session_windows": "WITH n AS (SELECT user_id, ts, event_id, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 DAY THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM n) SELECT user_id, min(epoch_us(ts)) AS start_us, count(*) AS events, round(sum(value), 4) AS value FROM s GROUP BY user_id, k",
    "byte_budget": "SELECT user_id, event_id, kept::BIGINT AS kept_size FROM (SELECT user_id, event_id, sum(size) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS kept FROM (SELECT *, round(value * 100)::BIGINT AS size FROM events) WHERE size <= 100000) WHERE kept <= 100000",
    "confusion_matrix": "SELECT quality::VARCHAR AS expected, toxic::VARCHAR AS actual, count(*) AS n, (quality = toxic)::INT AS agree FROM labels GROUP BY quality, toxic",
    "arm_comparison": "WITH m AS (SELECT user_id % 2 AS arm, event_type, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2) SELECT event_type, a.mean AS a, b.mean AS b, round(b.mean - a.mean, 6) AS delta, CASE WHEN round(b.mean - a.mean, 6) > 0 THEN 'up' WHEN round(b.mean - a.mean, 6) < 0 THEN 'down' ELSE 'same' END AS direction FROM (SELECT * FROM m WHERE arm = 0) a FULL JOIN (SELECT * FROM m WHERE arm = 1) b USING (event_type)",
    "live_title_lookup": "SELECT o_orderkey, o_custkey AS c_custkey, coalesce(c_name, 'gone') AS c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) ON c_custkey = o_custkey",
    "reconcile_union_anti": "WITH l AS (SELECT o_custkey AS key, max(o_orderpriority) AS title FROM orders GROUP BY 1), s AS (SELECT c_custkey AS key, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS title FROM customer WHERE c_custkey % 3 <> 0) SELECT key, coalesce(s.title, l.title, '') AS title, 'server' AS origin FROM s LEFT JOIN l USING (key) UNION ALL SELECT key, title, 'local' FROM l WHERE key NOT IN (SELECT key FROM s)",
    "parent_group": "SELECT l_orderkey, arg_max(l_linenumber, (l_discount, -l_linenumber)) AS best_line, max(l_discount) AS score, count(*) AS children FROM lineitem GROUP BY 1",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, floor(sum(l_quantity) * 100 + 0.5) / 100 AS sum_qty, sum(round(l_extendedprice * (1 - l_discount) * 100)::BIGINT)::BIGINT / 100 AS sum_price, floor(avg(l_discount) * 1000000 + 0.5) / 1000000 AS avg_discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    "star_join_revenue": "SELECT n_name, year(o_orderdate)::INT AS year, sum(round(l_extendedprice * (1 - l_discount) * 100)::BIGINT)::BIGINT / 100 AS revenue, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2",
}

QUERIES = {name: f for name, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not name.startswith("_")}
