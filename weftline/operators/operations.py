"""Operational analytics over event tables: percentiles, rates, days, feedback, quotas."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Callable, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from weftline.operators import order
from weftline.tables import half_up, micros

#: Parts that a group's values are cut into, at approximate quantiles, to find exact ones.
PARTS = 64


def nearest_rank(percent: int) -> Callable[[Column], Column]:
    """The place, from 1, of a percentile by nearest rank among ``total`` values, in whole numbers."""
    return lambda total: F.greatest(F.lit(1), F.ceil(total * percent / 100).cast("long"))


def floor_index(p: float) -> Callable[[Column], Column]:
    """The place, from 1, of the element at index floor(p x total)."""
    return lambda total: F.least(total, F.floor(total * F.lit(p)) + 1)


def percentiles(rows: DataFrame, by: str, value: str, places: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """(by, and a column for each of ``places``): the values that stand at exact places in each group's order; nulls do not count.

    Values are counted, dealt to parts between approximate quantiles, and only the part that holds a place is put in
    order, so no task has a whole group, however few groups there are. A null ``by`` is a group of its own.
    """
    named = rows.select(F.struct(F.col(by).alias("by")).alias("__by"), F.col(value).alias("v")).where("v IS NOT NULL")
    counts = named.groupBy("__by", "v").agg(F.count(F.lit(1)).alias("c"))
    cuts = named.groupBy("__by").agg(F.percentile_approx("v", [i / PARTS for i in range(1, PARTS)], 1000).alias("cuts"))
    dealt = counts.join(cuts, "__by").select("__by", "v", "c", F.size(F.filter("cuts", lambda x: x < F.col("v"))).alias("part"))
    group = Window.partitionBy("__by")
    held = dealt.groupBy("__by", "part").agg(F.sum("c").alias("held")).withColumn("upto", F.sum("held").over(group.orderBy("part"))).withColumn("total", F.sum("held").over(group))
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), place(F.col("total")).cast("long").alias("place")) for name, place in places.items()]))
    wanted = held.withColumn("x", asked).select("__by", "part", (F.col("upto") - F.col("held")).alias("before"), "upto", "x.*").where("place > before AND place <= upto")
    inside = dealt.join(wanted.select("__by", "part", "before", "name", "place"), ["__by", "part"])
    running = inside.withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy("__by", "name").orderBy("v")))
    found = running.where("upto >= place").groupBy("__by").agg(*[F.min(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in places])
    return found.select(F.col("__by.by").alias(by), *places)


def latency_summary(events: DataFrame, kind: str, value: str, digits: int = 6) -> DataFrame:
    """(kind, n, mean, p50, p95, p99), percentiles by nearest rank."""
    means = events.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), digits).alias("mean"))
    found = percentiles(events, kind, value, {f"p{p}": nearest_rank(p) for p in (50, 95, 99)}).withColumnRenamed(kind, "__kind")
    return means.join(found, F.col(kind).eqNullSafe(F.col("__kind")), "left").drop("__kind")


def last_n(events: DataFrame, by: list[str], n: int, *newest_first: Column) -> DataFrame:
    """The newest ``n`` rows of each key (a limit that Spark applies before the shuffle)."""
    w = Window.partitionBy(*by).orderBy(*newest_first)
    return events.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def stage_summary(events: DataFrame, stage: str, failed: Column, value: str) -> DataFrame:
    """Successes, failures, total and rate (per cent, one digit) by stage."""
    ok = F.count_if(~failed)
    return events.groupBy(stage).agg(ok.alias("success"), F.count_if(failed).alias("failure"), F.round(F.sum(value), 4).alias("total"), half_up(ok * 100.0 / F.count(F.lit(1)), 1).alias("rate"))


def share(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.when(whole > 0, F.round(part / whole, digits)).otherwise(0.0)


def sliding_errors(events: DataFrame, ts: str, failed: Column, seconds: int = 300, least: float = 0.1) -> DataFrame:
    """Each event with the number of events and failures in the ``seconds`` up to it (open at the far end), and an alert flag.

    Time is cut in stretches of that length. Every event counts from its time on, and in the next stretch until it is
    ``seconds`` old, so a window's numbers are sums up to a time within one stretch: each row is added once, however many
    events a window holds, and the history is worked on in parallel.
    """
    width = seconds * 1_000_000
    timed = events.withColumn("__us", micros(F.col(ts))).withColumn("__failed", failed.cast("int"))
    own = F.floor(F.col("__us") / width)
    mark = lambda part, at, sign, seen: F.struct(part.alias("part"), at.alias("at"), F.lit(sign).alias("sign"), F.lit(seen).alias("seen"))
    marks = F.array(mark(own, F.col("__us"), 1, True), mark(own + 1, F.col("__us"), 1, False), mark(own + 1, F.col("__us") + width, -1, False))
    dealt = timed.withColumn("__mark", F.explode(marks))
    w = Window.partitionBy("__mark.part").orderBy("__mark.at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    counted = dealt.withColumn("in_window", F.sum("__mark.sign").over(w)).withColumn("failed_in_window", F.sum(F.col("__mark.sign") * F.col("__failed")).over(w))
    rate = F.round(F.col("failed_in_window") / F.col("in_window"), 6)
    return counted.where("__mark.seen AND __us IS NOT NULL").withColumn("error_rate", rate).withColumn("alert", (rate >= least).cast("int")).drop("__us", "__failed", "__mark")


def local_day(ts: Column, zone: str) -> Column:
    """The calendar day of an instant (UTC) in a zone."""
    return F.date_format(F.from_utc_timestamp(ts.cast("timestamp"), zone), "yyyy-MM-dd")


def latest(events: DataFrame, by: list[str], *newest_first: Column) -> DataFrame:
    """The last row of each key."""
    return last_n(events, by, 1, *newest_first)


def feedback_summary(rows: DataFrame, rating: str, by: list[str] | None = None) -> DataFrame:
    """total, likes, dislikes, and the share of likes in per cent (one digit; null without ratings)."""
    like, dislike = F.count_if(F.col(rating) == "like"), F.count_if(F.col(rating) == "dislike")
    return rows.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("total"), like.alias("likes"), dislike.alias("dislikes"), F.when(like + dislike > 0, half_up(like * 100.0 / (like + dislike), 1)).alias("satisfaction"))


def admitted(events: DataFrame, by: list[str], limit: int, *in_order: Column) -> DataFrame:
    """Each request with its number in its key (say, user and day) and whether it is within the limit."""
    return events.withColumn("request", F.row_number().over(Window.partitionBy(*by).orderBy(*in_order))).withColumn("admitted", (F.col("request") <= limit).cast("int"))


def usage_rows(log: DataFrame, usage: str, input_price: float, output_price: float) -> DataFrame:
    """``log`` with prompt_tokens, completion_tokens, total_tokens and cost of the JSON text ``usage``.

    Prompt tokens may come as ``prompt_tokens`` or ``input_tokens``, completion tokens as ``completion_tokens`` or
    ``output_tokens``; a total that is not told is their sum. What is no number counts as 0. Prices are for a million.
    """
    parsed = F.try_parse_json(F.col(usage))
    number = lambda *names: F.coalesce(*[F.try_variant_get(parsed, f"$.{n}", "double") for n in names])
    finite = lambda x: F.coalesce(F.when(~F.isnan(x), x), F.lit(0.0))
    rows = log.withColumn("prompt_tokens", finite(number("prompt_tokens", "input_tokens"))).withColumn("completion_tokens", finite(number("completion_tokens", "output_tokens")))
    both = F.col("prompt_tokens") + F.col("completion_tokens")
    cost = (F.col("prompt_tokens") * input_price + F.col("completion_tokens") * output_price) / 1_000_000
    return rows.withColumn("total_tokens", finite(F.coalesce(number("total_tokens"), both))).withColumn("cost", cost)


def usage_totals(rows: DataFrame, by: str, digits: int = 6) -> DataFrame:
    """(by, calls, prompt_tokens, completion_tokens, total_tokens, cost) of ``usage_rows``; a null ``by`` is ``unknown``."""
    sums = [F.sum(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")]
    return rows.groupBy(F.coalesce(F.nullif(F.col(by), F.lit("")), F.lit("unknown")).alias(by)).agg(F.count(F.lit(1)).alias("calls"), *sums, F.round(F.sum("cost"), digits).alias("cost"))


def feedback_events(log: DataFrame, user: str, most: int = 500, *newest_first: Column) -> DataFrame:
    """``log`` with ``own`` and ``common``: whether each event is among the newest ``most`` of its user, and of all; events in neither are gone.

    The newest of all are found by a limit, those of a user by a window that Spark cuts before the shuffle, so neither
    log puts more in order than it keeps. A null user is ``anonymous``.
    """
    who = F.coalesce(F.col(user), F.lit("anonymous"))
    own = last_n(log.withColumn(user, who), [user], most, *newest_first)
    common = log.withColumn(user, who).orderBy(*newest_first).limit(most)
    marks = own.withColumn("own", F.lit(1)).withColumn("common", F.lit(0)).unionByName(common.withColumn("own", F.lit(0)).withColumn("common", F.lit(1)))
    return marks.groupBy(*log.columns).agg(F.max("own").alias("own"), F.max("common").alias("common"))


#: Rows of a block of a quota log; one row of each block is folded in one task.
QUOTA_BLOCK = 1 << 16


def quota_balance(log: DataFrame, by: list[str], action: str, limit: int, *order_by: str) -> DataFrame:
    """``log`` with ``balance``, what is used of each key's quota after the row, and ``ok``: whether a reserve was admitted, or a release gave something back.

    A reserve (``action`` = 'reserve') adds one below ``limit`` and is refused at it; a release takes one back, never
    below 0; other actions change nothing and are not ok. What a run of them does to a balance is always adding a
    number and clipping the sum to a range, and two such steps make one again: every block of the order sums up its
    last key in this way, one row for each block is folded, and the blocks are then walked side by side. A key may hold
    any part of the rows. A null in a key is a value like others.
    """
    key = F.to_json(F.struct(*by), {"ignoreNullFields": "false"})
    step = F.when(F.col(action) == "reserve", 1).when(F.col(action) == "release", -1).otherwise(0)
    rows = order.numbered(log.withColumn("__key", key).withColumn("__step", step), "__key", *order_by, out="__idx", block=QUOTA_BLOCK)
    rows = rows.withColumnRenamed("block", "__block")

    def clip(table: pa.Table) -> pa.Table:
        table = table.sort_by("__idx")
        keys, steps = table.column("__key"), table.column("__step").to_numpy()
        last = keys[-1].as_py()
        own = pc.equal(keys, last).to_numpy(zero_copy_only=False)
        add, low, high = 0, 0, limit
        for x in steps[own].tolist():
            add, low, high = add + x, min(limit, max(0, low + x)), min(limit, max(0, high + x))
        return pa.table([table.column("__block")[:1], *[pa.array([x]) for x in (keys[0].as_py(), last, bool(own.all()), add, low, high)]], ["block", "first", "last", "whole", "add", "low", "high"])

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        before, value, starts = None, 0, []
        for r in table.to_pylist():
            start = value if r["first"] == before else 0
            starts.append(start)
            value = min(r["high"], max(r["low"], (start if r["whole"] else 0) + r["add"]))
            before = r["last"]
        return pa.table([table.column("block"), pa.array(starts, pa.int64())], ["__block", "__start"])

    ends = rows.select("__block", "__idx", "__key", "__step").groupBy("__block").applyInArrow(clip, "block long, first string, last string, whole boolean, add long, low long, high long")
    starts = ends.withColumn("__all", F.lit(1)).groupBy("__all").applyInArrow(fold, "__block long, __start long")
    kept = log.columns

    def walk(table: pa.Table) -> pa.Table:
        table = table.sort_by("__idx")
        now, value, out, ok = table.column("__key")[0].as_py(), table.column("__start")[0].as_py(), [], []
        for key, x in zip(table.column("__key").to_pylist(), table.column("__step").to_pylist()):
            if key != now:
                now, value = key, 0
            then = min(limit, max(0, value + x))
            ok.append(int(then != value))
            out.append(then)
            value = then
        return pa.table([*[table.column(c) for c in kept], pa.array(out, pa.int64()), pa.array(ok, pa.int32())], [*kept, "balance", "ok"])

    schema = StructType([*log.schema.fields, StructField("balance", LongType()), StructField("ok", IntegerType())])
    return rows.join(starts, "__block").groupBy("__block").applyInArrow(walk, schema)


def feedback_page(rows: DataFrame, fields: list[str], titles: str, rating: str | None = None, keyword: str = "", page: int = 1, size: int = 20) -> DataFrame:
    """(all columns, place, total, likes, dislikes): a page of the feedback ``rows`` (rating, created, id, and others) that have a rating and hold a keyword, newest first.

    The keyword is looked for, in any case, in ``fields`` and the texts of the array ``titles``, joined by spaces. Totals
    count all rows that fit, before the page is cut. Pages count from 1 and have 1 to 200 rows; only the first pages are
    put in order. A page beyond the last is empty.
    """
    size, page = min(max(size, 1), 200), max(page, 1)
    text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields], F.col(titles)))
    fit = rows.where(F.col("rating") == rating) if rating else rows
    word = keyword.strip().lower()
    fit = fit.where(F.contains(text, F.lit(word))) if word else fit
    newest = [F.desc("created"), F.desc("id")]
    shown = fit.orderBy(*newest).limit(page * size).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*newest))).where(F.col("place") > (page - 1) * size)
    sums = fit.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("rating") == "like").alias("likes"), F.count_if(F.col("rating") == "dislike").alias("dislikes"))
    one = F.lit(1).alias("__one")
    return shown.select("*", one).join(F.broadcast(sums.select("*", one)), "__one").drop("__one")


def redacted_list(values: Column, most: int = 20, each: int = 120) -> Column:
    """The first ``most`` texts of an array, each cut after ``each`` characters and marked."""
    return F.transform(F.slice(values, 1, most), lambda v: F.when(F.length(v) > each, F.concat(F.substring(v, 1, each), F.lit("..."))).otherwise(v))


def trace_id(value: Column) -> Column:
    """A trace id without white space around it; null if it is empty, over 128 characters, or holds others than letters, digits and ``_.:-``."""
    text = F.trim(value, F.lit(" \t\r\n"))
    return F.when((F.length(text) <= 128) & text.rlike("^[a-zA-Z0-9_.:-]+$"), text)


def redacted(payload: Column, most: int = 300) -> Column:
    """A map without keys that look secret; long values cut, addresses masked."""
    kept = F.map_filter(payload, lambda k, v: ~k.rlike("(?i)key|token|secret|password|cookie|authorization"))
    masked = lambda v: F.regexp_replace(v, r"https?://\S+", "[url]")
    return F.transform_values(kept, lambda k, v: F.when(F.length(masked(v)) > most, F.concat(F.substring(masked(v), 1, most), F.lit("..."))).otherwise(masked(v)))


def trace_summary(traces: DataFrame) -> DataFrame:
    """(trace_id, status, stages, failed_stages, total_ms) of traces with ``stages`` (name, duration_ms, success, error) and ``fallback``."""
    failed = F.filter("stages", lambda s: ~s["success"])
    total = F.aggregate("stages", F.lit(0.0), lambda a, s: a + F.when(s["name"] == "total", 0.0).otherwise(s["duration_ms"].cast("double")))
    return traces.select("trace_id", F.when(F.size(failed) > 0, "error").when(F.col("fallback"), "fallback").otherwise("ok").alias("status"), F.size("stages").alias("stages"), F.transform(failed, lambda s: s["name"]).alias("failed_stages"), total.alias("total_ms"))


def within_bytes(rows: DataFrame, by: list[str], size: Column, most: int, *newest_first: Column) -> DataFrame:
    """The newest rows of each key whose sizes together stay within ``most``; larger single rows are never kept."""
    w = Window.partitionBy(*by).orderBy(*newest_first).rowsBetween(Window.unboundedPreceding, 0)
    fits = rows.withColumn("__size", size).where(F.col("__size") <= most)
    return fits.withColumn("kept_size", F.sum("__size").over(w)).where(F.col("kept_size") <= most).drop("__size")


def sliding_requests(events: DataFrame, event_id: str, ts: str, value: str, failed: Column, seconds: int = 300, p: float = 0.95, most: int = 2000) -> DataFrame:
    """(event_id, idx, in_window, failed_in_window, p95): of the events in the ``seconds`` up to each (open at the far end), of the newest ``most`` at most, how many there are, how many failed, and the nearest-rank percentile of their values.

    Events are put in order (time, then id) and numbered; blocks of the order are worked on side by side, each with the
    ``most`` events before it, so no task needs more, however many events fall into a window. Events without a time are
    left out; null values do not count in the percentile.
    """
    width, kind = seconds * 1_000_000, dict(events.dtypes)[event_id]
    timed = events.select(F.col(event_id).alias("id"), micros(F.col(ts)).alias("us"), F.col(value).cast("double").alias("v"), failed.cast("int").alias("failed")).where("us IS NOT NULL")
    size = max(order.BLOCK, most)

    def work(table: pa.Table) -> pa.Table:
        us, v = table.column("us").to_numpy(), table.column("v").to_numpy()
        errors = np.concatenate([[0], np.cumsum(table.column("failed").fill_null(0).to_numpy())])
        own = table.column("own").to_numpy(zero_copy_only=False)
        n = len(us)
        low = np.maximum(np.searchsorted(us, us - width, "right"), np.arange(n) - most + 1)
        held, at, found = [], 0, np.full(n, np.nan)
        for i in range(n):
            if v[i] == v[i]:
                insort(held, v[i])
            while at < low[i]:
                if v[at] == v[at]:
                    del held[bisect_left(held, v[at])]
                at += 1
            if held:
                found[i] = held[max(1, math.ceil(len(held) * p)) - 1]
        many, bad = np.arange(n) - low + 1, errors[1:] - errors[low]
        columns = [table.column("id"), table.column("idx"), pa.array(many), pa.array(bad), pa.array(found, mask=np.isnan(found))]
        return pa.table(columns, ["event_id", "idx", "in_window", "failed_in_window", "p95"]).filter(pa.array(own))

    rows = order.numbered(timed, "us", "id", block=size)
    return order.over_blocks(rows, work, f"event_id {kind}, idx long, in_window long, failed_in_window long, p95 double", most - 1, size)


def sliding_latency(events: DataFrame, event_id: str, ts: str, value: str, seconds: int = 300, p: float = 0.95, most: int = 2000, least: float = 3000.0) -> DataFrame:
    """(event_id, p95, alert) by ``sliding_requests``: whether the percentile reaches ``least``."""
    rows = sliding_requests(events, event_id, ts, value, F.lit(False), seconds, p, most)
    return rows.select("event_id", "p95", F.coalesce((F.col("p95") >= least).cast("int"), F.lit(0)).alias("alert"))


def operational_alerts(events: DataFrame, event_id: str, ts: str, value: str, cost: str, failed: Column, zone: str, most_cost: float, least_errors: float = 0.1, least_ms: float = 3000.0, **window) -> DataFrame:
    """(event_id, error_rate, p95, day, day_cost, alerts) of every event: its window by ``sliding_requests``, the cost of its local day so far, and which of ``error-rate``, ``latency`` and ``daily-cost`` are reached.

    The cost of a day is summed up by blocks of the order of events, and the blocks' sums are added, so that a day may
    hold any part of the rows. Null costs count as 0.
    """
    seen = sliding_requests(events, event_id, ts, value, failed, **window).drop("idx")
    spent = events.select(F.col(event_id).alias("event_id"), micros(F.col(ts)).alias("us"), local_day(F.col(ts), zone).alias("day"), F.coalesce(F.col(cost).cast("double"), F.lit(0.0)).alias("cost")).where("us IS NOT NULL")
    daily = order.running_sum(order.numbered(spent, "us", "event_id"), "day", "cost", "day_cost").select("event_id", "day", F.round("day_cost", 6).alias("day_cost"))
    rate = F.round(F.col("failed_in_window") / F.col("in_window"), 6)
    rows = seen.join(daily, "event_id").select("event_id", rate.alias("error_rate"), "p95", "day", "day_cost")
    return rows.withColumn("alerts", F.concat_ws(",", F.when(F.col("error_rate") >= least_errors, "error-rate"), F.when(F.col("p95") >= least_ms, "latency"), F.when(F.col("day_cost") >= most_cost, "daily-cost")))


def latency_band(ms: Column) -> Column:
    """good under 500 ms, fair under 2000, else poor."""
    return F.when(ms < 500, "good").when(ms < 2000, "fair").otherwise("poor")


def latency_text(ms: Column) -> Column:
    """Milliseconds under a second, else seconds to two places."""
    return F.when(ms < 1000, F.concat(F.round(ms).cast("long").cast("string"), F.lit(" ms"))).otherwise(F.concat(F.format_string("%.2f", ms / 1000), F.lit(" s")))


def coverage_band(share: Column) -> Column:
    """good from 80 per cent, fair from 50, else poor."""
    return F.when(share >= 0.8, "good").when(share >= 0.5, "fair").otherwise("poor")


def override(value: Column, low: float, high: float, default: Column) -> Column:
    """A setting given as text, if it is a number within the range; else the default."""
    number = value.try_cast("double")
    return F.when(number.between(low, high), number).otherwise(default)
