"""Streams over what is there give what the batch form gives."""

from pyspark.sql import functions as F

from weftline.operators import operations
from weftline.streaming import events as streams
from weftline.tables import load

FOLDER = "/root/testdata/sf0.001"


def source(spark, tmp_path):
    load(spark, FOLDER, "events").coalesce(1).write.parquet(str(tmp_path / "in"))
    return streams.event_stream(spark, str(tmp_path / "in"))


def test_daily_totals(spark, tmp_path):
    got = streams.run_to_end(streams.daily_totals(source(spark, tmp_path)), "daily", "complete", str(tmp_path / "cp"))
    day = operations.local_day(F.col("ts"), "Asia/Shanghai")
    want = load(spark, FOLDER, "events").groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("cost"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_alerts(spark, tmp_path):
    rows = source(spark, tmp_path).where("event_type = 'error'").select("user_id", "ts")
    got = streams.run_to_end(streams.suppressed_stream(rows, "user_id", 6 * 3600), "alerts", "append", str(tmp_path / "cp"))
    batch = load(spark, FOLDER, "events").where("event_type = 'error'").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id")
    want = streams.suppressed(batch, "user_id", 6 * 3600 * 1_000_000)
    assert sorted((r[0], r[1]) for r in got.select("user_id", F.unix_micros("ts")).collect()) == sorted((r["user_id"], r["us"]) for r in want.collect())


def test_data_lines(spark):
    df = spark.createDataFrame([('data: {"a": 1}',), ("event: x",), ("data: [DONE]",), ("data: {broken",)], "value string")
    assert [r["done"] for r in streams.data_lines(df).collect()] == [False, True]
