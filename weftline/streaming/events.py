"""Streaming sources and operators: event-stream text, sliding error rates, daily totals, alerts with a pause."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftline.operators import order

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, schema: str = EVENTS, late: str = "10 minutes", files: int = 1) -> DataFrame:
    """Events from Parquet files as they arrive, with a zoned time stamp and a watermark; later rows than that are dropped."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def joined_lines(chunks: DataFrame, stream: str, seq: str, data: str) -> DataFrame:
    """(stream, line, value): the lines of byte streams that arrive in chunks (stream, seq, data: binary) cut anywhere, even inside a character.

    Chunks are put in order and the line ends before each are counted by blocks of that order, which tells every piece
    of a chunk its line; the pieces of a line, of however many chunks, meet by that number and are read as text
    only then. What follows the last line end is a line, unless it is empty. Null chunks are empty; rows without a
    stream are left out.
    """
    # One character for each byte, so that a cut character stays whole until its pieces meet.
    pieces = F.split(F.decode(F.coalesce(F.col(data), F.lit(b"")), "ISO-8859-1"), "\n", -1)
    rows = chunks.where(F.col(stream).isNotNull()).select(F.col(stream).alias("stream"), F.col(seq).alias("seq"), pieces.alias("pieces")).withColumn("ends", F.size("pieces") - 1)
    placed = order.running_sum(order.numbered(rows, "stream", "seq"), "stream", "ends", "upto")
    lines = placed.select("stream", "idx", (F.col("upto") - F.col("ends")).alias("first"), F.posexplode("pieces").alias("pos", "piece")).where("piece <> ''")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "piece"))), lambda x: x["piece"]), "")
    text = lines.groupBy("stream", (F.col("first") + F.col("pos")).alias("line")).agg(F.decode(F.encode(whole, "ISO-8859-1"), "UTF-8").alias("value"))
    return text.select("stream", "line", F.regexp_replace("value", "\r$", "").alias("value"))


def stream_payloads(lines: DataFrame) -> DataFrame:
    """(stream, line, payload variant) of the ``data:`` lines of ``joined_lines`` up to each stream's first ``[DONE]``; other lines and broken JSON go."""
    body = F.trim(F.substring(F.trim("value"), 6, 1 << 30))
    rows = lines.where(F.trim("value").startswith("data:")).select("stream", "line", body.alias("body"))
    ends = rows.where("body = '[DONE]'").groupBy("stream").agg(F.min("line").alias("__end"))
    kept = rows.join(ends, "stream", "left").where(F.col("__end").isNull() | (F.col("line") < F.col("__end")))
    return kept.select("stream", "line", F.try_parse_json("body").alias("payload")).where("payload IS NOT NULL")


def data_lines(lines: DataFrame) -> DataFrame:
    """(payload variant, done) of the ``data:`` lines of an event-stream text; other lines and broken JSON go."""
    body = F.trim(F.substring(F.col("value"), 6, 1 << 30))
    rows = lines.where(F.col("value").startswith("data:")).select(body.alias("body"))
    return rows.select(F.try_parse_json("body").alias("payload"), (F.col("body") == "[DONE]").alias("done")).where(F.col("done") | F.col("payload").isNotNull())


def error_rates(events: DataFrame, length: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Events, failures and their share in sliding windows."""
    failed = F.count_if(F.col("event_type") == "error")
    n = F.count(F.lit(1))
    return events.groupBy(F.window("ts", length, slide)).agg(n.alias("events"), failed.alias("failed"), F.round(failed / n, 6).alias("rate"))


def daily_totals(events: DataFrame, zone: str = "Asia/Shanghai") -> DataFrame:
    """Running count and cost of each local day."""
    return events.groupBy(F.date_format(F.from_utc_timestamp("ts", zone), "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("cost"))


def _pick(times, pause: int, last: int | None) -> tuple[list[bool], int | None]:
    """Which of the sorted times raise an alert, and the last that did."""
    out = []
    for t in times:
        fires = last is None or t - last >= pause
        last = t if fires else last
        out.append(fires)
    return out, last


def suppressed(events: DataFrame, key: str, pause: int) -> DataFrame:
    """Of the events (key, us, event_id) those at least ``pause`` microseconds after the last one of their key that was let through.

    Whether an event passes hangs on the one before that did, so a key's events are walked in order. They are sorted by
    Spark and come a batch at a time; only the last passed time is held.
    """
    ordered = events.repartition(key).sortWithinPartitions(key, "us", "event_id")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last = object(), None
        for batch in batches:
            keep = []
            for k, t in zip(batch[key], batch["us"]):
                if k != now:
                    now, last = k, None
                passed, last = _pick([t], pause, last)
                keep += passed
            yield batch[keep]

    return ordered.mapInPandas(walk, ordered.schema)


def suppressed_stream(events: DataFrame, key: str, pause_seconds: int) -> DataFrame:
    """The streaming form of ``suppressed`` over (key, ts): the last passed time of each key is its state."""
    schema = f"{key} {dict(events.dtypes)[key]}, ts timestamp"

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("ts")
        times = rows["ts"].astype("int64") // (1000 if rows["ts"].dtype == "datetime64[ns]" else 1)
        passed, last = _pick(times, pause_seconds * 1_000_000, last)
        if last is not None:
            state.update((int(last),))
        yield rows[passed][[key, "ts"]]

    return events.groupBy(key).applyInPandasWithState(step, schema, "last long", "append", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what is there (``availableNow``) into a table in memory and return it; for tests and small results."""
    writer = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    query = writer.start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
