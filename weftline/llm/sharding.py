"""Sharding by sampled splitters: near-equal bytes, equal texts together.

Records are ordered by a hash of their text, then by id. Keys drawn with a chance in proportion to their size give
quantile boundaries of fine ranges, which deal the records out; a range that turns out overfull (a group of equal
texts may hold a third of all bytes) is subdivided by splitters drawn inside it, on text and id. Sums by range then
give every record its exact place in bytes and rows of the whole order, and with it its shard: shards are consecutive
pieces of the order with near-equal bytes. A group of equal texts stays in one shard unless it is larger than
``WHOLE_GROUP`` of a shard's share.

Only range boundaries and range sums reach the driver, one for each ``RANGE_BYTES`` of text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import materialise

#: Aimed-at bytes of a fine range, least and most number of them, and keys drawn for each.
RANGE_BYTES, LEAST_RANGES, MOST_RANGES, DRAWS = 64 << 20, 1024, 1 << 16, 16
#: Equal texts stay together as long as no shard gets further from its share than this part of it; a larger group may be split.
WHOLE_GROUP = 0.05
#: Bytes of a record besides its text.
RECORD_BYTES = 8


def _spot(*keys: str) -> Column:
    """A hash of the keys as a number from 0 to 1, the same in every run."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit("draw"), *keys), 11)).cast("double") / float(1 << 53)


def _cuts(keys: list[tuple], n: int) -> list[tuple]:
    """At most ``n - 1`` distinct quantile boundaries of drawn keys."""
    keys = sorted(keys)
    return sorted({keys[i * len(keys) // n] for i in range(1, n)}) if keys else []


def _ranges(records: DataFrame, cuts: list[tuple]) -> DataFrame:
    """``records`` with ``r``: the number of cuts (hash, id) at or before the record's key, by binary search."""
    keys = np.array(sorted(cuts), dtype=np.int64).reshape(-1, 2)
    sent = records.sparkSession.sparkContext.broadcast((keys[:, 0].copy(), keys[:, 1].copy()))

    @F.pandas_udf("long")
    def place(h: pd.Series, i: pd.Series) -> pd.Series:
        hashes, ids = sent.value
        h, i = h.to_numpy(), i.to_numpy()
        low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
        out = low.copy()
        for a in np.unique(low[high > low]):  # cuts that share a hash: inside a large group the id decides
            at = np.flatnonzero((low == a) & (high > a))
            out[at] = a + np.searchsorted(ids[a : high[at[0]]], i[at], "right")
        return pd.Series(out)

    return records.withColumn("r", place("h", "i"))


def assign(df: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row for each row of ``df``.

    ``size`` is the text's UTF-8 bytes plus 8; a null text counts as empty. Slots count from 0 without gaps in each
    shard. Null ids sort first; rows equal in id and text are interchangeable and keep separate slots. An empty table
    gives an empty result; with fewer rows than shards some shards stay empty. Other columns are not looked at.
    """
    spark = df.sparkSession
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    narrow = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(body).alias("h"), F.octet_length(body).cast("long").alias("b"), F.crc32(body.cast("binary")).alias("text_crc32"))
    records = materialise(narrow.select("doc_id", "h", (F.col("b") + RECORD_BYTES).alias("size"), "text_crc32", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("i")))
    total, rows = records.agg(F.sum("size"), F.count(F.lit(1))).first()
    out_schema = "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int"
    if not rows:
        return spark.createDataFrame([], out_schema)
    n_ranges = int(min(MOST_RANGES, max(LEAST_RANGES, total // RANGE_BYTES)))
    chance = F.col("size") * (DRAWS * n_ranges / total)
    least = -(1 << 63)
    drawn = [(r["h"], least) for r in records.where(_spot("h") < chance).select("h").distinct().collect()]
    cuts = _cuts(drawn, n_ranges)
    dealt = _ranges(records, cuts)
    # Subdivide what holds over twice its share; the boundaries inside are drawn on text and id.
    held = {r["r"]: r["b"] for r in dealt.groupBy("r").agg(F.sum("size").alias("b")).collect()}
    share = total / n_ranges
    over = [r for r, b in held.items() if b > 2 * share]
    if over:
        few = F.broadcast(spark.createDataFrame([(r,) for r in over], "r long"))
        inside: dict[int, list[tuple]] = {}
        for x in dealt.join(few, "r").where(_spot("h", "i") < chance).select("r", "h", "i").collect():
            inside.setdefault(x["r"], []).append((x["h"], x["i"]))
        for r, keys in inside.items():
            cuts += _cuts(keys, int(held[r] // share) + 1)
        dealt = _ranges(records, sorted(set(cuts)))
    sums = dealt.groupBy("r").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
    starts, b, n = [], 0, 0
    for x in sorted(sums.collect(), key=lambda x: x["r"]):
        starts.append((x["r"], b, n))
        b, n = b + x["b"], n + x["n"]
    start = spark.createDataFrame(starts, "r long, b0 long, n0 long")
    order = Window.partitionBy("r").orderBy("h", "i")
    placed = dealt.withColumn("n1", F.row_number().over(order)).withColumn("b1", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.join(F.broadcast(start), "r").select("doc_id", "size", "text_crc32", "h", (F.col("n0") + F.col("n1") - 1).alias("row"), (F.col("b0") + F.col("b1")).alias("end"))
    placed = materialise(placed)
    # The place of a group of equal texts is that of its middle byte; of a large group, each record's own.
    first = placed.groupBy("h").agg(F.min(F.col("end") - F.col("size")).alias("begin"), F.sum("size").alias("g")).where(F.col("g") <= WHOLE_GROUP * total / shards)
    middle = F.coalesce(F.col("begin") + F.col("g") / 2, F.col("end") - F.col("size") / 2)
    shard = F.least(F.floor(middle * shards / total), F.lit(shards - 1)).cast("int")
    sharded = materialise(placed.join(first, "h", "left").select("doc_id", "size", "text_crc32", shard.alias("shard"), "row"))
    begins = sharded.groupBy("shard").agg(F.min("row").alias("row0"))
    return sharded.join(F.broadcast(begins), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("row0")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
