"""Places in an order over a whole table, and running sums and windows over blocks of it, without a task that has all rows."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.tables import stored

#: Rows of a block.
BLOCK = 8192


def numbered(df: DataFrame, *order: str, out: str = "idx", block: int = BLOCK) -> DataFrame:
    """``df`` with its place from 0 in the order of columns, and ``block``, the place over ``block`` in whole numbers.

    Rows are dealt to ranges and sorted there; the ranges' sizes, one row each, give the rest. Rows equal in all of
    ``order`` have their places in any order, which is fixed by being written.
    """
    run = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__run", F.monotonically_increasing_id()))
    rows = run.withColumn("__range", F.shiftright("__run", 33))
    sizes = rows.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"), F.min("__run").alias("__first"))
    before = F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__range", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"))
    placed = rows.join(F.broadcast(starts), "__range").withColumn(out, F.col("__run") + F.col("__shift")).drop("__run", "__range", "__shift")
    return placed.withColumn("block", F.expr(f"`{out}` div {block}"))


def running_sum(rows: DataFrame, by: str, value: str, out: str, idx: str = "idx") -> DataFrame:
    """``numbered`` rows with the sum of ``value`` up to each within ``by``: inside its block, and over the sums of the blocks before. A null ``by`` is a group of its own."""
    own = F.sum(value).over(Window.partitionBy(by, "block").orderBy(idx))
    sums = rows.groupBy(F.col(by).alias("__by"), F.col("block").alias("__block")).agg(F.sum(value).alias("__sum"))
    before = F.sum("__sum").over(Window.partitionBy("__by").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select("__by", "__block", F.coalesce(before, F.lit(0)).alias("__before"))
    same = (F.col("block") == F.col("__block")) & F.col(by).eqNullSafe(F.col("__by"))
    return rows.withColumn("__own", own).join(starts, same).withColumn(out, F.coalesce("__own", F.lit(0)) + F.col("__before")).drop("__own", "__by", "__block", "__before")


def over_blocks(rows: DataFrame, work: Callable[[pa.Table], pa.Table], schema: str, halo: int, block: int = BLOCK) -> DataFrame:
    """What ``work`` makes of each block of ``numbered`` rows in order, with up to ``halo`` rows before it; they are marked by ``own`` = false."""
    if halo > block:
        raise ValueError("a block must have as many rows as the ones before it that are needed")
    late = F.col("idx") % block >= block - halo
    dealt = rows.withColumn("__at", F.explode(F.when(late, F.array("block", F.col("block") + 1)).otherwise(F.array("block")))).withColumn("own", F.col("__at") == F.col("block"))

    def run(table: pa.Table) -> pa.Table:
        return work(table.sort_by("idx"))

    return dealt.drop("block").groupBy("__at").applyInArrow(run, schema)
