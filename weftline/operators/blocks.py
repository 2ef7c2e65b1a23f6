"""A set of queries held against all rows, in blocks: what search by vectors and by text has in common."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries, and numbers in all their lists, that are sent to every task at once, at most; beyond either, queries and rows meet in blocks of so many.
SENT_QUERIES, SENT_NUMBERS, QUERY_BLOCK, ROW_BLOCK = 1024, 1 << 22, 4096, 1 << 16

#: What a task does: it is given the queries, and returns a function that takes rows and one that tells what was found.
Work = Callable[[pa.Table], tuple[Callable[[pa.RecordBatch], None], Callable[[], pa.RecordBatch]]]


class Best:
    """The ``k`` best of each query so far: largest score first, ties to the smaller id; further values are carried along."""

    def __init__(self, queries: int, k: int, more: int = 0):
        self.k = k
        self.least = np.full(queries, -np.inf)
        self.held = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), *[np.zeros(0)] * more]

    def add(self, scores: np.ndarray, ids: np.ndarray, *more: np.ndarray) -> None:
        """Take in scores (query by row; -inf: no candidate) of the rows ``ids``. Ties with the last place are settled by id, never dropped."""
        least = self.least
        if scores.shape[1] > self.k:
            least = np.maximum(least, np.partition(scores, -self.k, axis=1)[:, -self.k])
        q, r = np.nonzero((scores >= least[:, None]) & np.isfinite(scores))
        new = [q, scores[q, r], ids[r], *(x[q, r] for x in more)]
        held = [np.concatenate(x) for x in zip(self.held, new)]
        order = np.lexsort((held[2], -held[1], held[0]))
        held = [x[order] for x in held]
        first = np.searchsorted(held[0], np.arange(len(self.least)))
        place = np.arange(len(order)) - first[held[0]]
        self.held = [x[place < self.k] for x in held]
        last = place == self.k - 1
        self.least[held[0][last]] = held[1][last]


def meet(queries: DataFrame, rows: DataFrame, work: Work, schema: str) -> DataFrame:
    """What ``work`` finds of all ``queries`` in all ``rows``, by task: a partial result for its caller to merge.

    Up to ``SENT_QUERIES`` queries of up to ``SENT_NUMBERS`` numbers in all, as counted beforehand, are broadcast and the
    rows are read in place, without a shuffle. More are dealt to blocks, and so are the rows; each pair of blocks meets in one task, which holds no more than one block
    of each. The rows are read once, however many queries there are, and no list of pairs is made.
    """
    spark = rows.sparkSession
    lists = [F.coalesce(F.size(name), F.lit(0)) for name, kind in queries.dtypes if kind.startswith("array")]
    n, numbers = queries.agg(F.count(F.lit(1)), F.coalesce(F.sum(sum(lists, F.lit(0))), F.lit(0))).first()
    if not n:
        return spark.createDataFrame([], schema)
    if n <= SENT_QUERIES and numbers <= SENT_NUMBERS:
        sent = spark.sparkContext.broadcast(queries.toArrow())

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            add, told = work(sent.value)
            for batch in batches:
                if batch.num_rows:
                    add(batch)
            yield told()

        return rows.mapInArrow(scan, schema)
    across, down = max(-(-n // QUERY_BLOCK), -(-numbers // SENT_NUMBERS)), -(-max(1, rows.count()) // ROW_BLOCK)
    names, own = rows.columns, queries.columns
    # Both sides' keys are longs: whole numbers of two types do not go to the same partition, and their blocks would never meet.
    place = lambda df, blocks: F.pmod(F.xxhash64(F.lit("block"), F.col(df.columns[0])), F.lit(blocks)).cast("long")
    each = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    # Both sides may come from one table, so the columns of one get names of their own.
    left = queries.toDF(*[f"__asked_{c}" for c in own])
    asked = left.withColumn("__a", place(left, across)).withColumn("__d", each(down))
    held = rows.withColumn("__down", place(rows, down)).withColumn("__across", each(across))

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.select([f"__asked_{c}" for c in own]).rename_columns(own)
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([work(left.slice(0, 0))[1]()])
        add, told = work(left)
        for batch in right.select(names).combine_chunks().to_batches(max_chunksize=8192):
            add(batch)
        return pa.Table.from_batches([told()])

    return asked.groupBy("__a", "__d").cogroup(held.groupBy("__across", "__down")).applyInArrow(pair, schema)
