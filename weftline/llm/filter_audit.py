"""Filter interaction audit: what each filter removes in every order of application.

Every document gets a mask of the filters it fails. Four filters look at a text alone; the fifth (an exact copy of an
earlier document) is prepared by a counting Bloom sketch: tasks count hashed texts, the sketches are merged by adding,
and a text with a counter below two stands alone for certain. Only the texts of possible repeats are shuffled, grouped
by the whole text for the least id; the flags then join by id and are added up by part and mask. All orders follow from
those counts, at most ``2 ** filters`` for a part, without another look at the documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import materialise, mix

#: The filters in the order of their bits.
FILTERS = "ABCDE"
#: Counters for each row, fewest and most of them (a bit each when sent: 64 MB), hashes of a text at most.
COUNTERS, LEAST_COUNTERS, MOST_COUNTERS, HASHES = 8, 1 << 16, 1 << 29, 4
#: Counters of a slice of the sketch, texts that a task counts at a time.
SLICE, CHUNK = 1 << 16, 1 << 18

_WHITE = r"[\x20\x09-\x0D]+"


def text_mask(text: Column) -> Column:
    """Bits 1, 2, 4 and 8 of a text: under 200 words; under half of the words distinct; over 3 % capitals A to Z; any of ``#$%&*|``. Null counts as empty."""
    body = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(body, _WHITE), "")
    capitals = F.length(body) - F.length(F.regexp_replace(body, "[A-Z]+", ""))
    fails = [
        F.size(words) < 200,
        F.size(F.array_distinct(words)) * 100 < F.size(words) * 50,
        capitals * 100 > F.length(body) * 3,
        body.rlike("[#$%&*|]"),
    ]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0)).cast("int")


def _places(hashes: np.ndarray, counters: int, many: int) -> np.ndarray:
    """Counters of each hash, ``many`` in a row."""
    first = mix(hashes.view(np.uint64).copy())
    step = mix(first.copy()) | np.uint64(1)
    return (first[:, None] + step[:, None] * np.arange(many, dtype=np.uint64)) & np.uint64(counters - 1)


def _capped(places: np.ndarray) -> np.ndarray:
    """Sorted ``places``, each at most twice: more than two does not count."""
    places = np.sort(places)
    return np.concatenate([places[:2], places[2:][places[2:] != places[:-2]]])


class Sketch:
    """A merged counting Bloom sketch, one bit for each counter: whether it has reached two."""

    def __init__(self, bits: np.ndarray, counters: int, many: int):
        self.bits, self.counters, self.many = bits, counters, many

    def possible(self, hashes: np.ndarray) -> np.ndarray:
        """Whether a text of this hash may stand twice; false is certain."""
        at = _places(hashes, self.counters, self.many)
        return ((self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def sketch(hashes: DataFrame, rows: int) -> Sketch:
    """The sketch of a column ``h`` of ``rows`` hashes.

    A task adds up ``CHUNK`` hashes at a time and sends the counters it touched by slice, each at most twice; slices
    are merged in two turns, so no task gets all. Counters follow ``rows`` up to ``MOST_COUNTERS``; with more rows than
    an eighth of that fewer texts are cleared, never one too many.
    """
    counters = min(MOST_COUNTERS, max(LEAST_COUNTERS, 1 << math.ceil(math.log2(max(1, rows) * COUNTERS))))
    many = min(HASHES, max(1, round(counters / max(1, rows) * math.log(2))))
    slices = -(-counters // SLICE)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, turn = [], 0, 0

        def told() -> pa.RecordBatch:
            places = _capped(_places(np.concatenate(held), counters, many).ravel())
            slice_of = places // np.uint64(SLICE)
            starts = np.flatnonzero(np.diff(slice_of, prepend=np.uint64(slices)))
            parts = np.split((places % np.uint64(SLICE)).astype("<u2"), starts[1:])
            n = len(starts)
            return pa.RecordBatch.from_arrays([pa.array(slice_of[starts].astype(np.int64)), pa.array(np.full(n, turn)), pa.array([p.tobytes() for p in parts], pa.binary())], ["slice", "part", "data"])

        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            size += len(held[-1])
            if size >= CHUNK:
                yield told()
                held, size, turn = [], 0, turn + 1
        if size:
            yield told()

    def merge(table: pa.Table) -> pa.Table:
        places = _capped(np.concatenate([np.frombuffer(x, "<u2") for x in table.column("data").to_pylist()]))
        return pa.table([table.column("slice")[:1], pa.array([0], pa.int64()), pa.array([places.tobytes()], pa.binary())], ["slice", "part", "data"])

    def finish(table: pa.Table) -> pa.Table:
        places = np.concatenate([np.frombuffer(x, "<u2") for x in table.column("data").to_pylist()])
        twice = np.bincount(places, minlength=SLICE) >= 2
        return pa.table([table.column("slice")[:1], pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())], ["slice", "bits"])

    schema = "slice long, part long, data binary"
    parts = hashes.select("h").mapInArrow(count, schema).withColumn("part", F.pmod(F.col("part") + F.spark_partition_id(), F.lit(max(1, int(hashes.rdd.getNumPartitions() ** 0.5)))))
    merged = parts.groupBy("slice", "part").applyInArrow(merge, schema).groupBy("slice").applyInArrow(finish, "slice long, bits binary")
    bits = np.zeros(slices * SLICE // 8, np.uint8)
    for r in merged.toLocalIterator():
        bits[r["slice"] * SLICE // 8 : (r["slice"] + 1) * SLICE // 8] = np.frombuffer(r["bits"], np.uint8)
    return Sketch(bits, counters, many)


def masks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, part, mask), one row for each row of ``docs``; bit 16 marks texts equal to that of a smaller id.

    Null texts are empty ones, and equal to each other; a null language is the empty part. A row without an id is never
    a repeat and makes none; rows equal in id and text do not make each other repeats. The texts of possible repeats
    are scanned a second time, the others never leave their task. Other columns are not looked at.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    hashed = F.xxhash64(body)
    narrow = materialise(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("")).alias("part"), text_mask(F.col(f"`{text}`")).alias("mask"), hashed.alias("h")))
    sent = docs.sparkSession.sparkContext.broadcast(sketch(narrow, narrow.count()))

    @F.pandas_udf("boolean")
    def possible(h: pd.Series) -> pd.Series:
        return pd.Series(sent.value.possible(h.to_numpy(dtype=np.int64)))

    texts = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), body.alias("text"), hashed.alias("h")).where(F.col("doc_id").isNotNull()).where(possible("h"))
    firsts = texts.groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.xxhash64("text").alias("h"), F.lit(True).alias("first"))
    # Of an id with several texts, the hash tells which of them is the first of its kind.
    told = narrow.join(firsts.distinct(), ["doc_id", "h"], "left")
    again = F.col("doc_id").isNotNull() & F.col("first").isNull() & possible("h")
    return told.select("doc_id", "part", F.col("mask").bitwiseOR(F.when(again, 16).otherwise(0)).alias("mask"))


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """What every filter removes at every step of every order, from (part, mask, n, good, toxic) with one row for each part and mask.

    One row for each part, order and step: documents kept after the step, removed at it, failing its filter but removed
    before, failing its filter alone, good and toxic ones among the removed, and ``shapley``, what the filter removes
    summed over all orders: of ``k`` filters that a document fails each comes first in one of ``k`` orders.
    """
    rows = []
    for order in permutations(range(len(filters))):
        before = 0
        for step, f in enumerate(order, 1):
            rows.append(("".join(filters[i] for i in order), step, 1 << f, before))
            before |= 1 << f
    names, steps, bits, befores = (list(x) for x in zip(*rows))
    bit, before = np.array(bits)[:, None], np.array(befores)[:, None]
    masks = np.arange(1 << len(filters))[None, :]
    fails, gone = (masks & bit) > 0, (masks & before) > 0
    size = np.array([max(1, int(m).bit_count()) for m in masks[0]])
    total = math.factorial(len(filters))
    by_count = {
        "kept": ~gone & ~fails, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": masks == bit, "shapley": fails * (total // size),
    }
    out = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def told(table: pa.Table) -> pa.Table:
        at = table.column("mask").to_numpy()
        held = {c: np.bincount(at, weights=table.column(c).to_numpy(), minlength=1 << len(filters)).astype(np.int64) for c in ("n", "good", "toxic")}
        values = {k: m.astype(np.int64) @ held["n"] for k, m in by_count.items()}
        values |= {f"{k}_lost": by_count["removed"].astype(np.int64) @ held[k] for k in ("good", "toxic")}
        part = pa.array([table.column("part")[0].as_py()] * len(names), pa.string())
        return pa.table([part, pa.array(names), pa.array(steps, pa.int32()), *[pa.array(values[c]) for c in out]], ["part", "filter_order", "step", *out])

    return counts.groupBy("part").applyInArrow(told, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in out))


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``interactions`` of the five filters over ``docs`` by language, with the good and toxic documents of ``labels`` (doc_id, quality, toxic).

    A document without a label is neither; of several labels of an id one that says so is enough. An empty table gives
    no rows. See ``masks`` for nulls and repeated rows.
    """
    marked = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))])
    rows = masks(docs, doc_id, text, lang).join(marked, "doc_id", "left")
    counts = rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")])
    return interactions(counts)
