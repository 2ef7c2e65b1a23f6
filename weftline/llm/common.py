"""What the training-data operators share: tables, the shared folder, word hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only where none is set and the master is local (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-weftline-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


def materialise(df: DataFrame, *partition_cols: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftline-{uuid.uuid4().hex}"
    writer = df.write
    if partition_cols:
        writer = writer.partitionBy(*partition_cols)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of text that a task works on at a time; what it needs besides is a small multiple of this.
SLICE_BYTES = 1 << 20


def slices(batch: pa.RecordBatch, column: int, rows: int = 512, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of at most ``rows`` rows and about ``size`` bytes of a column; a longer value is a part of its own."""
    values = batch.column(column)
    if pa.types.is_string(values.type) or pa.types.is_binary(values.type):
        wide = pc.binary_length(values)
    elif pa.types.is_list(values.type):
        wide = pc.multiply(pc.list_value_length(values), 8)
    else:
        wide = pa.array(np.zeros(len(values), np.int64))
    ends = np.cumsum(pc.fill_null(wide, 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, "right"))))
        yield batch.slice(at, to - at)
        at = to


def map_texts(df: DataFrame, column: str, make: Callable[[], Callable[[list], list]], schema: str, keep: list[str] | None = None, rows: int = 512, size: int = SLICE_BYTES) -> DataFrame:
    """``df`` (or its columns ``keep``) with the fields of ``schema``, worked out from the values of ``column``.

    ``make`` is called once in each task and gives a function from a list of values to a list of columns (Arrow arrays or
    lists). It gets at most ``rows`` values and about ``size`` bytes at a time, so what a worker holds besides one Arrow
    batch stays small however long the texts are, and what it remembers goes with the task. A column of ``df`` that has
    the name of a new one (in any case) is replaced.
    """
    new = StructType.fromDDL(schema)
    taken = {f.name.lower() for f in new}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]
    out = StructType([df.schema[c] for c in kept] + list(new))
    types = [to_arrow_type(f.dataType) for f in new]
    names = [f.name for f in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, 0, rows, size):
                made = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(work(part.column(0).to_pylist()), types)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *made], names)

    source = df.select(F.col(f"`{column}`").alias("__value"), *[F.col(f"`{c}`") for c in kept])
    return source.mapInArrow(run, out)


def held_out(doc_id: str | Column) -> Column:
    """The fold that no model may learn labels from: crc32 of the id as text is divisible by 5."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % 5 == 0


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows of ``df`` (all, if fewer), chosen by a hash of ``key``, so a recomputed task chooses alike."""
    n = df.count()
    if n <= rows:
        return df
    buckets = 1 << 30
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(buckets)) < int(buckets * rows / n))


def usable_labels(labels: DataFrame, label: str, doc_id: str) -> DataFrame:
    """(id, y): one label of 0 or 1 for each id outside the held-out fold; of several the larger."""
    rows = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("id"))
    return rows.groupBy("id").agg(F.max("y").alias("y"))


def labelled_texts(docs: DataFrame, sample: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, y, text) of the ids of ``sample`` (id, y; bounded), one row for each: of an id with several texts the one of the least hash, so what is learnt from is bounded too."""
    held = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(sample), "id")
    return held.groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(1 << (n - 1).bit_length(), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers


_MARK = np.ones(256, dtype=bool)
_MARK[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False


#: Bytes of text that are hashed at a time; what this needs in memory is some sixty times as much.
HASH_BYTES = 1 << 20


def word_hashes(texts: list[str | None], marks: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of all texts (split at ASCII white space), and where each text's begin and end.

    One polynomial hash of the joined bytes gives every word's hash by a difference; nothing runs per word. Without
    ``marks``, words that are a single mark of punctuation are left out.
    """
    parts, bounds, held, size = [], [0], [], 0
    for last, t in enumerate(texts, 1):
        held.append((t or "").lower().encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size >= HASH_BYTES or last == len(texts):
            hashes, places = _hashed(held, marks)
            bounds += (places[1:] + bounds[-1]).tolist()
            parts.append(hashes)
            held, size = [], 0
    return np.concatenate([np.zeros(0, np.uint64), *parts]), np.array(bounds)


def _hashed(coded: list[bytes], marks: bool) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b" ".join([b"", *coded, b""]), np.uint8)
    space = _SPACE[raw]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    if not marks:
        kept = ~((ends - starts == 1) & _MARK[raw[starts]])
        starts, ends = starts[kept], ends[kept]
    power, inverse = _power_tables(len(raw))
    sums = np.cumsum((raw + np.uint64(1)) * power[: len(raw)], dtype=np.uint64)
    hashes = mix((sums[ends - 1] - sums[starts - 1]) * inverse[starts] + (ends - starts).astype(np.uint64))
    offsets = np.cumsum([1, *(len(c) + 1 for c in coded)])
    return hashes, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift) over an array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def summed_arrays(parts: DataFrame, many: int, dtype: type) -> dict[int, np.ndarray]:
    """Sums of the arrays (slice, part, data) by slice, for ``many`` parts; added up in two levels so that no task gets them all."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(1, dtype)
        for x in table.column("data").to_pylist():
            total = total + np.frombuffer(x, dtype)
        return pa.table([table.column("slice")[:1], pa.array([0], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["slice", "part", "data"])

    schema = "slice long, part long, data binary"
    width = max(1, int(many**0.5))
    first = parts.withColumn("part", F.col("part") % width).groupBy("slice", "part").applyInArrow(add, schema)
    return {r["slice"]: np.frombuffer(r["data"], dtype) for r in first.groupBy("slice").applyInArrow(add, schema).toLocalIterator()}
