"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Centroids and codebooks are fitted on a bounded sample (``FIT_ROWS`` vectors); every vector is indexed. A vector's
residual is scaled by the spread of its cell before it is quantised, so a cell of near-copies keeps its order as well
as a wide one; the residual's part along the centroid, which large inner products hang on, is kept exactly. A query
probes the cells with the largest inner products; in each it scores codes from a table of the inner products of its
parts with the codebooks (asymmetric: the query itself is not quantised). An entry's code is off by a known length, so
each score has a bound, and whatever may be among the best of its block is scored again on the original vectors: no
number of candidates is fixed, and none is lost in a cell that is probed.

Equal vectors are one entry with their least ids. Cells are split into blocks of bounded size for rows and for
queries, so no task gets a whole hot cell. How many cells are probed follows from the sample: as many as hold
``TARGET`` of the sample's own nearest neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from weftline.llm.common import bounded_sample, materialise
from weftline.operators.blocks import Best

#: Vectors in the fit, queries that measure how many cells to probe, and the share of neighbours these must hold.
FIT_ROWS, TRIALS, TARGET = 16_384, 512, 0.995
#: How many standard deviations above its centroid a cell's best vector is taken to be when cells are ordered.
OUTLOOK = 3.0
#: Parts of a vector and codes of a part.
PARTS, CODES = 16, 256
#: Rows and queries in one block of a cell.
BLOCK_ROWS, BLOCK_QUERIES = 4096, 1024


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 2) -> np.ndarray:
    """Centroids of at most ``k`` clusters; fewer if there are fewer distinct rows."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centroids = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centroids)
        count = np.bincount(near, minlength=len(centroids))
        total = np.zeros_like(centroids)
        np.add.at(total, near, x)
        centroids[count > 0] = total[count > 0] / count[count > 0, None]
    return centroids


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The place of each row's nearest centroid."""
    half = (centroids**2).sum(axis=1) / 2
    return np.concatenate([(x[i : i + 4096] @ centroids.T - half).argmax(axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def outlook(q: np.ndarray, centroids: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Inner product with each centroid, and what a wide cell may add to it."""
    return q @ centroids.T + OUTLOOK / np.sqrt(q.shape[1]) * np.linalg.norm(q, axis=1)[:, None] * spread


@dataclass
class Index:
    """What tasks need to code and to score: centroids, their spreads, codebooks (parts, codes, width), cells to probe."""

    centroids: np.ndarray
    spread: np.ndarray
    books: np.ndarray
    probes: int

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Cell of each vector, the inner product of its residual with the centroid, the residual's codes, how far these are off, and the residual's length."""
        cell = nearest(x, self.centroids)
        rest = x - self.centroids[cell]
        along = np.einsum("ij,ij->i", rest, self.centroids[cell])
        scaled = (self._padded(rest) / self.spread[cell, None]).reshape(len(x), len(self.books), -1)
        codes = np.stack([nearest(scaled[:, p], book) for p, book in enumerate(self.books)], axis=1) if len(x) else np.zeros((0, len(self.books)), np.int64)
        coded = np.stack([book[codes[:, p]] for p, book in enumerate(self.books)], axis=1)
        off = np.linalg.norm((scaled - coded).reshape(len(x), -1), axis=1) * self.spread[cell]
        return cell, along, codes.astype(np.uint8), off, np.linalg.norm(rest, axis=1)

    def _padded(self, x: np.ndarray) -> np.ndarray:
        width = self.books.shape[0] * self.books.shape[2]
        return np.pad(x, ((0, 0), (0, width - x.shape[1])))

    def nearest_cells(self, q: np.ndarray) -> np.ndarray:
        """The cells that each query probes: those whose best vectors are likely to have the largest inner products."""
        score = outlook(q, self.centroids, self.spread)
        return np.argsort(-score, axis=1, kind="stable")[:, : self.probes]

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(queries, parts, codes): inner products of the queries' parts with the codebooks."""
        parts = self._padded(q).reshape(len(q), len(self.books), -1)
        return np.einsum("qpw,pcw->qpc", parts, self.books)


def fit(x: np.ndarray, rows: int, k: int) -> Index:
    """Fit to a sample ``x`` of ``rows`` vectors, with cells in proportion to the square root of ``rows``."""
    centroids = kmeans(x, int(np.clip(round(rows**0.5 / 2), 1, 4096)))
    cell = nearest(x, centroids)
    rest = x - centroids[cell]
    count = np.bincount(cell, minlength=len(centroids))
    spread = np.sqrt(np.bincount(cell, (rest**2).sum(axis=1), len(centroids)) / np.maximum(1, count))
    spread[~(spread > 1e-9)] = max(1e-9, float(np.sqrt((rest**2).sum(axis=1).mean())))
    parts = min(PARTS, x.shape[1])
    width = -(-x.shape[1] // parts)
    scaled = np.pad(rest / spread[cell, None], ((0, 0), (0, parts * width - x.shape[1]))).reshape(len(x), parts, width)
    books = np.zeros((parts, CODES, width))
    for p in range(parts):
        found = kmeans(scaled[:, p], CODES, rounds=8)
        books[p, : len(found)] = found
        books[p, len(found) :] = found[:1]
    tried = np.random.default_rng(20).permutation(len(x))[:TRIALS]
    score = x[tried] @ x.T
    score[np.arange(len(tried)), tried] = -np.inf
    top = np.argsort(-score, axis=1)[:, : min(k, len(x) - 1)]
    order = np.argsort(np.argsort(-outlook(x[tried], centroids, spread), axis=1, kind="stable"), axis=1)
    place = np.take_along_axis(order, cell[top], axis=1).ravel()
    probes = int(np.quantile(place, TARGET, method="higher")) + 1 if len(place) else len(centroids)
    return Index(centroids, spread, books, probes)


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def search(df: DataFrame, is_query, vec_id: str = "vec_id", vector: str = "embedding", k: int = 20, exact: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows nearest by inner product to each row where ``is_query`` holds.

    A query probes the cells that are likely to hold its nearest. In a cell no candidate is lost: the tables tell each
    score up to a known error, and whatever may reach the best ``k`` of a block is scored exactly there. With ``exact``
    the cells that were not probed are too, as far as the largest distance from their centroid does not rule them out,
    so that the result is that of all rows (and, where no cell can be ruled out, costs as much).

    A query's own row is no candidate; other rows with an equal vector are. Ties go to the smaller id; with fewer
    candidates than ``k`` all are returned. Rows with a null id, and vectors that are null, empty, zero, of another
    length than most, or that hold null or non-finite components take no part. Repeated rows (equal id and vector)
    count once. No rows give an empty result. Other columns are not looked at.
    """
    spark = df.sparkSession
    rows = df.select(F.col(f"`{vec_id}`").cast(LongType()).alias("id"), F.col(f"`{vector}`").alias("v"), is_query.alias("q"))
    kind = dict(rows.dtypes)["v"]
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0))
    out_schema = "query_id long, rank int, vec_id long, score double"
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return spark.createDataFrame([], out_schema)
    rows = rows.where(F.size("v") == lengths["n"])
    # Equal vectors are one entry, named by the least id; the hot one is added up before any shuffle.
    entries = materialise(rows.groupBy("v").agg(F.min("id").alias("e"), F.max("q").alias("q")))
    n = entries.count()
    sample = np.array([r["v"] for r in bounded_sample(entries.select("e", "v"), "e", FIT_ROWS).orderBy("e").collect()], dtype=np.float64)
    index = spark.sparkContext.broadcast(fit(sample, n, k))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                cell, along, codes, off, far = index.value.encode(_matrix(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cell.astype(np.int32)), pa.array(along), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(off), pa.array(far)], ["e", "v", "cell", "along", "codes", "off", "far"])

    coded = materialise(entries.select("e", "v").mapInArrow(code, f"e long, v {kind}, cell int, along double, codes binary, off double, far double"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = index.value.nearest_cells(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(cells.astype(np.int32)), pa.list_(pa.int32()))], ["qe", "v", "cells"])

    queries = entries.where("q").select(F.col("e").alias("qe"), "v")
    asked = queries.mapInArrow(probe, f"qe long, v {kind}, cells array<int>").select("qe", "v", F.explode("cells").alias("cell"))
    best = Window.partitionBy("qe").orderBy(F.desc("score"), "e")
    nearest_of = lambda hits: hits.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    scored = materialise(nearest_of(_scanned(coded, materialise(asked), index, k)))
    if exact:
        # At most 4096 cells: the farthest entry of each.
        far = np.zeros(len(index.value.centroids))
        for r in coded.groupBy("cell").agg(F.max("far").alias("far")).collect():
            far[r["cell"]] = r["far"]
        enough = scored.groupBy("qe").agg(F.when(F.count(F.lit(1)) > k, F.min("score")).alias("least"))

        def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = index.value
            for batch in batches:
                q = _matrix(batch.column(1))
                bound = q @ model.centroids.T + np.linalg.norm(q, axis=1)[:, None] * far * (1 + 1e-9)
                least = np.array([-np.inf if x is None else x for x in batch.column(2).to_pylist()])
                open_ = bound >= least[:, None] - 1e-9 * np.abs(least[:, None], where=np.isfinite(least[:, None]), out=np.zeros((len(q), 1)))
                np.put_along_axis(open_, model.nearest_cells(q), False, axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([np.flatnonzero(x).astype(np.int32) for x in open_], pa.list_(pa.int32()))], ["qe", "v", "cells"])

        rest = queries.join(enough, "qe", "left").select("qe", "v", "least").mapInArrow(more, f"qe long, v {kind}, cells array<int>").select("qe", "v", F.explode("cells").alias("cell"))
        scored = materialise(nearest_of(scored.unionByName(_scanned(coded, materialise(rest), index, k))))
    # A query entry is always among its own candidates, for the other rows that share its vector.
    own = queries.select("qe", F.col("qe").alias("e"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")).alias("score"))
    scored = scored.unionByName(own)
    # Back from entries to rows: of an entry only its k + 1 least ids can be among the nearest of anyone.
    vectors = entries.select("e", "v")
    named = materialise(rows.select("id", "v", "q").join(vectors, "v").select("e", "id", "q").distinct())
    least = named.withColumn("r", F.row_number().over(Window.partitionBy("e").orderBy("id"))).where(F.col("r") <= k + 1).select("e", "id")
    asking = named.where("q").select(F.col("e").alias("qe"), F.col("id").alias("query_id")).distinct()
    order = Window.partitionBy("qe").orderBy(F.desc("score"), "id")
    # An entry's queries share one list of k + 1 rows; each leaves out itself.
    lists = scored.join(least, "e").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).select("qe", "id", "score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    pairs = lists.join(asking, "qe").where("id != query_id").withColumn("rank", rank).where(F.col("rank") <= k)
    return pairs.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def _scanned(coded: DataFrame, asked: DataFrame, index, k: int) -> DataFrame:
    """(qe, e, score): of every block of a cell that a query (qe, v, cell) probes its ``k + 1`` best entries, with exact scores; its own entry is none."""
    # Blocks: sizes are one row for each of at most 4096 cells.
    sizes = coded.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("nr")).join(asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("nq")), "cell")
    sizes = F.broadcast(materialise(sizes))
    block = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = coded.join(sizes, "cell").select("cell", block("e", "nr").alias("br"), every("nq").alias("bq"), "e", F.col("v").alias("x"), "along", "codes", "off")
    right = asked.join(sizes, "cell").select("cell", every("nr").alias("br"), block("qe", "nq").alias("bq"), "qe", "v")

    def scan(key, rows: pa.Table, queries: pa.Table) -> pa.Table:
        ids, asking = rows.column("e").to_numpy(), queries.column("qe").to_numpy()
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        model, cell = index.value, key[0].as_py()
        if len(ids) and len(asking):
            x = _matrix(rows.column("x").combine_chunks())
            along, off = rows.column("along").to_numpy(), rows.column("off").to_numpy()
            codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1).astype(np.int64)
        for at in range(0, len(asking) if len(ids) else 0, 64):
            q, own = _matrix(queries.column("v").slice(at, 64).combine_chunks()), asking[at : at + 64]
            # What a query has along the centroid meets the exact part of the residual; tables score the rest.
            centroid = model.centroids[cell]
            level = q @ centroid
            part = level / max(1e-300, centroid @ centroid)
            across = q - part[:, None] * centroid
            tables = model.tables(across)
            near = np.zeros((len(q), len(ids)))
            for p in range(codes.shape[1]):
                near += tables[:, p, codes[:, p]]
            near = near * model.spread[cell] + level[:, None] + part[:, None] * along
            near[own[:, None] == ids] = -np.inf
            # The tables are off by no more than this; what cannot be among the best is not looked at again.
            slack = np.linalg.norm(across, axis=1)[:, None] * off * (1 + 1e-9) + 1e-9
            sure = near - slack
            least = np.partition(sure, -k - 1, axis=1)[:, -k - 1] if len(ids) > k + 1 else np.full(len(q), -np.inf)
            maybe = (near + slack >= least[:, None]) & np.isfinite(near)
            some = np.flatnonzero(maybe.any(axis=0))
            best = Best(len(q), k + 1, 1)
            best.add(np.where(maybe[:, some], q @ x[some].T, -np.inf), ids[some], np.broadcast_to(some, (len(q), len(some))))
            row, place = best.held[0], best.held[3].astype(np.int64)
            out.append((own[row], ids[place], np.einsum("ij,ij->i", q[row], x[place])))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], ["qe", "e", "score"])

    by = ["cell", "br", "bq"]
    return left.groupBy(*by).cogroup(right.toDF("acell", "abr", "abq", "qe", "v").groupBy("acell", "abr", "abq")).applyInArrow(scan, "qe long, e long, score double")
