"""Text search over two channels without a model: hashed dense vectors and sparse n-gram counts, combined exactly."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.blocks import Best, meet
from weftline.tables import stored

#: Slots of a dense vector, keys of the sparse one, weights of characters, bigrams and trigrams.
SLOTS, KEYS = 512, 0xFFFFFE
GRAM_WEIGHTS = (0.5, 1.0, 1.5)
#: Characters whose n-grams are counted at once, about.
COUNTED = 1 << 18
#: Queries and rows that meet in one product.
PRODUCT_QUERIES, PRODUCT_ROWS = 64, 64


def _hashes(points: np.ndarray, n: int, prefix: str = "") -> np.ndarray:
    """``text.hash31`` of ``prefix`` and each n-gram of code points, in order."""
    out = np.full(max(0, len(points) - n + 1), sum(ord(c) * 31 ** (len(prefix) + n - 1 - i) for i, c in enumerate(prefix)), np.int64)
    for i in range(n):
        out += points[i : i + len(out)] * 31 ** (n - 1 - i)
    out %= 1 << 32
    return np.abs(np.where(out >= 1 << 31, out - (1 << 32), out))


def _dense_grams(points: np.ndarray) -> list[tuple[int, np.ndarray, float]]:
    """Of characters, bigrams and trigrams: their length, the slot of each, and their weight."""
    return [(n, _hashes(points, n) % SLOTS, weight) for n, weight in enumerate(GRAM_WEIGHTS, 1)]


def _sparse_grams(points: np.ndarray) -> list[tuple[int, np.ndarray, float]]:
    """Of bigrams and trigrams: their length, the term of each, and 1."""
    return [(n, _hashes(points, n, mark) % KEYS, 1.0) for n, mark in ((2, "b:"), (3, "t:"))]


def _summed(owner: np.ndarray, entry: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, entry and sum of weights, once each, in order; entries are less than 2^24."""
    both, place = np.unique(owner << 24 | entry, return_inverse=True)
    return both >> 24, both & 0xFFFFFF, np.bincount(place, weight, len(both))


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Keys and texts of (key, text) a few rows at a time, so that about ``COUNTED`` characters are worked on at once."""
    for batch in batches:
        texts, start, held = batch.column(1).to_pylist(), 0, 0
        for at, one in enumerate(texts):
            if held and held + len(one) > COUNTED:
                yield batch.column(0).slice(start, at - start), texts[start:at]
                start, held = at, 0
            held += len(one)
        if texts:
            yield batch.column(0).slice(start), texts[start:]


def _counted(df: DataFrame, key: str, body: str, kinds: list[Callable], told: Callable[..., list[pa.Array]], fields: str) -> DataFrame:
    """What ``told`` makes of the keys and, for each of ``kinds`` of n-grams, the owner (a place among the keys), entry and sum of weights.

    The rows of one key meet in a task, sorted, and count as one text's n-grams; what is held from one portion of rows to
    the next is the sums of one key. Only texts are shuffled, no n-grams.
    """
    rows = df.select(F.col(key), F.lower(F.trim(F.coalesce(F.col(body), F.lit("")))).alias("__text"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums = None, []
        batch = lambda keys, sums: pa.RecordBatch.from_arrays(told(keys, *sums), names)
        for keys, texts in _portions(batches):
            values = keys.to_pylist()
            new = np.array([i > 0 and v != values[i - 1] for i, v in enumerate(values)])
            group, firsts = np.cumsum(new), np.flatnonzero(new | (np.arange(len(new)) == 0))
            points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
            row = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
            goes_on = held is not None and held[0].as_py() == values[0]
            if held is not None and not goes_on:
                yield batch(held, sums)
            now = []
            for i, grams in enumerate(kinds):
                owner, entry, weight = [], [], []
                for n, entries, w in grams(points):
                    inside = row[: len(entries)] == row[n - 1 :]
                    owner.append(group[row[: len(entries)][inside]])
                    entry.append(entries[inside])
                    weight.append(np.full(len(entry[-1]), w))
                if goes_on:
                    for list_, x in zip((owner, entry, weight), sums[i]):
                        list_.append(x)
                now.append(_summed(*map(np.concatenate, (owner, entry, weight))))
            last = len(firsts) - 1
            cut = [np.searchsorted(x[0], last) for x in now]
            if last:
                yield batch(keys.take(pa.array(firsts[:last])), [tuple(y[:c] for y in x) for x, c in zip(now, cut)])
            held, sums = keys.take(pa.array(firsts[last:])), [(x[0][c:] - last, x[1][c:], x[2][c:]) for x, c in zip(now, cut)]
        if held is not None:
            yield batch(held, sums)

    schema = f"`{key}` {dict(rows.dtypes)[key]}, {fields}"
    names = [key, *(f.split()[0] for f in fields.split(", "))]
    return rows.repartition(parts, key).sortWithinPartitions(key).mapInArrow(work, schema)


def sparse_terms(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, term, tf): hashed bigrams and trigrams of the lower-cased, trimmed text with their counts; none for texts of one character."""
    told = lambda keys, x: [keys.take(pa.array(x[0])), pa.array(x[1]), pa.array(x[2].astype(np.int64))]
    return _counted(df, key, body, [_sparse_grams], told, "term long, tf long")


def dense_slots(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, slot, weight, norm): characters, bigrams and trigrams hashed to slots, their weights added up, before any scaling, and the length of the key's vector."""

    def told(keys, x):
        norm = np.sqrt(np.bincount(x[0], x[2] * x[2], len(keys)))
        return [keys.take(pa.array(x[0])), pa.array(x[1]), pa.array(x[2]), pa.array(norm[x[0]])]

    return _counted(df, key, body, [_dense_grams], told, "slot long, weight double, norm double")


def indexed(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, slots, weights, terms, tfs): both vectors of every key, in order of slot and term; empty texts have empty ones.

    What is gathered for a key is bounded by the distinct n-grams of its own text.
    """

    def told(keys, *kinds):
        out = [keys]
        for owner, entry, weight in kinds:
            ends = pa.array(np.searchsorted(owner, np.arange(len(keys) + 1)).astype(np.int32))
            out += [pa.ListArray.from_arrays(ends, pa.array(entry)), pa.ListArray.from_arrays(ends, pa.array(weight))]
        return out

    return _counted(df, key, body, [_dense_grams, _sparse_grams], told, "slots array<long>, weights array<double>, terms array<long>, tfs array<double>")


def _lists(keys: pa.Array, values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, key and value of every entry of two list columns, each row's values scaled to unit length."""
    many = pc.fill_null(pc.list_value_length(keys), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(many)), many)
    k = keys.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    v = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    norm = np.sqrt(np.bincount(owner, v * v, len(many)))
    return owner, k, v / np.where(norm > 0, norm, 1.0)[owner]


def _cosines(queries: tuple, rows: tuple, n_queries: int, n_rows: int) -> np.ndarray:
    """Inner products of two sets of sparse unit vectors (row, key, value)."""
    out = np.zeros((n_queries, n_rows))
    qo, qk, qv = queries
    ro, rk, rv = rows
    for a in range(0, n_queries, PRODUCT_QUERIES):
        mine = (qo >= a) & (qo < a + PRODUCT_QUERIES)
        known, place = np.unique(qk[mine], return_inverse=True)
        if not len(known):
            continue
        left = np.zeros((min(PRODUCT_QUERIES, n_queries - a), len(known)))
        left[qo[mine] - a, place] = qv[mine]
        at = np.minimum(np.searchsorted(known, rk), len(known) - 1)
        same = known[at] == rk
        for b in range(0, n_rows, PRODUCT_ROWS):
            on = same & (ro >= b) & (ro < b + PRODUCT_ROWS)
            right = np.zeros((len(known), min(PRODUCT_ROWS, n_rows - b)))
            right[at[on], ro[on] - b] = rv[on]
            out[a : a + len(left), b : b + right.shape[1]] = left @ right
    return out


class _Scorer:
    """Both cosines of a block of queries (query_id and the columns of ``indexed``) with rows (id and those)."""

    def __init__(self, asked: pa.Table, digits: int):
        column = lambda name: asked.column(name).combine_chunks()
        self.ids, self.digits = asked.column("query_id").to_numpy().astype(np.int64), digits
        self.dense, self.sparse = _lists(column("slots"), column("weights")), _lists(column("terms"), column("tfs"))

    def parts(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids, dense and sparse scores of a few rows at a time."""
        for start in range(0, batch.num_rows, 1024):
            part = batch.slice(start, 1024)
            found = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            score = lambda own, a, b, part=part, n=len(found): np.round(_cosines(own, _lists(part.column(a), part.column(b)), len(self.ids), n), self.digits) + 0.0
            yield found, score(self.dense, 1, 2), score(self.sparse, 3, 4)


_VECTORS = ["slots", "weights", "terms", "tfs"]


def _search(queries: DataFrame, corpus: DataFrame, lists: Callable[[np.ndarray, np.ndarray], list[tuple[str, np.ndarray]]], k: int, digits: int) -> DataFrame:
    """(query_id, id, list, dense, sparse): each task's ``k`` best rows of every query in each of the named ``lists`` of scores."""

    def work(asked: pa.Table):
        scorer, best = _Scorer(asked, digits), {}

        def add(batch: pa.RecordBatch) -> None:
            for found, dense, sparse in scorer.parts(batch):
                for name, score in lists(dense, sparse):
                    if name not in best:
                        best[name] = Best(len(scorer.ids), k, 2)
                    best[name].add(score, found, dense, sparse)

        def told() -> pa.RecordBatch:
            rows = [(scorer.ids[b.held[0]], b.held[2], np.full(len(b.held[0]), name), b.held[3], b.held[4]) for name, b in best.items()]
            columns = [np.concatenate(c) for c in zip(*rows)] if rows else [[]] * 5
            types = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["query_id", "id", "list", "dense", "sparse"])

        return add, told

    return meet(queries.select("query_id", *_VECTORS), corpus.select("id", *_VECTORS), work, "query_id long, id long, list string, dense double, sparse double")


def _stands(scores: np.ndarray, ids: np.ndarray, own_scores: np.ndarray, own_ids: np.ndarray) -> np.ndarray:
    """Of rows (negated score, id), the first of the ordered own ones that each stands before; their number, if none."""
    low, high = np.searchsorted(own_scores, scores, "left"), np.searchsorted(own_scores, scores, "right")
    out = high.copy()
    for a in np.unique(low[low < high]):  # equal scores: the id decides
        at = np.flatnonzero((low == a) & (low < high))
        out[at] = a + np.searchsorted(own_ids[a : high[at[0]]], ids[at], "right")
    return out


def _places(asked: DataFrame, corpus: DataFrame, digits: int) -> DataFrame:
    """(query_id, id, channel, place): the exact position in a channel of rows that ``asked`` names (with its query's vectors, and ``wanted``: channel, score, id).

    Rows with a larger score, or the same and a smaller id, stand before: every task counts, for all rows that are
    asked for at once, how many of its own stand between two of them in order; the counts are added up.
    """

    def work(table: pa.Table):
        scorer = _Scorer(table, digits)
        wanted = table.column("wanted").to_pylist()
        keys = {}
        for c in ("dense", "sparse"):
            for q, rows in enumerate(wanted):
                own = sorted((-w["score"], w["id"]) for w in rows if w["channel"] == c)
                keys[c, q] = np.array([s for s, _ in own]), np.array([i for _, i in own], np.int64)
        counts = {k: np.zeros(len(ids) + 1, np.int64) for k, (_, ids) in keys.items()}

        def add(batch: pa.RecordBatch) -> None:
            for found, dense, sparse in scorer.parts(batch):
                for c, scores in (("dense", dense), ("sparse", sparse)):
                    for q in range(len(scorer.ids)):
                        if len(keys[c, q][0]):
                            counts[c, q] += np.bincount(_stands(-scores[q], found, *keys[c, q]), minlength=len(counts[c, q]))

        def told() -> pa.RecordBatch:
            out = [(int(scorer.ids[q]), int(i), c, int(n)) for (c, q), (_, ids) in keys.items() for i, n in zip(ids, np.cumsum(counts[c, q][:-1]))]
            columns = list(zip(*out)) if out else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64()))], ["query_id", "id", "channel", "before"])

        return add, told

    counted = meet(asked.select("query_id", *_VECTORS, "wanted"), corpus.select("id", *_VECTORS), work, "query_id long, id long, channel string, before long")
    return counted.groupBy("query_id", "id", "channel").agg((F.sum("before") + 1).alias("place"))


def _channels() -> Column:
    return F.concat_ws(",", F.when(F.col("dense") > 0, "dense"), F.when(F.col("sparse") > 0, "sparse")).alias("channels")


def weighted(queries: DataFrame, corpus: DataFrame, k: int, weights: tuple[float, float] = (0.6, 0.4), digits: int = 9) -> DataFrame:
    """(query_id, id, score, channels, rank): the ``k`` rows with the largest weighted sum of both cosines, over all rows; ties go to the smaller id.

    The sum is taken before any cut, so a row that is first in neither channel is not missed. Negative scores do not occur.
    """
    found = _search(queries, corpus, lambda dense, sparse: [("both", np.round(weights[0] * dense + weights[1] * sparse, digits))], k, digits)
    score = F.round(weights[0] * F.col("dense") + weights[1] * F.col("sparse"), digits)
    rows = found.select("query_id", "id", score.alias("score"), _channels())
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return rows.withColumn("rank", place).where(F.col("rank") <= k)


def reciprocal(queries: DataFrame, corpus: DataFrame, k: int, constant: int = 60, digits: int = 9) -> DataFrame:
    """(query_id, id, score, channels, rank): the ``k`` best by the sum of 1 / (constant + position) over both channels.

    Positions count all rows with a score above 0 in a channel, without a cut, yet neither all pairs are listed nor is
    any query's whole list put in order. With ``depth = constant + 2 k`` a row that is among the first ``depth`` of
    neither channel has at most 2 / (constant + depth + 1), less than 1 / (constant + k), which ``k`` rows of one
    channel have; a channel of fewer rows is listed whole. So the first ``depth`` of each channel hold the answer, and
    only what one of them lacks of a row, its position in the other channel, is counted in a second pass.
    """
    depth = constant + 2 * k
    only = lambda x: np.where(x > 0, x, -np.inf)
    found = _search(queries, corpus, lambda dense, sparse: [("dense", only(dense)), ("sparse", only(sparse))], depth, digits)
    place = lambda c: F.row_number().over(Window.partitionBy("query_id", "list").orderBy(F.desc(c), "id"))
    listed = found.withColumn("place", F.when(F.col("list") == "dense", place("dense")).otherwise(place("sparse"))).where(F.col("place") <= depth)
    of = lambda c: F.max(F.when(F.col("list") == c, F.col("place"))).alias(c[0])
    rows = stored(listed.groupBy("query_id", "id").agg(F.first("dense").alias("dense"), F.first("sparse").alias("sparse"), of("dense"), of("sparse")))
    lacking = [F.when((F.col(c) > 0) & F.col(c[0]).isNull(), F.struct(F.lit(c).alias("channel"), F.col(c).alias("score"), "id")) for c in ("dense", "sparse")]
    asked = rows.select("query_id", F.explode(F.filter(F.array(*lacking), lambda x: x.isNotNull())).alias("x")).groupBy("query_id").agg(F.collect_list("x").alias("wanted"))
    counted = _places(queries.join(asked, "query_id"), corpus, digits)
    known = counted.groupBy("query_id", "id").agg(*[F.max(F.when(F.col("channel") == c, F.col("place"))).alias(f"{c[0]}2") for c in ("dense", "sparse")])
    part = lambda c: F.coalesce(1 / (F.coalesce(F.col(c), F.col(f"{c}2")) + constant), F.lit(0.0))
    fused = rows.join(known, ["query_id", "id"], "left").select("query_id", "id", F.round(part("d") + part("s"), digits).alias("score"), _channels())
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
