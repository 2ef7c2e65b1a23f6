"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into passages of 64 words. A distributed randomised SVD of the TF-IDF matrix of all passages gives
a latent space: every task multiplies its passages with a random matrix and back (one pass; only vocabulary-by-rank
sums meet, never passages). Benchmark items and sliding windows of documents are folded into that space; windows near
an item by cosine (by words alone, where most of an item's words stand in a tenth of all passages) are compared with it by longest common subsequence of words, and those that match only in part
must also contain the item's answer (its last words, unless a column names it), so that paraphrases are kept apart
from texts of the same subject.

Windows that cannot reach the least match are passed over first: a match shares at least half of an item's uncommon
words, so a window with fewer of the benchmark's uncommon words than that needs no further look.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from weftline.llm.common import materialise, slices, summed_arrays, word_hashes

#: Words of a passage; rank and oversampling of the SVD; hashed terms besides the benchmark's own words.
PASSAGE, RANK, MORE, HASHED = 64, 24, 8, 1 << 14
#: Probes that are searched for at a time; terms, weights and the latent space are fitted once, for all.
BLOCK_PROBES = 1024
#: Words of the benchmark that have terms of their own; what a larger benchmark has besides shares the hashed ones.
MOST_WORDS = 1 << 18
#: Cosines that are worked out at a time.
COSINES = 1 << 21
#: Window lengths and their step, in words.
WINDOWS, STEP = (16, 32, 64), 8
#: Words of an item that count as uncommon at least; least share of its words with a weight for which the cosine tells anything.
FEW, TOLD = 4, 0.25
#: Least cosine of a candidate; LCS share that is enough alone, or together with the answer; share of the answer and of uncommon words.
COSINE, ENOUGH, LEAST, ANSWER = 0.4, 0.8, 0.6, 0.5

_SLICE = 256
_FOUND = "doc_id long, item_id long, lcs_share double, cosine double, answer_share double, word long"


@dataclass
class Vocabulary:
    """Numbers of terms: the benchmark's words (sorted hashes) have their own, others share ``HASHED`` slots after them."""

    own: np.ndarray

    @property
    def size(self) -> int:
        return len(self.own) + HASHED

    def of(self, words: np.ndarray) -> np.ndarray:
        """The terms of hashed words."""
        out = len(self.own) + (words >> np.uint64(40)).astype(np.int64) % HASHED
        maybe = np.zeros(1 << 16, bool)
        maybe[self.own & np.uint64(0xFFFF)] = True
        at = np.flatnonzero(maybe[words & np.uint64(0xFFFF)])
        place = np.minimum(np.searchsorted(self.own, words[at]), max(0, len(self.own) - 1))
        same = self.own[place] == words[at] if len(self.own) else np.zeros(len(at), bool)
        out[at[same]] = place[same]
        return out

    @property
    def dtype(self) -> str:
        return "<u2" if self.size < 1 << 16 else "<u4"


@dataclass
class Probe:
    """A benchmark item, or a part of a long one, as terms."""

    item: int
    terms: list[int]
    answer: list[int]
    window: int


def probes_of(rows: list, vocabulary: Vocabulary) -> list[Probe]:
    """Items of under 96 words are one probe, longer ones a probe for each 64 words and for the last 64; items without words none."""
    terms = lambda text: vocabulary.of(word_hashes([text], marks=False)[0]).tolist()
    out = []
    for item, text, answer in rows:
        words, told = terms(text), terms(answer)
        parts = [words] if len(words) < 96 else [words[i : i + PASSAGE] for i in [*range(0, len(words) - PASSAGE, PASSAGE), len(words) - PASSAGE]]
        out += [Probe(item, p, told or p[-max(3, len(p) // 5) :], min(WINDOWS, key=lambda s: abs(np.log(s / len(p))))) for p in parts if p]
    return out


def lcs(masks: dict[int, int], size: int, terms) -> int:
    """Length of the longest common subsequence of ``terms`` and the sequence that ``masks`` has the places of, bit-parallel."""
    full = (1 << size) - 1
    s = full
    for t in terms:
        if m := masks.get(t):
            u = s & m
            s = ((s + u) | (s - u)) & full
    return size - s.bit_count()


def masks_of(terms: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, t in enumerate(terms):
        out[t] = out.get(t, 0) | 1 << i
    return out


def _tokenised(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(id, text) to (id, terms binary)."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value
        for batch in batches:
            for part in slices(batch, 1):
                words, bounds = word_hashes(part.column(1).to_pylist(), marks=False)
                terms = vocabulary.of(words).astype(vocabulary.dtype)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in np.split(terms, bounds[1:-1])], pa.binary())], ["id", "terms"])

    return docs.mapInArrow(run, "id long, terms binary")


def _pieces(batch: pa.RecordBatch, dtype: str, rows: int = 256) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Ids, joined terms and bounds of a few documents at a time."""
    for part in slices(batch, 1, rows):
        raw = part.column(1).to_pylist()
        sizes = np.array([len(r) for r in raw]) // np.dtype(dtype).itemsize
        yield part.column(0).to_pylist(), np.frombuffer(b"".join(raw), dtype).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])


def _passages(terms: np.ndarray, bounds: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Passage, term and count of each distinct pair, and the number of passages."""
    sizes = np.diff(bounds)
    many = -(-sizes // PASSAGE)
    first = np.cumsum(many) - many
    doc = np.repeat(np.arange(len(sizes)), sizes)
    passage = first[doc] + (np.arange(len(terms)) - bounds[doc]) // PASSAGE
    key, count = np.unique(passage * n_terms + terms, return_counts=True)
    return key // n_terms, key % n_terms, count, int(many.sum())


def _document_frequency(tokens: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """Passages that hold each term, and behind them the number of passages."""
    size, dtype = vocabulary.size, vocabulary.dtype

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size + 1, np.int64)
        for batch in batches:
            for _, terms, bounds in _pieces(batch, dtype):
                _, t, _, n = _passages(terms, bounds, size)
                df[:-1] += np.bincount(t, minlength=size)
                df[-1] += n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["term", "n"])

    out = np.zeros(size + 1)
    for term, n in tokens.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).toPandas().itertuples(index=False):
        out[term] = n
    return out


def _weighted(terms, bounds, idf, size):
    """Passage, term and weight of each pair that counts, rows of unit length."""
    p, t, count, n = _passages(terms, bounds, size)
    w = count * idf[t]
    on = w > 0
    p, t, w = p[on], t[on], w[on]
    norm = np.sqrt(np.bincount(p, w * w, n))
    return p, t, (w / norm[p]).astype(np.float32)


def _times(p, t, w, matrix) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the product of the passages with ``matrix``, and the place of each pair's row."""
    start = np.flatnonzero(np.diff(p, prepend=-1))
    row = np.cumsum(np.diff(p, prepend=-1) != 0) - 1
    return np.add.reduceat(matrix[t] * w[:, None], start, axis=0), row


def _latent(tokens: DataFrame, vocabulary: Vocabulary, idf: np.ndarray) -> np.ndarray:
    """Terms by rank: the leading right singular vectors of the passages, by a randomised one-pass sketch."""
    spark, size, dtype, width = tokens.sparkSession, vocabulary.size, vocabulary.dtype, RANK + MORE
    start = np.random.default_rng(10).standard_normal((size, width)).astype(np.float32)
    sent_idf, sent = spark.sparkContext.broadcast(idf), spark.sparkContext.broadcast(start)
    many = tokens.rdd.getNumPartitions()

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        omega, weights = sent.value, sent_idf.value
        total = np.zeros((size, width), np.float32)
        for batch in batches:
            for _, terms, bounds in _pieces(batch, dtype):
                p, t, w = _weighted(terms, bounds, weights, size)
                if not len(p):
                    continue
                y, row = _times(p, t, w, omega)
                order = np.argsort(t, kind="stable")
                first = np.flatnonzero(np.diff(t[order], prepend=-1))
                total[t[order][first]] += np.add.reduceat(y[row[order]] * w[order, None], first, axis=0)
        part = TaskContext.get().partitionId()
        for at in range(0, size, _SLICE):
            if (data := total[at : at + _SLICE]).any():
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([part]), pa.array([data.astype(np.float64).tobytes()], pa.binary())], ["slice", "part", "data"])

    z = np.zeros((size, width))
    for at, data in summed_arrays(tokens.mapInArrow(back, "slice long, part long, data binary"), many, np.float64).items():
        z[at : at + _SLICE] = data.reshape(-1, width)
    # Nystrom: with C the passages' Gram matrix and Z = C Omega known, C is about Z (Omega' Z)^+ Z'; no second pass.
    shift = 1e-6 * np.linalg.norm(z)
    z = z + shift * start
    core = start.T.astype(np.float64) @ z
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > max(1e-12, 1e-10 * values[-1])
    if not good.any():
        return np.zeros((size, RANK), np.float32)
    u, _, _ = np.linalg.svd(z @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    out = np.zeros((size, RANK), np.float32)
    out[:, : min(RANK, u.shape[1])] = u[:, :RANK]
    return out


def _search(tokens: DataFrame, vocabulary: Vocabulary, probes: list[Probe], df: np.ndarray, idf: np.ndarray, space: np.ndarray, rare: np.ndarray) -> DataFrame:
    spark, dtype, size = tokens.sparkSession, vocabulary.dtype, vocabulary.size
    folded = np.vstack([space * idf[:, None].astype(np.float32), np.zeros((1, RANK), np.float32)])
    unit = lambda v: v / np.maximum(1e-12, np.linalg.norm(v, axis=-1, keepdims=True))
    vectors = np.array([unit(folded[p.terms].sum(axis=0)) for p in probes])
    # An item of common words alone is known by its least common ones. Terms of its own or shared ones: both sides count alike.
    known_by = [{t for t in p.terms if rare[t]} if sum(rare[t] for t in p.terms) >= FEW else {*sorted(set(p.terms), key=lambda t: (df[t], t))[:FEW], *(t for t in p.terms if rare[t])} for p in probes]
    uncommon = [sum(t in own for t in p.terms) for p, own in zip(probes, known_by)]
    asked = np.zeros(size, bool)
    asked[sorted(set().union(*known_by))] = True
    # Which terms a probe is known by, as sorted keys (probe, term).
    keys = np.sort(np.concatenate([k * (size + 1) + np.array(sorted(own), np.int64) for k, own in enumerate(known_by)]))
    plain = np.array([sum(idf[t] > 0 for t in p.terms) < max(FEW, TOLD * len(p.terms)) for p in probes])
    by_window = {s: np.array([k for k, p in enumerate(probes) if p.window == s], np.int64) for s in WINDOWS}
    need = {s: np.array([ANSWER * uncommon[k] for k in ks]) for s, ks in by_window.items()}
    gate = {s: max(1, int(ANSWER * min(uncommon[k] for k in ks))) for s, ks in by_window.items() if len(ks)}
    sent = spark.sparkContext.broadcast((folded, vectors, [(p, masks_of(p.terms), masks_of(p.answer)) for p in probes], asked, known_by, keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folded, vectors, held, asked, known_by, keys = sent.value
        none = len(folded) - 1

        def shared(probe: np.ndarray, shown: np.ndarray) -> np.ndarray:
            """How many of each row of terms the probe is known by."""
            wanted = probe[:, None] * (size + 1) + shown
            return (keys[np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)] == wanted).sum(axis=1)

        for batch in batches:
            found: dict[tuple[int, int], tuple] = {}
            ids, numbers, base = batch.column(0).to_pylist(), batch.column(2).to_pylist(), 0
            for some, terms, bounds in _pieces(batch, dtype):
                in_own = np.concatenate([[0], np.cumsum(asked[terms])])
                sizes = np.diff(bounds)
                steps = -(-sizes // STEP)
                doc = np.repeat(np.arange(len(sizes)), steps)
                begin = bounds[doc] + STEP * (np.arange(len(doc)) - np.repeat(np.cumsum(steps) - steps, steps))
                for s, least in gate.items():
                    ks = by_window[s]
                    end = np.minimum(begin + s, bounds[doc + 1])
                    on = np.flatnonzero(in_own[end] - in_own[begin] >= least)
                    step = min(2048, max(1, COSINES // len(ks)))
                    for at in range(0, len(on), step):
                        few = on[at : at + step]
                        place = begin[few, None] + np.arange(s)
                        shown = np.where(place < end[few, None], terms[np.minimum(place, len(terms) - 1)], none)
                        cosine = unit(folded[shown].sum(axis=1)) @ vectors[ks].T
                        hits = in_own[end[few]] - in_own[begin[few]]
                        # Items of words that are everywhere have no direction; their windows are chosen by words alone.
                        pair_i, pair_k = np.nonzero(((cosine >= COSINE) | plain[ks]) & (hits[:, None] >= need[s]))
                        both = np.zeros(len(pair_i), bool)
                        for x in range(0, len(pair_i), 1 << 14):
                            i, k = pair_i[x : x + (1 << 14)], pair_k[x : x + (1 << 14)]
                            both[x : x + (1 << 14)] = shared(ks[k], shown[i]) >= need[s][k]
                        for i, k in zip(pair_i[both], pair_k[both]):
                            w, probe = few[i], ks[k]
                            p, places, answer = held[probe]
                            near = terms[max(bounds[doc[w]], begin[w] - s // 2) : min(bounds[doc[w] + 1], begin[w] + s + s // 2)].tolist()
                            share = lcs(places, len(p.terms), near) / len(p.terms)
                            if share < LEAST or len(known_by[probe].intersection(near)) < ANSWER * len(known_by[probe]):
                                continue
                            told = lcs(answer, len(p.answer), near) / max(1, len(p.answer))
                            if share < ENOUGH and told < ANSWER:
                                continue
                            key = (base + int(doc[w]), p.item)
                            if key not in found or found[key][0] < share:
                                found[key] = (share, float(cosine[i, k]), told, int(begin[w] - bounds[doc[w]]))
                base += len(some)
            rows = [(numbers[d], ids[d], item, *x) for (d, item), x in found.items()]
            columns = list(zip(*rows)) if rows else [[]] * 7
            types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["row", "doc_id", "item_id", "lcs_share", "cosine", "answer_share", "word"])

    return tokens.mapInArrow(run, f"row long, {_FOUND}")


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", answer: str | None = None) -> DataFrame:
    """(doc_id, item_id, lcs_share, cosine, answer_share, word): a row for each document and item found in it.

    ``word`` is where the best window begins. Null and empty documents hold nothing; null and empty items are found
    nowhere; with an empty benchmark or no documents the result is empty. Repeated documents are each reported, those
    without an id under null, equal items each under their own id, an item of several rows or texts once, with its best window. Terms, weights
    and the latent space are fitted once; items are then searched for in blocks of about ``BLOCK_PROBES`` probes (an
    item is never cut), so what is sent to the tasks is bounded and an item fares alike in every block; each block
    costs a run over the terms. Words of a benchmark beyond ``MOST_WORDS`` share hashed terms, which count as words in
    the item and in the documents, so items of such words are found too. Other columns are not looked at.
    """
    spark = docs.sparkSession
    corpus = docs.select(F.col(f"`{doc_id}`").cast(LongType()).alias("id"), F.col(f"`{text}`").alias("text"))
    items = benchmark.select(F.col(f"`{item_id}`").cast(LongType()).alias("id"), F.col(f"`{item_text}`").alias("text"), (F.col(f"`{answer}`") if answer else F.lit(None).cast("string")).alias("answer"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(word_hashes(batch.column(0).to_pylist(), marks=False)[0]).view(np.int64))], ["w"])

    said = items.select("text").mapInArrow(words, "w long").distinct()
    if said.isEmpty():
        return spark.createDataFrame([], _FOUND)
    own = said.orderBy("w").limit(MOST_WORDS).toPandas()["w"]
    vocabulary = Vocabulary(np.sort(own.to_numpy(dtype=np.int64).view(np.uint64)))
    # Rows have a number of their own, fixed by being written: ids may be null or repeated.
    tokens = materialise(_tokenised(corpus, vocabulary).withColumn("row", F.monotonically_increasing_id()))
    df = _document_frequency(tokens, vocabulary)
    n = max(1.0, df[-1])
    idf = np.where(df[:-1] > 0.1 * n, 0.0, np.log((n + 1) / (df[:-1] + 1)))
    rare = df[:-1] <= max(1.0, 0.01 * n)
    space = _latent(tokens, vocabulary, np.where(df[:-1] > 0, idf, 0.0))
    numbered = materialise(items.where("text IS NOT NULL").dropDuplicates().withColumn("nth", F.monotonically_increasing_id()))
    many = numbered.agg(F.coalesce(F.sum(F.ceil(F.size(F.split("text", r"\s+")) / PASSAGE)), F.lit(0))).first()[0]
    n_blocks = max(1, -(-int(many) // BLOCK_PROBES))
    found = None
    for block in range(n_blocks):
        part = numbered.where(F.pmod(F.xxhash64("nth"), F.lit(n_blocks)) == block).select("id", "text", "answer")
        probes = probes_of([tuple(r) for r in part.collect()], vocabulary)
        if probes:
            one = _search(tokens, vocabulary, probes, df[:-1], idf, space, rare)
            found = one if found is None else found.union(one)
    if found is None:
        return spark.createDataFrame([], _FOUND)
    # Texts that share an item's id may have been searched for in several blocks.
    best = found.groupBy("row", "doc_id", "item_id").agg(F.max(F.struct("lcs_share", "cosine", "answer_share", (-F.col("word")).alias("word"))).alias("x"))
    return best.select("doc_id", "item_id", "x.lcs_share", "x.cosine", "x.answer_share", (-F.col("x.word")).alias("word"))
