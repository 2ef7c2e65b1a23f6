"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, everything else is a gap between words; all n-grams of one to four characters, gaps at the
ends of words included, are hashed to buckets. Tasks count buckets by language, the counts are added up on the cluster,
and one matrix of log probabilities, whose size is bounded, is sent to the tasks, which add its rows over the n-grams
of a batch of documents at a time.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import map_texts, mix, slices, summed_arrays

#: Lengths of n-grams, most buckets, most numbers of the matrix (64 MB), most languages, added to every count.
GRAMS, MOST_BUCKETS, MATRIX, MOST_LANGUAGES, ALPHA = (1, 2, 3, 4), 1 << 16, 1 << 23, 1 << 14, 0.1
#: N-grams whose rows of the matrix are held at a time, over the number of languages; bucket counts that travel together.
CELLS, PIECE = 1 << 20, 1 << 12
#: What is predicted of a text without letters.
UNKNOWN = "und"

_GAP = 32


@dataclass
class Model:
    """Languages, the log of their shares of documents, and (bucket, language) log probabilities."""

    languages: list[str]
    prior: np.ndarray
    logs: np.ndarray


@cache
def _letters() -> np.ndarray:
    """For each code point its lower-case letter or mark, else the gap."""
    out = np.full(0x110000, _GAP, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if unicodedata.category(x)[0] in "LM":
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letters_of(text: str) -> np.ndarray:
    """Code points of the text's words in lower case, a single gap before, between and after them; empty, if there are no letters."""
    codes = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    codes = np.concatenate([[np.uint32(_GAP)], codes, [np.uint32(_GAP)]])
    kept = codes[(codes != _GAP) | np.concatenate([[True], codes[:-1] != _GAP])]
    return kept if len(kept) > 1 else kept[:0]


def buckets_of(codes: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """The bucket of each run of ``n`` codes."""
    if len(codes) < n:
        return np.zeros(0, np.int64)
    last = len(codes) - n + 1
    h = np.full(last, n, np.uint64)
    for i in range(n):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += codes[i : i + last]
    return (mix(h) >> np.uint64(32)).astype(np.int64) & (buckets - 1)


def _grams(texts: list[str | None], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all texts, text by text, and where each text's begin and end."""
    parts, sizes = [], []
    for t in texts:
        codes = letters_of(t or "")
        own = [buckets_of(codes, n, buckets) for n in GRAMS]
        parts += own
        sizes.append(sum(map(len, own)))
    return np.concatenate([np.zeros(0, np.int64), *parts]), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def train(docs: DataFrame, text: str = "text", lang: str = "lang", where=None) -> Model:
    """The model of the rows of ``docs`` with a text and a language, of those only that meet the condition ``where``.

    All of them are counted. A table without such rows gives a model without languages. The buckets are halved until
    buckets times languages is within ``MATRIX``; a column of over ``MOST_LANGUAGES`` values is an error.
    """
    rows = docs if where is None else docs.where(where)
    rows = rows.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    shares = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(shares) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} values in the language column")
    languages = sorted(shares)
    if not languages:
        return Model([], np.zeros(0), np.zeros((1, 0)))
    buckets = MOST_BUCKETS
    while buckets * len(languages) > MATRIX:
        buckets //= 2
    number = {x: i for i, x in enumerate(languages)}
    piece = min(PIECE, buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(languages) * buckets, np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                grams, bounds = _grams(part.column(0).to_pylist(), buckets)
                of = np.repeat(np.array([number[x] for x in part.column(1).to_pylist()], np.int64), np.diff(bounds))
                at, n = np.unique(of * buckets + grams, return_counts=True) if len(total) > MOST_BUCKETS * 8 else (slice(None), np.bincount(of * buckets + grams, minlength=len(total)))
                total[at] += n
        part = TaskContext.get().partitionId()
        for at in range(0, len(total), piece):
            if (data := total[at : at + piece]).any():
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([part]), pa.array([data.tobytes()], pa.binary())], ["slice", "part", "data"])

    counts = np.zeros(len(languages) * buckets, np.int64)
    for at, data in summed_arrays(rows.mapInArrow(count, "slice long, part long, data binary"), docs.rdd.getNumPartitions(), np.int64).items():
        counts[at : at + piece] = data
    counts = counts.reshape(len(languages), buckets)
    logs = np.log((counts + ALPHA) / (counts.sum(axis=1, keepdims=True) + ALPHA * buckets))
    have = np.array([shares[x] for x in languages], float)
    return Model(languages, np.log(have / have.sum()), np.ascontiguousarray(logs.T))


def likelihoods(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """For each text, whether it has letters, and the joint log probability of every language with its n-grams."""
    grams, bounds = _grams(texts, len(model.logs))
    out = np.tile(model.prior, (len(texts), 1))
    has = np.diff(bounds) > 0
    step = max(1, CELLS // max(1, len(model.languages)))
    for at in range(0, len(grams), step):
        to = min(at + step, len(grams))
        first, last = np.searchsorted(bounds, at, "right") - 1, np.searchsorted(bounds, to, "left")
        own = np.arange(first, last)
        own = own[has[own]]
        out[own] += np.add.reduceat(model.logs[grams[at:to]], np.maximum(bounds[own], at) - at, axis=0)
    return has, out


def predict(df: DataFrame, text: str, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with ``lang_pred``, the likeliest language, and ``score``, its posterior probability.

    Ties go to the language that is first by code points. A null text, one without letters and, where nothing was
    learnt, any text is ``und`` with score 0. Repeated rows are predicted alike; columns named like the new ones are
    replaced.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    def make():
        model = sent.value

        def work(texts: list[str | None]) -> list[list]:
            if not model.languages:
                return [[UNKNOWN] * len(texts), [0.0] * len(texts)]
            has, logs = likelihoods(texts, model)
            best = logs.argmax(axis=1)
            score = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
            return [[model.languages[b] if h else UNKNOWN for b, h in zip(best, has)], np.where(has, score, 0.0).tolist()]

        return work

    return map_texts(df, text, make, "lang_pred string, score double", keep)
