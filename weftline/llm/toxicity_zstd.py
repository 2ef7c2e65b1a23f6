"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text.

Both dictionaries hold words and beginnings of words: those of ordinary text that most documents share, and for the toxic one, besides, those
that toxic training documents hold far more often than ordinary ones. A document is cut into windows of words; each
is compressed with either dictionary, and the bytes that the toxic one saves are its evidence. As both share their
ordinary part, ordinary words cost the same with either, and a window's difference is near zero without toxic words.
A logistic regression on the largest savings and their sums, fitted on the training fold, turns a document's windows
into a calibrated probability.

The fit uses a bounded sample of labelled documents (``FIT_TOXIC``, ``FIT_ORDINARY``); copies in it count once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import bounded_sample, labelled_texts, map_texts, usable_labels

#: Most labelled documents of each kind in the fit.
FIT_TOXIC, FIT_ORDINARY = 6_000, 12_000
#: Words of a window; bytes of the ordinary and of the toxic part; standard score that a word of the toxic part
#: needs: 0.3 times the root of the toxic documents, within these bounds.
WINDOW, ORDINARY_BYTES, TOXIC_BYTES, LEAST_Z = 16, 60_000, 12_000, (7.0, 12.0)
#: Besides whole words, their beginnings of so many characters can be in a dictionary.
PREFIXES = (5, 7)
#: Match finder: short matches count, as one word is what matters.
_FINDER = dict(strategy=zstandard.STRATEGY_LAZY2, min_match=4, search_log=4, window_log=17, hash_log=16, chain_log=16, target_length=16)

FEATURES = ("largest", "second", "third", "strong", "sum", "log_windows", "per_window")


@dataclass
class Model:
    """The two dictionaries and the calibration."""

    ordinary: bytes = b""
    toxic: bytes = b""
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES) + 1))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES)))
    scale: np.ndarray = field(default_factory=lambda: np.ones(len(FEATURES)))

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale @ self.weights[1:] + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Compressors:
    """Compressed lengths with either dictionary."""

    def __init__(self, model: Model) -> None:
        self.by = [self._of(model.ordinary), self._of(model.toxic + model.ordinary)] if model.toxic and model.ordinary else None

    @staticmethod
    def _of(content: bytes):
        params = zstandard.ZstdCompressionParameters(write_content_size=False, write_checksum=False, write_dict_id=False, **_FINDER)
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(compression_params=params)
        return zstandard.ZstdCompressor(compression_params=params, dict_data=held).compress

    def savings(self, text: str | None) -> np.ndarray:
        """The bytes that the toxic dictionary saves in each window of the text."""
        words = (text or "").lower().split()
        if not words or not self.by:
            return np.zeros(1)
        ordinary, toxic = self.by
        windows = [" ".join(["", *words[i : i + WINDOW]]).encode("utf-8", "surrogatepass") for i in range(0, len(words), WINDOW)]
        return np.array([len(ordinary(w)) - len(toxic(w)) for w in windows], dtype=np.float64)


def features_of(savings: np.ndarray) -> list[float]:
    top = np.sort(savings)[::-1]
    strong = savings[savings >= 3]
    return [*np.append(top[:3], np.zeros(max(0, 3 - len(top)))), float(len(strong)), float(strong.sum()), float(np.log1p(len(savings))), float(strong.sum() / len(savings))]


def dictionaries(words: list[tuple[str, int, int]], n_toxic: int, n_ordinary: int) -> tuple[bytes, bytes]:
    """Contents of the ordinary and the toxic part, from (word, toxic documents, ordinary documents); likelier words last, where matches are cheapest."""
    n = n_toxic + n_ordinary
    least_z = float(np.clip(0.3 * np.sqrt(n_toxic), *LEAST_Z))
    scored = []
    for word, t, o in words:
        expected = n_toxic * (t + o) / n
        scored.append(((t - expected) / np.sqrt(max(1e-9, expected * n_ordinary / n)), word, t, o))

    def fill(chosen, room: int) -> bytes:
        parts, size = [], 0
        for word in chosen:
            part = f" {word}".encode("utf-8", "surrogatepass")
            if size + len(part) > room:
                break
            parts.append(part)
            size += len(part)
        return b"".join(reversed(parts))

    toxic = [w for z, w, t, o in sorted(scored, reverse=True) if z >= least_z and t * n_ordinary > 8 * o * n_toxic]
    ordinary = [w for o, w in sorted(((o, w) for z, w, t, o in scored if o and z < least_z), reverse=True)]
    return fill(ordinary, ORDINARY_BYTES), fill(toxic, TOXIC_BYTES)


def calibrate(model: Model, x: np.ndarray, y: np.ndarray, rounds: int = 30) -> None:
    """Fit the regression by Newton steps; with one label only, the score is constant."""
    share = (y.sum() + 1) / (len(y) + 2)
    model.weights[0] = np.log(share / (1 - share))
    if not len(y) or y.min() == y.max():
        return
    model.mean, model.scale = x.mean(axis=0), np.maximum(1e-6, x.std(axis=0))
    a = np.hstack([np.ones((len(x), 1)), (x - model.mean) / model.scale])
    w = model.weights.copy()
    ridge = np.array([1e-6, *[1.0] * x.shape[1]])

    def loss(v: np.ndarray) -> float:
        z = a @ v
        return float(np.logaddexp(0, z).sum() - y @ z + (ridge * v * v).sum() / 2)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + np.diag(ridge + 1e-9), a.T @ (y - p) - ridge * w)
        size, now = 1.0, loss(w)
        while size > 1e-6 and not loss(w + size * step) < now:
            size /= 2
        if size <= 1e-6:
            break
        w = w + size * step
    model.weights = w


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text") -> Model:
    """Fit outside the held-out fold, on at most about ``FIT_TOXIC`` and ``FIT_ORDINARY`` documents.

    Rows without an id or a label of 0 or 1 take no part; of several labels of an id the larger counts, of several texts
    one, so no id, however many rows it has, brings more than one to the driver.
    """
    spark = docs.sparkSession
    usable = usable_labels(labels, label, doc_id)
    sample = bounded_sample(usable.where("y = 1"), "id", FIT_TOXIC).union(bounded_sample(usable.where("y = 0"), "id", FIT_ORDINARY))
    held = labelled_texts(docs, sample, doc_id, text).groupBy(F.xxhash64("text").alias("h"), "y").agg(F.min_by("text", "id").alias("text"), F.min("id").alias("id"))
    held = held.persist()
    n = {r["y"]: r["count"] for r in held.groupBy("y").count().collect()}
    model = Model()
    if n.get(1) and n.get(0):
        split = F.split(F.lower("text"), r"\s+")
        parts = F.flatten(F.array(split, *[F.transform(F.filter(split, lambda w: F.length(w) > n), lambda w: F.substring(w, 1, n)) for n in PREFIXES]))
        words = held.select("y", F.explode(F.array_distinct(parts)).alias("w")).where("w != ''")
        counted = words.groupBy("w").agg(F.count_if(F.col("y") == 1).alias("t"), F.count_if(F.col("y") == 0).alias("o"))
        # What can be in a dictionary: the commonest ordinary words, and those that toxic documents repeat.
        common = counted.orderBy(F.desc("o"), "w").limit(30_000)
        marked = counted.where("t >= 3").orderBy(F.desc(F.col("t") / (F.col("o") + 1)), "w").limit(30_000)
        rows = {(r["w"], r["t"], r["o"]) for r in common.union(marked).collect()}
        model.ordinary, model.toxic = dictionaries(sorted(rows), n[1], n[0])
    sent = spark.sparkContext.broadcast(model)

    def measure():
        own = Compressors(sent.value)
        return lambda texts: [[features_of(own.savings(t)) for t in texts]]

    got = map_texts(held, "text", measure, "x array<double>", ["id", "y"]).toPandas().sort_values(["id", "y"], kind="stable")
    held.unpersist()
    x = np.vstack(got["x"].to_numpy()) if len(got) else np.zeros((0, len(FEATURES)))
    calibrate(model, x, got["y"].to_numpy(dtype=np.float64))
    return model


def score(df: DataFrame, text: str, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with ``score``, between 0 and 1, and ``saved`` (array: bytes saved in each window).

    Every row gets a score from its whole text; null and empty texts have one window without savings. Columns named
    like the new ones are replaced.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    def make():
        own = Compressors(sent.value)

        def work(texts: list) -> list:
            saved = [own.savings(t) for t in texts]
            x = np.array([features_of(s) for s in saved]).reshape(-1, len(FEATURES))
            return [pa.array(sent.value.score(x)), [s.astype(np.int32) for s in saved]]

        return work

    return map_texts(df, text, make, "score double, saved array<int>", keep)
