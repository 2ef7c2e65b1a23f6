"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees on one feature at a time, boosted in turn over the features (so that correlated features share what
they explain), add up to one lookup table a feature; then trees on pairs of features, chosen by how much they lower
the remaining loss, add up to one grid a pair. A score is the logistic of the sum of the looked-up values, taken for
whole Arrow batches at once. The fit works on a bounded sample of labelled rows (``FIT_ROWS``), features only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import bounded_sample, labelled_texts, map_texts, usable_labels

#: Most labelled rows that a fit uses; beyond, a sample by a hash of the id.
FIT_ROWS = 20_000

FEATURES = ("log_bytes", "log_words", "word_length", "upper_share", "digit_share", "space_share", "mark_share", "stop_share", "pipe_share", "odd_share", "distinct_words", "top_word", "repeat_next", "distinct_pairs", "distinct_lines", "log_line_words")

_CLASS = np.zeros(256, dtype=np.int8)
_CLASS[[*range(0x41, 0x5B)]] = 1
_CLASS[[*range(0x61, 0x7B)]] = 2
_CLASS[[*range(0x30, 0x3A)]] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[[ord(c) for c in "!?*#$%&@^~+=<>\\/_"]] = 5
_CLASS[[ord(c) for c in ".,;:'\"()-"]] = 6
_CLASS[[ord(c) for c in "|{}[]`"]] = 7
_CLASS[[*range(0x80, 0x100)]] = 8


def features_of(text: str | None) -> list[float]:
    """The features of one whole text, in the order of ``FEATURES``; all defined for an empty one."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    words, n_bytes = text.split(), max(1, len(raw))
    by = np.bincount(_CLASS[raw], minlength=9) / n_bytes
    n = len(words)
    if n:
        at = dict(zip(words, range(n)))
        codes = np.fromiter(map(at.__getitem__, words), dtype=np.int64, count=n)
        distinct, top = len(at) / n, np.bincount(codes).max() / n
        again = float((codes[1:] == codes[:-1]).mean()) if n > 1 else 0.0
        pairs = len(np.unique(codes[1:] * n + codes[:-1])) / (n - 1) if n > 1 else 1.0
    else:
        distinct, top, again, pairs = 1.0, 0.0, 0.0, 1.0
    lines = [x for x in text.split("\n") if x.strip()]
    return [np.log1p(len(raw)), np.log1p(n), len(raw) / max(1, n) if n else 0.0, by[1] / max(1e-9, by[1] + by[2]), by[3], by[4], by[5], by[6], by[7], by[0] + by[8], distinct, top, again, pairs, len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines)))]


@dataclass
class Additive:
    """A fitted model: cut points and a lookup table for each feature, a grid for each chosen pair."""

    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        bins = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)]
        for b, table in zip(bins, self.tables):
            z += table[b]
        for (i, j), grid in zip(self.pairs, self.grids):
            z += grid[self.coarse[i][bins[i]], self.coarse[j][bins[j]]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _best_cut(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, int]:
    """Gain and place of the cut of one row of bins that lowers the loss most."""
    cg, ch = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    rg, rh = g.sum() - cg, h.sum() - ch
    gain = np.where((ch > least) & (rh > least), cg**2 / (ch + 1) + rg**2 / (rh + 1), -np.inf)
    k = int(np.argmax(gain)) if len(gain) else 0
    return (float(gain[k]), k + 1) if len(gain) and np.isfinite(gain[k]) else (-np.inf, 0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int, least: float) -> np.ndarray:
    """A shallow tree over bins, as the value of every bin."""
    gain, k = _best_cut(g, h, least) if depth else (-np.inf, 0)
    if k and gain > g.sum() ** 2 / (h.sum() + 1) + 1e-6:
        return np.concatenate([_tree(g[:k], h[:k], depth - 1, least), _tree(g[k:], h[k:], depth - 1, least)])
    return np.full(len(g), g.sum() / (h.sum() + 1))


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 120, pair_rounds: int = 40, n_pairs: int = 6, rate: float = 0.1) -> Additive:
    """Fit to features ``x`` and labels ``y`` (0 or 1). Without rows of both labels the score is constant: the share of 1, or one half."""
    n = len(y)
    model = Additive()
    if n == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (n + 2)
        model.base = float(np.log(share / (1 - share)))
        return model
    least = max(1.0, 0.0005 * n)
    model.base = float(np.log(y.mean() / (1 - y.mean())))
    for j in range(x.shape[1]):
        model.cuts.append(np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])))
    code = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.cuts)]
    size = [len(c) + 1 for c in model.cuts]
    model.tables = [np.zeros(s) for s in size]
    z = np.full(n, model.base)
    for _ in range(rounds):
        for j, (b, s) in enumerate(zip(code, size)):
            p = 1 / (1 + np.exp(-z))
            step = rate * _tree(np.bincount(b, y - p, s), np.bincount(b, p * (1 - p), s), 2, least)
            model.tables[j] += step
            z += step[b]
    model.coarse = [np.minimum(np.arange(s) * 8 // s, 7) for s in size]
    rough = [m[b] for m, b in zip(model.coarse, code)]
    p = 1 / (1 + np.exp(-z))
    gains = []
    for i in range(len(code)):
        for j in range(i):
            g, h = (np.bincount(rough[i] * 8 + rough[j], v, 64) for v in (y - p, p * (1 - p)))
            gains.append((float((g**2 / (h + 1)).sum()), j, i))
    model.pairs = [(j, i) for _, j, i in sorted(gains, reverse=True)[:n_pairs]]
    model.grids = [np.zeros((8, 8)) for _ in model.pairs]
    for _ in range(pair_rounds):
        for k, (i, j) in enumerate(model.pairs):
            p, cell = 1 / (1 + np.exp(-z)), rough[i] * 8 + rough[j]
            g, h = (np.bincount(cell, v, 64).reshape(8, 8) for v in (y - p, p * (1 - p)))
            gain, cut = _best_cut(g.sum(1), h.sum(1), least)
            parts = [(0, cut), (cut, 8)] if cut else [(0, 8)]
            step = np.zeros((8, 8))
            for a, b in parts:
                step[a:b] = rate * _tree(g[a:b].sum(0), h[a:b].sum(0), 1, least)
            model.grids[k] += step
            z += step.ravel()[cell]
    for k, table in enumerate(model.tables):
        shift = float(table[code[k]].mean())
        model.tables[k] = table - shift
        model.base += shift
    return model


def with_features(df: DataFrame, text: str, keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with ``features`` (array of double), for every row, null and empty texts too."""
    return map_texts(df, text, lambda: lambda texts: [[features_of(t) for t in texts]], "features array<double>", keep)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", rows: int = FIT_ROWS) -> Additive:
    """Fit on at most about ``rows`` labelled documents outside the held-out fold.

    Rows without an id or a label of 0 or 1 take no part; of several labels of an id the larger counts, of several texts
    one, so no id, however many rows it has, brings more than one to the driver.
    """
    sample = bounded_sample(usable_labels(labels, label, doc_id), "id", rows)
    got = with_features(labelled_texts(docs, sample, doc_id, text), "text", ["id", "y"]).toPandas().sort_values("id", kind="stable")
    if got.empty:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    return fit(np.vstack(got["features"].to_numpy()), got["y"].to_numpy(dtype=np.float64))


def score(df: DataFrame, text: str, model: Additive, keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with ``score``, between 0 and 1, higher where label 1 is likelier.

    Every row gets one, null texts as empty ones, rows without an id too; a column named ``score`` is replaced.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    def make():
        return lambda texts: [pa.array(sent.value.score(np.array([features_of(t) for t in texts]).reshape(-1, len(FEATURES))))]

    return map_texts(df, text, make, "score double", keep)
