"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins; cyclic boosting gives every feature a lookup table, a
small tree of at most four leaves at a time, then the pairs of features with the most left
to explain get tables of two dimensions. A score is a sum of looked-up values.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, labelled_sample, small_batches, spans, tidy

BINS = 32
COARSE = 8

FEATURES = (
    "log_words", "bytes_per_word", "upper", "digit", "space", "newline", "comma_stop", "bang", "bar", "other_symbol", "high_byte",
    "distinct_words", "distinct_triples", "repeat_next", "top_word", "short_words", "long_words", "words_per_line", "distinct_lines", "stopped_lines", "word_entropy",
)

_CLASS = np.full(256, 7, dtype=np.int64)
_CLASS[65:91], _CLASS[48:58], _CLASS[128:], _CLASS[97:123] = 0, 1, 8, 9
_CLASS[[32, 9, 11, 12]], _CLASS[[10, 13]], _CLASS[[44, 46, 59, 58]], _CLASS[[33, 63]], _CLASS[124] = 2, 3, 4, 5, 6


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text; zeros for null, empty and wordless texts."""
    raw = texts.fill_null("")
    words = Words(raw, lower=False)
    out = np.zeros((len(raw), len(FEATURES)))
    size = words.end - words.start
    for i, text in enumerate(raw.to_pylist()):
        a, b = int(words.first[i]), int(words.first[i + 1])
        if a == b:
            continue
        own, n = words.hash[a:b], b - a
        data = text.encode()
        kind = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=10) / len(data)
        _, times = np.unique(own, return_counts=True)
        share = times / n
        triples = spans(own, 3)
        lines = [x for x in text.split("\n") if x]
        long = size[a:b]
        out[i] = (
            np.log1p(n), len(data) / n, kind[0], kind[1], kind[2], kind[3], kind[4], kind[5], kind[6], kind[7], kind[8],
            len(times) / n, len(np.unique(triples)) / max(1, len(triples)), (own[1:] == own[:-1]).sum() / n, share.max(), (long <= 2).sum() / n, (long >= 12).sum() / n,
            np.log1p(n / max(1, len(lines))), len(set(lines)) / max(1, len(lines)), sum(x.rstrip()[-1:] in (".", "!", "?") for x in lines) / max(1, len(lines)), -(share * np.log(share)).sum() / np.log(n + 1),
        )
    return out


@dataclass
class AdditiveModel:
    """``edges[j]`` cut feature j; ``tables[j]`` has a value for each bin; ``pairs`` hold
    (feature, feature, table) over coarse bins."""

    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    base: float = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1) if self.edges else np.zeros((len(x), 0), np.int64)

    def coarse(self, at: np.ndarray) -> np.ndarray:
        """Bins in COARSE cells or fewer; a feature of few values keeps a cell for each."""
        held = np.array([len(e) + 1 for e in self.edges], dtype=np.int64)
        return at * np.minimum(held, COARSE) // np.maximum(held, 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        at = self.bins(x)
        cell = self.coarse(at)
        total = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            total += table[at[:, j]]
        for i, j, table in self.pairs:
            total += table[cell[:, i], cell[:, j]]
        return 1 / (1 + np.exp(-total))


def _leaf(g: float, h: float, ridge: float) -> float:
    return g / (h + ridge)


def _split(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """(gain, first bin on the right) of the best cut; (0, 0) if no cut helps."""
    cg, ch = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    tg, th = g.sum(), h.sum()
    if not len(cg):
        return 0.0, 0
    gain = cg**2 / (ch + ridge) + (tg - cg) ** 2 / (th - ch + ridge) - tg**2 / (th + ridge)
    gain[(ch < 1e-9) | (th - ch < 1e-9)] = 0
    best = int(np.argmax(gain))
    return (float(gain[best]), best + 1) if gain[best] > 1e-9 else (0.0, 0)


def shallow_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """The values of a tree of depth two over bins with summed gradients g and curvatures h."""
    out = np.zeros(len(g))
    _, cut = _split(g, h, ridge)
    for lo, hi in ((0, cut), (cut, len(g))) if cut else ((0, len(g)),):
        _, second = _split(g[lo:hi], h[lo:hi], ridge)
        for a, b in ((lo, lo + second), (lo + second, hi)) if second else ((lo, hi),):
            out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum(), ridge)
    return out


def shallow_grid(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """(values, gain): one cut of the first feature, then one of the second on each side."""
    out, gain = np.zeros_like(g), 0.0
    _, cut = _split(g.sum(axis=1), h.sum(axis=1), ridge)
    for lo, hi in ((0, cut), (cut, len(g))) if cut else ((0, len(g)),):
        gs, hs = g[lo:hi].sum(axis=0), h[lo:hi].sum(axis=0)
        _, second = _split(gs, hs, ridge)
        for a, b in ((0, second), (second, len(gs))) if second else ((0, len(gs)),):
            out[lo:hi, a:b] = _leaf(gs[a:b].sum(), hs[a:b].sum(), ridge)
            gain += gs[a:b].sum() ** 2 / (hs[a:b].sum() + ridge)
    return out, gain


def fit_additive(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, n_pairs: int = 6, rate: float = 0.15, ridge: float = 5.0) -> AdditiveModel:
    """Cyclic boosting of one feature after the other, then of the strongest pairs."""
    if not len(y):
        return AdditiveModel()
    model = AdditiveModel(base=float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))))
    model.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    model.tables = [np.zeros(BINS) for _ in model.edges]
    at = model.bins(x)
    total = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(x.shape[1]):
            r, c = slopes()
            step = rate * shallow_tree(np.bincount(at[:, j], r, BINS), np.bincount(at[:, j], c, BINS), ridge)
            model.tables[j] += step
            total += step[at[:, j]]
    coarse = model.coarse(at)

    def grid(i: int, j: int, r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = coarse[:, i] * COARSE + coarse[:, j]
        return (np.bincount(cell, v, COARSE * COARSE).reshape(COARSE, COARSE) for v in (r, c))

    r, c = slopes()
    gains = sorted(((shallow_grid(*grid(i, j, r, c), ridge)[1], i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)
    model.pairs = [(i, j, np.zeros((COARSE, COARSE))) for _, i, j in gains[:n_pairs]]
    for _ in range(pair_rounds):
        for i, j, table in model.pairs:
            r, c = slopes()
            step = rate * shallow_grid(*grid(i, j, r, c), ridge)[0]
            table += step
            total += step[coarse[:, i], coarse[:, j]]
    return model


@tidy
def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "text"):
        x = features(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "label", "x"])


def fit_quality(docs: DataFrame, labels: DataFrame, column: str = "quality", limit: int = 20_000) -> AdditiveModel:
    """Fit on at most about ``limit`` labelled training rows; whole texts, of which only features
    reach the driver. Without labels every text scores the same 0.5."""
    sample = labelled_sample(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels, column, limit)
    rows = sample.mapInArrow(_features, "doc_id long, label double, x array<double>").toPandas().sort_values(["doc_id"], kind="stable")
    if not len(rows):
        return AdditiveModel()
    x = np.array(rows["x"].tolist())
    order = np.lexsort((*x.T[::-1], rows["doc_id"].to_numpy()))
    return fit_additive(x[order], rows["label"].to_numpy()[order])


@tidy
def _score(batches: Iterator[pa.RecordBatch], model: AdditiveModel, at: int) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, at):
        score = model.score(features(batch.column(at)))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=[*batch.schema.names, "score"])


def score_quality(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """``docs`` with score (0 to 1, higher is better), from ``text`` alone and all of it.

    Null, empty and wordless texts have features of zero and get the score that those
    give. A column score that ``docs`` has is replaced. Equal texts get equal scores.
    """
    docs = docs.drop("score")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(partial(_score, model=model, at=docs.columns.index("text")), f"{ddl}, score double")
