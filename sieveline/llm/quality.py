"""Quality scores by a generalised additive model with pairwise interactions (lookup tables over binned features)."""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc

#: What a score is made of, in this order; all are measured on the whole text.
FEATURES = (
    "log_words", "word_length", "upper_share", "digit_share", "stop_share", "comma_share", "symbol_share", "bar_share",
    "repeat_share", "unique_words", "short_words", "wide_share", "log_line", "same_lines", "noisy_lines", "shouted_lines",
)
#: Labelled documents the model is fitted on at most (expected number of a hash sample).
FIT_DOCS = 20_000
BINS = 32
ROUNDS = 150
PAIRS = 8
PAIR_ROUNDS = 60
RATE = 0.15
#: A document is predicted good from this score on.
THRESHOLD = 0.7

_OTHER, _LOWER, _UPPER, _DIGIT, _SPACE, _STOP, _COMMA, _BAR, _WIDE = range(9)
_CLASSES = np.full(256, _OTHER, np.uint8)
for _kind, _chars in ((_LOWER, bytes(range(97, 123))), (_UPPER, bytes(range(65, 91))), (_DIGIT, b"0123456789"), (_SPACE, b" \t\n\r\x0b\x0c"), (_STOP, b".!?"), (_COMMA, b",;:'\"()-"), (_BAR, b"|")):
    _CLASSES[list(_chars)] = _kind
_CLASSES[128:] = _WIDE
_WIDE_UPPER = re.compile("[À-ÖØ-Þ]")


def features(text: str | None) -> list[float]:
    """The features of one text; zeros for null, empty and blank texts."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    words = (text or "").split()
    if not words:
        return [0.0] * len(FEATURES)
    kinds = _CLASSES[data]
    n = np.bincount(kinds, minlength=9).astype(float)
    black = len(data) - n[_SPACE]
    letters = n[_LOWER] + n[_UPPER] + n[_WIDE]
    upper = n[_UPPER] + 2 * len(_WIDE_UPPER.findall(text))
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends + 1])
    starts = starts[starts < len(data)]
    sizes = np.diff(np.concatenate([starts, [len(data)]]))
    noisy = np.add.reduceat((kinds == _OTHER) | (kinds == _BAR) | (data == 33), starts)
    shouted = np.add.reduceat(kinds == _UPPER, starts)
    lines = [x for x in text.split("\n") if x]
    same = (data[1:] == data[:-1]) & (kinds[1:] != _SPACE)
    return [
        math.log(len(words)), black / len(words), upper / max(letters, 1), n[_DIGIT] / black, n[_STOP] / len(words), n[_COMMA] / len(words), n[_OTHER] / black, n[_BAR] / len(words),
        float(same.sum()) / black, len(set(words)) / len(words), sum(len(w) <= 3 for w in words) / len(words), n[_WIDE] / max(letters, 1), math.log(len(words) / max(len(lines), 1)),
        1 - len(set(lines)) / max(len(lines), 1), float(sizes[noisy * 20 > sizes].sum()) / len(data), float(sizes[shouted * 3 > sizes].sum()) / len(data),
    ]


@dataclass
class Gam:
    """edges[f] bins feature f; log odds = intercept + sum of tables[f][bin] + sum of pairs[i, j][bin_i, bin_j]."""

    edges: list[np.ndarray]
    intercept: float
    tables: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.intercept)
        for f, t in enumerate(self.tables):
            z += t[b[:, f]]
        for (i, j), t in self.pairs.items():
            z += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, least: float) -> np.ndarray:
    """Leaf values by bin of a tree with up to three cuts (depth two) fitted to gradient and hessian sums by bin."""

    def cut(lo: int, hi: int) -> int | None:
        cg, ch = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
        left_g, left_h = cg[:-1], ch[:-1]
        gain = left_g**2 / (left_h + 1) + (cg[-1] - left_g) ** 2 / (ch[-1] - left_h + 1) - cg[-1] ** 2 / (ch[-1] + 1)
        gain[(left_h < least) | (ch[-1] - left_h < least)] = -1
        return lo + int(gain.argmax()) + 1 if len(gain) and gain.max() > 1e-9 else None

    root = cut(0, len(g))
    bounds = sorted({0, len(g), *([root] if root else [])})
    for lo, hi in itertools.pairwise(list(bounds)):
        if root and (c := cut(lo, hi)):
            bounds.append(c)
    out = np.zeros(len(g))
    for lo, hi in itertools.pairwise(sorted(bounds)):
        out[lo:hi] = _leaf(g[lo:hi].sum(), h[lo:hi].sum())
    return out


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Values of the best tree with one cut on each of two features, and its gain; g and h are sums by pair of bins."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    tg, th = cg[-1, -1], ch[-1, -1]
    a, b = np.arange(g.shape[0] - 1), np.arange(g.shape[1] - 1)
    if not len(a) or not len(b):
        return np.zeros_like(g), 0.0
    qg = [cg[np.ix_(a, b)], cg[a, -1][:, None] - cg[np.ix_(a, b)], cg[-1, b][None, :] - cg[np.ix_(a, b)]]
    qh = [ch[np.ix_(a, b)], ch[a, -1][:, None] - ch[np.ix_(a, b)], ch[-1, b][None, :] - ch[np.ix_(a, b)]]
    qg.append(tg - sum(qg))
    qh.append(th - sum(qh))
    gain = sum(x**2 / (y + 1) for x, y in zip(qg, qh, strict=True)) - tg**2 / (th + 1)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    out = np.empty_like(g)
    for (rows, cols), x, y in zip(((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))), qg, qh, strict=True):
        out[rows, cols] = _leaf(x[i, j], y[i, j])
    return out, float(gain[i, j])


def fit_gam(x: np.ndarray, y: np.ndarray, bins: int = BINS, rounds: int = ROUNDS, pairs: int = PAIRS, pair_rounds: int = PAIR_ROUNDS, rate: float = RATE) -> Gam:
    """Boosts shallow trees feature by feature in a cycle, then on the `pairs` pairs whose crossed cuts help most.

    Without rows the model scores 0.5; with one class only, nearly that class everywhere.
    """
    width = x.shape[1]
    if not len(x):
        return Gam([np.empty(0)] * width, 0.0, [np.zeros(1)] * width, {})
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    share = (y.sum() + 1) / (len(y) + 2)
    model = Gam(edges, math.log(share / (1 - share)), [np.zeros(len(e) + 1) for e in edges], {})
    b = model.bins(x)
    z = np.full(len(x), model.intercept)
    least = max(1.0, 0.0005 * len(x))

    def gradients():
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f in range(width):
            g, h = gradients()
            size = len(model.tables[f])
            step = rate * _tree(np.bincount(b[:, f], g, size), np.bincount(b[:, f], h, size), least)
            model.tables[f] += step
            z += step[b[:, f]]

    def crossed(i: int, j: int) -> tuple[np.ndarray, float]:
        g, h = gradients()
        shape = len(model.tables[i]), len(model.tables[j])
        flat = b[:, i] * shape[1] + b[:, j]
        return _cross(np.bincount(flat, g, shape[0] * shape[1]).reshape(shape), np.bincount(flat, h, shape[0] * shape[1]).reshape(shape))

    ranked = sorted(itertools.combinations(range(width), 2), key=lambda p: -crossed(*p)[1])[:pairs]
    for i, j in ranked:
        model.pairs[i, j] = np.zeros((len(model.tables[i]), len(model.tables[j])))
    for _ in range(pair_rounds):
        for i, j in ranked:
            step = rate * crossed(i, j)[0]
            model.pairs[i, j] += step
            z += step[b[:, i], b[:, j]]
    return model


def _featured(docs: DataFrame, text_col: str, columns: list[str], model=None) -> DataFrame:
    """docs' columns and `score` by the model, or without one the features."""
    rows = docs.select(*[F.col(c) for c in columns], F.col(text_col).alias("__text"))
    added = "__score double" if model is not None else "__x array<double>"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema), added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.as_py()) for t in b["__text"]]
            if model is None:
                last = pa.array(x, pa.list_(pa.float64()))
            else:
                last = pa.array(model.value.score(np.array(x, float)) if x else [], pa.float64())
            yield pa.RecordBatch.from_arrays([*[b[c] for c in columns], last], names=[*columns, added.split()[0]])

    return rows.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", max_docs: int = FIT_DOCS) -> Gam:
    """Fits on the labelled documents: all labels up to max_docs, else a hash sample of ids of about that many.

    Labels other than 0 and 1 are left out. An id with several rows on either side counts once for each pair of them.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("__y"))
    n = known.count()
    if n > max_docs:
        known = known.where(F.pmod(F.xxhash64(F.col("__id"), F.lit("quality")), F.lit(1 << 30)) < F.lit(int((1 << 30) * max_docs / n)))
    joined = docs.join(F.broadcast(known), F.col(id_col) == F.col("__id")).select("__id", "__y", F.col(text_col).alias("__body"))
    rows = sorted(((r["__id"], r["__y"], list(r["__x"])) for r in _featured(joined, "__body", ["__id", "__y"]).collect()))
    return fit_gam(np.array([r[2] for r in rows], float).reshape(len(rows), len(FEATURES)), np.array([r[1] for r in rows], float))


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.where(F.pmod(id_crc(F.col("doc_id")), F.lit(4)) != 2)


def score_documents(docs: DataFrame, model: Gam, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from the threshold on) of every row, from the text alone.

    Null, empty and blank texts have all features 0 and the score of such a text. Repeated rows score alike; an empty table
    gives no rows; other columns are not read.
    """
    scored = _featured(docs, "text", ["doc_id"], docs.sparkSession.sparkContext.broadcast(model))
    return scored.select("doc_id", F.col("__score").alias("score"), (F.col("__score") >= threshold).cast("int").alias("predicted"))
