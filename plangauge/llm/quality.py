"""Quality classifier from trusted positives and unlabelled text (non-negative PU risk).

A small network over counts of the whole text is fitted to
``prior * E_p[l(+)] + max(0, E_u[l(-)] - prior * E_p[l(-)])`` with the logistic loss,
so its sigmoid is an estimate of P(good | text).

Nulls and empty texts have all counts zero and are scored like any other text.
Without a positive label every score is 0.5.  Every row in gives one row out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plangauge.llm.common import fold_column, map_rows, words

UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = b"0123456789"
BEYOND = bytes(range(128, 256))
MARKS = [bytes([c]) for c in b"!|*#$%&.,;:?<>@/-_'\"()"]
N_FEATURES = 17 + len(MARKS)


def features(text: str | None) -> list[float]:
    """Shares over the whole text; ``bytes`` methods keep the work in C."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    size = len(raw)
    if not size:
        return [0.0] * N_FEATURES
    tokens = raw.split()
    n = len(tokens) or 1
    without = lambda chars: (size - len(raw.translate(None, chars))) / size
    kinds = set(tokens)
    pairs = len(set(zip(tokens, tokens[1:])))
    same = sum(map(bytes.__eq__, tokens, tokens[1:]))
    lines = raw.split(b"\n")
    filled = [x for x in lines if x.strip()]
    m = len(filled) or 1
    return [
        np.log1p(len(tokens)),
        np.log1p(m),
        np.log1p(n / m),
        sum(map(len, tokens)) / n / 10,
        len(kinds) / n,
        len(kinds) / np.sqrt(n) / 5,
        (pairs + 1) / n,
        same / n,
        len(set(filled)) / m,
        without(UPPER),
        without(LOWER),
        without(DIGITS),
        without(BEYOND),
        sum(map(bytes.isupper, tokens)) / n,
        sum(map(bytes.islower, tokens)) / n,
        sum(map(bytes.isalpha, tokens)) / n,
        max(map(len, tokens), default=0) / 50,
        *[raw.count(c) / n for c in MARKS],
    ]


@dataclass(frozen=True)
class QualityModel:
    prior: float
    centre: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(x), 0.5)
        return _sigmoid(_forward(self.layers, _standard(x, self.centre, self.scale))[1])


def _standard(x, centre, scale):
    return np.clip((x - centre) / scale, -8, 8)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _forward(layers, x):
    a, b, c, d = layers
    h = np.tanh(x @ a + b)
    return h, h @ c + d[0]


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 24, steps: int = 1500, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> QualityModel:
    """Full-batch Adam on the non-negative PU risk; when the estimated negative part is below zero, its gradient is reversed."""
    if not len(positive) or not len(unlabelled):
        return QualityModel(prior, np.zeros(N_FEATURES), np.ones(N_FEATURES), ())
    both = np.vstack([positive, unlabelled])
    centre, scale = both.mean(0), both.std(0) + 1e-3
    p, u = _standard(positive, centre, scale), _standard(unlabelled, centre, scale)
    x, n_p = np.vstack([p, u]), len(p)
    rng = np.random.default_rng(seed)
    layers = [rng.normal(0, 0.2, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.2, hidden), np.zeros(1)]
    first, second = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers]
    for t in range(1, steps + 1):
        h, z = _forward(layers, x)
        s = _sigmoid(z)
        softplus = np.logaddexp(0, z)  # loss of calling a row negative
        negative_part = softplus[n_p:].mean() - prior * softplus[:n_p].mean()
        g = np.empty_like(z)
        if negative_part >= 0:
            g[:n_p] = prior * (s[:n_p] - 1) / n_p - prior * s[:n_p] / n_p
            g[n_p:] = s[n_p:] / (len(z) - n_p)
        else:
            g[:n_p] = prior * s[:n_p] / n_p
            g[n_p:] = -s[n_p:] / (len(z) - n_p)
        back = np.outer(g, layers[2]) * (1 - h * h)
        grads = [x.T @ back, back.sum(0), h.T @ g, np.array([g.sum()])]
        for i, d in enumerate(grads):
            d = d + decay * layers[i]
            first[i] = 0.9 * first[i] + 0.1 * d
            second[i] = 0.999 * second[i] + 0.001 * d * d
            layers[i] = layers[i] - rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    return QualityModel(prior, centre, scale, tuple(layers))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1, slack: float = 0.01) -> float:
    """Share of positives among the unlabelled, from scores of rows of both that the scorer was not fitted to.

    Above any threshold, the share of unlabelled rows over the share of positives bounds the prior from above, and meets it where
    no negative is left.  The threshold is the one with the least bound after what chance may add (best bin estimation).
    """
    n, m = len(positive), len(unlabelled)
    if not n or not m:
        return 0.5
    tops = np.sort(positive)[::-1]
    share_p = np.arange(1, n + 1) / n
    share_u = (m - np.searchsorted(np.sort(unlabelled), tops, side="left")) / m
    chance = np.sqrt(np.log(4 / delta) / (2 * n)) + np.sqrt(np.log(4 / delta) / (2 * m))
    at = int(np.argmin(share_u / share_p + (1 + slack) * chance / share_p))
    return float(np.clip(share_u[at] / share_p[at], 0.01, 0.99))


def train(
    documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality",
    folds: int = 5, held_out: int = 0, max_positive: int = 6000, max_unlabelled: int = 9000, prior: float | None = None,
) -> QualityModel:
    """Fit on a bounded sample: at most ``max_positive`` rows labelled 1 and ``max_unlabelled`` rows of any kind.

    Both are the first by a hash of the id, outside the held-out fold.  Unless a ``prior`` is given, it is estimated from them
    (:func:`estimate_prior`): a first scorer is fitted to one half and asked about the other.  Labels other than 1 are not used.
    """
    outside = fold_column(id_col, folds) != held_out
    trusted = labels.select(id_col, label).filter(outside & F.col(id_col).isNotNull() & (F.col(label) == 1))
    first = lambda ids, n: ids.select(id_col).distinct().orderBy(F.xxhash64(id_col), id_col).limit(n)
    positive = first(trusted, max_positive).withColumn("positive", F.lit(1))
    others = first(documents.filter(outside & F.col(id_col).isNotNull()), max_unlabelled).withColumn("positive", F.lit(0))
    # at most max_positive + max_unlabelled ids; rows that share one count once, the least text
    chosen = F.broadcast(positive.unionByName(others))
    sample = documents.select(id_col, F.col(text).alias("text")).join(chosen, id_col).groupBy(id_col, "positive").agg(F.min("text").alias("text")).select("positive", "text")

    def make():
        def work(flags, texts):
            for f, t in zip(flags, texts):
                yield f, features(t)

        return work

    rows = map_rows(sample, "positive int, x array<double>", make).collect()
    x = np.array([r["x"] for r in rows] or np.empty((0, N_FEATURES)))
    is_positive = np.array([r["positive"] for r in rows], dtype=bool)
    order = np.lexsort(x.T) if len(x) else np.arange(0)  # same fit whatever the order of rows
    x, is_positive = x[order], is_positive[order]
    p, u = x[is_positive], x[~is_positive]
    if prior is None:
        ranker = fit_nnpu(p[::2], u[::2], 0.5, steps=400)
        prior = estimate_prior(ranker.score(p[1::2]), ranker.score(u[1::2])) if len(p) > 1 and len(u) > 1 else 0.5
    return fit_nnpu(p, u, float(prior))


def score(df: DataFrame, model: QualityModel, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every row; no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast((model.prior, model.centre, model.scale, model.layers))

    def make():
        m = QualityModel(*shared.value)

        def work(ids, texts):
            yield from zip(ids, m.score(np.array([features(t) for t in texts])).tolist())

        return work

    return map_rows(df.select(id_col, text), f"doc_id {dict(df.dtypes)[id_col]}, score double", make)
