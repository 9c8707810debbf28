"""A quality classifier from trusted good documents and unlabelled ones.

Positive-unlabelled learning: with the class prior ``p``, which is estimated from the two samples, the risk on the unseen negatives is the risk of unlabelled
documents less ``p`` times that of the positives when both are taken for negatives. Its estimate must not become
negative; where it does, the step undoes it instead of following it. The loss is the bounded sigmoid loss.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamgrid.llm.style import NAMES, features
from streamgrid.llm.training import SAMPLE_ROWS, descend, in_order, sample, scored, sigmoid

#: Quantile bins of each feature.
BINS = 12
STEPS = 600
RATE = 0.02
DECAY = 3e-4
THRESHOLD = 0.3
#: The classifier that only estimates the prior is fitted more smoothly.
PRIOR_STEPS = 300
PRIOR_DECAY = 1e-2
#: Chance that the bound by which the prior is read off does not hold.
CONFIDENCE = 0.1


class Model(NamedTuple):
    """Bin edges, scale and weights of the features; ``weights`` None: nothing to learn from, every score is 0.5."""

    edges: tuple[np.ndarray, ...]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    prior: float

    def expand(self, x: np.ndarray) -> np.ndarray:
        places = [np.eye(len(e) + 1)[np.searchsorted(e, x[:, i], side="right")] for i, e in enumerate(self.edges)]
        return np.concatenate([*places, (x - self.mean) / self.scale, np.ones((len(x), 1))], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), 0.5) if self.weights is None else sigmoid(self.expand(x) @ self.weights)


def class_prior(good: np.ndarray, web: np.ndarray) -> float:
    """Share of good documents among the unlabelled ones, from trusted good ones and the unlabelled alone.

    A classifier of good against unlabelled is fitted on every other row and sorts the rest by its score, and the other
    way round. Above any score lies at least the prior times as large a share of the unlabelled as of the good ones, and
    where few bad ones are left hardly more. The ratio is taken where its upper confidence bound is smallest, so that
    the tails, which hold few rows, do not decide.
    """
    if len(good) < 8 or len(web) < 8:
        return 0.5
    found = [_ratio(good[i::2], web[i::2], good[1 - i :: 2], web[1 - i :: 2]) for i in (0, 1)]
    return float(np.clip(np.mean(found), 0.02, 0.98))


def _ratio(good: np.ndarray, web: np.ndarray, good_rest: np.ndarray, web_rest: np.ndarray) -> float:
    def gradient(w: np.ndarray) -> np.ndarray:
        a, b = sigmoid(good @ w) - 1, sigmoid(web @ w)
        return good.T @ a / len(a) + web.T @ b / len(b) + PRIOR_DECAY * np.append(w[:-1], 0)

    w = descend(gradient, np.zeros(good.shape[1]), PRIOR_STEPS, RATE)
    a, b = np.sort(good_rest @ w), np.sort(web_rest @ w)
    bounds = np.unique(a)
    good_above = 1 - np.searchsorted(a, bounds, "left") / len(a)
    web_above = 1 - np.searchsorted(b, bounds, "left") / len(b)
    slack = math.sqrt(math.log(8 / CONFIDENCE) / (2 * len(a))) + math.sqrt(math.log(8 / CONFIDENCE) / (2 * len(b)))
    best = int(np.argmin((web_above + slack) / good_above))
    return web_above[best] / good_above[best]


def fit_arrays(labelled: np.ndarray, labels: np.ndarray, unlabelled: np.ndarray) -> Model:
    width = len(NAMES)
    base = np.concatenate([labelled, unlabelled]) if len(labelled) + len(unlabelled) else np.zeros((1, width))
    cuts = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = tuple(np.unique(np.quantile(base[:, i], cuts)) for i in range(width))
    model = Model(edges, base.mean(0), base.std(0) + 1e-9, None, 0.5)
    if not (labels == 1).any() or not len(unlabelled):
        return model
    good, web = model.expand(labelled[labels == 1]), model.expand(unlabelled)
    prior = class_prior(good, web)
    model = model._replace(prior=prior)

    def gradient(w: np.ndarray) -> np.ndarray:
        a, b = sigmoid(good @ w), sigmoid(web @ w)
        towards_good = prior * good.T @ (a * (1 - a)) / len(good)
        negative_risk = b.mean() - prior * a.mean()
        rise = web.T @ (b * (1 - b)) / len(web) - towards_good
        step = rise - towards_good if negative_risk >= 0 else -rise
        return step + DECAY * np.append(w[:-1], 0)

    start = np.zeros(good.shape[1])
    start[-1] = 1
    return model._replace(weights=descend(gradient, start, STEPS, RATE))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``rows`` labelled and ``rows`` unlabelled documents (see ``sample``), as numbers on the driver."""
    shape = _features_udf()
    table = in_order(sample(docs, labels, label, rows).select("doc_id", shape(F.col("text")).alias("x"), "label").toArrow())
    x = np.array(table["x"].to_pylist(), float).reshape(-1, len(NAMES))
    y = np.array([-1 if v is None else v for v in table["label"].to_pylist()], int)
    return fit_arrays(x[y >= 0], y[y >= 0], x[y < 0])


def _features_udf():  # noqa: ANN202
    @F.arrow_udf("array<double>")
    def shape(texts: pa.Array) -> pa.Array:
        return pa.array([features(t.as_py() or "") for t in texts], pa.list_(pa.float64()))

    return shape


def score(df: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add ``score`` (0 to 1, null and empty texts too) and ``predicted`` (1 from ``threshold`` on).

    Rows, repeated ones too, and other columns stay; columns of these names are replaced.
    """

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        x = np.array([features(t.as_py() or "") for t in texts], float).reshape(-1, len(NAMES))
        return pa.array(model.score(x), pa.float64())

    return scored(df, run(F.col(text)), threshold)
