"""Quality classifier: Naive Bayes support vectors.

N-gram indicators are scaled by the log ratio of their smoothed class frequencies; a linear model is
fitted on them with the hinge loss by dual coordinate descent. Margins become scores by a logistic
curve fitted on rows that the descent did not see.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandset.llm.common import held_out
from strandset.llm.features import WIDTH, Grams, fit_in_one_task, labelled_sample, score_column, sigmoid


def _grams() -> Grams:
    return Grams(shapes=True)


def log_count_ratios(y: np.ndarray, rows: list[np.ndarray], smooth: float = 1.0) -> np.ndarray:
    """log of (share among positives / share among negatives) for each indicator."""
    counts = [np.bincount(np.concatenate([r for r, t in zip(rows, y, strict=True) if t == c] or [np.zeros(0, np.uint32)]), minlength=WIDTH) + smooth for c in (1, 0)]
    p, q = (c / c.sum() for c in counts)
    return np.log(p / q)


def dual_coordinate_descent(values: list[np.ndarray], rows: list[np.ndarray], sign: np.ndarray, cost: np.ndarray, epochs: int) -> np.ndarray:
    """Weights of the hinge-loss support vector machine min |w|^2/2 + sum cost * max(0, 1 - sign * w.x)."""
    w, alpha, rng = np.zeros(WIDTH), np.zeros(len(rows)), np.random.default_rng(7)
    norm = np.array([max(v @ v, 1e-12) for v in values])
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            gradient = sign[i] * (w[rows[i]] @ values[i]) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                w[rows[i]] += (new - alpha[i]) * sign[i] * values[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def logistic_curve(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """(slope, shift) of a logistic curve for labels y of margins z, with Platt's smoothed targets."""
    up, down = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * z + b)
        g = np.array([((p - t) * z).sum() + 1e-3 * a, (p - t).sum()])
        r = p * (1 - p) + 1e-9
        hessian = np.array([[(r * z * z).sum() + 1e-3, (r * z).sum()], [(r * z).sum(), r.sum() + 1e-6]])
        step = np.linalg.solve(hessian, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    return float(max(a, 1e-3)), float(b)


def _fit(y: np.ndarray, rows: list[np.ndarray], cost: float, epochs: int) -> np.ndarray:
    """The model: a weight for each indicator (ratio included), then slope and shift of the curve."""
    if not len(y) or y.min() == y.max():
        return np.concatenate((np.zeros(WIDTH), [1.0, 0.0 if not len(y) else 5.0 if y[0] else -5.0]))
    y = (y > 0).astype(np.int64)
    seen = np.arange(len(y)) % 5 != 0
    if min(np.bincount(y[seen], minlength=2)) == 0 or min(np.bincount(y[~seen], minlength=2)) == 0:
        seen[:] = True
    ratio = log_count_ratios(y[seen], [r for r, s in zip(rows, seen, strict=True) if s])
    values = [ratio[r] / max(np.sqrt((ratio[r] ** 2).sum()), 1e-9) for r in rows]
    weight = len(y) / (2 * np.bincount(y, minlength=2))
    pick = np.flatnonzero(seen)
    w = dual_coordinate_descent([values[i] for i in pick], [rows[i] for i in pick], np.where(y[pick] == 1, 1.0, -1.0), cost * weight[y[pick]], epochs)
    margins = np.array([w[r] @ v for r, v in zip(rows, values, strict=True)])
    rest = ~seen if not seen.all() else seen
    # The margin divides by the norm of the ratios, so ratios are kept beside the weights.
    return np.concatenate((w, ratio, logistic_curve(margins[rest], y[rest])))


def quality_column(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    learnable=lambda doc_id: ~held_out(doc_id),
    bound: int = 12_000,
    cost: float = 4.0,
    epochs: int = 12,
) -> Column:
    """The score of every whole ``text`` in ``docs``, as a column: the chance of label 1.

    The model is fitted on at most ``bound`` rows of ``labels`` whose ids ``learnable`` accepts (a
    documented bound; the same rows each time), and every document is scored. Only the text enters a
    score. Null and empty texts get a score like any other text; null ids and repeated rows are kept,
    one result a row; rows of ``labels`` with nulls teach nothing, and of repeated ids the largest label
    counts; without labels all scores are 0.5. Other columns are not read.
    """
    sample = labelled_sample(docs, labels, label, learnable, bound, _grams)
    model = fit_in_one_task(sample, lambda y, rows: _fit(y, rows, cost, epochs))
    slope, shift = model[-2:]
    w = model[:WIDTH].astype(np.float32)
    ratio = model[WIDTH:-2].astype(np.float32) if len(model) > WIDTH + 2 else np.ones(WIDTH, np.float32)

    def margin(row: np.ndarray) -> float:
        v = ratio[row]
        return slope * float(w[row] @ v) / max(float(np.sqrt(v @ v)), 1e-9) + shift

    return score_column(F.col("text"), _grams, margin)


def score_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, score) of every document (see :func:`quality_column`)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), quality_column(docs, labels, **options).alias("score"))


def keep_quality(docs: DataFrame, labels: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """The documents, all columns, that score ``least`` or more."""
    return docs.where(quality_column(docs, labels, **options) >= least)


def with_decision(scored: DataFrame, least: float) -> DataFrame:
    """(doc_id, held_out, score, predicted)."""
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
