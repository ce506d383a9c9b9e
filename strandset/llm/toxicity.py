"""Toxicity: a counterfactual-regularised classifier.

A logistic model on word indicators. Each labelled text that names a group is paired with the text in
which the group terms are swapped for others; the squared change of the log-odds between the two is
added to the loss, so that a group's name by itself moves no score.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandset.llm.common import held_out
from strandset.llm.features import WIDTH, Grams, fit_in_one_task, labelled_sample, score_column, sigmoid

#: Group terms; each is swapped for the next of its row.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("female", "male"), ("girls", "boys"), ("girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european", "american", "mexican", "chinese", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("old", "young"), ("elderly", "teenage"), ("blind", "deaf", "disabled"), ("immigrants", "refugees", "foreigners", "natives"),
    ("frauen", "männer"), ("frau", "mann"), ("muslime", "christen", "juden"),
    ("femmes", "hommes"), ("femme", "homme"), ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("musulmanes", "cristianos", "judíos"),
)
_NEXT = {w: row[(i + 1) % len(row)] for row in IDENTITY for i, w in enumerate(row)}
_WORD = re.compile(r"\w+")


def swapped(text: str) -> str:
    """The text with each group term exchanged; other characters stay."""
    return _WORD.sub(lambda m: _NEXT.get(m[0].lower(), m[0]), text)


def _grams() -> Grams:
    return Grams(shapes=False, bigrams=False)


def _sample(docs: DataFrame, labels: DataFrame, label: str, learnable, bound: int) -> DataFrame:
    """The labelled sample; where a swap changes a text, its indicators are followed by those of the swapped text."""
    class Pair(Grams):
        """Indicators of the text, a separator, then those of the swapped text."""

        def __call__(self, text: str) -> np.ndarray:
            own, other = super().__call__(text), swapped(text)
            return own if other == text else np.concatenate((own, [np.uint32(WIDTH)], super().__call__(other))).astype(np.uint32)

    return labelled_sample(docs, labels, label, learnable, bound, lambda: Pair(shapes=False, bigrams=False))


def _fit(y: np.ndarray, rows: list[np.ndarray], ridge: float, sparsity: float, fairness: float, epochs: int) -> np.ndarray:
    """Weights, then the intercept, by full-batch descent with per-weight adaptive steps.

    Each step shrinks weights towards zero by ``sparsity``, so that the many neutral words of a long
    text do not outweigh a single toxic one.
    """
    if not len(y) or y.min() == y.max():
        return np.concatenate((np.zeros(WIDTH), [0.0 if not len(y) else 5.0 if y[0] else -5.0]))
    y = (y > 0).astype(np.float64)
    own, plus, minus = [], [], []
    for r in rows:
        at = np.flatnonzero(r == WIDTH)
        a, b = (r[: at[0]], r[at[0] + 1 :]) if len(at) else (r, r)
        own.append(a)
        plus.append(np.setdiff1d(b, a, assume_unique=True))
        minus.append(np.setdiff1d(a, b, assume_unique=True))
    sizes = np.array([len(a) for a in own])
    column = np.concatenate(own).astype(np.int64)
    row = np.repeat(np.arange(len(own)), sizes)
    pair = [i for i in range(len(own)) if len(plus[i]) or len(minus[i])]
    pc = np.concatenate([np.concatenate((plus[i], minus[i])) for i in pair] or [np.zeros(0)]).astype(np.int64)
    ps = np.concatenate([np.repeat([1.0, -1.0], [len(plus[i]), len(minus[i])]) for i in pair] or [np.zeros(0)])
    pr = np.repeat(np.arange(len(pair)), [len(plus[i]) + len(minus[i]) for i in pair]).astype(np.int64)
    # A start at smoothed log ratios of document frequencies; words seen once or twice start at zero.
    up = np.bincount(column, weights=y[row], minlength=WIDTH)
    all_ = np.bincount(column, minlength=WIDTH)
    n1, n0 = y.sum(), len(y) - y.sum()
    ratio = np.log((up + 0.5) / (n1 + 1)) - np.log((all_ - up + 0.5) / (n0 + 1))
    w = np.where(np.abs(ratio) > 2.0, ratio, 0.0) * (all_ >= 4)
    bias, weight = np.log(n1 / n0), np.where(y == 1, 0.5 * len(y) / n1, 0.5 * len(y) / n0) ** 0.5
    g2, b2 = np.full(WIDTH, 1e-8), 1e-8
    for _ in range(epochs):
        z = np.bincount(row, weights=w[column], minlength=len(y)) + bias
        e = weight * (sigmoid(z) - y) / len(y)
        gradient = np.bincount(column, weights=e[row], minlength=WIDTH) + ridge * w
        if len(pair):
            change = np.bincount(pr, weights=ps * w[pc], minlength=len(pair))
            gradient += fairness / len(y) * np.bincount(pc, weights=ps * change[pr], minlength=WIDTH)
        g2, b2 = g2 + gradient**2, b2 + e.sum() ** 2
        rate = 0.15 / np.sqrt(g2)
        w = w - rate * gradient
        w = np.sign(w) * np.maximum(np.abs(w) - rate * sparsity, 0.0)
        bias -= 0.15 * e.sum() / np.sqrt(b2)
    return np.concatenate((w, [bias]))


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    learnable=lambda doc_id: ~held_out(doc_id),
    bound: int = 16_000,
    ridge: float = 1e-5,
    sparsity: float = 1e-4,
    fairness: float = 1.0,
    epochs: int = 80,
) -> DataFrame:
    """(doc_id, score) of every whole text in ``docs``: the chance that it is toxic.

    The model is fitted on at most ``bound`` rows of ``labels`` whose ids ``learnable`` accepts (a
    documented bound; the same rows each time), and every document is scored. ``fairness`` weighs the
    squared change of the log-odds under a swap of group terms. Only the text enters a score. Null and
    empty texts get a score like any other text; null ids and repeated rows are kept, one result a row;
    rows of ``labels`` with nulls teach nothing, and of repeated ids the largest label counts; without
    labels all scores are 0.5. Other columns are not read.
    """
    sample = _sample(docs, labels, label, learnable, bound)
    model = fit_in_one_task(sample, lambda y, rows: _fit(y, rows, ridge, sparsity, fairness, epochs))
    w, bias = model[:-1].astype(np.float32), float(model[-1])
    score = score_column(F.col("text"), _grams, lambda row: float(w[row].sum()) + bias)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), score.alias("score"))
