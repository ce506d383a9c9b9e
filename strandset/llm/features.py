"""Hashed n-gram indicators of whole texts, and the bounded labelled sample that models are fitted on."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandset.llm.common import texts

#: Indicators are hashed into so many columns.
WIDTH = 1 << 18
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHAPE = re.compile(r"[^\W\d_]+")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _MIX
    return (x ^ (x >> np.uint64(29))) * _MIX >> np.uint64(64 - 18)


class Grams:
    """Indicators of a text: word unigrams and bigrams, and for ``shapes`` also word-shape trigrams and
    how often its bigrams repeat. The dictionary of words seen is bounded."""

    def __init__(self, shapes: bool, bigrams: bool = True, most: int = 400_000) -> None:
        self.shapes, self.bigrams, self.most, self.known = shapes, bigrams, most, {}

    def _word(self, word: str) -> int:
        """The word's crc32 and, above it, the crc of its shape."""
        if not self.shapes:
            return zlib.crc32(_EDGES.sub("", word).lower().encode("utf-8", "replace"))
        letters = "".join(_SHAPE.findall(word))
        case = "-" if not letters else "A" if letters.isupper() and len(letters) > 1 else "Aa" if letters[0].isupper() else "a"
        rest = _SHAPE.sub("", word)
        shape = case + ("9" if any(c.isdigit() for c in rest) else rest[:4])
        return zlib.crc32(word.encode("utf-8", "replace")) | (zlib.crc32(shape.encode("utf-8", "replace")) & 0x7FFFFFFF) << 32

    def __call__(self, text: str) -> np.ndarray:
        words, known = text.split(), self.known
        if len(known) > self.most:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = self._word(w)
        both = np.array([known[w] for w in words], np.uint64)
        h = both & np.uint64(0xFFFFFFFF)
        parts = [_mixed(h + np.uint64(1 << 33))]
        pairs = h[:-1] * np.uint64(0x100000001B3) + h[1:]
        if self.bigrams and len(pairs):
            parts.append(_mixed(pairs + np.uint64(2 << 33)))
        if self.shapes:
            s = both >> np.uint64(32)
            parts.append(_mixed(s + np.uint64(3 << 33)))
            if len(s) > 2:
                parts.append(_mixed((s[:-2] * _MIX + s[1:-1]) * _MIX + s[2:] + np.uint64(4 << 33)))
            size = int(np.log2(len(words) + 1))
            again = 0 if len(pairs) < 4 else int(16 * (1 - len(np.unique(pairs)) / len(pairs)))
            plain = 0 if not len(s) else int(16 * (len(np.unique(h)) / len(h)))
            own = np.array([100 + again, 200 + size, 300 + plain, 400 + 32 * size + again], np.uint64)
            parts.append(_mixed(own + np.uint64(5 << 33)))
        return np.unique(np.concatenate(parts)).astype(np.uint32)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learnable, bound: int, grams: Callable[[], Grams]) -> DataFrame:
    """At most ``bound`` labelled documents as (doc_id, y, grams): those first in the order of their ids' hashes.

    Ids are chosen first, so at most ``bound`` of them are joined to the texts; of rows with one id the
    smallest text is taken, so that the bound holds for rows as well.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & learnable(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    )
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = read.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("y").alias("y"), F.min("text").alias("text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = grams()
        for batch in batches:
            found = [make(t).tobytes() for t in texts(batch, "text")]
            yield pa.record_batch([batch.column("doc_id"), batch.column("y"), pa.array(found, pa.binary())], ["doc_id", "y", "grams"])

    return rows.mapInArrow(extract, "doc_id long, y int, grams binary")


def gathered(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, list[np.ndarray]]:
    """All rows of a sample, in the order of their ids so that the fit is the same each time."""
    rows = sorted((k, y, g) for b in batches for k, y, g in zip(*(c.to_pylist() for c in b.columns), strict=True))
    return np.array([y for _, y, _ in rows], np.int64), [np.frombuffer(g, np.uint32) for _, _, g in rows]


def fit_in_one_task(sample: DataFrame, fit: Callable[[np.ndarray, list[np.ndarray]], np.ndarray]) -> np.ndarray:
    """Fits a model on the bounded sample in one executor task; float64 weights come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, rows = gathered(batches)
        yield pa.record_batch([pa.array([fit(y, rows).astype(np.float64).tobytes()], pa.binary())], ["model"])

    return np.frombuffer(sample.repartition(1).mapInArrow(run, "model binary").first()["model"], np.float64)


def sigmoid(z: np.ndarray | float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def score_column(text: Column, grams: Callable[[], Grams], margin: Callable[[np.ndarray], float]) -> Column:
    """The score of every whole text; ``margin`` is on the log-odds scale. Runs where the rows are: no shuffle."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        make = grams()
        for part in parts:
            yield pd.Series(sigmoid(np.array([margin(make(t or "")) for t in part], np.float64)))

    return score(text.cast("string"))
