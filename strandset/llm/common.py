"""Shared helpers: table access, lineage cuts, and Arrow/numpy text buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandset.operators.lineage import few, shared_folder, written

__all__ = ["cut", "few", "held_out", "one_byte", "row_key", "runs_of", "shared_folder", "slices", "table", "texts", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read through Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def row_key(doc_id: str, text: str) -> list[Column]:
    """Two hashes k1 and k2 that name a row by its id and text; null in neither, and never null."""
    none = [F.col(c).isNull() for c in (doc_id, text)]
    return [F.xxhash64(F.lit(n), *none, F.col(doc_id), F.col(text)).alias(f"k{n}") for n in (1, 2)]


def held_out(doc_id: Column) -> Column:
    """True for the rows whose labels are never learned: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that what is made of one at a time stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column as Python strings; null is the empty text."""
    return [x or "" for x in batch.column(name).to_pylist()]


def one_byte(strings: list[str], gap: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """All strings in one byte array, one byte for each code point, and each one's start.

    Code points beyond Latin-1 become ``?``; ``gap`` zero bytes follow each string, so that no run
    or q-gram spans two of them.
    """
    sep = b"\0" * gap
    parts = [s.encode("latin-1", "replace") for s in strings]
    sizes = np.fromiter((len(p) for p in parts), np.int64, len(parts)) + gap
    starts = np.concatenate(([0], np.cumsum(sizes)))
    return np.frombuffer(sep.join([*parts, b""]), np.uint8), starts


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return edges[::2], edges[1::2]
