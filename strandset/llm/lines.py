"""Line deduplication by overlapping windows of three lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandset.llm.common import slices


def _windows(keyed: DataFrame, size: int) -> DataFrame:
    """(h1, h2, id, row, pos) of (id, row, text): the 128-bit hash of each window of ``size`` lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in slices(batches, 256):
            found: list[bytes] = []
            at: list[int] = []
            pos: list[int] = []
            for row, s in enumerate(batch.column("text").to_pylist()):
                lines = (s or "").split("\n")
                if len(lines) < size:
                    continue
                d = [digest(x.encode("utf-8", "replace")) for x in lines]
                own = [j for j in range(len(d) - size + 1) if any(lines[j : j + size])]
                found += [digest(b"".join(d[j : j + size])) for j in own]
                pos += own
                at += [row] * len(own)
            both = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
            rows = pa.array(at, pa.int64())
            yield pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1]), batch.column("id").take(rows), batch.column("row").take(rows), pa.array(pos, pa.int32())], ["h1", "h2", "id", "row", "pos"])

    return keyed.select("id", "row", "text").mapInArrow(run, "h1 long, h2 long, id long, row long, pos int")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, counts: bool = True) -> DataFrame:
    """Removes later occurrences of repeated windows of ``size`` consecutive lines.

    Returns all columns with ``text`` replaced by the kept lines and, with ``counts``, n_lines and
    n_removed (long) appended. A window is found again if its lines are equal anywhere in the corpus, the
    same document included; its first occurrence by (doc_id, row hash, position) stays, and the lines that
    any later one covers go. Windows of empty lines only don't count. A null text stays null and an empty
    text is one empty line, with nothing removed; texts of fewer lines hold no window; null ids come first.
    Rows with equal id and text are one document and are treated alike, so that a repeated row keeps
    its lines. An empty table gives an empty result. Columns of any other name are not touched; with
    ``counts``, n_lines and n_removed take the place of columns of these names, else those stay too.

    Windows are counted by partial aggregation and only those seen in two places are joined back; the
    join's hot keys are left to adaptive execution, which splits them.
    """
    t, i = F.col(f"`{text}`").cast("string"), F.col(f"`{doc_id}`").cast("long")
    keyed = docs.select(F.struct("*").alias("all"), i.alias("id"), t.alias("text")).select("all", "id", "text", F.xxhash64("text").alias("row"))
    windows = _windows(keyed, size)
    place = F.struct("id", "row", "pos")
    first = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("h1", "h2", "first")
    later = windows.join(first, ["h1", "h2"]).where(place != F.col("first"))
    covered = later.groupBy("id", "row").agg(F.collect_set("pos").alias("starts"))
    met = keyed.alias("d").join(covered.alias("c"), F.col("d.id").eqNullSafe(F.col("c.id")) & (F.col("d.row") == F.col("c.row")), "left")
    kept = met.select("d.all", "d.text", "c.starts")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            new, n_lines, n_removed = [], [], []
            for s, starts in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist(), strict=True):
                lines = (s or "").split("\n")
                gone = np.zeros(len(lines) + size, bool)
                if starts:
                    for j in range(size):
                        gone[np.array(starts) + j] = True
                n = int(gone.sum())
                new.append("\n".join([x for x, g in zip(lines, gone.tolist(), strict=False) if not g]) if n else s)
                n_lines.append(len(lines))
                n_removed.append(n)
            yield pa.record_batch([batch.column("all"), pa.array(new, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())], ["all", "text", "n_lines", "n_removed"])

    out = kept.mapInArrow(apply, StructType([kept.schema["all"], *StructType.fromDDL("text string, n_lines long, n_removed long")]))
    own = ("n_lines", "n_removed") if counts else ()
    return out.select(*[F.col("text").alias(c) if c == text else F.col("all")[c].alias(c) for c in docs.columns if c not in own], *own)


#: The same in DuckDB's SQL, by the windows' texts themselves.
ORACLE = """
WITH l AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, pos, array_to_string(ls[pos:pos + 2], chr(10)) AS win
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS pos FROM l)),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS n FROM w
      WHERE win <> chr(10) || chr(10)),
g AS (SELECT DISTINCT doc_id, pos + j AS pos FROM (SELECT doc_id, pos, unnest([0, 1, 2]) AS j FROM r WHERE n > 1)),
e AS (SELECT doc_id, len(ls) AS n_lines, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM l),
k AS (SELECT e.doc_id, any_value(e.n_lines) AS n_lines, count(g.pos) AS n_removed,
             string_agg(CASE WHEN g.pos IS NULL THEN e.line END, chr(10) ORDER BY e.pos) AS kept
      FROM e LEFT JOIN g ON e.doc_id = g.doc_id AND e.pos = g.pos GROUP BY e.doc_id)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, coalesce(kept, '') AS text FROM k
"""
