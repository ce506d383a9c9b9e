"""Exact top-k inner-product search with block-at-a-time pruning.

Vectors of integers are dealt into document-range blocks, each with a forward index (its vectors) and
its term maxima (the largest and smallest value of each component). For each query the maxima sum to a
bound on every score in a block; blocks are scored in the order of their bounds until a bound falls
below the query's k-th score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandset.llm.common import cut, few, slices

#: Tasks over which the packs that meet one chunk of maxima are dealt.
_SPREAD = 4
_NONE = -(2**62)  # below any score; its negative is still a 64-bit integer


def quantized(vectors: DataFrame, vec_id: str, embedding: str, scale: int, **others: Column) -> DataFrame:
    """(vec_id, v, others) with v = floor(scale * x); vectors that are null, empty or hold null or non-finite components go."""
    x = F.col("x")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return (
        vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("x"), *[c.alias(name) for name, c in others.items()])
        .where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~bad)
        .select("vec_id", F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"), *others)
    )


def _packed(rows: DataFrame, size: int, at_once: int, by: tuple[str, ...]) -> DataFrame:
    """Rows (vec_id, v) in shards (n, dim, ids, values): up to ``size`` rows each, in the order of ``by``.

    The order is a range partition, so neighbours share a block and no key can fill one task.
    """
    lead = F.expr("array_position(transform(v, c -> abs(c)), array_max(transform(v, c -> abs(c))))")
    keyed = rows.withColumn("lead", lead * F.signum(F.element_at("v", lead.cast("int")).cast("double")).cast("long"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[int, list[int]] = {}
        values: dict[int, list[list[int]]] = {}

        def out(dim: int) -> pa.RecordBatch:
            i, v = ids.pop(dim), values.pop(dim)
            return pa.record_batch(
                [pa.array([dim], pa.int32()), pa.array([np.array(i, np.int64).tobytes()], pa.binary()), pa.array([np.array(v, np.int64).tobytes()], pa.binary())],
                ["dim", "ids", "values"],
            )

        for batch in batches:
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                ids.setdefault(len(v), []).append(i)
                values.setdefault(len(v), []).append(v)
                if len(ids[len(v)]) == size:
                    yield out(len(v))
        for dim in list(ids):
            yield out(dim)

    n = max(1, -(-rows.count() // at_once))
    dealt = keyed.repartitionByRange(n, *by).sortWithinPartitions(*by)
    return dealt.select("vec_id", "v").mapInArrow(pack, "dim int, ids binary, values binary")


def _arrays(ids: bytes, values: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(values, np.int64).reshape(-1, dim)


def _bounds(q: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each query and range of vectors what no score exceeds: the summed products with the range's extremes."""
    return np.maximum(q, 0) @ most.T + np.minimum(q, 0) @ least.T


def search_block(
    q_ids: np.ndarray, q: np.ndarray, d_ids: np.ndarray, d: np.ndarray, k: int, block: int, reached: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (query, vector, score) of one shard for each query, ties to the smaller vector id.

    Blocks of ``block`` documents are taken in the order of their bounds; a query stops at the first
    bound below its k-th score, or below the k-th score that it has ``reached`` elsewhere (an equal bound
    may still hold a tie with a smaller id).
    """
    starts = np.arange(0, len(d), block)
    most, least = np.maximum.reduceat(d, starts), np.minimum.reduceat(d, starts)
    bounds = _bounds(q, most, least)
    order = np.argsort(-bounds, axis=1, kind="stable")
    floor = np.int64(_NONE)
    top_s = np.full((len(q), k), floor)
    top_i = np.full((len(q), k), np.iinfo(np.int64).max)
    # Integer sums of this size are exact in doubles, whose matrix product is much faster.
    exact = np.abs(q).max(initial=0) * np.abs(d).max(initial=0) * q.shape[1] < 2**53
    qf, df = (q.astype(np.float64), d.astype(np.float64)) if exact else (q, d)
    active = np.arange(len(q))
    for step in range(len(starts)):
        which = order[active, step]
        keep = bounds[active, which] >= (top_s[active, -1] if reached is None else np.maximum(top_s[active, -1], reached[active]))
        active, which = active[keep], which[keep]
        if not len(active):
            break
        for b in np.unique(which):
            rows = active[which == b]
            part = slice(starts[b], starts[b] + block)
            s = (qf[rows] @ df[part].T).astype(np.int64)
            ids = np.broadcast_to(d_ids[part], s.shape)
            s = np.where(ids == q_ids[rows][:, None], floor, s)
            all_s, all_i = np.concatenate((top_s[rows], s), 1), np.concatenate((top_i[rows], ids), 1)
            all_i = np.where(all_s == floor, np.iinfo(np.int64).max, all_i)
            best = np.lexsort((all_i, -all_s), axis=1)[:, :k]
            top_s[rows], top_i[rows] = np.take_along_axis(all_s, best, 1), np.take_along_axis(all_i, best, 1)
    row, at = np.nonzero(top_s != floor)
    return q_ids[row], top_i[row, at], top_s[row, at]


def top_k(
    vectors: DataFrame,
    is_query: Column,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    k: int = 5,
    scale: int = 256,
    block: int = 256,
    shard: int = 8_192,
    queries_at_once: int = 1_024,
) -> DataFrame:
    """Each query's k highest scores: (query_id, rank, vec_id, score).

    Components become floor(scale * x); a score is the integer inner product. ``is_query`` is a
    condition on ``vec_id``. Candidates are all rows but those with the query's own id; ties go to the
    smaller id; fewer candidates give fewer rows. Vectors that are null or empty or hold null or
    non-finite components, and rows with a null id, take no part; vectors of another length than the
    query's are no candidates of it. Repeated ids are candidates each, and a repeated query is asked
    once, with the smallest of its vectors. Other columns are not read; an empty table gives an empty
    result.

    Vectors lie in shards of ``shard`` rows. A first pass over the shards' term maxima alone gives each
    query the shard of its highest bound, whose k-th score is its threshold; a second one gives the other
    shards whose bounds reach it. Only there are queries sent, in packs of ``queries_at_once``, so a task
    holds one pack and one shard, and a shard returns k rows a query.
    """
    rows = cut(quantized(vectors, vec_id, embedding, scale))
    asked = cut(rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")).select(F.col("vec_id").alias("query_id"), "v", F.size("v").alias("dim")))
    shards = cut(_packed(rows, shard, shard, ("lead", "vec_id")).withColumn("shard", F.monotonically_increasing_id()))
    best = cut(best_shards(asked, shards, queries_at_once))
    first = cut(_searched(asked.join(best, "query_id").withColumn("reached", F.lit(_NONE)), shards, k, block, queries_at_once))
    full = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    threshold = full.select("query_id", F.when(F.col("n") == k, F.col("least")).otherwise(_NONE).alias("reached"))
    # A query alone in its first shard found none there: any score reaches it.
    open_ = cut(asked.join(threshold, "query_id", "left").withColumn("reached", F.coalesce("reached", F.lit(_NONE))))
    others = reaching_shards(open_, shards, queries_at_once).join(best, ["query_id", "shard"], "left_anti")
    found = first.unionByName(_searched(open_.join(others, "query_id"), shards, k, block, queries_at_once))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _bounded(asked: DataFrame, shards: DataFrame, queries_at_once: int, maxima_at_once: int, choose: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(query_id, shard, bound) of the pairs that ``choose`` takes by the bounds (queries x shards) and what queries have reached.

    Packs of queries meet chunks of the shards' term maxima, some two vectors a shard; no vectors are sent.
    """

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                d = _arrays(row["ids"], row["values"], row["dim"])[1]
                kinds = (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                values = (row["dim"], row["shard"], d.max(axis=0).tolist(), d.min(axis=0).tolist())
                yield pa.record_batch([pa.array([x], t) for x, t in zip(values, kinds, strict=True)], ["dim", "shard", "most", "least"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8):
            for row in batch.to_pylist():
                most, least, number = (np.array([m[c] for m in row["maxima"]]) for c in ("most", "least", "shard"))
                q, ids, reached = (np.array([x[c] for x in row["queries"]]) for c in ("v", "query_id", "reached"))
                bounds = _bounds(q, most, least)
                i, j = np.nonzero(choose(bounds, reached))
                yield pa.record_batch([pa.array(ids[i]), pa.array(number[j]), pa.array(bounds[i, j])], ["query_id", "shard", "bound"])

    maxima = shards.mapInArrow(extremes, "dim int, shard long, most array<long>, least array<long>")
    chunks = cut(_grouped(maxima, "dim", "maxima", ("shard", "most", "least"), maxima_at_once, "chunk"))
    packs = _grouped(asked, "dim", "queries", ("query_id", "v", "reached"), queries_at_once, "pack")
    # A pack is sent to each chunk by number; pairs are dealt by both numbers, so no length of vectors is one key.
    numbers = cut(chunks.groupBy("dim").agg(F.max("chunk").alias("last")))
    sent = packs.join(few(numbers), "dim").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    spread = F.pmod(F.xxhash64("pack"), F.lit(_SPREAD)).alias("spread")
    copies = chunks.withColumn("spread", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SPREAD - 1).cast("long"))))
    met = sent.withColumn("spread", spread).join(copies, ["dim", "chunk", "spread"])
    return met.select("queries", "maxima").mapInArrow(compare, "query_id long, shard long, bound long")


def best_shards(asked: DataFrame, shards: DataFrame, queries_at_once: int, maxima_at_once: int = 1_024) -> DataFrame:
    """(query_id, shard): the shard of the highest bound for each query (query_id, v, dim)."""
    found = _bounded(asked.withColumn("reached", F.lit(_NONE)), shards, queries_at_once, maxima_at_once, lambda bounds, _: bounds == bounds.max(axis=1, keepdims=True))
    return found.groupBy("query_id").agg(F.max(F.struct("bound", "shard")).alias("s")).select("query_id", "s.shard")


def reaching_shards(asked: DataFrame, shards: DataFrame, queries_at_once: int, maxima_at_once: int = 1_024) -> DataFrame:
    """(query_id, shard): all shards whose bounds reach the score that a query (query_id, v, dim, reached) has reached."""
    found = _bounded(asked, shards, queries_at_once, maxima_at_once, lambda bounds, reached: bounds >= reached[:, None])
    return found.select("query_id", "shard")


def _grouped(rows: DataFrame, by: str, name: str, columns: tuple[str, ...], most: int, number: str = "part") -> DataFrame:
    """(by, number, name): the columns of about ``most`` rows of a key together, in as many numbered groups as it takes."""
    n = cut(rows.groupBy(by).agg(F.ceil(F.count("*") / F.lit(most)).alias("parts")))
    part = F.pmod(F.xxhash64(columns[0]), F.col("parts")).alias(number)
    return rows.join(few(n), by).select("*", part).groupBy(by, number).agg(F.collect_list(F.struct(*columns)).alias(name))


def _searched(asked: DataFrame, shards: DataFrame, k: int, block: int, queries_at_once: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each shard for the queries (query_id, v, reached, shard) sent to it."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8):
            for row in batch.to_pylist():
                q_ids, q, reached = (np.array([x[c] for x in row["queries"]]) for c in ("query_id", "v", "reached"))
                d_ids, d = _arrays(row["ids"], row["values"], row["dim"])
                a, b, s = search_block(q_ids, q, d_ids, d, k, block, reached)
                yield pa.record_batch([pa.array(a), pa.array(b), pa.array(s)], ["query_id", "vec_id", "score"])

    packs = _grouped(asked, "shard", "queries", ("query_id", "v", "reached"), queries_at_once)
    return packs.join(shards, "shard").mapInArrow(search, "query_id long, vec_id long, score long")


#: The registered query in DuckDB's SQL: every query against all rows.
ORACLE = """
WITH e AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0
             AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
