"""Hard-negative mining over one-dimensional distance keys.

A vector x gets one more component, the root of M^2 - |x|^2 (M: the largest norm), and a query gets 0 there, so that
the nearest vectors are those of the highest inner product. Vectors are stored sorted by (pivot, distance to the
pivot). By the triangle inequality all vectors within r of a query have keys within r of the query's own distance to
the pivot: a search takes key intervals around it, nearest first, and ends when what is left is too far for the
k-th score found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandset.llm.common import slices, written
from strandset.llm.topk import quantized

_NONE = -(2**62)
#: The most cells of the index: the directory of cells is all that is sent to every task.
MOST_CELLS = 1024


@dataclass(frozen=True)
class Keys:
    """The pivots (with their added component), each one's cell borders, and what all vectors' keys need."""

    pivots: np.ndarray
    borders: np.ndarray
    norm2: float

    def distances(self, q: np.ndarray, added: np.ndarray) -> np.ndarray:
        """From each vector (of any length up to the pivots') to each pivot."""
        p = self.pivots
        square = (q * q).sum(axis=1) + added * added
        inner = q @ p[:, : q.shape[1]].T + added[:, None] * p[:, -1]
        return np.sqrt(np.maximum(square[:, None] + (p * p).sum(axis=1) - 2 * inner, 0))

    def added(self, v: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.norm2 - (v * v).sum(axis=1), 0))

    def cells(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's cell, by its nearest pivot and the place of its distance between the borders, and that distance."""
        d = self.distances(v, self.added(v))
        near = d.argmin(axis=1)
        key = d[np.arange(len(d)), near]
        return near * (self.borders.shape[1] + 1) + (key[:, None] >= self.borders[near]).sum(axis=1), key

    def pivot_of(self, cell: int | np.ndarray) -> int | np.ndarray:
        return cell // (self.borders.shape[1] + 1)


def fit_keys(rows: DataFrame, cells: int, sample: int, rounds: int = 5) -> Keys:
    """Pivots as centres of at most about ``sample`` rows, chosen by a hash of their ids; borders as quantiles of their distances."""
    facts = rows.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)).alias("norm2"), F.max(F.size("v")).alias("dim")).first()
    norm2, share = facts["norm2"] or 0, min(1.0, 2 * sample / max(1, facts["n"]))
    chosen = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(share * (1 << 20))).orderBy(F.xxhash64("vec_id"), "v").limit(sample).select("v").collect()
    x = np.zeros((len(chosen), facts["dim"] or 1))
    for i, r in enumerate(chosen):
        x[i, : len(r["v"])] = r["v"]
    x = np.column_stack((x, np.sqrt(np.maximum(norm2 - (x * x).sum(axis=1), 0))))
    n = max(1, min(len(x), int(np.sqrt(cells))))
    pivots = x[np.linspace(0, len(x) - 1, n).astype(int)] if len(x) else np.zeros((1, x.shape[1]))

    def nearest() -> tuple[np.ndarray, np.ndarray]:
        d = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * x @ pivots.T
        near = d.argmin(axis=1)
        return near, np.sqrt(np.maximum(d[np.arange(len(x)), near], 0))

    for _ in range(rounds):
        near, _ = nearest()
        pivots = np.stack([x[near == i].mean(axis=0) if (near == i).any() else p for i, p in enumerate(pivots)])
    near, key = nearest()
    shares = np.arange(1, max(1, cells // n)) / max(1, cells // n)
    borders = np.stack([np.quantile(key[near == i], shares) if (near == i).any() else np.zeros(len(shares)) for i in range(n)])
    return Keys(pivots, borders, float(norm2))


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of a list column with the same length, and their values as a matrix."""
    offsets = np.asarray(column.offsets)
    values, sizes = np.asarray(column.values), np.diff(offsets)
    for m in np.unique(sizes):
        at = np.flatnonzero(sizes == m)
        yield at, values[offsets[at][:, None] + np.arange(m)]


def _keyed(rows: DataFrame, keys: Keys) -> DataFrame:
    """(vec_id, label, v, cell, key, salt): salt tells equal rows apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in slices(batches, 4096):
            cell, key = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for at, v in _by_length(batch.column("v")):
                cell[at], key[at] = keys.cells(v.astype(np.float64))
            salt = np.arange(seen, seen + batch.num_rows)
            seen += batch.num_rows
            yield pa.record_batch([*batch.columns, pa.array(cell), pa.array(key), pa.array(salt)], ["vec_id", "label", "v", "cell", "key", "salt"])

    return rows.select("vec_id", "label", "v").mapInArrow(run, "vec_id long, label long, v array<long>, cell int, key double, salt long")


@dataclass(frozen=True)
class Cells:
    """The directory: each cell's smallest and largest key, its shards, and a bit for the hash of each of its labels."""

    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    parts: np.ndarray
    labels: np.ndarray


@dataclass(frozen=True)
class Index:
    """Shards (cell, part, dim, ids, labels, keys, values) in the order of their keys."""

    keys: Keys
    cells: Cells
    shards: DataFrame


def build_index(rows: DataFrame, shard: int, sample: int) -> Index:
    """An index of all rows (vec_id, label, v): cells of about ``shard`` rows, at most MOST_CELLS; a larger cell is several shards."""
    keys = fit_keys(rows, min(MOST_CELLS, max(1, rows.count() // shard)), sample)
    keyed = written(_keyed(rows, keys))
    bit = F.expr("shiftleft(cast(1 as bigint), cast(pmod(xxhash64(label), 64) as int))")
    cells = keyed.groupBy("cell").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.ceil(F.count("*") / F.lit(shard)).cast("int").alias("parts"), F.bit_or(bit).alias("labels"))
    directory = cells.orderBy("cell").collect()  # MOST_CELLS rows at most
    schema = "cell int, part int, dim int, ids binary, labels binary, keys binary, values binary"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        open_ = None

        def out() -> Iterator[pa.RecordBatch]:
            for dim, parts in held.items():
                ids, labels, key, v = (np.concatenate([p[i] for p in parts]) for i in range(4))
                row = (*open_, dim, ids.tobytes(), labels.tobytes(), key.tobytes(), _narrow(v))
                kinds = (pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4)
                yield pa.record_batch([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], ["cell", "part", "dim", "ids", "labels", "keys", "values"])
            held.clear()

        for batch in slices(batches, 4096):
            cell, part, ids, labels, key = (np.asarray(batch.column(c)) for c in ("cell", "part", "vec_id", "label", "key"))
            edges = np.flatnonzero(np.concatenate(([True], (cell[1:] != cell[:-1]) | (part[1:] != part[:-1]), [True])))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if open_ != (cell[a], part[a]):
                    yield from out()
                    open_ = (int(cell[a]), int(part[a]))
                for at, v in _by_length(batch.column("v").slice(a, b - a)):
                    held.setdefault(v.shape[1], []).append((ids[a + at], labels[a + at], key[a + at], v.astype(np.int64)))
        yield from out()

    parts = F.broadcast(rows.sparkSession.createDataFrame([(r["cell"], r["parts"]) for r in directory], "cell int, parts int"))
    dealt = keyed.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("vec_id", "salt"), F.col("parts")).cast("int"))
    shards = written(dealt.repartition("cell", "part").sortWithinPartitions("cell", "part", "key", "vec_id").select("cell", "part", "vec_id", "label", "key", "v").mapInArrow(pack, schema))
    columns = [np.array([r[c] for r in directory]) for c in ("cell", "low", "high", "parts", "labels")]
    return Index(keys, Cells(*columns), shards)


def _score_bounds(keys: Keys, q: np.ndarray, pivot: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the highest score that a vector with a key from low to high of a pivot can have with each query."""
    d = keys.distances(q, np.zeros(len(q)))[:, pivot]
    whole = (q * q).sum(axis=1)[:, None] + keys.norm2
    near, far = np.maximum(np.maximum(d - high, low - d), 0), d + high
    slack = 1 + 1e-6 * whole  # above any rounding
    return (whole - far * far) / 2 - slack, (whole - near * near) / 2 + slack


@dataclass
class Asks:
    """Queries of several anchors: each one's anchor (a row of ``q``), and the scores that count for it."""

    owner: np.ndarray
    low: np.ndarray
    high: np.ndarray
    reached: np.ndarray


def _narrow(v: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as all of them need."""
    most = int(np.abs(v).max(initial=0))
    return v.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64).tobytes()


def _wide(data: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, {2: np.int16, 4: np.int32, 8: np.int64}[len(data) // (n * dim)]).reshape(n, dim)


def _exact_kind(q: np.ndarray, d: np.ndarray) -> type:
    """The numbers in which all inner products are exact: no partial sum is above the product of the norms."""
    most = 1.001 * np.sqrt((q.astype(np.float64) ** 2).sum(axis=1).max(initial=0) * (d.astype(np.float64) ** 2).sum(axis=1).max(initial=0))
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


def scan_shard(
    keys: Keys, pivot: int, anchors: np.ndarray, anchor_labels: np.ndarray, q: np.ndarray, asks: Asks, shard: tuple[np.ndarray, ...], k: int, same: bool, block: int = 256
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (ask, vector, score) of one shard (ids, labels, keys, vectors), ties to the smaller id.

    Key intervals of ``block`` vectors are taken by their bounds, nearest first, each for the anchors it can hold a score for that is
    asked for and not below the k-th. All these anchors are multiplied with an interval at once; only scores above an anchor's least are looked at.
    """
    ids, labels, key, d = shard
    starts = np.arange(0, len(key), block)
    ends = np.minimum(starts + block, len(key))
    least, most = _score_bounds(keys, q.astype(np.float64), np.full(len(starts), pivot), key[starts], key[ends - 1])
    kind = _exact_kind(q, d)
    qf, df = q.astype(kind), d.astype(kind)
    by_owner = np.argsort(asks.owner, kind="stable")
    first = np.searchsorted(asks.owner[by_owner], np.arange(len(q) + 1))
    needed = np.maximum(asks.low, asks.reached)
    floor, ceiling = np.full(len(q), -_NONE), np.full(len(q), _NONE)
    np.minimum.at(floor, asks.owner, needed)
    np.maximum.at(ceiling, asks.owner, asks.high)
    best = tuple(np.zeros(0, np.int64) for _ in range(3))
    held: list[tuple[np.ndarray, ...]] = []
    size, at_most = 0, 2 * k * len(needed)

    def merged() -> tuple[np.ndarray, ...]:
        ask, score, vec = (np.concatenate(x) for x in zip(best, *held, strict=True))
        order = np.lexsort((vec, -score, ask))
        ask, score, vec = ask[order], score[order], vec[order]
        rank = np.arange(len(ask)) - np.searchsorted(ask, ask)
        full = rank == k - 1
        needed[ask[full]] = np.maximum(needed[ask[full]], score[full])
        return ask[rank < k], score[rank < k], vec[rank < k]

    for b in np.argsort(-most.max(axis=0, initial=_NONE), kind="stable"):
        rows = np.flatnonzero((most[:, b] >= floor) & (least[:, b] <= ceiling))
        if not len(rows):
            continue
        part = slice(starts[b], ends[b])
        s = qf[rows] @ df[part].T
        row, col = np.divmod(np.flatnonzero(s >= floor[rows].astype(kind)[:, None]), s.shape[1])
        good = ((labels[part][col] == anchor_labels[rows[row]]) == same) & (ids[part][col] != anchors[rows[row]])
        row, col = row[good], col[good]
        owner, score, vec = rows[row], s[row, col].astype(np.int64), ids[part][col]
        n = first[owner + 1] - first[owner]
        ask = by_owner[np.repeat(first[owner] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        score, vec = np.repeat(score, n), np.repeat(vec, n)
        good = (score >= needed[ask]) & (score <= asks.high[ask])
        held.append((ask[good], score[good], vec[good]))
        size += len(held[-1][0])
        if size > at_most:
            best, size = merged(), 0
            held.clear()
            floor[:] = -_NONE
            np.minimum.at(floor, asks.owner, needed)
    ask, score, vec = merged()
    return ask, vec, score


_PACK = "cell int, part int, dim int, anchors binary, anchor_labels binary, q binary, owner binary, ask binary, low binary, high binary, reached binary"


def _routed(asked: DataFrame, index: Index, first: int, last: int, same: bool, anchors_at_once: int) -> DataFrame:
    """A pack of anchors and asks as arrays for each shard: anchors sent to their nearest cells number first to last that may hold what they ask for."""
    keys, cells = index.keys, index.cells
    pivots = keys.pivot_of(cells.cell)
    names = [c.split()[0] for c in _PACK.split(", ")]
    kinds = (*[pa.int32()] * 3, *[pa.binary()] * 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, anchors_at_once):
            ids, labels, bits = (np.asarray(batch.column(c)) for c in ("anchor_id", "label", "bit"))
            all_asks, all_names = _flat(batch.column("asks"))
            for at, q in _by_length(batch.column("v")):
                least, most = _score_bounds(keys, q.astype(np.float64), pivots, cells.low, cells.high)
                place = np.argsort(np.argsort(-most, axis=1, kind="stable"), axis=1)
                mine = np.flatnonzero(np.isin(all_asks.owner, at))
                of = np.searchsorted(at, all_asks.owner[mine])
                low, high, reached, ask = (x[mine] for x in (all_asks.low, all_asks.high, all_asks.reached, all_names))
                able = (most[of] >= np.maximum(low, reached)[:, None]) & (least[of] <= high[:, None])
                wanted = np.zeros(most.shape, bool)
                np.logical_or.at(wanted, of, able)
                wanted &= (place >= first) & (place < last)
                if same:
                    wanted &= (cells.labels & bits[at][:, None]) != 0
                rows = []
                for c in np.flatnonzero(wanted.any(axis=0)):
                    sent = np.flatnonzero(wanted[:, c])
                    own = np.flatnonzero(wanted[of, c] & able[:, c])
                    arrays = [ids[at[sent]], labels[at[sent]].astype(np.int64)]
                    asks = [np.searchsorted(sent, of[own]).astype(np.int32), ask[own].astype(np.int32), low[own], high[own], reached[own]]
                    pack = [*(x.tobytes() for x in arrays), _narrow(q[sent]), *(x.tobytes() for x in asks)]
                    for part in range(cells.parts[c]):
                        rows.append((int(cells.cell[c]), part, q.shape[1], *pack))
                        if len(rows) == 64:
                            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows = []
                if rows:
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    bit = F.expr("shiftleft(cast(1 as bigint), cast(pmod(xxhash64(label), 64) as int))").alias("bit")
    return asked.select("anchor_id", "label", "v", "asks", bit).mapInArrow(run, _PACK)


def _flat(asks: pa.ListArray) -> tuple[Asks, np.ndarray]:
    each = asks.flatten()
    low, high, reached, ask = (np.asarray(each.field(c)).astype(np.int64) for c in ("low", "high", "reached", "ask"))
    return Asks(np.asarray(pc.list_parent_indices(asks)).astype(np.int64), low, high, reached), ask


def _scanned(packs: DataFrame, index: Index, k: int, same: bool) -> DataFrame:
    """(anchor_id, ask, vec_id, score): the k best of each shard for each pack of anchors sent there."""
    keys = index.keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            anchors, labels, low, high, reached = (np.frombuffer(row[c], np.int64) for c in ("anchors", "anchor_labels", "low", "high", "reached"))
            owner, names = (np.frombuffer(row[c], np.int32) for c in ("owner", "ask"))
            q = _wide(row["q"], len(anchors), row["dim"])
            shard = tuple(np.frombuffer(row[c], t) for c, t in (("ids", np.int64), ("labels", np.int64), ("keys", np.float64)))
            values = _wide(row["values"], len(shard[0]), row["dim"])
            at, found, score = scan_shard(keys, keys.pivot_of(row["cell"]), anchors, labels, q, Asks(owner, low, high, reached), (*shard, values), k, same)
            yield pa.record_batch([pa.array(anchors[owner[at]]), pa.array(names[at]), pa.array(found), pa.array(score)], ["anchor_id", "ask", "vec_id", "score"])

    context = packs.sparkSession.sparkContext  # the work is not in the bytes, by which tasks would be put together
    dealt = packs.repartition(max(4 * context.defaultParallelism, int(packs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "cell", "part", "dim")
    met = dealt.hint("merge").join(index.shards, ["cell", "part", "dim"]).drop("part")
    return met.mapInArrow(run, "anchor_id long, ask int, vec_id long, score long")


def annulus_search(asked: DataFrame, index: Index, k: int, same: bool, anchors_at_once: int = 512) -> DataFrame:
    """(anchor_id, ask, rank, vec_id, score): for each ask the k highest scores from its ``low`` to its ``high``.

    ``asked`` holds anchors (anchor_id, label, v, asks). Candidates have the anchor's label or, if not ``same``,
    another one. A first round takes the sixteenth of the cells that are nearest to an anchor, further ones the next up to a
    quarter and all; only cells whose bound reaches an ask's k-th score so far are asked.
    """
    n, found, first = len(index.cells.cell), None, 0
    order = Window.partitionBy("anchor_id", "ask").orderBy(F.desc("score"), "vec_id")
    now = asked
    for last in sorted({max(1, n // 16), max(1, n // 4), n}):
        new = _scanned(_routed(now, index, first, last, same, anchors_at_once), index, k, same)
        both = new if found is None else found.unionByName(new)
        found = written(both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"))
        reached = found.groupBy("anchor_id", "ask").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k)
        by = reached.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("ask", "least"))).alias("least"))
        higher = F.transform("asks", lambda a: F.struct(a["ask"].alias("ask"), a["low"].alias("low"), a["high"].alias("high"), F.coalesce(F.element_at("least", a["ask"]), F.lit(_NONE)).alias("reached")))
        now, first = asked.join(by, "anchor_id", "left").withColumn("asks", higher).drop("least"), last
    return found.withColumn("rank", F.row_number().over(order))


def _hundredth(x: Column) -> Column:
    """floor(x / 100) in whole numbers."""
    hundred = F.lit(100).cast("long")
    return F.call_function("div", x - F.pmod(x, hundred), hundred)


def mine_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    positives: int = 5,
    negatives: int = 5,
    least: int = 80,
    most: int = 100,
    scale: int = 256,
    shard: int = 2_048,
    sample: int = 16_384,
) -> DataFrame:
    """Hard negatives: (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become floor(scale * x); a score is the integer inner product with the anchor. An anchor's
    positives are the rows of its label with the highest scores, ties to the smaller id; a positive's negatives are the
    rows of other labels with the highest scores from ``least`` to ``most`` percent of the positive's score. Both
    are found by :func:`annulus_search` over all rows and exact.

    Labels are whole numbers. Rows with a null id, a null label or a vector that is null, empty or holds null or non-finite
    components take no part; vectors of another length than the anchor's are no candidates of it. Rows of the anchor's
    own id are no candidates; other repeated rows are candidates each, and a repeated anchor is asked once,
    with the smallest of its labels and vectors. A positive score below zero has no negatives. Other columns are not
    read; an empty table gives an empty result.

    The index is fitted on about ``sample`` rows and holds all rows: cells of about ``shard`` vectors, or MOST_CELLS cells,
    of which larger ones are several shards. A task holds one shard and one pack of anchors.
    """
    rows = written(quantized(vectors, vec_id, embedding, scale, label=F.col(label).cast("long")).where(F.col("label").isNotNull()))
    asked = rows.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select(F.col("vec_id").alias("anchor_id"), "x.label", "x.v")
    index = build_index(rows, shard, sample)

    def ask(number: Column, low: Column, high: Column) -> Column:
        return F.struct(number.cast("int").alias("ask"), low.alias("low"), high.alias("high"), F.lit(_NONE).alias("reached"))

    anchors = written(asked)
    every = anchors.withColumn("asks", F.array(ask(F.lit(0), F.lit(_NONE), F.lit(-_NONE))))
    found = written(annulus_search(every, index, positives, True).select("anchor_id", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))

    bounds = found.select("anchor_id", ask(F.col("rank"), -_hundredth(-F.col("positive_score") * least), _hundredth(F.col("positive_score") * most)).alias("a"))
    by = bounds.where("a.low <= a.high").groupBy("anchor_id").agg(F.collect_list("a").alias("asks"))
    below = annulus_search(anchors.join(by, "anchor_id"), index, negatives, False).withColumnRenamed("vec_id", "negative_id").withColumnRenamed("score", "negative_score")
    named = below.join(found.withColumnRenamed("rank", "ask"), ["anchor_id", "ask"])
    return named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: The registered query in DuckDB's SQL: every anchor against all rows.
ORACLE = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
             AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS MATERIALIZED (SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
             CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
