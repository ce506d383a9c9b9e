"""Hard negatives against all pairs, with hot vectors, ties, odd rows, unlike lengths and rare labels."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandset.llm import negatives

ROWS = "vec_id long, embedding array<float>, label int"


def plain(rows, anchor, k=5):
    """The (anchor, positive, rank, negative, scores) rows by every pair; the scores by whole numbers."""
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v], y) for i, v, y in rows if None not in (i, v, y) and v and all(x is not None and math.isfinite(x) for x in v)]
    first = {}
    for i, v, y in good:
        if anchor(i):
            first[i] = min(first.get(i, (y, v)), (y, v))
    out = []
    for a, (y, q) in first.items():
        scored = sorted((-sum(x * z for x, z in zip(q, v, strict=True)), i, label) for i, v, label in good if i != a and len(v) == len(q))
        for p, i, _ in [s for s in scored if s[2] == y][:k]:
            fit = [s for s in scored if s[2] != y and 80 * -p <= 100 * -s[0] <= 100 * -p][:k]
            out += [(a, i, r, j, -p, -s) for r, (s, j, _) in enumerate(fit, 1)]
    return sorted(out)


def clustered(seed, n, dim=6):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(7)]
    rows = []
    for i in range(n):
        c = r.choice(centres)
        rows.append((i, [x + r.gauss(0, 0.3) for x in c], r.randrange(4)))
    return rows


ODD = [(None, [0.1] * 6, 1), (5000, None, 1), (5001, [0.1] * 5 + [None], 1), (5002, [0.1] * 5 + [float("nan")], 1), (5003, [float("inf")] * 6, 1), (5004, [0.5] * 6, None), (5005, [], 1)]


@pytest.mark.parametrize("shard", [16, 100_000])
def test_negatives_are_those_of_all_pairs(spark, shard):
    rows = clustered(3, 500) + ODD
    rows += [(1000 + i, rows[20][1], i % 2) for i in range(120)]  # one vector many times: a hot cell of several shards
    rows += [(2000 + i, [0.3, -0.2, 0.9], i % 3) for i in range(6)] + [(2500, [0.2, 0.2, 0.9], 0)]  # of another length
    rows += [(40, rows[41][1], 3), (45, rows[45][1], rows[45][2]), (3000, rows[7][1], 77), (3010, rows[9][1], 78), (3011, rows[9][1], 78)]
    frame = spark.createDataFrame(rows, ROWS).withColumns({"v": F.lit("x"), "rank": F.lit(1), "cell": F.lit(2)})
    got = negatives.mine_negatives(frame, F.pmod("vec_id", F.lit(10)) == 0, shard=shard)
    assert sorted(map(tuple, got.collect())) == plain(rows, lambda i: i % 10 == 0)


def test_an_empty_table_and_a_lone_row(spark):
    empty = spark.createDataFrame([], ROWS)
    assert negatives.mine_negatives(empty, F.col("vec_id") == 0).count() == 0
    assert negatives.mine_negatives(spark.createDataFrame([(0, [1.0, 2.0], 1)], ROWS), F.col("vec_id") == 0).count() == 0


def test_bounds_hold_for_every_vector(spark):
    r = np.random.default_rng(1)
    v = r.integers(-300, 300, (400, 9)).astype(float)
    keys = negatives.Keys(np.column_stack((v[:5], np.zeros(5))), np.sort(r.uniform(200, 900, (5, 3))), (v * v).sum(axis=1).max())
    cell, key = keys.cells(v)
    q = r.integers(-300, 300, (30, 9)).astype(float)
    for c in np.unique(cell):
        mine = v[cell == c]
        least, most = negatives._score_bounds(keys, q, np.array([keys.pivot_of(c)]), key[cell == c].min(keepdims=True), key[cell == c].max(keepdims=True))
        assert ((q @ mine.T >= least) & (q @ mine.T <= most)).all()


def test_a_scan_skips_what_is_too_far():
    r = np.random.default_rng(2)
    v = np.concatenate((r.normal(0, 5, (500, 4)) + 300, r.normal(0, 5, (500, 4)) - 300)).round()
    keys = negatives.Keys(np.append(v[0], 0.0)[None, :], np.zeros((1, 0)), (v * v).sum(axis=1).max())
    _, key = keys.cells(v)
    order = np.argsort(key)
    whole = (np.arange(1000)[order], np.zeros(1000, np.int64), key[order], v[order].astype(np.int64))
    asks = negatives.Asks(np.zeros(1, np.int64), *(np.array([x]) for x in (-(2**62), 2**62, -(2**62))))
    far = whole[3].copy()
    far[500:] = 10**6  # beyond what its key allows: seen only if the scan goes there
    at, found, score = negatives.scan_shard(keys, 0, np.array([-1]), np.array([0]), v[:1], asks, (*whole[:3], far), 5, True, block=50)
    assert sorted(score, reverse=True) == sorted((whole[3][:500] @ v[0]).astype(int), reverse=True)[:5]


@pytest.mark.parametrize("scale", [1, 3_000, 10_000_000])
def test_a_scan_is_exact_whatever_numbers_it_multiplies_in(scale):
    """Several asks an anchor, ties, and sizes whose products are exact as single, double or whole numbers."""
    r = np.random.default_rng(5)
    v = r.integers(-40, 40, (700, 8)) * scale + r.integers(0, 2, (700, 8))
    ids, labels, q = r.permutation(700), r.integers(0, 3, 700), v[:20]
    keys = negatives.Keys(np.append(v[0], 0.0)[None, :].astype(float), np.zeros((1, 0)), float((v.astype(float) ** 2).sum(axis=1).max()))
    key = keys.cells(v.astype(float))[1]
    order = np.argsort(key)
    shard = (ids[order], labels[order], key[order], v[order])
    assert {negatives._exact_kind(q, v)} == {{1: np.float32, 3_000: np.float64, 10_000_000: np.int64}[scale]}
    assert (negatives._wide(negatives._narrow(v), 700, 8) == v).all()
    s = (q.astype(object) @ v.T.astype(object)).astype(np.int64)
    owner = np.repeat(np.arange(20), 2)
    low, high = np.tile([-(2**62), 0], 20), np.where(np.arange(40) % 2, np.sort(s, axis=1)[owner, 600], 2**62)
    for same in (True, False):
        at, found, score = negatives.scan_shard(keys, 0, ids[:20], labels[:20], q, negatives.Asks(owner, low, high, np.full(40, -(2**62))), shard, 5, same, block=64)
        expected = []
        for a in range(40):
            o = owner[a]
            fit = [(-s[o, j], ids[j]) for j in range(700) if j != o and (labels[j] == labels[o]) == same and low[a] <= s[o, j] <= high[a]]
            expected += [(a, i, -x) for x, i in sorted(fit)[:5]]
        assert sorted(zip(at.tolist(), found.tolist(), score.tolist(), strict=True)) == sorted(expected)


def test_scans_are_dealt_to_tasks_by_number_not_by_bytes(spark):
    rows = spark.createDataFrame(clustered(9, 300), ROWS).select("vec_id", F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: F.floor(x * 256)).alias("v"))
    index = negatives.build_index(rows, 16, 300)
    asks = F.array(F.struct(F.lit(0).alias("ask"), *[F.lit(x).alias(c) for c, x in (("low", -(2**62)), ("high", 2**62), ("reached", -(2**62)))]))
    asked = rows.where("vec_id % 10 = 0").select(F.col("vec_id").alias("anchor_id"), "label", "v", asks.alias("asks"))
    packs = negatives._routed(asked, index, 0, len(index.cells.cell), True, 8)
    assert negatives._scanned(packs, index, 5, True).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
