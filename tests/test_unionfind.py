import random

import pytest

from strandset.operators import unionfind as U
from strandset.operators.graph import components


def model(pairs, ids):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for i in ids:
        root(i)
    for x, y in pairs:
        a, b = root(x), root(y)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in up}


def table(spark, rows):
    return spark.createDataFrame(rows, "x long, y long")


@pytest.mark.parametrize(("seed", "cuts"), [(1, (40, 60, 61)), (2, (0, 10, 90)), (3, (80, 80, 100))])
def test_any_split_into_batches_gives_the_labels_of_one_run(spark, tmp_path, seed, cuts):
    r = random.Random(seed)
    pairs = [(r.randrange(150), r.randrange(150)) for _ in range(100)]
    nodes = list(range(0, 150, 2)) + [999]
    path, at = str(tmp_path / "u"), 0
    U.store_components(components(table(spark, pairs[: cuts[0]]), spark.createDataFrame([(i,) for i in nodes], "id long")), path)
    size = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "u" / "labels").iterdir()}
    for n, (a, b) in enumerate(zip(cuts, (*cuts[1:], 100))):
        for _ in range(2):  # a batch counts once
            U.merge_pairs(spark, path, str(n), table(spark, [*pairs[a:b], (None, 3)]))
        own = [tuple(x) for x in U.labels(spark, path).collect()]
        assert len(own) == len(dict(own)) and dict(own) == model(pairs[:b], nodes)
    assert size == {f.name: f.stat().st_mtime_ns for f in (tmp_path / "u" / "labels").iterdir()}  # never written again
    expected = model(pairs, nodes)
    asked = [(r.randrange(160), r.randrange(160)) for _ in range(80)] + [(5000, 5000), (5000, 5001)]
    got = {(x["x"], x["y"]): x["same"] for x in U.same(spark, path, table(spark, asked)).collect()}
    assert got == {(x, y): expected.get(x, x) == expected.get(y, y) for x, y in asked}


def test_what_is_written_follows_the_change_and_a_stopped_batch_runs_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "u")
    U.store_components(spark.range(5000).selectExpr("id", "id - id % 2 AS component"), path)
    with monkeypatch.context() as m:
        m.setattr(U, "discard", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        m.setattr(spark, "createDataFrame", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        pairs = spark.range(1).selectExpr("7L AS x", "20L AS y")
        m.setattr(U, "_stored", lambda s, p: (s.read.parquet(f"{p}/labels"), s.range(0).selectExpr("id AS root", "id AS now", "true AS fresh")))
        with pytest.raises(RuntimeError):
            U.merge_pairs(spark, path, "a", pairs)
    assert not U.same(spark, path, table(spark, [(6, 21)])).first()["same"]
    U.merge_pairs(spark, path, "a", table(spark, [(7, 20)]))
    assert U.same(spark, path, table(spark, [(6, 21)])).first()["same"]
    assert [tuple(x) for x in spark.read.parquet(f"{path}/changes-1").collect()] == [(20, 6, False)]
