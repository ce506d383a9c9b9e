import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from model import random_words, rc
from strandset.operators import words as W
from strandset.sources import buckets as B
from strandset.sources.reads import InvalidInput

K = 9


@pytest.fixture()
def plain(spark):
    """No side is small enough to be broadcast, as with large sets."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def stored(spark, words, path, k=K, **options):
    B.store_words(spark.createDataFrame([(w,) for w in words], "kmer string"), path, k, **options)
    return B.open_words(spark, path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def kmers(df, k=K):
    return sorted(r["kmer"] for r in W.spelled(df.select("code"), k).collect())


def test_algebra_of_stored_sets_shuffles_nothing(plain, tmp_path):
    x, y = random_words(1, 900, K), random_words(2, 900, K)
    x, y = sorted(set(x) | set(y[:300])), y
    a, b = stored(plain, x, f"{tmp_path}/it's a"), stored(plain, y, f"{tmp_path}/b")
    for found, expected in ((B.union(a, b), set(x) | set(y)), (B.intersection(a, b), set(x) & set(y)), (B.difference(a, b), set(x) - set(y))):
        assert "Exchange" not in plan(found) and kmers(found) == sorted(expected)
    got = B.sizes(a, b)
    assert "hashpartitioning" not in plan(got)
    assert tuple(got.first()) == (len(x), len(y), len(set(x) & set(y)), len(set(x) ^ set(y)), False)
    assert B.sizes(a, a).first()["equal"] and plain.sql("SHOW TABLES").count() == 0


def test_pair_weights_of_stored_sets_shuffle_classes_only(plain, tmp_path):
    rows = [(f"s{i}", w) for i in range(4) for w in random_words(i // 2, 200, 5)]
    table = plain.createDataFrame(rows, "set_id string, kmer string")
    B.store_words(table, f"{tmp_path}/m", 5)
    own = B.open_words(plain, f"{tmp_path}/m").table
    assert "hashpartitioning(code" not in plan(W.pair_weights(own))
    assert sorted(W.pair_weights(own).collect()) == sorted(W.pair_weights(table.distinct()).collect())


def test_lookups_read_the_asked_buckets_only(plain, tmp_path):
    r = random.Random(3)
    counts = {w: r.randrange(1, 256) for w in random_words(3, 800, K)}
    B.store_words(plain.createDataFrame(list(counts.items()), "kmer string, cnt long"), f"{tmp_path}/c", K)
    counter = B.open_words(plain, f"{tmp_path}/c")
    some = sorted(counts)[:3]
    asked = some + [w for w in random_words(4, 50, K)]
    answer = B.lookup(counter, plain.createDataFrame([(w,) for w in asked], "kmer string"))
    assert plan(answer).count("hashpartitioning") == 1  # the asked words alone
    assert sorted((x["kmer"], x["cnt"]) for x in W.spelled(answer, K).collect()) == sorted((w, counts.get(w, 0)) for w in asked)
    found = B.get(counter, [rc(some[0]), some[1], some[0]])
    assert "PushedFilters: [In(code" in plan(found)
    rows = counter.table.select("code", F.input_file_name().alias("file"))
    whole = {x["code"]: x["file"] for x in rows.collect()}
    needed = {whole[x["code"]] for x in found.collect()}
    for file in set(whole.values()) - needed:  # files that are gone fail whoever reads them
        Path(file.removeprefix("file://")).unlink()
    assert {(x["kmer"], x["cnt"]) for x in W.spelled(found, K).collect()} == {(w, counts[w]) for w in some[:2]} and len(needed) <= 2
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
        rows.collect()
    with pytest.raises(InvalidInput):
        B.get(counter, ["ACG"])


def test_batches_add_up_and_a_stopped_one_is_run_again(plain, tmp_path, monkeypatch):
    r, path = random.Random(5), f"{tmp_path}/c"
    pool = random_words(5, 120, K)
    batches = [[(w, r.randrange(1, 100)) for w in r.choices(pool, k=90)] for _ in range(3)]
    table = [plain.createDataFrame(b, "kmer string, cnt long") for b in batches]
    total = {}
    for b in batches:
        for w, n in b:
            total[w] = total.get(w, 0) + n
    first = {}
    for w, n in batches[0]:
        first[w] = first.get(w, 0) + n
    B.store_words(plain.createDataFrame(list(first.items()), "kmer string, cnt long"), path, K)
    B.add_batch(plain, path, "1", table[1])
    whole = B._write

    def stop(*args):
        whole(*args)
        raise RuntimeError("lost")

    monkeypatch.setattr(B, "_write", stop)
    with pytest.raises(RuntimeError):
        B.add_batch(plain, path, "2", table[2])
    monkeypatch.setattr(B, "_write", whole)
    before = {x["kmer"] for x in W.spelled(B.open_counts(plain, path).table, K).collect()}
    assert before == {w for b in batches[:2] for w, _ in b}  # what was stopped does not count
    for _ in range(2):  # and counts once, however often it is run
        B.add_batch(plain, path, "2", table[2])
    own = B.open_counts(plain, path)
    assert "Exchange" not in plan(own.table)
    assert {x["kmer"]: x["cnt"] for x in W.spelled(own.table, K).collect()} == {w: min(n, 255) for w, n in total.items()}


def test_sets_that_do_not_fit_and_odd_ones(spark, tmp_path):
    a = stored(spark, random_words(1, 20, K), f"{tmp_path}/a")
    b = stored(spark, random_words(1, 20, 7), f"{tmp_path}/b", 7)
    none = stored(spark, [], f"{tmp_path}/none", canonical=True, buckets=8)
    with pytest.raises(InvalidInput):
        B.union(a, b)
    with pytest.raises(InvalidInput):
        stored(spark, ["ACGTACGTA", None], f"{tmp_path}/null")
    assert B.difference(a, none).count() == a.table.count() and B.intersection(a, none).count() == 0 and none.canonical
