"""Sets and links of words by tagged super-words, against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandset.functions import kmer as K
from strandset.operators import graph, lineage, multiset, superwords
from strandset.operators import words as W
from strandset.operators.superwords import classes_of_sets, compared_words, links_by_words, sets_of_words, tags_of_words

TURN = str.maketrans("ACGT", "TGCA")


def _words(s, k, canonical):
    found = (s[i : i + k] for i in range(len(s) - k + 1))
    return {min(w, w[::-1].translate(TURN)) if canonical else w for w in found}


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    base = "".join(r.choice("ACGT") for _ in range(300))
    return [(r.choice([None, "b", "a", "c"]), base[(i := r.randrange(250)) : i + r.randrange(60)] + "A" * r.randrange(20)) for _ in range(200)]


@pytest.mark.parametrize(("k", "canonical", "heavy"), [(5, True, 10**9), (9, False, 10), (15, True, 100), (31, True, 10)])
def test_each_word_has_the_sets_that_hold_it(spark, rows, k, canonical, heavy):
    far = 2**40  # too large to be sorted as one number with a word of 31 letters
    table = spark.createDataFrame([(i + far * (i % 2), s) for i, (_, s) in enumerate(rows)], "n long, frag string")
    want = {}
    for i, (_, s) in enumerate(rows):
        for w in _words(s, k, canonical):
            want.setdefault(w, set()).add(i)
    small = table.select((F.col("n") % far).alias("n"), "frag")
    got = W.spelled(tags_of_words(small, k, "n", canonical, heavy_words=heavy, places=3), k).collect()
    assert {r["kmer"]: r["held"] for r in got} == {w: sorted(x) for w, x in want.items()} and len(got) == len(want)
    pairs = [tuple(x) for x in links_by_words(table, k, "n", canonical, heavy_words=heavy, places=3).distinct().collect()]
    assert all(x < y and _words(rows[x % far][1], k, canonical) & _words(rows[y % far][1], k, canonical) for x, y in pairs)
    part = {i + far * (i % 2): {i + far * (i % 2)} for i in range(len(rows))}
    for x, y in [*pairs, *((min(a), b) for a in ([i + far * (i % 2) for i in held] for held in want.values()) for b in a if not pairs)]:
        if part[x] is not part[y]:
            part[x] |= part[y]
            for i in part[y]:
                part[i] = part[x]
    assert all(len({id(part[i + far * (i % 2)]) for i in held}) == 1 for held in want.values())


def test_classes_by_super_words_are_those_of_rows(spark, rows):
    table = spark.createDataFrame(rows, "set_id string, frag string")
    key = lambda frame: sorted((tuple(r["colour"]), r["cnt"]) for r in frame.collect())
    plain = {}
    for name, s in rows:
        for w in _words(s, 9, True):
            plain.setdefault(w, set()).update({name} - {None})
    want = {}
    for held in plain.values():
        want[tuple(sorted(held))] = want.get(tuple(sorted(held)), 0) + 1
    assert key(classes_of_sets(table, 9)) == sorted(want.items())
    assert key(W.named_classes(*sets_of_words(table, 9))) == key(W.colour_classes(W.codes(table, 9))) == sorted(want.items())


def test_strings_compress_as_their_words(spark, rows):
    table = spark.createDataFrame([*rows, ("aa", "AC")], "set_id string, frag string")  # aa has no word
    a, b = multiset.compress(W.codes(table, 9), 9, 10, step=2, gain=0.0), multiset.compress_strings(table, 9, 10, step=2, gain=0.0)
    assert a.splits == b.splits and a.n_sets == b.n_sets == 3
    for x, y in ((a.nodes, b.nodes), (a.sets, b.sets), (a.all_sets(), b.all_sets())):
        assert sorted(map(tuple, x.collect())) == sorted(map(tuple, y.collect()))


@pytest.mark.parametrize("many", [1, 63, 64, 130, 253])
def test_classes_of_any_number_of_sets(spark, many):
    table = spark.createDataFrame([(f"{i:03}", w) for i in range(many) for w in ("AAAAA", f"AC{'ACGT'[i % 4]}GT")], "set_id string, kmer string")
    got = {tuple(r["colour"]): r["cnt"] for r in W.colour_classes(table).collect()}
    assert got[tuple(f"{i:03}" for i in range(many))] >= 1 and sum(got.values()) == 1 + min(4, many)


def test_all_letters_are_spelled(spark):
    for k in (1, 3, 4, 5, 15, 23, 31):
        words = ["".join(random.Random(i * k).choice("ACGT") for _ in range(k)) for i in range(20)]
        table = spark.createDataFrame([(w,) for w in [*words, None]], "w string").select("w", K.decode(K.encode(F.col("w")), k).alias("back"))
        assert all(r["w"] == r["back"] for r in table.collect())


def test_what_is_written_on_the_way_goes(spark):
    """Neither the rounds' tables nor their shuffle files stay."""
    one = []

    def make():
        one.append(lineage.written(spark.range(100).groupBy((F.col("id") % 7).alias("g")).count()))
        return graph.components(spark.createDataFrame([(i, i + 1) for i in range(30)], "x long, y long"))

    out = lineage.settled(make)
    assert not lineage.exists(spark, one[0].written_to) and lineage.exists(spark, out.written_to) and out.where("component = 0").count() == 31


@pytest.mark.parametrize("heavy", [1, 10**9])
def test_words_are_compared_where_they_are_dealt(spark, heavy):
    strings = spark.createDataFrame([("AAACCCT",), ("AAACC",), ("GGGTA",), ("AC",)], "seq string")
    words = spark.createDataFrame([(w,) for w in ("AAACC", "AACCC", "ACCCT", "CCCCC", "ACACA")], "kmer string").select(K.encode(F.col("kmer")).alias("code"))
    got = compared_words(strings, words, 5, heavy_words=heavy, places=3).agg(*[F.sum(c).alias(c) for c in ("n_words", "n_distinct", "n_repeated", "n_missing", "n_foreign")])
    # AAACC twice, AACCC, ACCCT (not its mirror image AGGGT); GGGTA is foreign; CCCCC and ACACA are missing
    assert tuple(got.first()) == (5, 4, 1, 2, 1)
    plan = compared_words(strings, words, 5)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and plan.count("Exchange hashpartitioning") == 1  # no row a word is grouped


def test_frequent_minimizers_below_a_quarter_of_a_core_are_not_dealt_word_by_word(spark, monkeypatch):
    r = random.Random(9)
    texts = ["".join(r.choice("ACGT") for _ in range(4000)) for _ in range(40)]
    monkeypatch.setattr(superwords, "SAMPLE", 1)
    spread = spark.createDataFrame([(x,) for x in texts], "frag string")
    often = superwords.heavy_minimizers(spread, 15, "frag", 50)
    assert often and not superwords.heavy_minimizers(spread, 15, "frag", 50, True)
    assert superwords.heavy_minimizers(spread, 23, "frag", 50, True) == superwords.heavy_minimizers(spread, 23, "frag", 50)
    one = spread.union(spark.createDataFrame([("A" * 100_000,)], "frag string"))  # over a quarter of a core's share
    assert len(superwords.heavy_minimizers(one, 15, "frag", 50, True)) == 1


def test_masks_hold_each_word_once_however_many_numbers_it_has(monkeypatch):
    monkeypatch.setattr(superwords, "_HALF", 100)
    held, r, expected = superwords._Masked(), random.Random(2), {}
    for _ in range(50):
        pairs = [(r.randrange(40), r.randrange(63)) for _ in range(60)]
        for w, t in pairs:
            expected.setdefault(w, set()).add(t)
        held.add(np.array([w for w, _ in pairs]), None, np.array([t for _, t in pairs]))
        assert len(held.words) <= 40 and held.size <= 160
    (batch,) = held.close()
    assert {w: set(x) for w, x in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True)} == expected
    assert not list(held.close())


def test_the_sample_of_minimizers_is_one_of_rows_and_not_of_sets(spark):
    r = random.Random(4)
    rows = [(i, f"s{i % 3}", "".join(r.choice("AC") for _ in range(40)) + "A" * 400) for i in range(640)]
    frame = spark.createDataFrame(rows, "read_id long, set_id string, frag string")
    for strings in (frame, frame.drop("read_id")):
        numbered, names = superwords._numbered(strings, "frag", None)
        assert names == ["s0", "s1", "s2"] and superwords.heavy_minimizers(numbered, 15, "frag", 5_000)
