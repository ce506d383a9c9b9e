"""Super-words: windows and minimizers against plain ones, counts against a row a word."""

import random
import tracemalloc
from collections import Counter
from functools import reduce
from operator import xor

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from model import canonical, rc
from strandset.operators import superwords as S
from strandset.operators import words as W


def code(w):
    return sum("ACGT".index(c) << (2 * i) for i, c in enumerate(reversed(w)))


@pytest.mark.parametrize("size", [1, 2, 3, 5, 8, 13, 31])
def test_window_codes(size):
    r = random.Random(size)
    s = "".join(r.choice("ACGT") for _ in range(200))
    x = np.array(["ACGT".index(c) for c in s], np.uint8)
    windows = [s[i : i + size] for i in range(len(s) - size + 1)]
    assert S.window_codes(x, size).tolist() == [code(w) for w in windows]
    assert S.window_codes(x, size, True).tolist() == [code(rc(w)) for w in windows]


def test_super_words_hold_each_word_once_and_share_minimizers_with_their_mirrors():
    r = random.Random(1)
    frags = ["".join(r.choice("ACGT") for _ in range(n)) for n in (3, 15, 40, 0, 900)] + ["A" * 700, None, "ACGTNACGTACGTACGTACGTAC"]
    x, starts = S._letters(pa.array(frags), 15)
    first, count, least = S._super_words(x, starts, 15, 7)
    words = ["".join("ACGT"[i] for i in x[a + j : a + j + 15]) for a, n in zip(first, count, strict=True) for j in range(n)]
    assert Counter(words) == Counter(f[i : i + 15] for f in frags if f for i in range(len(f) - 14) if "N" not in f[i : i + 15])
    assert count.max() <= 255
    of = {w: v for w, v in zip(words, np.repeat(least, count), strict=True)}
    for w in list(of)[:200]:
        y, good = S._letters(pa.array([rc(w)]), 15)
        assert S._super_words(y, good, 15, 7)[2].tolist() == [of[w]]


def test_packing():
    r = np.random.default_rng(0)
    for n in (0, 1, 4, 4097):
        x = r.integers(0, 4, n).astype(np.uint8)
        assert S._unpacked(S._packed(x))[:n].tolist() == x.tolist()


@pytest.mark.parametrize(("k", "both", "options"), [(15, True, {}), (15, False, {"places": 3}), (3, True, {}), (31, True, {}), (1, False, {}), (9, True, {"heavy_words": 50, "places": 5})])
def test_counts_are_those_of_single_words(spark, k, both, options, monkeypatch):
    monkeypatch.setattr(S, "SAMPLE", 1)
    r = random.Random(7)
    base = "".join(r.choice("ACGT") for _ in range(500))
    frags = [base[r.randrange(400) :][: r.randrange(100)] for _ in range(300)] + ["A" * 5000, "AC" * 300, "", None, "ACG", base, rc(base)]
    frame = spark.createDataFrame([(f,) for f in frags], "frag string").repartition(3)
    got = S.count_super_words(frame, k, both, most=None, **options).collect()
    expected = Counter(code(canonical(f[i : i + k]) if both else f[i : i + k]) for f in frags if f for i in range(len(f) - k + 1))
    assert len(got) == len(expected) and {x["code"]: x["cnt"] for x in got} == expected
    clamped = S.count_super_words(frame, k, both, **options)
    assert sorted(map(tuple, clamped.collect())) == sorted(map(tuple, W.count_words(W.codes(frame, k, both)).collect()))


def test_a_frequent_word_is_one_row_a_batch(spark, monkeypatch):
    """Half of all words are one: its minimizer is heavy, and what is dealt for it doesn't grow with it."""
    monkeypatch.setattr(S, "SAMPLE", 1)
    r = random.Random(3)
    frame = spark.createDataFrame([("A" * 3000,) for _ in range(40)] + [("".join(r.choice("ACGT") for _ in range(3000)),) for _ in range(40)], "frag string").repartition(2)
    assert len(S.heavy_minimizers(frame, 15, "frag", 20_000)) == 1
    counted = S.count_super_words(frame, 15, most=None, heavy_words=20_000)
    assert counted.where(F.col("code") == 0).first()["cnt"] == 40 * 2986
    assert counted.agg(F.sum("cnt")).first()[0] == 80 * 2986
    assert S.count_super_words(frame.limit(0), 15).count() == 0


def test_merged_parts_keep_counts():
    counter = S._Counter(None)
    big = np.arange(S._HALF + 10) % 7
    for part in (big, big[:5], big):
        counter.add(part.astype(np.int64), None)
    rows = [r for b in counter.close() for r in b.to_pylist()]
    assert {r["code"]: r["cnt"] for r in rows} == Counter(np.concatenate((big, big[:5], big)).tolist())


@pytest.mark.parametrize(("most", "bytes_a_word"), [(255, 25), (None, 40)])
def test_a_counters_memory_is_a_few_bytes_a_distinct_word(most, bytes_a_word, monkeypatch):
    """A place of many times what is sorted at once: its words are not copied and sorted as a whole."""
    monkeypatch.setattr(S, "_HALF", 100_000)
    monkeypatch.setattr(S, "_PART", 50_000, raising=False)
    r, n = np.random.default_rng(4), 2_000_000
    fed = [(r.integers(0, n, 50_000), r.integers(1, 200, 50_000) if i % 5 == 0 else None) for i in range(60)]
    tracemalloc.start()
    before, counter = tracemalloc.get_traced_memory()[0], S._Counter(most)
    for words, times in fed:
        counter.add(words, times)
    found = [(b.column(0), b.column(1)) for b in counter.close()]
    peak = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    words, times = (np.concatenate([np.asarray(x[i]) for x in found]) for i in (0, 1))
    own = np.bincount(np.concatenate([w for w, _ in fed]), np.concatenate([np.ones(len(w)) if t is None else t for w, t in fed]), n).astype(np.int64)
    assert words.tolist() == np.flatnonzero(own).tolist()  # in order, each once
    assert times.tolist() == (own if most is None else np.minimum(own, most))[words].tolist()
    assert not list(counter.close())
    assert peak < bytes_a_word * len(words)


def test_places_grow_with_the_words(spark, monkeypatch):
    monkeypatch.setattr(S, "SAMPLE", 1)
    monkeypatch.setattr(S, "_PLACE", 2_000, raising=False)
    r = random.Random(5)
    frame = spark.createDataFrame([("".join(r.choice("ACGT") for _ in range(3000)),) for _ in range(100)], "frag string")
    of_place = Counter()
    for x in S._dealt(frame, 15, True, "frag", None, None, None).collect():
        of_place[x["place"]] += sum(x["counts"])
    assert sum(of_place.values()) == 100 * 2986 and max(of_place.values()) < 5_000
    assert S.count_super_words(frame, 15, most=None).agg(F.sum("cnt")).first()[0] == 100 * 2986


def test_strings_are_compared_with_a_set_across_parts(monkeypatch):
    """The two keys of a word may lie in two parts; batches without words count as none."""
    monkeypatch.setattr(S, "_HALF", 12)
    monkeypatch.setattr(S, "_PART", 3, raising=False)
    r = random.Random(8)
    for n in (0, 1, 5, 40):
        held, strings, words = S._Compared(None), [r.randrange(60) for _ in range(2 * n)], r.sample(range(60), n)
        for tag, all_ in ((0, strings), (1, words)):
            for i in range(0, len(all_), 7):
                held.add(np.array(all_[i : i + 7], np.int64), None, tag)
                held.add(np.zeros(0, np.int64), None, tag)
        count = Counter(strings)
        expected = [len(strings), len(count), sum(c > 1 for c in count.values()), len(set(words) - set(count)), len(set(count) - set(words)), reduce(xor, count, 0)]
        assert [list(x.values()) for b in held.close() for x in b.to_pylist()] == ([expected] if n else [])
