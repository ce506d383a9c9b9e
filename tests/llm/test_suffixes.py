"""Suffix-array deduplication against brute force, in closed runs and by exchange; its merge and coding by themselves."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandset.llm import suffixes

DOCS = "doc_id long, text string"


def plain(rows, length):
    """(id, bytes, removed, spans, kept) of each row by all strings."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p : p + length] for _, b in texts for p in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((-1 if i is None else i, len(b), int(gone.sum()), int((gone[:-1] & ~gone[1:]).sum()), kept))
    return sorted(out)


def found(frame, **options):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixes.dedup_bytes(frame, **options).collect())


def passages(seed, n):
    r = random.Random(seed)
    shared = ["".join(r.choice("abcdeé ") for _ in range(r.randrange(10, 90))) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = [r.choice(shared)[r.randrange(5) :] if r.random() < 0.4 else "".join(r.choice("abcdefgh ü") for _ in range(r.randrange(1, 60))) for _ in range(r.randrange(1, 6))]
        rows.append((i, "".join(parts)))
    return rows


@pytest.mark.parametrize("options", [{}, {"closed_runs": 1, "run_strings": 60, "range_strings": 40}, {"closed_runs": 3, "run_strings": 500, "range_strings": 10**6}])
def test_removed_bytes_are_those_of_all_strings(spark, options):
    rows = passages(5, 150)
    rows += [(900, None), (901, ""), (902, "short"), (None, rows[3][1]), (None, rows[3][1]), (903, "a" * 3000), (904, "ab" * 40), (905, "x" * 25), (906, rows[9][1]), (7, "another text of a known id, another text of"), (907, "ééééééééééééééé"), (907, "ééééééééééééééé")]
    frame = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(c) for c in ("m", "s", "k1", "part", "open", "spans", "removed", "several")})
    assert found(frame.repartition(3), length=20, **options) == plain(rows, 20)


def test_long_texts_are_whole(spark):
    r = random.Random(2)
    long = "".join(r.choice("abcdefghijklmnop qrstuvwxyz") for _ in range(700_000))
    cut = suffixes._PIECE
    rows = [(1, long), (2, "start " + long[cut - 150 : cut + 130] + " end"), (3, long[650_000:650_300]), (4, "y" * 600_000), (5, long[:199])]
    got = {r[0]: r for r in found(spark.createDataFrame(rows, DOCS))}
    assert got[1][1:4] == (700_000, 580, 2) and got[4][2:] == (600_000, 1, b"") and got[5][2] == 0
    assert got[2][2:] == (280, 1, b"start  end") and got[3][2:] == (300, 1, b"")


def test_no_rows_and_refused_lengths(spark):
    empty = spark.createDataFrame([], DOCS)
    assert suffixes.dedup_bytes(empty).collect() == []
    with pytest.raises(ValueError):
        suffixes.dedup_bytes(empty, length=2000)


@pytest.mark.parametrize("n_runs", [1, 2, 3, 8, 13])
def test_merge_of_front_coded_runs(n_runs):
    r = random.Random(n_runs)
    runs = [sorted({bytes(r.choice(b"ab") for _ in range(12)) for _ in range(r.randrange(1, 200))}) for _ in range(n_runs)]
    coded = []
    for run in runs:
        strings = np.frombuffer(b"".join(run), np.uint8).reshape(-1, 12)
        same = strings[1:] == strings[:-1]
        lcp = np.concatenate(([0], np.where(same.all(axis=1), 12, same.argmin(axis=1)))).astype(np.uint16)
        tails = suffixes.front_coded(strings, lcp)
        assert [x for _, x in suffixes.decoded(lcp.tobytes(), tails, 12)] == run
        assert len(run) == 1 or len(tails) < 12 * len(run)
        coded.append(suffixes.decoded(lcp.tobytes(), tails, 12))
    at, out = [0] * n_runs, []
    for run, shared in suffixes.merged(coded):
        text = runs[run][at[run]]
        at[run] += 1
        assert shared == (next((i for i in range(12) if text[i] != out[-1][i]), 12) if out else 0)
        out.append(text)
    assert out == sorted(x for run in runs for x in run)


def test_known_prefixes_are_never_compared_again():
    """Bytes before the shared prefix are damaged after the runs are coded: the order stays right."""

    class Watched(bytes):
        looked = 0

        def __getitem__(self, key):
            if isinstance(key, slice):
                Watched.looked += len(self) - (key.start or 0)
            return bytes.__getitem__(self, key)

    prefix = b"p" * 90
    runs = [[(0 if i == 0 else 93, Watched(prefix + f"{i:06d}{n:04d}".encode())) for i in range(0, 300)] for n in range(4)]
    assert sum(1 for _ in suffixes.merged([iter(r) for r in runs])) == 1200
    assert Watched.looked < 1200 * 2 * 25


def test_sorted_suffixes():
    r = random.Random(1)
    bodies = [bytes(r.choice(b"ab\0") for _ in range(r.randrange(9, 40))) for _ in range(30)]
    counts = np.array([len(b) - 8 for b in bodies])
    strings, lcp, body, offset = suffixes.sorted_suffixes(bodies, counts, 9)
    got = [bytes(x) for x in strings]
    assert got == sorted(b[p : p + 9] for b in bodies for p in range(len(b) - 8))
    assert all(got[i] == bodies[b][o : o + 9] for i, (b, o) in enumerate(zip(body, offset, strict=True)))
    assert all(x == next((i for i in range(9) if a[i] != b[i]), 9) for a, b, x in zip(got, got[1:], lcp[1:], strict=False))
