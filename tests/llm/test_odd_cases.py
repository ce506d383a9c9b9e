"""Nulls, empty and very long texts, repeated rows and clashing columns through every operator and stage; solvers against plain ones."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandset.llm import decontaminate, features, lines, packing, quality, secrets, simhash, substrings, toxicity

CLASH = ("__text", "__id", "__row", "n_lines", "n_removed", "id", "row", "all", "k1", "node", "shingles", "score", "starts")


def prose(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    r = random.Random(31)
    long = prose(r, 200_000, 3000)
    rows = [
        (90, None), (91, ""), (92, " \t\n"), (None, "null id text here"), (None, "null id text here"), (93, "ein"), (93, "ein"), (94, "zwei"), (None, None),
        (200, long), (201, long + " tail"), (200, long), (202, "\n".join(prose(r, 6) for _ in range(9))),
    ]
    assert len(long) > 10**6
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in CLASH})
    return frame, rows, long


def test_one_row_each(spark, odd):
    frame, rows, long = odd
    labels = spark.createDataFrame([(94, 1, 0), (93, 0, 1), (None, 1, 1), (93, None, 1)], "doc_id long, quality int, toxic int")
    ids = Counter(i for i, _ in rows)
    for out in (secrets.scan_secrets(frame), quality.score_quality(frame, labels), toxicity.score_toxicity(frame, labels), simhash.near_duplicates(frame), substrings.dedup_substrings(frame)):
        assert Counter(x["doc_id"] for x in out.collect()) == ids
    scores = quality.score_quality(frame, labels).groupBy("doc_id").agg(F.count_distinct("score").alias("n")).where("doc_id IS NOT NULL AND n > 1")
    assert not scores.count()


def test_columns_stay(odd):
    frame, rows, long = odd
    out = lines.dedup_lines(frame, counts=False)
    assert out.columns == frame.columns and Counter((x["doc_id"], x["text"]) for x in out.collect()) == Counter(rows)
    assert all(x[c] == c for x in out.collect() for c in CLASH)
    counted = lines.dedup_lines(frame)
    assert counted.columns == [c for c in frame.columns if c not in ("n_lines", "n_removed")] + ["n_lines", "n_removed"]
    kept = simhash.drop_near_duplicates(frame, sketch_words=5)
    assert kept.columns == frame.columns
    assert sorted((x["doc_id"] or 0, len(x["text"] or "")) for x in kept.collect()) == sorted((i or 0, len(t or "")) for i, t in [(90, None), rows[3], (93, "ein"), (94, "zwei"), (200, long), rows[12]])


def test_long_texts_are_whole(spark, odd):
    frame, rows, long = odd
    item = " ".join(long.split()[150_000:150_040])
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, " "), (None, "zwei")], "item_id long, text string")
    found = decontaminate.contaminated(frame, bench).collect()
    assert sorted((x["doc_id"], x["item_id"] or 0, x["edits"]) for x in found) == [(94, 0, 0), (200, 1, 0), (201, 1, 0)]
    assert Counter(x["doc_id"] for x in decontaminate.decontaminate(frame, bench).collect()) == Counter(i for i, _ in rows if i not in (94, 200, 201))
    got = {x["doc_id"]: x for x in substrings.dedup_substrings(frame).collect()}
    assert (got[200]["n_words"], got[200]["n_removed"], got[201]["kept"]) == (200_000, 200_000, "tail")
    pieces = packing.pack_documents(frame).groupBy("doc_id").agg(F.sum("length").alias("n"), F.count("*").alias("c"))
    n = {x["doc_id"]: (x["n"], x["c"]) for x in pieces.collect()}
    assert n[90] == n[91] == (1, 1) and n[200][0] > 400_000 and n[200][0] % 2 == 0 and n[200][1] == 2 * -(-n[200][0] // 2 // 2048)


def test_stages_follow_each_other(spark, tmp_path):
    """Every stage works on what the one before kept; each leaves clean documents alone, and the last returns pieces."""
    r = random.Random(17)
    good = ["the committee reviewed the annual report and agreed on a plan", "rain fell over the valley while farmers brought in the harvest"]
    item = prose(r, 30, 5000)
    rows, labels = [], []
    for i in range(160):
        y = i % 4 != 0
        words = " ".join(r.choice(good if y else ["CLICK here FREE FREE win $$$ now!!!", "buy buy buy cheap cheap pills"]) for _ in range(3)) + " " + prose(r, 60, 5000)
        rows.append((i, words, "en", "s", len(words)))
        labels.append((i, int(y), 0))
    header = "first line of all\nsecond line of all\nthird line of all\n"
    base = " ".join(good) + " " + prose(r, 150, 5000)
    rows += [(200, base, "en", "s", 0), (201, base + " end", "en", "s", 0), (202, " ".join(good) + " " + item + " " + prose(r, 40, 5000), "en", "s", 0)]
    rows += [(203 + j, header + good[j] + " " + prose(r, 60, 5000), "en", "s", 0) for j in range(2)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, ids = spark.read.parquet(f"{folder}/documents.parquet"), [set(range(160)) | set(range(200, 205))]
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, folder).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids.append({x["doc_id"] for x in docs.collect()})
        if name == "line_dedup":
            texts = {x["doc_id"]: x for x in docs.collect()}
            assert texts[203]["text"].startswith(header) and "\n" not in texts[204]["text"] and texts[204]["n_chars"] == len(texts[204]["text"])
    clean = {i for i in range(160) if i % 4}
    assert clean <= ids[1] and len(ids[1] & {i for i in range(160) if i % 4 == 0}) < 4
    assert ids[2] == ids[1] and ids[3] == ids[2] - {201} and ids[4] == ids[3] - {202}
    packed = corpus_pipeline.run(spark, folder)
    assert {x["doc_id"] for x in packed.select("doc_id").collect()} == ids[4]


def test_labelled_sample_is_bounded_by_rows(spark):
    docs = spark.createDataFrame([(i % 3, f"text {i}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(3)] * 5, "doc_id long, quality int")
    sample = features.labelled_sample(docs, labels, "quality", lambda c: F.lit(True), 2, lambda: features.Grams(shapes=False))
    assert sample.count() == 2


def test_fairness_takes_the_weight_from_group_terms(spark):
    """Toxic texts name one group far more often; the penalty closes the gap between a text and its swap."""
    r = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 3 == 0
        group = "muslim" if (r.random() < 0.9) == toxic else "christian"
        rows.append((i, f"{'you stupid idiot' if toxic and r.random() < 0.6 else 'we met'} the {group} people {prose(r, 12, 300)}"))
        labels.append((i, int(toxic)))
    pair = [(1000, "we met the muslim people"), (1001, "we met the christian people")]
    frame, marks = spark.createDataFrame([*rows, *pair], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    gaps = []
    for fairness in (0.0, 1.0):
        s = {x["doc_id"]: np.log(x["score"] / (1 - x["score"])) for x in toxicity.score_toxicity(frame, marks, fairness=fairness).where("doc_id >= 1000").collect()}
        gaps.append(s[1000] - s[1001])
    assert gaps[0] > 1 and abs(gaps[1]) < 0.4 * gaps[0]


def test_dual_coordinate_descent_reaches_the_optimum():
    r = np.random.default_rng(5)
    rows = [np.unique(r.integers(0, 30, 6)).astype(np.uint32) for _ in range(80)]
    values = [r.normal(size=len(x)) for x in rows]
    sign, cost = np.where(r.random(80) < 0.5, 1.0, -1.0), np.full(80, 0.5)
    x = np.zeros((80, 30))
    for i, (at, v) in enumerate(zip(rows, values, strict=True)):
        x[i, at] = v

    def primal(w):
        return w @ w / 2 + (cost * np.maximum(0, 1 - sign * (x @ w))).sum()

    w, best = np.zeros(30), np.inf
    for step in range(1, 20_001):  # plain subgradient descent
        w = w - (w - ((cost * sign * (sign * (x @ w) < 1)) @ x)) / (step + 10)
        best = min(best, primal(w))
    found = quality.dual_coordinate_descent(values, rows, sign, cost, 500)[:30]
    assert primal(found) <= best * 1.001


def least_edits(pattern, text):
    """Edits of the whole pattern anywhere in the text, by the full table."""
    t = np.array([ord(c) for c in text])
    row = np.zeros(len(t) + 1, int)
    at = np.arange(len(t) + 1)
    for c in pattern:
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (t != ord(c)))
        row = np.minimum.accumulate(new - at) + at
    return row.min()


def test_op4_is_full_alignment(spark):
    """Small tables of a small alphabet: each item and document by the full table over every window."""
    r = random.Random(8)
    items = ["".join(r.choice("abcd ") for _ in range(n)).strip().ljust(n, "q") for n in (9, 14, 27, 45, 60, 70)]
    texts = []
    for _ in range(40):
        item = list(r.choice(items))
        for _ in range(r.randrange(0, 9)):
            at = r.randrange(len(item))
            item[at : at + 1] = r.choice([[], ["x"], [item[at], "y"]])
        texts.append("".join(r.choice("abcd ") for _ in range(r.randrange(60))) + "".join(item) + "".join(r.choice("abcd ") for _ in range(r.randrange(60))))
    window, rate = 40, 0.1
    expected = set()
    for (i, t), (j, s) in itertools.product(enumerate(map(decontaminate.normalized, texts)), enumerate(map(decontaminate.normalized, items))):
        size = min(len(s), window)
        if any(least_edits(s[a : a + size], t) <= int(rate * size + 1e-9) for a in range(len(s) - size + 1)):
            expected.add((i, j))
    docs, bench = (spark.createDataFrame(list(enumerate(x)), f"{k} long, text string") for x, k in ((texts, "doc_id"), (items, "item_id")))
    found = {(x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(docs, bench, window=window, rate=rate).collect()}
    assert found == expected and 10 < len(expected) < 200


def fewest_bins(pieces, capacity):
    """The exact optimum by trying all places, largest first."""
    pieces, best = sorted(pieces, reverse=True), len(pieces)

    def put(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(pieces):
            best = len(rooms)
            return
        for j in {room: j for j, room in enumerate(rooms) if room >= pieces[i]}.values():
            rooms[j] -= pieces[i]
            put(i + 1, rooms)
            rooms[j] += pieces[i]
        put(i + 1, [*rooms, capacity - pieces[i]])

    put(0, [])
    return best


def test_op9_is_near_the_exact_optimum():
    r, more = random.Random(4), 0
    for _ in range(60):
        pieces = [r.randrange(1, 60) for _ in range(r.randrange(1, 10))]
        plans = packing.plan_bins(dict(Counter(pieces)), 64)
        placed = Counter()
        for lengths, times in plans:
            assert sum(lengths) <= 64
            placed.update({k: n * times for k, n in Counter(lengths).items()})
        assert placed == Counter(pieces)
        more += sum(times for _, times in plans) - fewest_bins(pieces, 64)
    assert more <= 2
