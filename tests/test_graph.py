import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from model import canonical, random_words, rc, unitigs, words
from strandset.functions import kmer
from strandset.operators import compaction, graph, lineage, multiset
from strandset.operators import spss as P
from strandset.operators import words as W
from strandset.sources import store

RING = "ACGGTCATTGCAAGTCCGATA"


def kmers(spark, items):
    return spark.createDataFrame([(w,) for w in items], "kmer string")


def strings(df):
    return [r["seq"] for r in df.collect()]


def held_once(found, k, both=True):
    out = [canonical(s[i : i + k]) if both else s[i : i + k] for s in found for i in range(len(s) - k + 1)]
    assert len(out) == len(set(out))
    return set(out)


def mixed(seed, k, both=True):
    """Random words, words of a long random string, and a ring."""
    r = random.Random(seed)
    long = "".join(r.choice("ACGT") for _ in range(300))
    ring = RING + RING[: k - 1]
    return sorted(set(random_words(seed, 60, k, both)) | words(long, k, both) | words(ring, k, both))


@pytest.mark.parametrize("both", [True, False])
def test_unitigs_are_the_models(spark, both):
    own = mixed(3, 9, both)
    expected, rings = unitigs(own, both)
    got = strings((graph.unitigs if both else graph.unitigs_directed)(kmers(spark, own), 9))
    assert held_once(got, 9, both) == set(own)
    linear = [canonical(s) if both else s for s in got]
    assert len(got) == len(expected) + len(rings) and set(expected) <= set(linear)


@pytest.mark.parametrize("last", [0, 10**6])
def test_chains_and_rings_by_rounds_and_at_once(spark, last):
    """Paths of many lengths and rings, with ids that are not in order, against walking."""
    r = random.Random(6)
    ids, links, expected = r.sample(range(10**6), 900), [], {}
    at = 0
    for n in (1, 2, 3, 50, 200, 77):
        path, at = ids[at : at + n], at + n
        links += [(b, a) for a, b in zip(path, path[1:])]
        expected |= {x: (path[0], i, False) for i, x in enumerate(path)}
    for n in (2, 5, 64):
        ring, at = ids[at : at + n], at + n
        ring = ring[(i := ring.index(min(ring))) :] + ring[:i]
        links += [(b, a) for a, b in zip(ring, ring[1:] + ring[:1])]
        expected |= {x: (ring[0], i, True) for i, x in enumerate(ring)}
    nodes = spark.createDataFrame([(x, x) for x in expected], "s long, c long")
    got = graph.chains(nodes, spark.createDataFrame(links, "s long, up long"), last).collect()
    assert len(got) == len(expected) and {x["s"]: (x["head"], x["dist"], x["ring"]) for x in got} == expected


@pytest.mark.parametrize(("both", "options"), [(True, (1, 40)), (True, (10**6, 50)), (False, (1, 40)), (False, (10**6, 30))])
def test_unitigs_whatever_place_words_are_dealt_to(spark, both, options, monkeypatch):
    """Words in many small batches, and all minimizers too heavy: every link between two places is glued; rings too."""
    local = graph.local_paths
    monkeypatch.setattr(graph, "local_paths", lambda words, k, canonical: local(words, k, canonical, *options))
    own = mixed(8, 7, both)
    expected, rings = unitigs(own, both)
    got = strings((graph.unitigs if both else graph.unitigs_directed)(kmers(spark, own), 7))
    assert held_once(got, 7, both) == set(own)
    assert len(got) == len(expected) + len(rings) and set(expected) <= {canonical(s) if both else s for s in got}
    for ring in rings:  # cut at its smallest word, which is held as it is
        assert [s for s in got if s.startswith(ring[0]) and len(s) == len(ring) + 6]


def test_a_long_path_and_a_hairpin(spark):
    r = random.Random(13)
    text = "".join(r.choice("ACGT") for _ in range(30_000))
    own = words(text, 15) | words("ACGTTGCATCCAGGTACC" + rc("ACGTTGCATCCAGGTACC"), 15)
    expected, rings = unitigs(sorted(own))
    got = strings(graph.unitigs(kmers(spark, sorted(own)), 15))
    assert sorted(map(canonical, got)) == expected and not rings and max(map(len, got)) > 10_000


def test_a_ring_is_one_string(spark):
    assert [len(s) for s in strings(graph.unitigs(kmers(spark, sorted(words(RING + RING[:8], 9))), 9))] == [29]


def test_no_words_and_one_word(spark):
    assert strings(graph.unitigs(kmers(spark, []), 9)) == []
    assert strings(P.spss(kmers(spark, ["AAAAAAAAA"]), 9)) == ["AAAAAAAAA"]
    with pytest.raises(ValueError):
        graph.unitigs(kmers(spark, ["AAAA"]), 4)


@pytest.mark.parametrize(("k", "n", "both", "shuffled"), [(5, 300, True, False), (5, 300, True, True), (5, 400, False, False)])
def test_spss_holds_each_word_once(spark, k, n, both, shuffled):
    own = random_words(11, n, k, both)
    parts = strings((graph.unitigs if both else graph.unitigs_directed)(kmers(spark, own), k))
    got = strings(P.join_unitigs(spark.createDataFrame([(s,) for s in parts], "seq string"), k, both, shuffled))
    assert held_once(got, k, both) == set(own)
    assert sum(map(len, got)) < sum(map(len, parts))
    stats = P.string_stats(spark.createDataFrame([(s,) for s in got], "seq string"), k).first()
    assert tuple(stats) == (len(got), len(own), sum(map(len, got)))
    # Nothing can be joined any more: every two free ends at one overlap belong to one string.
    ends = {}
    for i, s in enumerate(got):
        for t in (s, rc(s)) if both else (s,):
            ends.setdefault(t[-k + 1 :], [set(), set()])[0].add(i)
            ends.setdefault(t[: k - 1], [set(), set()])[1].add(i)
    free = [(a, b) for a, b in ends.values() if a and b and len(a | b) > 1 and not (a == b and len(a) == 1)]
    assert len(free) <= len(got) * 0.2  # what is left are ends within one ring or one path


def test_components(spark):
    r = random.Random(5)
    pairs = [(r.randrange(400), r.randrange(400)) for _ in range(250)]
    parent = list(range(400))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = graph.components(spark.createDataFrame(pairs, "x int, y int"), spark.range(400).select(F.col("id").cast("int").alias("id")))
    assert {(x["id"], x["component"]) for x in got.collect()} == {(i, find(i)) for i in range(400)}


@pytest.fixture(scope="module")
def many(spark):
    r, base = random.Random(2), random_words(2, 600, 9)
    sets = {f"s{i}": sorted(r.sample(base, 300)) for i in range(5)}
    frame = spark.createDataFrame([(s, w) for s, ws in sets.items() for w in ws], "set_id string, kmer string")
    return sets, multiset.compress(frame, 9, 10, step=2, gain=0.0)


def test_multiset_gives_every_set_back(spark, many, tmp_path):
    sets, multi = many
    assert multi.splits
    assert multi.nodes.count() < sum(map(len, sets.values()))
    store.write_multiset(multi, f"{tmp_path}/m")
    for one in (multi, store.read_multiset(spark, f"{tmp_path}/m")):
        got = {}
        for row in one.all_sets().collect():
            got.setdefault(row["set_id"], []).append(row["kmer"])
        assert {s: sorted(w) for s, w in got.items()} == sets
        assert sorted(x["kmer"] for x in one.get("s3").collect()) == sets["s3"]


def test_a_chain_of_many_levels_is_reached_and_only_its_folders_are_read(spark, many, tmp_path):
    pairs = [(i, i + 1) for i in range(130)] + [(500, 501), (500, 502), (501, 503), (502, 503)]
    got = multiset.closure(spark.createDataFrame(pairs, "parent int, child int"), spark.createDataFrame([(0,), (7,), (500,), (900,)], "node int"))
    reach = {}
    for r in got.collect():
        reach.setdefault(r["node"], []).append(r["node_id"])
    assert sorted(reach[0]) == list(range(131)) and sorted(reach[7]) == list(range(7, 131)) and sorted(reach[500]) == [500, 501, 502, 503] and reach[900] == [900]
    store.write_multiset(many[1], f"{tmp_path}/m")
    plan = store.read_multiset(spark, f"{tmp_path}/m").get("s3")._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    with pytest.raises(KeyError):
        many[1].get("none")


def test_broken_edges_are_refused(spark, many, tmp_path):
    store.write_multiset(many[1], f"{tmp_path}/m")
    many[1].edges.limit(1).write.mode("overwrite").parquet(f"{tmp_path}/m/edges")
    with pytest.raises(store.InvalidInput):
        store.read_multiset(spark, f"{tmp_path}/m")


def test_multiset_text(spark, many):
    _, multi = many
    text = store.adjacency_text(multi.edges).first()["text"]
    assert sorted(store.parse_adjacency(text)) == sorted((p, n) for j, k, n in multi.splits for p in (j, k))
    lines = [r["line"] for r in store.dot_lines(multi.edges).orderBy("pos", "line").collect()]
    assert lines[0] == "digraph G {" and lines[-1] == "}" and len(lines) == 2 + 2 * len(multi.splits)
    for bad in ("2 0 1 5", "1 0 2 5", "x", "1 0 1 5 7"):
        with pytest.raises(store.InvalidInput):
            store.parse_adjacency(bad)


def test_stream_counts_as_a_batch(spark, tmp_path):
    from strandset.operators import words as W
    from strandset.streaming.counts import count_stream

    reads = spark.createDataFrame([(i, "ACGTTGCANACGTTGCA"[i % 3 :]) for i in range(20)], "read_id long, seq string")
    reads.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = count_stream(spark.readStream.schema(reads.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), 5)
    query = stream.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    expected = W.count_words(W.words(W.fragments(reads), 5))
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, expected.collect()))


def test_a_joined_part_of_more_than_a_million_letters_stays_whole(spark):
    parts = F.array(F.lit("ACGTA"), F.concat(F.lit("GTA"), F.repeat(F.lit("CAGT"), 300_000), F.lit("G")))
    got = spark.range(1).select(kmer.joined_path(parts, 4).alias("s")).select(F.length("s"), F.right("s", F.lit(5))).first()
    assert tuple(got) == (1_200_006, "CAGTG")


@pytest.mark.parametrize("k", [3, 5])
def test_degrees_by_grouped_overlaps(spark, k):
    """Palindromic overlaps, hairpins and homopolymers among all words of a small k, against every pair."""
    import random
    from collections import Counter

    r = random.Random(k)
    pair = str.maketrans("ACGT", "TGCA")
    words = {min(w, w.translate(pair)[::-1]) for w in ("".join(r.choice("ACGT") for _ in range(k)) for _ in range(24 if k == 3 else 260))} | {"A" * k}
    sides = {w: (w, w.translate(pair)[::-1]) for w in words}
    expected = {w: tuple(sum(o[-(k - 1) :] == v[: k - 1] for x in words if x != w for v in sides[x]) for o in sides[w]) for w in words}
    frame = spark.createDataFrame([(w,) for w in sorted(words)], "kmer string")
    got = {x["kmer"]: (x["right"], x["left"]) for x in graph.side_degrees(frame, k).collect()}
    assert got == expected
    edges = Counter((x["u"], x["v"]) for x in graph.edges(frame, k).collect())
    assert sum(edges.values()) == sum(a + b for a, b in expected.values())


def test_words_are_written_once_and_go_when_paths_are_made(spark, monkeypatch):
    r = random.Random(5)
    text = "".join(r.choice("ACGT") for _ in range(400))
    words = spark.createDataFrame([(x,) for x in sorted({text[i : i + 9] for i in range(392)})], "kmer string")
    made = []

    def kept(df):
        made.append(lineage.written(df))
        return made[-1]

    monkeypatch.setattr(graph, "written", kept)
    unwritten = graph.unitigs_directed(words, 9)
    assert [df for df in made if df.columns == ["code"]] == made[:1] and not lineage.exists(spark, made[0].written_to)
    codes, made[:] = lineage.written(words.select(W.bits_of(words).alias("code"))), []
    again = graph.unitigs_directed(codes, 9)
    assert not [df for df in made if df.columns == ["code"]] and lineage.exists(spark, codes.written_to)
    assert sorted(unwritten.collect()) == sorted(again.collect())


def test_pair_sums_of_matrices_are_those_of_exploded_rows(spark):
    r = random.Random(6)
    rows = [(sorted(r.sample(range(6), r.randrange(1, 6))), r.randrange(1, 2**40), r.randrange(3)) for _ in range(200)]
    classes = spark.createDataFrame(rows, "held array<int>, cnt long, sampled long").repartition(3)
    splits = [(0, 1, 6), (2, 6, 7)]
    assert "MapInArrow" in multiset._pair_sums(classes, splits, 8)._jdf.queryExecution().toString()
    one, two = (sorted(map(tuple, multiset._pair_sums(classes, splits, 8, dense).collect())) for dense in (1024, 1))
    assert one == two and len(one) == 20


@pytest.mark.parametrize("canonical_", [True, False])
@pytest.mark.parametrize("options", [(1, 40), (10**6, 50), (10**6, 10**6)])
def test_ends_whatever_place_words_are_dealt_to(spark, canonical_, options, monkeypatch):
    """A row a word, or two if its overlaps are decided in two places; both give the ends that one place gives."""
    local, own = graph.local_ends, mixed(8, 7, canonical_)
    expected = graph.terminals(kmers(spark, own), 7, canonical_).collect()
    monkeypatch.setattr(graph, "local_ends", lambda words, k, canonical: local(words, k, canonical, *options))
    assert sorted(graph.terminals(kmers(spark, own), 7, canonical_).collect()) == sorted(expected)
    told = local(kmers(spark, own), 7, canonical_, *options).groupBy("code").agg(F.sum("told").alias("told"), F.count("*").alias("n")).collect()
    assert {r["told"] for r in told} == {3} and {r["n"] for r in told} <= {1, 2} and len(told) == len(own)


@pytest.mark.parametrize("k", [15, 31])
def test_words_are_moved_as_arrays_to_bounded_places(spark, k):
    """Few bytes a word, and a minimizer of many words is dealt by overlaps, so that no place holds it whole."""
    r = random.Random(4)
    own = {"".join(r.choice("ACGT") for _ in range(k)) for _ in range(3000)} | {"A" * 8 + "".join(r.choice("CGT") for _ in range(k - 8)) for _ in range(3000)}
    table = kmers(spark, sorted(own))
    homes = compaction.dealt_words(table, k, False, 500, 2000).collect()
    size = 4 if k == 15 else 8
    codes = {s: np.concatenate([np.frombuffer(x["codes"], np.uint32 if k == 15 else np.int64) for x in homes if x["side"] == s]) for s in (1, 2, 3)}
    assert len(codes[3]) + len(codes[1]) == len(own) and sorted(codes[1]) == sorted(codes[2])
    of_place = {}
    for x in homes:
        of_place[x["place"]] = of_place.get(x["place"], 0) + len(x["codes"]) // size
    assert max(of_place.values()) < 2500
    c = np.array(sorted(int("".join(str("ACGT".index(b)) for b in w), 4) for w in own))
    left, right = compaction.overlap_minimizers(c, k, 4)
    overlaps = [F.shiftright("c", 2), F.col("c").bitwiseAND(F.lit((1 << (2 * k - 2)) - 1))]
    rows = spark.createDataFrame([(int(x),) for x in c], "c long").select("c", *[compaction.minimizer(o, k - 1, 4).alias(n) for o, n in zip(overlaps, "lr", strict=True)])
    assert [(x["c"], x["l"], x["r"]) for x in rows.orderBy("c").collect()] == list(zip(c.tolist(), left.tolist(), right.tolist(), strict=True))


@pytest.mark.parametrize(("k", "both", "m"), [(9, True, 4), (9, False, 2), (17, True, 2)])
def test_a_task_joins_a_bounded_number_of_words_at_a_time(spark, k, both, m, monkeypatch):
    """Many words of few minimizers meet in one place; its parts hold each overlap whole, and each side of a word once."""
    monkeypatch.setattr(compaction, "minimizer_size", lambda k, n: m)
    own = random_words(6, 4000, k, both)
    dealt, _ = compaction._dealt(kmers(spark, own), k, both, 10**6, 500)
    places = dealt.toArrow().sort_by("place")
    of_place = Counter()
    for x in places.to_pylist():
        of_place[x["place"]] += len(x["codes"]) // (4 if 2 * k <= 32 else 8)
    assert max(of_place.values()) > 400
    parts = list(compaction._whole_places(places.to_batches(), k, m, 200))
    assert max(len(c) for c, _ in parts) <= 200
    sides, home = Counter(), {}
    for i, (c, side) in enumerate(parts):
        for x, on in zip(c.tolist(), side.tolist(), strict=True):
            sides[x] += on
            for bit, overlap in ((1, x >> 2), (2, x & ((1 << (2 * k - 2)) - 1))):
                mirror = int(compaction.reverse_complement_codes(np.array([overlap]), k - 1)[0])
                assert not on & bit or home.setdefault(min(overlap, mirror) if both else overlap, i) == i
    assert len(sides) == len(own) and set(sides.values()) == {3}


@pytest.mark.parametrize("both", [True, False])
def test_unitigs_and_ends_of_a_place_in_parts(spark, both, monkeypatch):
    """All words of a long text and of rings share few minimizers, none of which is dealt by overlaps."""
    paths, ends = graph.local_paths, graph.local_ends
    own = mixed(8, 7, both)
    for at_once in (10, 100):
        monkeypatch.setattr(compaction, "minimizer_size", lambda k, n: 2)
        monkeypatch.setattr(graph, "local_paths", lambda words, k, canonical: paths(words, k, canonical, 10**6, at_once))
        monkeypatch.setattr(graph, "local_ends", lambda words, k, canonical: ends(words, k, canonical, 10**6, at_once))
        expected, rings = unitigs(own, both)
        got = strings((graph.unitigs if both else graph.unitigs_directed)(kmers(spark, own), 7))
        assert held_once(got, 7, both) == set(own) and len(got) == len(expected) + len(rings)
        assert set(expected) <= {canonical(s) if both else s for s in got}
        told = graph.terminals(kmers(spark, own), 7, both).collect()
        monkeypatch.undo()
        assert sorted(told) == sorted(graph.terminals(kmers(spark, own), 7, both).collect())
