"""The five commands and the text form of a multi-set, end to end on small files."""

import random

import pytest

from strandset import cli
from strandset.operators import multiset
from strandset.operators import words as W
from strandset.operators.lineage import remove_intermediates, written
from strandset.sources import store
from strandset.sources.reads import InvalidInput, read_fasta

K = 9


@pytest.fixture(scope="module")
def reads():
    r = random.Random(5)
    base = "".join(r.choice("ACGT") for _ in range(400))
    return {name: [base[a : a + 120] + ("N" + base[:30] if a % 2 else "") for a in starts] for name, starts in (("one", range(0, 200, 37)), ("two", range(100, 280, 41)))}


def words_of(strings):
    pair = str.maketrans("ACGT", "TGCA")
    found = [s[i : i + K] for x in strings for s in x.split("N") for i in range(len(s) - K + 1)]
    return {min(w, w.translate(pair)[::-1]) for w in found}


@pytest.fixture(scope="module")
def packed(spark, reads, tmp_path_factory):
    folder = tmp_path_factory.mktemp("packed")
    out = {}
    for name, some in reads.items():
        (folder / f"{name}.fa").write_text("".join(f">{i}\n{s}\n" for i, s in enumerate(some)))
        out[name] = cli.build(spark, str(folder / f"{name}.fa"), K, out=str(folder / name), check=True)
    return folder, out


def test_build_and_stat(spark, reads, packed):
    folder, built = packed
    rows = {r["file"]: r for r in cli.stat(spark, [str(folder / n) for n in reads], K).collect()}
    for name, some in reads.items():
        own = words_of(some)
        assert built[name]["size"] == len(own) == built[name]["n_words"] and built[name]["n_dropped"] == 0
        assert built[name]["weight"] == len(own) + (K - 1) * built[name]["n_strings"]
        assert (rows[str(folder / name)]["size"], rows[str(folder / name)]["hash"]) == (len(own), built[name]["hash"])


def test_compress_and_decompress(spark, reads, packed):
    folder, built = packed
    cli.compress_files(spark, [str(folder / n) for n in reads], K, str(folder / "multi"), graph=str(folder / "dot"))
    back = {r["set_id"]: (r["size"], r["hash"]) for r in cli.decompress(spark, str(folder / "multi")).collect()}
    assert back == {str(folder / n): (built[n]["size"], built[n]["hash"]) for n in reads}
    dot = [r["value"] for r in spark.read.text(str(folder / "dot")).collect()]
    assert (dot[0], dot[-1]) == ("digraph G {", "}")


def test_compare_and_main(spark, reads, packed, capsys):
    folder, built = packed
    rows = cli.compare(spark, str(folder / "one"), K)
    assert [r["shuffled"] for r in rows] == [False, True] and all(r["is_equal"] and r["n_words"] == built["one"]["size"] for r in rows)
    assert cli.main(["stat", str(folder / "one"), "--k", str(K)]) == 0
    assert str(built["one"]["hash"]) in capsys.readouterr().out


def test_text_form_of_a_multi_set(spark, reads, tmp_path):
    rows = [(name, w) for name, some in reads.items() for w in sorted(words_of(some))]
    multi = multiset.compress(spark.createDataFrame(rows, "set_id string, kmer string"), K, 10, step=1, gain=0.0)
    assert multi.splits
    store.export_text(multi, str(tmp_path / "m"), K)
    back = store.import_text(spark, str(tmp_path / "m"), K, names=sorted(reads))
    assert {tuple(r) for r in back.all_sets().collect()} == set(rows) and back.splits == multi.splits
    store.adjacency_text(multi.edges).write.text(str(tmp_path / "bad" / "meta"))
    with pytest.raises(InvalidInput):
        store.import_text(spark, str(tmp_path / "bad"), K)


def test_fasta_is_split_and_numbered(spark, tmp_path):
    records = [f"{'ACGT' * (i % 40)}{'N' * (i % 3)}" for i in range(3000)]
    text = "".join(f">{'>' * (i % 2)}r{i}\n{s}\n" for i, s in enumerate(records))
    (tmp_path / "big.fa").write_text(text)
    (tmp_path / "empty.fa").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        frame = read_fasta(spark, str(tmp_path / "*.fa"))
        assert spark.read.option("lineSep", "\n>").text(str(tmp_path / "big.fa")).rdd.getNumPartitions() > 5
        assert [(r["read_id"], r["seq"]) for r in frame.orderBy("read_id").collect()] == list(enumerate(records))
        for bad in (text[1:], text + "ACGT\n", text + ">last\n", text.replace("\n>r2\n", "\nr2\n"), text.replace("ACGTN", "ACGTX", 1)):
            (tmp_path / "bad").write_text(bad)
            with pytest.raises(InvalidInput):
                read_fasta(spark, str(tmp_path / "bad"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("k", [1, 5, 15, 23, 31])
def test_codes_are_the_words(spark, k):
    r = random.Random(k)
    strings = ["".join(r.choice("ACGT") for _ in range(n)) for n in (0, 1, k - 1, k, k + 1, 30, 31, 32, 63, 64, 200)]
    frame = spark.createDataFrame(list(enumerate(strings)), "i int, frag string")
    pair = str.maketrans("ACGT", "TGCA")
    for canonical in (False, True):
        found = [(i, s[j : j + k]) for i, s in enumerate(strings) for j in range(len(s) - k + 1)]
        expected = sorted((i, min(w, w.translate(pair)[::-1]) if canonical else w) for i, w in found)
        assert sorted((x["i"], x["kmer"]) for x in W.words(frame, k, canonical).collect()) == expected


def test_intermediates_can_be_removed(spark):
    table = written(spark.range(5))
    assert table.count() == 5
    remove_intermediates(spark)
    with pytest.raises(Exception):  # noqa: B017
        table.count()


def test_sets_are_named_by_the_paths_given(spark, packed, tmp_path, monkeypatch):
    """Relative paths, letters that are encoded in a URL, folders of several part files, and one name that begins another."""
    import shutil

    folder, _ = packed
    for name in ("x", "a b", "x2"):
        shutil.copytree(folder / "one", tmp_path / "sets" / name)
    part = next((tmp_path / "sets" / "x").glob("part-*"))
    shutil.copy(part, part.with_name("part-99999" + part.suffix))
    monkeypatch.chdir(tmp_path)
    size = cli.stat(spark, [str(folder / "one")], K).first()["size"]
    given = [f"{tmp_path}/sets/x", f"{tmp_path}/sets/a b", f"{tmp_path}/sets/x2"]
    assert {r["file"]: r["size"] for r in cli.stat(spark, given, K).collect()} == dict.fromkeys(given, size)
    assert [r["file"] for r in cli.stat(spark, [f"{tmp_path}/sets/x*"], K).collect()] == [f"{tmp_path}/sets/x*"]


def test_few_moves_no_rows_and_intermediates_go(spark):
    from strandset.operators.lineage import few, own_folder
    from strandset.plans import queries

    assert "hint" in few(spark.range(5))._jdf.queryExecution().logical().toString().lower()
    assert "hint" not in few(spark.range(5), 4)._jdf.queryExecution().logical().toString().lower()
    written(spark.range(3)), spark.range(3).checkpoint()
    queries.QUERIES["fasta_roundtrip"](spark, "/root/testdata/sf0.001").collect()
    fs = lambda path: spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path))
    assert fs(own_folder(spark))
    remove_intermediates(spark)
    assert not fs(own_folder(spark)) and not fs(spark.sparkContext.getCheckpointDir())
    assert spark.range(3).checkpoint().count() == 3
