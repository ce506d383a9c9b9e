import gzip

import pytest
from pyspark.sql import functions as F

from strandset.functions import kmer as K
from strandset.operators import words as W
from strandset.sources.reads import InvalidInput, load_strings, read_fasta, write_strings


def kmers(spark, *words):
    return spark.createDataFrame([(w,) for w in words], "kmer string")


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_scalar_functions(spark):
    w = F.col("kmer")
    row = kmers(spark, "AGCTG").select(
        K.decode(K.encode(w), 5).alias("a"), K.reverse_complement(F.lit("AACCG")).alias("b"), K.following(w, "C").alias("c"), K.preceding(w, "C", 5).alias("d"),
        K.last_base(w).alias("e"), K.from_bucket(K.bucket(K.encode(w), 5, 3), K.bucket_key(K.encode(w), 5, 3), 5, 3).alias("f"), K.encode(w).alias("g"),
        K.saturating_add(F.lit(255).cast("long"), F.lit(1).cast("long")).alias("h"), K.joined_path(F.array(F.lit("AACC"), F.lit("CCG"), F.lit("CGT")), 3).alias("i"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e, row.f == row.g, row.h, row.i) == ("AGCTG", "CGGTT", "GCTGC", "CAGCT", "G", True, 255, "AACCGT")


@pytest.mark.parametrize(("word", "least"), [("AAAAT", "AAAAT"), ("TTTTA", "TAAAA"), ("CCCCG", "CCCCG"), ("GGGGC", "GCCCC")])
def test_canonical(spark, word, least):
    assert kmers(spark, word).select(K.canonical(F.col("kmer"))).first()[0] == least


def test_counts_of_reads_split_on_n(spark):
    reads = spark.createDataFrame([(1, "AACCGTT"), (2, "AACCGTA"), (3, "NNNN"), (4, ""), (5, None), (6, "AACNCGT")], "read_id long, seq string")
    found = W.count_words(W.words(W.fragments(reads), 5, canonical=False))
    assert values(found) == [("AACCG", 2), ("ACCGT", 2), ("CCGTA", 1), ("CCGTT", 1)]


def test_counts_stop_at_255_and_cut_off(spark):
    rows = spark.range(300).select(F.lit("AAAAA").alias("kmer"))
    counts = W.count_words(rows.union(kmers(spark, "CCCCC", "GGGGG", "GGGGG")))
    assert values(counts) == [("AAAAA", 255), ("CCCCC", 1), ("GGGGG", 2)]
    assert values(W.cut_off(counts, 2)) == [("AAAAA", 255), ("GGGGG", 2)]
    assert tuple(W.n_dropped(counts, 2).first()) == (1, 2)
    assert values(W.add_counts(counts, counts)) == [("AAAAA", 255), ("CCCCC", 2), ("GGGGG", 4)]
    assert values(W.lookup(counts, kmers(spark, "GGGGG", "TTTTT"))) == [("GGGGG", 2), ("TTTTT", 0)]
    with pytest.raises(ValueError):
        W.cut_off(counts, 256)


def test_set_algebra(spark):
    a, b = kmers(spark, "AAAAA", "TTTTT", "CCCCC"), kmers(spark, "AAAAA", "TTTTT", "GGGGG")
    assert W.union(a, b).count() == 4
    assert values(W.difference(a, b)) == [("CCCCC",)]
    assert W.intersection(a, b).count() == 2
    assert tuple(W.difference_size(a, b).first()) == (2, False)
    assert tuple(W.difference_size(a, a).first()) == (0, True)
    assert values(W.contains(a, b)) == [("AAAAA", True), ("GGGGG", False), ("TTTTT", True)]
    assert tuple(W.statistics(kmers(spark, "AAAAA", "AAAAC", "AAAAG")).first()) == (3, 1 ^ 2)
    assert tuple(W.statistics(kmers(spark)).first()) == (0, 0)


@pytest.mark.parametrize("text", ["AACC\nACGT\n", ">a\nACGU\n", ">a\nacgt\n", ">a\nACGT\n>b\n", ">a\nAC\nGT\n"])
def test_fasta_rules(spark, tmp_path, text):
    (tmp_path / "x.fa").write_text(text)
    with pytest.raises(InvalidInput):
        read_fasta(spark, str(tmp_path / "x.fa"))


def test_fasta_reads(spark, tmp_path):
    (tmp_path / "a.fa.gz").write_bytes(gzip.compress(b">a\nACGTN\n>b\n\n"))
    (tmp_path / "b.fa").write_text("")
    assert [(r.read_id, r.seq) for r in read_fasta(spark, f"{tmp_path}/*").orderBy("read_id").collect()] == [(0, "ACGTN"), (1, "")]


@pytest.mark.parametrize("codec", ["none", "gzip", "bzip2"])
def test_strings_roundtrip(spark, tmp_path, codec):
    strings = spark.createDataFrame([("ACGTA",), ("GGGGGG",)], "seq string")
    write_strings(strings, f"{tmp_path}/out", codec)
    assert values(load_strings(spark, f"{tmp_path}/out", 5)) == values(strings)
    with pytest.raises(InvalidInput):
        load_strings(spark, f"{tmp_path}/out", 6)


def test_the_following_word_of_a_very_long_one_is_whole(spark):
    long = spark.range(1).select(F.concat(F.lit("G"), F.repeat(F.lit("AC"), 600_000)).alias("w"))
    assert long.select(F.length(K.following(F.col("w"), "T")), F.left(K.following(F.col("w"), "T"), F.lit(2))).first() == (1_200_001, "AC")
