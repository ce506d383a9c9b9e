"""Command line: build, stat, compress, decompress and compare sets of words.

Codecs go by file name or ``--compression``; nothing is run in a shell.
"""

from __future__ import annotations

import argparse
import re
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandset.operators import words as W
from strandset.operators.multiset import compress
from strandset.operators.growth import grow_unitigs
from strandset.operators.spss import join_unitigs, spss, string_stats, words_of
from strandset.operators.graph import unitigs
from strandset.operators.lineage import written
from strandset.operators.superwords import count_super_words
from strandset.sources.reads import load_files, load_strings, read_fasta, write_strings
from strandset.sources.store import read_multiset, write_dot, write_multiset


def bucket_bits(k: int) -> int:
    """Bits of the bucket number: most of a short word, 10 to 14 of others (fixed values)."""
    return min(2 * k, 10 if k == 19 else 14)


def build(spark: SparkSession, fasta: str, k: int, cutoff: int = 1, canonical: bool = True, out: str | None = None, compression: str = "none", check: bool = False) -> dict:
    """FASTA to a packed set: (size, hash, n_dropped, n_strings, weight)."""
    counts = written(count_super_words(W.fragments(read_fasta(spark, fasta)), k, canonical))
    kept = W.cut_off(counts, cutoff).select("code")
    strings = written(spss(kept, k, canonical))
    stats = W.statistics(kept).first().asDict() | W.n_dropped(counts, cutoff).first().asDict() | string_stats(strings, k).first().asDict()
    if check and not W.difference_size(W.spelled(kept, k), words_of(strings, k, canonical)).first()["equal"]:
        raise RuntimeError("the strings don't hold the set")
    if out:
        write_strings(strings, out, compression)
    return stats


def _of_files(spark: SparkSession, paths: list[str], k: int, canonical: bool, name: str) -> DataFrame:
    """(name, code): the words of packed sets, all files in one scan; each set is named by the path given for it.

    A path may be a file, a folder of part files or a pattern; Hadoop's own listing tells which files each stands for. A file that two
    paths stand for belongs to the longer one.
    """
    given = {}
    for path in sorted(paths, key=len):
        files = (re.sub("^file:/+", "file:/", f) for f in spark.read.text(path).inputFiles())  # as a row's metadata names them
        given |= dict.fromkeys(files, path)
    named = F.broadcast(spark.createDataFrame(list(given.items()), "file string, given string"))  # a row a file of the call
    strings = load_files(spark, paths, k).join(named, "file")
    return W.codes(strings.select(F.col("given").alias(name), "seq"), k, canonical, "seq").distinct()


def stat(spark: SparkSession, paths: list[str], k: int, canonical: bool = True) -> DataFrame:
    """(file, size, hash) of packed sets."""
    return W.statistics(_of_files(spark, paths, k, canonical, "file"), ("file",))


def compress_files(spark: SparkSession, paths: list[str], k: int, out: str, canonical: bool = True, graph: str | None = None) -> None:
    """Packed sets to a multi-set folder, and its graph in DOT."""
    multi = compress(_of_files(spark, paths, k, canonical, "set_id"), k, bucket_bits(k))
    write_multiset(multi, out)
    if graph:
        write_dot(multi.edges, graph)


def decompress(spark: SparkSession, path: str) -> DataFrame:
    """(set_id, size, hash) of every set in a multi-set folder."""
    return W.statistics(read_multiset(spark, path).all_sets(), ("set_id",))


def compare(spark: SparkSession, path: str, k: int, repeats: int = 1, orders: tuple[str, ...] = ("first", "shuffled")) -> list[dict]:
    """Ways of joining unitigs, ``grown`` in a fixed order among them: seconds, weight, seconds to decode, whether the set comes back."""
    own = written(words_of(load_strings(spark, path, k), k))
    parts, rows = written(unitigs(own, k)), []
    for order in list(orders) * repeats:
        start = time.perf_counter()
        strings = written(grow_unitigs(parts, k) if order == "grown" else join_unitigs(parts, k, shuffled=order == "shuffled"))
        joined = time.perf_counter()
        back = written(words_of(strings, k))
        decoded = time.perf_counter()
        told = {"order": order, "shuffled": order == "shuffled", "sec": joined - start, "decode_sec": decoded - joined, "is_equal": W.difference_size(own, back).first()["equal"]}
        rows.append(told | string_stats(strings, k).first().asDict())
    return rows


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="strandset")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("build", "stat", "compress", "decompress", "compare"):
        one = commands.add_parser(name)
        one.add_argument("paths", nargs="+")
        one.add_argument("--k", type=int, default=15)
        one.add_argument("--directed", action="store_true", help="words are read one way")
        one.add_argument("--out")
        one.add_argument("--out-graph")
        one.add_argument("--cutoff", type=int, default=1)
        one.add_argument("--compression", default="none", choices=("none", "gzip", "bzip2"))
        one.add_argument("--check", action="store_true")
        one.add_argument("--repeats", type=int, default=1)
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("strandset").getOrCreate()
    if a.command == "build":
        print(build(spark, a.paths[0], a.k, a.cutoff, not a.directed, a.out, a.compression, a.check))
    elif a.command == "compress":
        compress_files(spark, a.paths, a.k, a.out, not a.directed, a.out_graph)
    elif a.command == "compare":
        print(*compare(spark, a.paths[0], a.k, a.repeats, ("first", "shuffled", "grown")), sep="\n")
    else:
        rows = stat(spark, a.paths, a.k, not a.directed) if a.command == "stat" else decompress(spark, a.paths[0])
        print(*["\t".join(map(str, r)) for r in rows.toLocalIterator()], sep="\n")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
