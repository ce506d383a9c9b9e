"""Multi-sets on disk: Parquet by node, and text for exchange."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandset.operators import words as W
from strandset.operators.lineage import shuffles_freed
from strandset.operators.multiset import MultiSet
from strandset.operators.spss import spss
from strandset.sources.reads import InvalidInput, load_files, write_strings


def write_multiset(multi: MultiSet, path: str) -> None:
    """Node words lie in a folder for each node, so that one set is read without the others."""
    with shuffles_freed(multi.nodes.sparkSession):
        multi.nodes.repartition("node_id", F.pmod(F.xxhash64("kmer"), F.lit(16))).write.partitionBy("node_id").parquet(f"{path}/nodes")
    multi.edges.write.parquet(f"{path}/edges")
    multi.sets.write.parquet(f"{path}/sets")


def read_multiset(spark: SparkSession, path: str) -> MultiSet:
    """Lazily: only the sets' names and the edges are read at once."""
    sets, edges = spark.read.parquet(f"{path}/sets"), spark.read.parquet(f"{path}/edges")
    nodes = spark.read.parquet(f"{path}/nodes").select(F.col("node_id").cast("int").alias("node_id"), "kmer")
    splits = _splits([(r["parent"], r["child"]) for r in edges.collect()], path)
    return MultiSet(sets, nodes, edges, splits, sets.count())


def _splits(pairs: list[tuple[int, int]], path: str) -> tuple[tuple[int, int, int], ...]:
    """(j, k, n) of each node n that was split off two others, which have smaller numbers; other edges raise InvalidInput."""
    parents: dict[int, list[int]] = {}
    for parent, child in pairs:
        parents.setdefault(child, []).append(parent)
    for child, two in parents.items():
        if len(set(two)) != 2 or len(two) != 2 or max(two) >= child:
            raise InvalidInput(f"{path}: node {child} must have two parents of smaller numbers, not {two}")
    return tuple((*sorted(p), n) for n, p in sorted(parents.items()))


def adjacency(edges: DataFrame) -> DataFrame:
    """(parent, line): each parent's part of the adjacency text, ``parent n child...``."""
    by = edges.groupBy("parent").agg(F.sort_array(F.collect_list("child")).alias("children"))
    return by.select("parent", F.concat_ws(" ", "parent", F.size("children"), F.array_join(F.col("children").cast("array<string>"), " ")).alias("line"))


def adjacency_text(edges: DataFrame) -> DataFrame:
    """(text): the number of parents, then every parent with its number of children and them."""
    lines = adjacency(edges).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("parent", "line"))).alias("lines"))
    return lines.select(F.concat_ws(" ", F.col("n"), F.array_join(F.transform("lines", lambda x: x["line"]), " ")).alias("text"))


def parse_adjacency(text: str) -> list[tuple[int, int]]:
    """The (parent, child) edges of an adjacency text; other than whole numbers in that form raise InvalidInput."""
    out: list[tuple[int, int]] = []
    try:
        numbers = [int(x) for x in text.split()]
        at = 1
        for _ in range(numbers[0]):
            parent, n = numbers[at], numbers[at + 1]
            children = numbers[at + 2 : at + 2 + n]
            if len(children) < n:
                raise IndexError
            out += [(parent, c) for c in children]
            at += 2 + n
    except (ValueError, IndexError):
        raise InvalidInput("an adjacency text ends early or holds other than numbers") from None
    if at != len(numbers):
        raise InvalidInput("an adjacency text goes on after its last parent")
    return out


def dot_lines(edges: DataFrame) -> DataFrame:
    """(pos, line): the graph in the DOT language."""
    arrows = edges.select(F.lit(1).alias("pos"), F.format_string("v%d -> v%d", "parent", "child").alias("line"))
    ends = edges.sparkSession.createDataFrame([(0, "digraph G {"), (2, "}")], "pos int, line string")
    return ends.unionByName(arrows)


def write_dot(edges: DataFrame, path: str) -> None:
    """One text file; there are at most two edges a split."""
    dot_lines(edges).repartition(1).sortWithinPartitions("pos", "line").select("line").write.text(path)


def export_text(multi: MultiSet, path: str, k: int, canonical: bool = True, compression: str = "none") -> None:
    """``meta`` (adjacency text, then the number of nodes) and a folder of strings for each node."""
    nodes = range(multi.n_sets + len(multi.splits))
    meta = adjacency_text(multi.edges).select(F.explode(F.array("text", F.lit(str(len(nodes))))).alias("line"))
    meta.repartition(1).write.option("compression", compression).text(f"{path}/meta")
    for node in nodes:
        write_strings(spss(multi.nodes.where(F.col("node_id") == node).select("kmer"), k, canonical), f"{path}/{node}", compression)


def import_text(spark: SparkSession, path: str, k: int, canonical: bool = True, names: Iterable[str] | None = None) -> MultiSet:
    """A multi-set from :func:`export_text`; sets are named by ``names`` or numbered, nodes without a parent first."""
    meta = [r["value"] for r in spark.read.text(f"{path}/meta").select("value", F.monotonically_increasing_id().alias("at")).orderBy("at").collect()]
    if len(meta) != 2 or not meta[1].isdigit():
        raise InvalidInput(f"{path}/meta must hold two lines")
    pairs, n_nodes = parse_adjacency(meta[0]), int(meta[1])
    splits = _splits(pairs, f"{path}/meta")
    n_sets = n_nodes - len(splits)
    named = list(names) if names is not None else [str(i) for i in range(n_sets)]
    strings = load_files(spark, [f"{path}/{node}" for node in range(n_nodes)], k)
    node = F.regexp_extract("file", r"/([0-9]+)/[^/]*\z", 1).cast("int").alias("node_id")
    nodes = W.spelled(W.codes(strings.select(node, "seq"), k, canonical, "seq").distinct(), k)
    sets = spark.createDataFrame(list(zip(named, range(n_sets), strict=True)), "set_id string, node_id int")
    return MultiSet(sets, nodes, spark.createDataFrame(pairs, "parent int, child int"), splits, n_sets)
