"""Many sets of words as a graph of shared intersections.

Words that lie in the same sets stay together through all steps, so the steps work on classes of words
(one row for each combination of sets), and the words are touched twice: when they are classed and when
they are dealt out to the nodes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandset.operators.lineage import discard, few, written
from strandset.operators.superwords import sets_of_words
from strandset.operators.words import MASKED, bits_of, in_sample, masked_names, set_masks, spelled, word_column


@dataclass(frozen=True)
class MultiSet:
    """``sets`` (set_id, node_id) names the inputs, ``nodes`` (node_id, kmer) holds each node's own words,
    ``edges`` (parent, child) their shared parts. A set is the union of all nodes its own node reaches."""

    sets: DataFrame
    nodes: DataFrame
    edges: DataFrame
    splits: tuple[tuple[int, int, int], ...]
    n_sets: int

    def reachable(self) -> DataFrame:
        """(set_id, node_id): every node that a set is made of, itself included."""
        pairs = closure(self.edges, self.sets.select(F.col("node_id").alias("node")))
        return self.sets.join(pairs, F.col("node") == self.sets["node_id"]).select("set_id", pairs["node_id"])

    def get(self, set_id: str) -> DataFrame:
        """(kmer): one set back; of nodes stored by folder only those that it reaches are read, by dynamic partition pruning."""
        if self.sets.where(F.col("set_id") == set_id).first() is None:
            raise KeyError(set_id)
        wanted = written(self.reachable()).where(F.col("set_id") == set_id).select("node_id")
        return self.nodes.join(few(wanted), "node_id", "left_semi").select("kmer").distinct()

    def all_sets(self) -> DataFrame:
        """(set_id, kmer): every set back. Words are shuffled once with a mask of their sets, not once for each set."""
        reach = written(self.reachable())
        names = [r["set_id"] for r in reach.select("set_id").distinct().orderBy("set_id").limit(MASKED + 1).collect()]
        if len(names) > MASKED:
            return self.nodes.join(few(reach), "node_id").select("set_id", "kmer").distinct()
        numbers = reach.sparkSession.createDataFrame([(x, i) for i, x in enumerate(names)], "set_id string, __set int")
        masks = set_masks(F.col("__set"), len(names))
        of_node = reach.join(F.broadcast(numbers), "set_id").groupBy("node_id").agg(*[F.bit_or(bit).alias(m) for m, bit in masks.items()])
        of_word = self.nodes.join(few(written(of_node)), "node_id").groupBy("kmer").agg(*[F.bit_or(m).alias(m) for m in masks])
        return of_word.select(F.explode(masked_names(names)).alias("set_id"), "kmer")


def closure(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, node_id): all nodes that a node reaches over edges (parent, child), and each of ``nodes`` (node) itself.

    Paths are doubled each round, so a chain of n levels takes log n rounds; equal pairs are one, however many paths lead there.
    """
    now = written(edges.select(F.col("parent").alias("node"), F.col("child").alias("node_id")).distinct())
    before, n = 0, now.count()
    while n > before:
        a, b = now.select("node", F.col("node_id").alias("by")), now.select(F.col("node").alias("by"), "node_id")
        longer = written(now.union(a.join(b, "by").select("node", "node_id")).distinct())
        discard(now)
        now, before, n = longer, n, longer.count()
    return now.union(nodes.select("node", F.col("node").alias("node_id"))).distinct()


def _after(splits: list[tuple[int, int, int]]) -> Column:
    """The nodes that hold a class's words after the splits, from the sets that held them at first."""
    if not splits:
        return F.col("held")
    done = F.array(*[F.array(*map(F.lit, x)) for x in splits])
    return F.aggregate(
        done, F.col("held"),
        lambda held, x: F.when(F.array_contains(held, x[0]) & F.array_contains(held, x[1]), F.concat(F.array_except(held, F.slice(x, 1, 2)), F.slice(x, 3, 1))).otherwise(held),
    )


def compress(words: DataFrame, k: int, n_bits: int, step: int = 50, gain: float = 0.1) -> MultiSet:
    """Splits shared words off the two sets that share most of a sample, again and again.

    ``words`` (set_id, kmer or code) may repeat rows; a null set_id or word takes no part. Weights are counts over
    the sampled buckets, ties go to the smaller numbers. It ends when no two nodes share a sampled word,
    or when an interval of steps (an eighth of the sets, and one) has cut the total size by a share of at
    most ``gain`` times the interval over the number of sets. The total size stands for the letters of the
    packed sets, of which it is the larger part, so that no set is packed for the test alone. Numbers of
    sets are by name; only they, the splits and one pair a step come to the driver. A step is one job on the classes.
    """
    word = word_column(words)
    own = words.where(F.col("set_id").isNotNull() & F.col(word).isNotNull()).select("set_id", bits_of(words).alias("code"))
    names = sorted(r["set_id"] for r in own.select("set_id").distinct().collect())
    sets = words.sparkSession.createDataFrame(list(zip(names, range(len(names)), strict=True)), "set_id string, node_id int")
    of_word = written(own.join(F.broadcast(sets), "set_id").groupBy("code").agg(F.sort_array(F.collect_set("node_id")).alias("held")))
    return _compressed(of_word, names, k, n_bits, step, gain)


def compress_strings(strings: DataFrame, k: int, n_bits: int, canonical: bool = True, step: int = 50, gain: float = 0.1, named: DataFrame | None = None) -> MultiSet:
    """:func:`compress` of all words of strings (set_id, frag), which are dealt as super-words and not as a row a word.

    The sets' names are read from ``named`` (set_id), if it is given.
    """
    named = None if named is None else named.where(F.col("set_id").isNotNull())
    of_word, names = sets_of_words(strings.where(F.col("set_id").isNotNull()), k, canonical, named=named)
    of_word = written(of_word)
    found = sorted(r["n"] for r in of_word.select("held").distinct().select(F.explode("held").alias("n")).distinct().collect())
    if len(found) < len(names):  # sets without a word have no number
        new = F.create_map(*[F.lit(x) for i, n in enumerate(found) for x in (n, i)]) if found else F.create_map().cast("map<int,int>")
        of_word = of_word.select("code", F.transform("held", lambda n: F.element_at(new, n)).alias("held"))
    return _compressed(of_word, [names[n] for n in found], k, n_bits, step, gain)


def _holding(held: pa.ListArray, splits: list[tuple[int, int, int]], n_nodes: int) -> np.ndarray:
    """Whether each node holds each row's words after the splits, by :func:`_after` on a whole batch."""
    row = np.repeat(np.arange(len(held)), np.asarray(pc.list_value_length(held)))
    holds = np.zeros((n_nodes, len(held)), bool)
    holds[np.asarray(held.flatten()), row] = True
    for j, k, n in splits:
        holds[n] = holds[j] & holds[k]
        holds[j] &= ~holds[n]
        holds[k] &= ~holds[n]
    return holds


#: Nodes whose pairs a task sums in one matrix; those of more are exploded to rows.
_DENSE = 1024


def _pair_sums(classes: DataFrame, splits: list[tuple[int, int, int]], n_nodes: int, dense: int = _DENSE) -> DataFrame:
    """(j, k, weight, shared): sampled and all words that nodes j < k share, of classes (held, cnt, sampled) after the splits."""
    sums = [F.sum("sampled").alias("weight"), F.sum("cnt").alias("shared")]
    if n_nodes > dense:
        held = classes.select("cnt", "sampled", _after(splits).alias("held")).where("size(held) > 1")
        pairs = held.select("cnt", "sampled", "held", F.explode("held").alias("j")).select("cnt", "sampled", "j", F.explode("held").alias("k"))
        return pairs.where("j < k").groupBy("j", "k").agg(*sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, n_nodes, n_nodes), np.int64)
        for batch in batches:
            holds = _holding(batch.column("held"), splits, n_nodes).astype(np.float64)
            for i, c in enumerate(("sampled", "cnt")):  # sums of a batch are exact below 2 ** 53
                total[i] += ((holds * np.asarray(batch.column(c), np.float64)) @ holds.T).astype(np.int64)
        j, k = np.nonzero(np.triu(total[1], 1))
        yield pa.record_batch([pa.array(j.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(total[0, j, k]), pa.array(total[1, j, k])], ["j", "k", "sampled", "cnt"])

    return classes.select("held", "cnt", "sampled").mapInArrow(run, "j int, k int, sampled long, cnt long").groupBy("j", "k").agg(*sums)


def _dealt_out(of_word: DataFrame, splits: list[tuple[int, int, int]], n_sets: int) -> DataFrame:
    """(node_id, code): the nodes that hold each word after the splits, by :func:`_after` on whole batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, at = np.nonzero(_holding(batch.column(1), splits, n_sets + len(splits)))
            yield pa.record_batch([pa.array(node.astype(np.int32)), batch.column(0).take(pa.array(at))], ["node_id", "code"])

    return of_word.select("code", "held").mapInArrow(run, "node_id int, code long")


def _compressed(of_word: DataFrame, names: list[str], k: int, n_bits: int, step: int, gain: float) -> MultiSet:
    """Compression of words (code, held): the numbers of the sets that hold each."""
    spark, n0 = of_word.sparkSession, len(names)
    sets = spark.createDataFrame(list(zip(names, range(n0), strict=True)), "set_id string, node_id int")
    sampled = in_sample(F.col("code"), k, n_bits, step)
    classes = written(of_word.groupBy("held").agg(F.count("*").alias("cnt"), F.count_if(sampled).alias("sampled")))
    total = classes.agg(F.coalesce(F.sum(F.size("held") * F.col("cnt")), F.lit(0)).alias("n")).first()["n"]
    # The classes as they stand after the splits up to ``base``; later splits are an expression on them.
    now, base = classes.where("size(held) > 1"), 0
    size, at_test, interval, splits = total, total, n0 // 8 + 1, []
    while True:
        if splits and len(splits) % interval == 0:
            if not at_test or (at_test - size) / at_test <= gain * interval / n0:
                break
            at_test = size
        if len(splits) - base == 16:
            now, base = written(now.select("cnt", "sampled", _after(splits[base:]).alias("held")).where("size(held) > 1")), len(splits)
        best = _pair_sums(now, splits[base:], n0 + len(splits)).orderBy(F.desc("weight"), "j", "k").first()
        if best is None or best["weight"] <= 0:
            break
        size -= best["shared"]
        splits.append((best["j"], best["k"], n0 + len(splits)))
    nodes = spelled(_dealt_out(of_word, splits, n0), k)  # dealt when they are read: the edges alone don't need them
    edges = spark.createDataFrame([(p, n) for j, k_, n in splits for p in (j, k_)], "parent int, child int")
    return MultiSet(sets, nodes, edges, tuple(splits), n0)
