"""The de Bruijn graph of a set of words: degrees, ends, unitigs by pointer doubling.

Inside, words are their 2-bit codes as longs. All neighbours of a word share one (k - 1)-letter overlap
with it, and at most eight oriented words share an overlap, so links are found by one grouping on the
overlap, without a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandset.functions import kmer as K
from strandset.operators import words as W
from strandset.operators.compaction import _COMPLETE, _PART, _SINGLE, cut_ring, local_ends, local_paths
from strandset.operators.lineage import discard, written


def _odd(k: int) -> None:
    if k % 2 == 0:
        raise ValueError("canonical graphs need an odd k")


def edges(words: DataFrame, k: int) -> DataFrame:
    """(u, v): oriented words that overlap by k - 1; loops and hairpins are no edges. k must be odd."""
    _odd(k)
    rows = _codes(words, k, True)
    a = rows.select(F.col("s").alias("u"), F.col("c").alias("cu"), F.col("s").bitwiseAND(F.lit((1 << (2 * k - 2)) - 1)).alias("overlap"))
    b = rows.select(F.col("s").alias("v"), F.col("c").alias("cv"), F.shiftright("s", 2).alias("overlap"))
    return a.join(b, "overlap").where("cu <> cv").select(K.decode(F.col("u"), k).alias("u"), K.decode(F.col("v"), k).alias("v"))


def side_degrees(words: DataFrame, k: int) -> DataFrame:
    """(word, right, left): neighbours on each side of every canonical word.

    A word's sides are grouped by the overlap that lies there, read in its smaller orientation: the
    neighbours are the others in the group, on the overlap's other side, so that no join is needed.
    """
    _odd(k)

    def side(overlap: Column, mirror: Column, right: bool) -> Column:
        before = F.lit(right)  # as the word is written, it lies before the overlap on its right
        cls = F.when(overlap == mirror, 2).when((overlap < mirror) == before, 0).otherwise(1)
        return F.struct(F.least(overlap, mirror).alias("o"), F.lit(right).alias("right"), cls.alias("cls"))

    word, c = W.word_column(words), F.col("c")
    ends = words.select(W.bits_of(words).alias("c")).select("c", c.bitwiseAND(F.lit((1 << (2 * k - 2)) - 1)).alias("r"), F.shiftright(c, 2).alias("l"))
    ends = ends.select("*", *[K.reverse_complement_code(F.col(x), k - 1).alias(f"{x}m") for x in "rl"])
    sides = ends.select("c", F.explode(F.array(side(F.col("r"), F.col("rm"), True), side(F.col("l"), F.col("lm"), False))).alias("e"))
    met = sides.groupBy("e.o").agg(F.collect_list(F.struct("c", "e.right", "e.cls")).alias("all"))
    own = F.col("x")

    def faces(other: Column) -> Column:
        return (other["c"] != own["c"]) & ((own["cls"] == 2) | (other["cls"] + own["cls"] == 1))

    each = met.select("all", F.explode("all").alias("x")).select(own["c"].alias("c"), own["right"].alias("right"), F.size(F.filter("all", faces)).alias("n"))
    count = [F.sum(F.when(F.col("right") == r, F.col("n")).otherwise(0)).cast("long").alias(name) for r, name in ((True, "right"), (False, "left"))]
    out = each.groupBy(F.col("c").alias("code")).agg(*count)
    return out if word == "code" else W.spelled(out, k)


def _codes(words: DataFrame, k: int, canonical: bool) -> DataFrame:
    """(s, c): codes of the oriented words, or of the words themselves in a directed graph."""
    own = words.select(W.bits_of(words).alias("c"))
    if not canonical:
        return own.select(F.col("c").alias("s"), "c")
    return own.select("c", K.reverse_complement_code(F.col("c"), k).alias("m")).select(F.explode(F.array("c", "m")).alias("s"), "c")


def terminals(words: DataFrame, k: int, canonical: bool = True) -> DataFrame:
    """(kmer, starts, ends): whether no unitig goes on before or after each word, read as it stands.

    Links are decided where a word's overlaps are dealt, as for unitigs; only words whose overlaps lie in two places are grouped.
    """
    told = written(local_ends(words, k, canonical))
    two = told.where("told <> 3").groupBy("code").agg(F.bit_or("goes").alias("goes"))
    goes = told.where("told = 3").select("code", "goes").unionByName(two)
    return goes.select(K.decode(F.col("code"), k).alias("kmer"), *[(F.col("goes").bitwiseAND(F.lit(bit).cast("byte")) == 0).alias(name) for name, bit in (("starts", 1), ("ends", 2))])


#: Nodes that one task places when doubling has left no more.
_LAST = 200_000


def chains(nodes: DataFrame, links: DataFrame, last: int = _LAST) -> DataFrame:
    """(s, head, dist, ring): each node's place on its path, by pointer doubling.

    ``nodes`` (s, c) are linked by (s, up), at most one on each side. c names a node and its mirror image
    alike (c = s in a directed graph). In each round only nodes that have not met their head move on, and
    only nodes that are still pointed at are kept to be asked, so a round costs what is left; when at most ``last`` nodes
    are left, one task places them. Rings are cut before their smallest node; of a ring and its mirror image that with the
    smaller one stays.
    """
    start = nodes.join(links, "s", "left").select(
        "s", F.coalesce("up", "s").alias("up"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("dist"),
        F.col("up").isNull().alias("done"), F.least("s", F.coalesce("up", "s")).alias("low"), F.col("c").alias("least_c"),
    )
    now = written(start)
    finished, kept = [written(now.where("done").select("s", "up", "dist"))], now
    before, left, ring = None, now.where("NOT done").count(), None
    while left:
        if left <= last:  # what they point at has met its head, or is among them
            rest = now.join(now.where("NOT done").select(F.col("up").alias("s")).distinct(), "s", "left_semi").where("done").unionByName(now.where("NOT done"))
            placed = written(_placed_at_once(rest))
            finished.append(placed.where("NOT ring").select("s", "up", "dist"))
            ring, left = placed.where("ring AND low = least_c").select("s", "low"), placed.where("ring").count()
            break
        here, ahead = now.where("NOT done").alias("a"), now.alias("b")
        met = written(here.join(ahead, F.col("a.up") == F.col("b.s")).select(F.struct("a.*").alias("a"), F.struct("b.*").alias("b")))
        state = met.agg(F.count_if(~F.col("b.done")), F.count_if((F.col("b.low") < F.col("a.low")) | (F.col("b.least_c") < F.col("a.least_c")))).first()
        if before == left and not state[1]:
            ring = written(now.where("NOT done AND low = least_c").select("s", "low"))
            discard(met)
            break  # nothing has met a head and no smallest node was news: rings alone are left
        before = left
        discard(kept)
        moved = met.select(
            "a.s", "b.up", (F.col("a.dist") + F.col("b.dist")).alias("dist"), "b.done", F.least("a.low", "b.low").alias("low"), F.least("a.least_c", "b.least_c").alias("least_c")
        )
        finished.append(written(moved.where("done").select("s", "up", "dist")))
        now, kept, left = moved.unionByName(met.where("b.done").select("b.*")), met, state[0]
    discard(kept)  # each round's rows are kept by what has met a head in it, and by the round that follows alone
    found = finished[0]
    for more in finished[1:]:
        found = found.unionByName(more)
    paths = found.select("s", F.col("up").alias("head"), "dist", F.lit(False).alias("ring"))
    if not left:
        return paths
    cut = ring.where("s <> low").join(links, "s").select("s", "up")
    opened = chains(ring.select("s", F.col("s").alias("c")), cut)
    return paths.unionByName(opened.select("s", "head", "dist", F.lit(True).alias("ring")))


def _placed_at_once(rest: DataFrame) -> DataFrame:
    """The rows of ``chains`` that have not met their head, with head and distance, or marked as a ring with its smallest nodes; a bounded number, in one task."""

    names = ["s", "up", "dist", "done", "low", "least_c"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        s, up, dist, done, low, least_c = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in names)
        order = np.argsort(s)
        s, up, dist, done, low, least_c = (x[order] for x in (s, up, dist, done, low, least_c))
        mine = np.flatnonzero(~done)
        to = np.searchsorted(s, up)
        for _ in range(len(s).bit_length() + 1):
            a = np.flatnonzero(~done)
            b = to[a]
            up[a], dist[a], done[a], to[a], low[a], least_c[a] = up[b], dist[a] + dist[b], done[b], to[b], np.minimum(low[a], low[b]), np.minimum(least_c[a], least_c[b])
        yield pa.record_batch([pa.array(x[mine]) for x in (s, up, dist, done, low, least_c, ~done)], [*names, "ring"])

    return rest.repartition(1).mapInArrow(run, "s long, up long, dist long, done boolean, low long, least_c long, ring boolean")


def joined(parts: DataFrame, k: int, overlap: int) -> DataFrame:
    """(seq, ring, n): parts (head, ring, dist, seq) of each path as one string; each shares ``overlap`` letters with the one before.

    Parts are joined in blocks of 4,096 first, so that no list holds all parts of a long path.
    """
    block = parts.select("head", "ring", F.expr("dist div 4096").alias("block"), F.struct("dist", F.when(F.col("dist") == 0, F.col("seq")).otherwise(F.substring("seq", overlap + 1, F.length("seq"))).alias("seq")).alias("p"))

    def whole(list_: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(list_), lambda x: x["seq"]), "")

    blocks = block.repartition("head").groupBy("head", "ring", "block").agg(whole(F.collect_list("p")).alias("seq"), F.count("*").alias("n"))
    return blocks.groupBy("head", "ring").agg(whole(F.collect_list(F.struct("block", "seq"))).alias("seq"), F.sum("n").alias("n")).select("seq", "ring", "n")


def _unitigs(words: DataFrame, k: int, canonical: bool) -> DataFrame:
    """(seq): paths joined where their words' overlaps lie, their ends glued along the words that lie in two places.

    Words that are not written yet are, once, and go when the paths are.
    """
    kept = hasattr(words, "written_to") and words.columns == ["code"]
    codes = words if kept else written(words.select(W.bits_of(words).alias("code")))
    paths = local_paths(codes, k, canonical)
    if not kept:
        discard(codes)
    complete = paths.where(f"kind = {_COMPLETE}").select("seq")
    # A word told alone in both of its places has no neighbour in either.
    lone = paths.where(f"kind = {_SINGLE}").groupBy("id").agg(F.count("*").alias("n")).where("n = 2").select(K.decode(F.col("id"), k).alias("seq"))
    parts = paths.where(f"kind = {_PART}")
    nodes = parts.select(F.col("id").alias("s"), F.least("id", "mirror").alias("c"))
    glue = parts.where("next IS NOT NULL").select(F.col("next").alias("s"), F.col("id").alias("up"))
    placed = chains(nodes, glue).join(parts.select(F.col("id").alias("s"), "seq"), "s")
    whole = joined(placed, k, k)
    first, last = K.canonical(F.left("seq", F.lit(k))), K.canonical(F.right("seq", F.lit(k)))
    linear = whole.where(~F.col("ring") & (first > last if canonical else F.lit(True))).select("seq")
    rings = whole.where("ring").select(cut_ring(F.left("seq", F.length("seq") - 1), k, canonical).alias("seq"))
    return complete.unionByName(lone).unionByName(linear).unionByName(rings)


def unitigs(words: DataFrame, k: int) -> DataFrame:
    """(seq): the maximal non-branching paths of a canonical set, each once.

    Of a path's two mirror images the one stays whose first canonical word is the larger; a single word
    stays as it is; rings are cut at their smallest word, which they hold as it is. The string of a path is one
    value and must fit a string of Spark (2 GB).
    """
    _odd(k)
    return _unitigs(words, k, True)


def unitigs_directed(words: DataFrame, k: int) -> DataFrame:
    """(seq): the maximal non-branching paths of a set whose words are read one way."""
    return _unitigs(words, k, False)


def components(pairs: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, component): the smallest id that is reachable over pairs (x, y); lone ``nodes`` (id) are their own.

    Neighbours' labels and labels of labels are taken in turn, so paths halve each round; a round is
    written to the shared folder.
    """
    ways = F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b")), F.struct(F.col("y").alias("a"), F.col("x").alias("b"))))
    both = written(pairs.select(ways.alias("e")).select("e.a", "e.b").where("a <> b").distinct())
    ids = both.select(F.col("a").alias("id")) if nodes is None else both.select(F.col("a").alias("id")).union(nodes.select("id"))
    if nodes is None:
        ids = ids.union(pairs.where("x = y").select("x"))
    now = before = written(ids.distinct().select("id", F.col("id").alias("component")))
    while True:
        near = both.join(now, both["b"] == now["id"]).groupBy("a").agg(F.min("component").alias("least"))
        step = now.join(near, now["id"] == near["a"], "left").select("id", F.least("component", F.coalesce("least", "component")).alias("component"), F.col("component").alias("old"))
        step = written(step)
        jump = step.select(F.col("id").alias("component"), F.col("component").alias("further"))
        next_ = written(step.join(jump, "component").select("id", F.least("component", "further").alias("component"), "old"))
        discard(step, before)
        if not next_.where("component <> old").take(1):
            discard(both)
            return next_.select("id", "component")
        now, before = next_.select("id", "component"), next_
