"""SimHash near-duplicates through vantage-point trees.

Fingerprints are a metric space under Hamming distance. A vantage point splits them at the median
distance; a query within ``radius`` of the border belongs to both sides. The first levels of the tree
are planned on a bounded sample and deal the distinct fingerprints into shards; a fingerprint lives in
one shard and is asked in each shard that its ball of ``radius`` can reach, so every pair is found.
Within a shard a deeper tree is walked by whole sets of queries at a time.

Balls of many shards' trees reach ever more of them. So where a fingerprint would be asked in more than
``radius + 1`` shards, fingerprints that share one of ``radius + 1`` bands of bits meet instead (two within
``radius`` do), each band's value a tree of its own.

Links by similarity need a radius at which balls reach nearly every shard. They are exact set joins
instead: texts that alike share one of their rarest shingles (prefix filter). The text that has the fewest
rarer shingles before a shared one is the vantage point of all that share it; the others are compared with
it first, and pairs only between texts that this leaves in different groups and whose counts allow it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandset.llm.common import cut, few, row_key, slices, written

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BITS = 1024  # bits of a set, a power of two


def _fingerprints(strings: list[str | None], words: int, seed: int) -> np.ndarray:
    out = np.zeros(len(strings), np.uint64)
    weights = np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))
    digest = xxhash.xxh64_intdigest
    for row, s in enumerate(strings):
        w = s.encode("utf-8", "replace").lower().split() if s else []
        if not w:
            continue
        if len(w) < words:
            h = np.array([digest(b" ".join(w), seed)], np.uint64)
        else:
            h = np.array([digest(g, seed) for g in map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))], np.uint64)
        ones = np.zeros(64, np.int64)
        for part in range(0, len(h), 8192):
            bits = np.unpackbits(h[part : part + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
        out[row] = weights[2 * ones > len(h)].sum(dtype=np.uint64)
    return out


def simhash(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, seed: int = 42, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash of every whole text, as a signed long; the long columns ``keep`` follow.

    A-Z are lower-cased; words are runs without white space; each occurrence of a shingle of ``words``
    words votes with its XXH64. Fewer words: the whole sequence is one shingle. No words, an empty or
    a null text: zero.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = pa.array(_fingerprints(batch.column(1).to_pylist(), words, seed).view(np.int64))
            yield pa.record_batch([batch.column(0), fp, *(batch.column(c) for c in keep)], ["doc_id", "fp", *keep])

    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *keep)
    return read.mapInArrow(hashed, "doc_id long, fp long" + "".join(f", {c} long" for c in keep))


def _median_split(points: np.ndarray, vantage: np.uint64) -> tuple[int, np.ndarray]:
    d = np.bitwise_count(points ^ vantage).astype(np.int64)
    return int(np.median(d)), d


def plan_tree(sample: np.ndarray, depth: int) -> list[tuple[int, int, int]]:
    """The upper tree on a sample: a heap-ordered list of (node, vantage point, radius)."""
    nodes, level = [], {1: sample}
    for _ in range(depth):
        below = {}
        for node, points in level.items():
            vantage = points[0] if len(points) else np.uint64(0x9E3779B97F4A7C15)
            mu, d = _median_split(points, vantage) if len(points) else (32, np.zeros(0, np.int64))
            nodes.append((node, int(vantage), mu))
            below[2 * node], below[2 * node + 1] = points[d <= mu], points[d > mu]
        level = below
    return nodes


def route(points: np.ndarray, nodes: list[tuple[int, int, int]], depth: int, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of point, leaf) for every leaf that a ball of ``slack`` around a point reaches."""
    index, at = np.arange(len(points)), np.ones(len(points), np.int64)
    plan = {n: (np.uint64(v), mu) for n, v, mu in nodes}
    vantage = np.zeros(2**depth, np.uint64)
    border = np.zeros(2**depth, np.int64)
    for n, (v, mu) in plan.items():
        vantage[n], border[n] = v, mu
    for _ in range(depth):
        d = np.bitwise_count(points[index] ^ vantage[at]).astype(np.int64)
        left, right = d <= border[at] + slack, d > border[at] - slack
        index, at = np.concatenate((index[left], index[right])), np.concatenate((2 * at[left], 2 * at[right] + 1))
    return index, at


class _Forest:
    """Union-find over positions, smallest position as root."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        p = self.parent
        r = p[x]
        while True:
            up = p[r]
            if np.array_equal(up, r):
                return r
            r = up

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            differ = ra != rb
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))


def linked_forest(points: np.ndarray, home: np.ndarray, queries: np.ndarray, radius: int, leaf: int = 48, at_once: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Links between queries and home points within ``radius``, as a spanning forest of positions.

    ``home`` and ``queries`` are positions in ``points``. A vantage-point tree over ``home`` is walked by
    all queries together. Only the forest of links is kept, so a dense group of m points gives m - 1
    links, not all its pairs.
    """
    forest = _Forest(len(points))
    stack = [(home, queries)]
    while stack:
        mine, asked = stack.pop()
        if not len(mine) or not len(asked):
            continue
        if len(mine) > leaf:
            vantage = points[mine[len(mine) // 2]]
            mu, d = _median_split(points[mine], vantage)
            inner = d <= mu
            if inner.any() and not inner.all():
                dq = np.bitwise_count(points[asked] ^ vantage).astype(np.int64)
                near, far = dq <= mu + radius, dq > mu - radius
                if near.sum() + far.sum() < 1.9 * len(asked):
                    stack.append((mine[inner], asked[near]))
                    stack.append((mine[~inner], asked[far]))
                    continue
                # The ball is wider than this split can part: the node is one leaf.
        step = max(1, at_once // len(mine))
        for part in range(0, len(asked), step):
            some = asked[part : part + step]
            q, h = np.nonzero(np.bitwise_count(points[some][:, None] ^ points[mine][None, :]) <= radius)
            differ = some[q] != mine[h]
            forest.unite(some[q][differ], mine[h][differ])
    roots = forest.roots(np.arange(len(points)))
    linked = np.flatnonzero(roots != np.arange(len(points)))
    return linked, roots[linked]


def _links(fps: DataFrame, radius: int, shard_rows: int, query_rows: int) -> DataFrame:
    """A spanning forest (a, b) of the distinct fingerprints ``fp``."""
    n = fps.count()
    depth = max(0, int(np.ceil(np.log2(max(1, n / shard_rows)))))
    some = fps.orderBy(F.xxhash64("fp")).limit(64 * 2 ** min(depth, 10)).collect()
    sample = np.array([r["fp"] for r in some], np.int64).view(np.uint64)
    nodes = plan_tree(sample, min(depth, 10))
    reach = len(route(sample, nodes, min(depth, 10), radius)[0]) / max(1, len(sample))
    if reach > radius + 1:
        return _band_links(fps, radius, shard_rows)
    blocks = max(1, int(np.ceil(reach * n / 2**depth / query_rows)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            points = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            index, leaf = route(points, nodes, depth, radius)
            mine, own = route(points, nodes, depth, 0)
            row = np.concatenate((index, np.tile(mine, blocks)))
            shard = np.concatenate((leaf, np.tile(own, blocks)))
            block = np.concatenate(((points[index] % np.uint64(blocks)).astype(np.int64), np.repeat(np.arange(blocks), len(mine))))
            home = np.arange(len(row)) >= len(index)
            yield pa.record_batch([pa.array(shard), pa.array(block), batch.column(0).take(pa.array(row)), pa.array(home)], ["shard", "block", "fp", "home"])

    dealt = fps.mapInArrow(deal, "shard long, block long, fp long, home boolean").withColumns({"key": F.lit(0).cast("long"), "query": ~F.col("home")})
    return dealt.groupBy("shard", "block").applyInPandas(_searched(radius), "a long, b long")


def _searched(radius: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The search of a shard's rows (key, fp, home, query): one tree for each key."""

    def search(group: pd.DataFrame) -> pd.DataFrame:
        out = [np.zeros((2, 0), np.uint64)]
        order = np.argsort(group["key"].to_numpy(), kind="stable")
        key, fp, home, query = (group[c].to_numpy()[order] for c in ("key", "fp", "home", "query"))
        for mine in np.split(np.arange(len(key)), np.flatnonzero(key[1:] != key[:-1]) + 1):
            points, at = np.unique(fp[mine].view(np.uint64), return_inverse=True)
            if len(points) > 1:
                a, b = linked_forest(points, np.unique(at[home[mine]]), np.unique(at[query[mine]]), radius)
                out.append(np.stack((points[a], points[b])))
        a, b = np.concatenate(out, axis=1).view(np.int64)
        return pd.DataFrame({"a": a, "b": b})

    return search


def _band_links(fps: DataFrame, radius: int, shard_rows: int) -> DataFrame:
    """The forest of :func:`_links` from ``radius + 1`` rows a fingerprint: two within ``radius`` share a whole band.

    Many values of bands share a shard; a value of more than ``shard_rows`` fingerprints is searched in
    blocks, each pair of blocks by itself.
    """
    bands = radius + 1
    width = 64 // bands
    parts = [F.shiftrightunsigned("fp", width * i).bitwiseAND(F.lit((1 << width) - 1)) * bands + i for i in range(bands)]
    keys = fps.select("fp", F.explode(F.array(*parts)).alias("key"))
    counts = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / F.lit(shard_rows)).cast("long")
    every = F.sequence(F.lit(0).cast("long"), blocks - 1)
    own = keys.join(counts, "key").select("key", "fp", "n", F.pmod(F.xxhash64("fp"), blocks).alias("own"), F.explode(every).alias("other"))
    shards = max(1, -(-fps.count() * bands // shard_rows))
    whole = blocks == 1
    shard = F.when(whole, F.pmod(F.xxhash64("key"), F.lit(shards))).otherwise(-1 - F.col("key")).alias("shard")
    sides = [("own", "other", F.lit(True), whole), ("other", "own", F.lit(False), F.lit(True))]
    home, query = (own.select(shard, F.col(i).alias("i"), F.col(j).alias("j"), "key", "fp", h.alias("home"), q.alias("query"), whole.alias("whole")) for i, j, h, q in sides)
    dealt = home.unionByName(query.where("NOT whole"))
    return dealt.groupBy("shard", "i", "j").applyInPandas(_searched(radius), "a long, b long")


class Shingles:
    """The distinct shingles of a text as ascending 64-bit hashes; fewer words are one shingle, none the empty set.

    A-Z are lower-cased. The dictionary of the words' hashes is bounded.
    """

    def __init__(self, words: int, most: int = 400_000) -> None:
        self.words, self.most, self.known = words, most, {}

    def __call__(self, text: str | None) -> np.ndarray:
        w, known = text.encode("utf-8", "replace").lower().split() if text else [], self.known
        if not w:
            return np.zeros(0, np.uint64)
        if len(known) > self.most:
            known.clear()
        for x in set(w).difference(known):
            known[x] = xxhash.xxh64_intdigest(x, 7)
        h = np.array([known[x] for x in w], np.uint64)
        size = min(self.words, len(h))
        out = np.full(len(h) - size + 1, size, np.uint64)
        for i in range(size):
            out = (out ^ (out >> np.uint64(29))) * _MIX + h[i : i + len(out)]
        return np.unique((out ^ (out >> np.uint64(32))) * _MIX)


def _set_rows(read: DataFrame, shingle: int, words: int, least: float, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, k1, k2, fp, node, n, tokens, bits) of (doc_id, text, k1, k2): node names the set of n shingles.

    ``tokens`` are so many of the set's rarest shingles, rarest first, that a set alike shares one of
    them; ``bits`` holds of each pattern of leading bits whether an odd number of shingles has it. Of copies
    of a set within a task only the first has these. fp is of ``words`` words, or zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, seen, (known, count) = Shingles(shingle), set(), common
        for batch in slices(batches):
            strings, node, size, tokens, bits = batch.column("text").to_pylist(), [], [], [], []
            for s in strings:
                x = make(s)
                name = xxhash.xxh64_intdigest(x.tobytes())
                node.append(name)
                size.append(len(x))
                if not len(x) or name in seen:
                    tokens.append(None)
                    bits.append(None)
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(name)
                rank = np.zeros(len(x), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
                    rank = np.where(known[at] == x, count[at], 0)
                tokens.append(x[np.lexsort((x, rank))[: len(x) - int(np.ceil(least * len(x) - 1e-9)) + 1]].view(np.int64))
                odd = np.bincount((x >> np.uint64(64 - _BITS.bit_length() + 1)).astype(np.int64), minlength=_BITS) & 1
                bits.append(np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64))
            fp = _fingerprints(strings, words, 42) if words else np.zeros(len(strings), np.uint64)
            own = [pa.array(fp.view(np.int64)), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(size, pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in (tokens, bits))]
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "k1", "k2")), *own], ["doc_id", "k1", "k2", "fp", "node", "n", "tokens", "bits"])

    return read.mapInArrow(run, "doc_id long, k1 long, k2 long, fp long, node long, n long, tokens array<long>, bits array<long>")


def _common_shingles(read: DataFrame, words: int, sample: int = 10_000, most: int = 50_000) -> tuple[np.ndarray, np.ndarray]:
    """(ascending hashes, rank) of the shingles frequent in a bounded sample; they come last in the order of shingles.

    Any order gives the same links. This one only keeps the groups of candidates small.
    """
    share = max(1, read.count() // sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingles(words)
        for batch in slices(batches, 256):
            sets = [make(s) for s in batch.column("text").to_pylist()]
            yield pa.record_batch([pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))], ["h"])

    counted = read.where(F.pmod("k2", F.lit(share)) == 0).select("text").mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("c"))
    rows = counted.where("c > 2").orderBy(F.desc("c"), "h").limit(most).collect()
    h = np.array([r["h"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], np.array([r["c"] for r in rows], np.int64)[order]


def _may_be_alike(n: Column, i: Column, m: Column, j: Column, least: float) -> Column:
    """Whether sets of n and m shingles, whose first common one stands at i and j, can reach the similarity."""
    need = F.ceil(F.lit(least / (1 + least)) * (n + m) - 1e-9)
    return (F.least(n, m) >= least * F.greatest(n, m) - 1e-9) & (F.least(n - i, m - j) >= need)


def _counts(x: np.ndarray) -> bytes:
    """How many shingles of a set begin with each pattern of bits, a byte a pattern; about two patterns a shingle."""
    bits = max(6, int(len(x)).bit_length() + 1)
    return np.minimum(np.bincount((x >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def _most_shared(x: bytes, y: bytes) -> float:
    """No two sets with these counts share more shingles."""
    a, b = sorted((np.frombuffer(z, np.uint8).astype(np.int64) for z in (x, y)), key=len)
    full = a.max(initial=0) == 255 or b.max(initial=0) == 255  # counts that stopped at a byte bound nothing
    return np.inf if full else np.minimum(a, b.reshape(len(a), -1).sum(axis=1)).sum()


def _whole_sets(read: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, n, shingles, counts) of the wanted ``nodes`` (node, k1, k2), one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingles(words)
        for batch in slices(batches, 256):
            sets = [make(s) for s in batch.column("text").to_pylist()]
            own = [pa.array([len(x) for x in sets], pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())), pa.array(list(map(_counts, sets)), pa.binary())]
            yield pa.record_batch([batch.column("node"), *own], ["node", "n", "shingles", "counts"])

    texts = read.join(few(written(nodes)), ["k1", "k2"]).select("node", "text")
    return texts.mapInArrow(run, "node long, n long, shingles array<long>, counts binary").dropDuplicates(["node"])


def _confirmed(pairs: DataFrame, whole: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets of shingles are alike by ``least``.

    Pairs (a, n, b, m) of sets of n and m shingles first meet with the sets' counts, which bound what they
    can share; the sets themselves are joined to the pairs that are left.
    """

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            rows = zip(*(batch.column(c).to_pylist() for c in ("n", "m", "x", "y")), strict=True)
            good = [_most_shared(x, y) >= least / (1 + least) * (n + m) - 1e-9 for n, m, x, y in rows]
            yield batch.select(["a", "b", "n", "m"]).filter(pa.array(good, pa.bool_()))

    def side(name: str, column: str, to: str) -> DataFrame:
        return whole.select(F.col("node").alias(name), F.col(column).alias(to))

    likely = pairs.join(side("a", "counts", "x"), "a").join(side("b", "counts", "y"), "b").mapInArrow(bounded, "a long, b long, n long, m long")
    met = written(likely).join(side("a", "shingles", "x"), "a").join(side("b", "shingles", "y"), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return written(met.where(shared >= least * (F.col("n") + F.col("m") - shared) - 1e-9).select("a", "b"))


def _pairs(x: DataFrame, y: DataFrame, least: float, *more: Column) -> DataFrame:
    """(a, n, b, m), once each, a < b: rows x and y (token, node, n, pos, root) of one token, but different roots, that may be alike."""
    x, y = x.alias("x"), y.alias("y")
    differ = (F.col("x.node") != F.col("y.node")) & (F.col("x.root") != F.col("y.root"))
    able = _may_be_alike(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"), least)
    on = (F.col("x.token") == F.col("y.token")) & differ & able
    for condition in more:
        on = on & condition
    both = x.join(y, on).select(F.array_sort(F.array(F.struct("x.node", "x.n"), F.struct("y.node", "y.n"))).alias("p"))
    a, b = F.element_at("p", 1), F.element_at("p", 2)
    return both.select(a["node"].alias("a"), a["n"].alias("n"), b["node"].alias("b"), b["n"].alias("m")).distinct()


def _open(tokens: DataFrame, edges: DataFrame, least: float) -> DataFrame:
    """The rows, with the roots that ``edges`` give, whose tokens still join sets of different groups that may be alike."""
    rooted = written(tokens.drop("root").join(few(components(edges)), "node", "left").select("token", "node", "n", "pos", F.coalesce("root", "node").alias("root")))
    spread = rooted.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("n").alias("fewest")).where("low <> high")
    best = F.least("n", F.greatest("fewest", F.ceil(F.col("n") * least - 1e-9)))
    able = _may_be_alike(F.col("n"), F.col("pos"), best, F.lit(0), least)  # with a set of fewest shingles, first at the token
    return rooted.join(spread, "token").where(able).select(*rooted.columns).dropDuplicates(["token", "node"])


def _exact_links(read: DataFrame, sets: DataFrame, words: int, least: float) -> DataFrame:
    """Links (a, b) that join all nodes alike by ``least``.

    Sets that share one of their rarest shingles are compared with that shingle's vantage point, the set
    that has it earliest. Pairs of others are compared only where this leaves them in different groups, and
    only those that can reach the similarity: by where the token stands in each, and by the bits in which
    they differ, of which each shingle of one set alone changes one at most.
    """
    rows = sets.select("node", "n", F.posexplode("tokens").alias("pos", "token"), F.col("node").alias("root"))
    often = rows.groupBy("token").agg(F.count("*").alias("rows")).where("rows > 1").select("token")
    tokens = written(rows.join(often, "token"))
    keys = sets.groupBy("node").agg(F.min(F.struct("k1", "k2")).alias("k")).select("node", "k.k1", "k.k2")

    def confirmed(pairs: DataFrame) -> DataFrame:
        some = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        return _confirmed(pairs, written(_whole_sets(read, keys.join(some, "node"), words)), least)

    lead = tokens.groupBy("token").agg(F.min(F.struct("pos", "n", "node", "root")).alias("s")).select("token", "s.*")
    tried = written(_pairs(lead, tokens, least))
    edges = confirmed(tried)
    open_ = written(_open(tokens, edges, least))
    bits = sets.where("tokens IS NOT NULL").join(open_.select("node").distinct(), "node", "left_semi").select("node", "bits").dropDuplicates(["node"])
    left = written(open_.join(few(written(bits), 100_000), "node"))
    apart = sum((F.bit_count(F.col("x.bits")[i].bitwiseXOR(F.col("y.bits")[i])) for i in range(_BITS // 64)), F.lit(0))
    within = apart <= (F.lit((1 - least) / (1 + least)) * (F.col("x.n") + F.col("y.n"))) + 1e-9
    rest = _pairs(left, left.where("true"), least, F.col("x.node") < F.col("y.node"), within)
    return edges.union(confirmed(written(rest.join(tried, ["a", "b"], "left_anti"))))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of the connected components of edges (a, b); root is the smallest node.

    Alternating large-star and small-star steps, each a shuffle and a checkpoint, until nothing changes.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not large:
            both = both.where("b < a")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = both.join(least, "a")
        out = out.where("b > a") if large else out
        own = least.where("m < a").select("a", F.col("m").alias("b"))
        moved = out.where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        return (moved if large else moved.union(own)).where("a <> b").distinct()

    now, seen = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), None
    for _ in range(rounds):
        now = cut(star(star(now, True), False))
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
    raise RuntimeError("components did not settle")


def _grouped(
    docs: DataFrame, doc_id: str, text: str, words: int, radius: int, sketch_words: int, similarity: float, shard_rows: int, query_rows: int, fingerprints: bool = True
) -> DataFrame:
    """(doc_id, k1, k2, fp, root) of every row; the rows of a group have one root, (k1, k2) names a row."""
    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    read = read.select("*", *row_key("doc_id", "text"))
    if sketch_words:
        common = _common_shingles(read, sketch_words)
        hashed = written(_set_rows(read, sketch_words, words if fingerprints else 0, similarity, common))
        edges = _exact_links(read, hashed, sketch_words, similarity)
    else:
        hashed = cut(simhash(read, words=words, keep=("k1", "k2")).withColumn("node", F.col("fp")))
        edges = _links(hashed.select("fp").distinct(), radius, shard_rows, query_rows)
    return hashed.join(few(components(edges)), "node", "left").select("doc_id", "k1", "k2", "fp", F.coalesce("root", "node").alias("root"))


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = 3,
    radius: int = 3,
    sketch_words: int = 0,
    similarity: float = 0.8,
    shard_rows: int = 32_768,
    query_rows: int = 131_072,
) -> DataFrame:
    """(doc_id, fp, component_id) of every document.

    Documents whose fingerprints differ in at most ``radius`` bits are linked; ``component_id`` is the
    smallest doc_id reachable, itself included. With ``sketch_words`` the links are instead those of texts
    whose sets of shingles of so many words have a Jaccard similarity of ``similarity`` at least: all of
    them and no others. The fingerprints then decide nothing, and ``radius`` isn't used.

    Copies take part in the search once, whatever their number. Texts without words share the fingerprint
    zero. Rows with a null id keep it and count in no minimum (null where no other id is reachable);
    repeated rows are returned each; other columns are not read; an empty table gives an empty result.
    """
    found = cut(_grouped(docs, doc_id, text, words, radius, sketch_words, similarity, shard_rows, query_rows))
    merged = found.groupBy("root").agg(F.min("doc_id").alias("least"), F.count("*").alias("of")).where("of > 1")
    component = F.when(F.isnull("of"), F.col("doc_id")).otherwise(F.col("least"))
    return found.join(few(written(merged)), "root", "left").select("doc_id", "fp", component.alias("component_id"))


def drop_near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = 3,
    radius: int = 3,
    sketch_words: int = 0,
    similarity: float = 0.8,
    shard_rows: int = 32_768,
    query_rows: int = 131_072,
) -> DataFrame:
    """The documents, all columns, with one row of each group of near duplicates: that of the smallest doc_id.

    A null id comes after all others. Among rows of that id the hash of id and text decides, among rows
    equal in both the other columns. Rows of one id with unlike texts are in different groups: each stays.
    Null and empty texts, and those of white space, are one group. Whole texts are compared, of any length;
    an empty table gives an empty result. Other columns, of any name, stay as they are.
    """
    found = _grouped(docs, doc_id, text, words, radius, sketch_words, similarity, shard_rows, query_rows, False)
    rows = written(found.groupBy("root", "k1", "k2").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")))
    first = rows.groupBy("root").agg(F.min(F.struct(F.isnull("id"), "id", "k1", "k2")).alias("s"), F.sum("n").alias("of")).where("of > 1")
    stays = (F.col("k1") == F.col("s.k1")) & (F.col("k2") == F.col("s.k2"))
    judged = rows.join(few(written(first)), "root").select("k1", "k2", "n", stays.alias("stays")).where("NOT stays OR n > 1")
    names = [F.col(c).alias(f"__{c}") for c in ("k1", "k2", "stays")]
    marked = written(judged.select(*names))
    keyed = docs.select(F.struct("*").alias("__row"), F.col(f"`{doc_id}`").cast("long").alias("__id"), F.col(f"`{text}`").cast("string").alias("__text"))
    keyed = keyed.select("__row", *[k.alias(f"__k{n}") for n, k in enumerate(row_key("__id", "__text"), 1)])
    alone = keyed.join(few(marked.select("__k1", "__k2")), ["__k1", "__k2"], "left_anti")
    again = keyed.join(few(marked.where("__stays").select("__k1", "__k2")), ["__k1", "__k2"])
    one = again.groupBy("__k1", "__k2").agg(F.min_by("__row", F.to_json("__row")).alias("__row"))
    return alone.select("__row").unionByName(one.select("__row")).select("__row.*")
