"""Unitigs by local compaction: words dealt by the minimizers of their overlaps, paths joined within a task, their ends glued.

All words that meet in one overlap of k - 1 letters lie where the overlap's minimizer is dealt, so each link is
decided in one place. A task joins the words of its overlaps to paths in one pass. A word whose two overlaps are dealt to two
places ends a path in both: these ends alone are glued, by pointer doubling over paths instead of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandset.functions import kmer as K
from strandset.operators import words as W
from strandset.operators.lineage import written

#: Words of a minimizer, at most; those of one with more are dealt by the overlap itself.
HEAVY = 500_000
#: Oriented words that a place has, about; a task joins twice as many words at a time, at most.
AT_ONCE = 250_000
#: Of large sets, one word in so many is taken to find the minimizers that are too frequent.
SAMPLE = 64
_COMPLETE, _PART, _SINGLE = range(3)
_PATHS = "kind byte, id long, mirror long, next long, seq string"
_LETTERS = np.frombuffer("".join(K.BASES).encode(), np.uint8)
_OURS = 1 << 62  # marks a path whose first word's left overlap lies in the same place


def minimizer(code: Column, length: int, m: int) -> Column:
    """The least of the mixed canonical codes of the m-letter parts of a string of ``length`` letters; m <= 15."""
    mask, mirror = F.lit((1 << (2 * m)) - 1), K.reverse_complement_code(code, length)
    parts = []
    for i in range(length - m + 1):
        here, there = (F.shiftrightunsigned(x, 2 * j).bitwiseAND(mask) for x, j in ((code, i), (mirror, length - m - i)))
        mixed = F.least(here, there).bitwiseXOR(F.lit(0x2545F491).bitwiseAND(mask))  # so that no run of one letter comes first
        parts.append((mixed * F.lit(0x5851F42D).cast("long")).bitwiseAND(mask))
    return F.least(*parts) if len(parts) > 1 else parts[0]


def minimizer_size(k: int, n: int, share: int = 20_000) -> int:
    """Letters of a minimizer, so that about ``share`` of n words have each."""
    m = 3
    while m < min(15, k - 1) and 4**m * share < 2 * n:
        m += 1
    return min(m, k - 1)


def reverse_complement_codes(codes: np.ndarray, k: int) -> np.ndarray:
    """:func:`strandset.functions.kmer.reverse_complement_code` of an array."""
    bits = codes.astype(np.uint64)
    for size, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        s, mask_ = np.uint64(size), np.uint64(mask)
        bits = ((bits >> s) & mask_) | ((bits & mask_) << s)
    return ((bits >> np.uint64(64 - 2 * k)) ^ np.uint64((1 << (2 * k)) - 1)).astype(np.int64)


def links(s: np.ndarray, c: np.ndarray, left: np.ndarray, right: np.ndarray, k: int) -> np.ndarray:
    """The number of the word that follows each oriented word s, -1 for none.

    ``left`` and ``right`` say whether a word's overlaps are decided here, c names a word and its mirror image alike. A word
    follows another if it is the only other word behind the overlap, and that one the only other before it.
    """
    outs, ins = np.flatnonzero(right), np.flatnonzero(left)
    before, behind = s[outs] & ((1 << (2 * k - 2)) - 1), s[ins] >> 2
    order = np.argsort(behind, kind="stable")
    ins, behind = ins[order], behind[order]
    low, high = np.searchsorted(behind, before, "left"), np.searchsorted(behind, before, "right")
    n = high - low
    u = np.repeat(outs, n)
    v = ins[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())] if n.sum() else np.zeros(0, np.int64)
    other = c[u] != c[v]
    u, v = u[other], v[other]
    alone = (np.bincount(u, minlength=len(s))[u] == 1) & (np.bincount(v, minlength=len(s))[v] == 1)
    follows = np.full(len(s), -1)
    follows[u[alone]] = v[alone]
    return follows


def places(follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(head, distance) of each word on its path; -1 as head for the words of rings."""
    up = np.arange(len(follows))
    up[follows[follows >= 0]] = np.flatnonzero(follows >= 0)
    dist = (up != np.arange(len(up))).astype(np.int64)
    active, steps = np.flatnonzero(dist), 1
    while len(active) and steps < len(up):
        ahead = up[active]
        dist[active], up[active] = dist[active] + dist[ahead], up[ahead]
        active, steps = active[dist[up[active]] > 0], 2 * steps
    head = up
    head[active] = -1
    return head, dist


def spelled(heads: np.ndarray, rows: np.ndarray, path: np.ndarray, dist: np.ndarray, k: int) -> pa.Array:
    """The strings of paths: the codes of their first words, then the last letter of each word ``rows`` of a path at its distance."""
    n = np.bincount(path, minlength=len(heads)) + k - 1
    ends = np.cumsum(n)
    data = np.empty(ends[-1] if len(ends) else 0, np.uint8)
    starts = ends - n
    for j in range(k):
        data[starts + j] = (heads >> (2 * (k - 1 - j))) & 3
    data[starts[path] + k - 1 + dist] = rows & 3
    offsets = np.concatenate(([0], ends))
    return pa.LargeStringArray.from_buffers(len(heads), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(_LETTERS[data])).cast(pa.string())


def _sides(c: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word once, in order, with all its sides that are decided here."""
    order = np.argsort(c)
    c, side = c[order], side[order]
    first = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1]))) if len(c) else np.zeros(0, np.int64)
    return c[first], np.bitwise_or.reduceat(side, first) if len(c) else side


def _oriented(c: np.ndarray, sides: np.ndarray, k: int, canonical: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(s, left, right, c): the words, then their mirror images if canonical, whether their overlaps are decided here, and the words' names."""
    left, right = (sides & 1) > 0, (sides & 2) > 0
    if not canonical:
        return c, left, right, c
    return np.concatenate((c, reverse_complement_codes(c, k))), np.concatenate((left, right)), np.concatenate((right, left)), np.concatenate((c, c))


def joined_paths(c: np.ndarray, side: np.ndarray, k: int, canonical: bool) -> Iterator[pa.RecordBatch]:
    """The paths of words c whose left (1), right (2) or both (3) overlaps are decided here, one row or two a word.

    Complete ones once, each orientation of the others with the path that comes next; a word that ends here on
    one side and goes on elsewhere is told alone.
    """
    s, left, right, c = _oriented(*_sides(c, side), k, canonical)
    follows = links(s, c, left, right, k)
    head, dist = places(follows)

    def batch(kind: int, ids: np.ndarray, mirror: np.ndarray | None, after: pa.Array | None, seq: pa.Array | None) -> pa.RecordBatch:
        n = len(ids)
        rest = [pa.nulls(n, pa.int64()) if mirror is None else pa.array(mirror), pa.nulls(n, pa.int64()) if after is None else after, pa.nulls(n, pa.string()) if seq is None else seq]
        return pa.record_batch([pa.array(np.full(n, kind, np.int8)), pa.array(ids), *rest], ["kind", "id", "mirror", "next", "seq"])

    on_path = np.flatnonzero(head >= 0)
    heads, path = np.unique(head[on_path], return_inverse=True)
    size = np.bincount(path, minlength=len(heads))
    last = np.zeros(len(heads), np.int64)
    final = dist[on_path] == size[path] - 1
    last[path[final]] = on_path[final]
    opens, goes_on = ~left[heads], ~right[last]
    complete = ~opens & ~goes_on
    alone = (size == 1) & ~complete
    chosen = complete.copy()
    if canonical:
        chosen &= (c[heads] > c[last]) | ((size == 1) & (s[heads] == c[heads]))
    for kind, which in ((_COMPLETE, chosen), (_PART, ~complete & ~alone)):
        number = np.cumsum(which) - 1
        rows = which[path]
        seq = spelled(s[heads[which]], s[on_path[rows]], number[path[rows]], dist[on_path[rows]], k)
        first, end = heads[which], last[which]
        ids = s[first] | np.where(left[first], _OURS, 0)
        ends = reverse_complement_codes(s[end], k) | np.where(right[end], _OURS, 0) if canonical else ids
        yield batch(kind, ids, ends, pa.array(s[end], mask=right[end]), seq)
    single = heads[alone & (s[heads] == c[heads])]
    yield batch(_SINGLE, s[single], None, None, None)
    rings = np.flatnonzero(head < 0)
    texts = []
    for i in rings[np.argsort(s[rings], kind="stable")]:
        if head[i] < 0:
            around = [i]
            while (j := follows[around[-1]]) != i:
                around.append(j)
            head[around] = 0
            if s[i] == c[around].min():  # else its mirror image stays
                texts.append("".join(K.BASES[(s[i] >> (2 * (k - 1 - j))) & 3] for j in range(k)) + "".join(K.BASES[s[j] & 3] for j in around[1:]))
    if texts:
        yield batch(_COMPLETE, np.zeros(len(texts), np.int64), None, None, pa.array(texts, pa.string()))


def place_ends(c: np.ndarray, side: np.ndarray, k: int, canonical: bool) -> pa.RecordBatch:
    """(code, told, goes): of each word of a place the sides that are decided here (as in :func:`joined_paths`), and those of them on which a path goes on."""
    c, sides = _sides(c, side)
    s, left, right, names = _oriented(c, sides, k, canonical)
    follows = links(s, names, left, right, k)
    after = follows >= 0
    before = np.zeros(len(s), bool)
    before[follows[after]] = True
    n = len(c)
    return pa.record_batch([pa.array(c), pa.array(sides.astype(np.int8)), pa.array((before[:n] + 2 * after[:n]).astype(np.int8))], ["code", "told", "goes"])


def overlap_minimizers(c: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`minimizer` of the left and the right overlap of each word."""
    mask, mirror = (1 << (2 * m)) - 1, reverse_complement_codes(c, k)
    left = right = None
    for i in range(k - m + 1):
        mixed = ((np.minimum((c >> (2 * (k - m - i))) & mask, (mirror >> (2 * i)) & mask) ^ (0x2545F491 & mask)) * 0x5851F42D) & mask
        if i < k - m:
            left = mixed if left is None else np.minimum(left, mixed)
        if i:
            right = mixed if right is None else np.minimum(right, mixed)
    return left, right


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[np.ndarray]:
    """The words of about ``most`` rows at a time."""
    held, size = [], 0
    for batch in batches:
        held.append(np.asarray(batch.column("c")))
        size += batch.num_rows
        if size >= most:
            yield np.concatenate(held)
            held, size = [], 0
    if size:
        yield np.concatenate(held)


def dealt_words(words: DataFrame, k: int, canonical: bool, heavy_words: int = HEAVY, at_once: int = AT_ONCE) -> DataFrame:
    """(place, side, codes): the words where their left (1), right (2) or both (3) overlaps are decided, as arrays, in the order of their places.

    An overlap lies where its minimizer is dealt, or by itself if that has more than ``heavy_words`` words. A place has about ``at_once``
    oriented words, and a row has all words of a batch with one side for a place, in four bytes each if they fit.
    """
    return _dealt(words, k, canonical, heavy_words, at_once)[0]


def _dealt(words: DataFrame, k: int, canonical: bool, heavy_words: int, at_once: int) -> tuple[DataFrame, int]:
    """:func:`dealt_words`, and the letters of the minimizers by which they are dealt."""
    c = words.select(W.bits_of(words).alias("c"))
    n = c.count()
    m, tasks = minimizer_size(k, n), max(2 * words.sparkSession.sparkContext.defaultParallelism, -(-n // (8 * at_once)))
    n_places = max(tasks, -(-2 * n // at_once))
    share = min(SAMPLE, max(1, n // 100_000))  # weights come from every share-th word by hash: they only say how words are dealt
    overlaps = [F.shiftright("c", 2), F.col("c").bitwiseAND(F.lit((1 << (2 * k - 2)) - 1))]
    sample = c.where(F.pmod(F.xxhash64("c"), F.lit(share)) == 0).select(F.explode(F.array(*[minimizer(o, k - 1, m) for o in overlaps])).alias("m"))
    often = sample.groupBy("m").agg(F.count("*").alias("n")).where(F.col("n") * share > heavy_words)
    heavy = np.array(sorted(r["m"] for r in often.collect()), np.int64)  # about 2 n / heavy_words numbers
    kind = np.uint32 if 2 * k <= 32 else np.int64

    def place_of(v: np.ndarray) -> np.ndarray:
        return (((v.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(n_places)).astype(np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _gathered(batches, 2 * at_once):
            to = []
            for least, overlap in zip(overlap_minimizers(c, k, m), (c >> 2, c & ((1 << (2 * k - 2)) - 1)), strict=True):
                place = place_of(least)
                if len(heavy) and len(alone := np.flatnonzero(np.isin(least, heavy))):
                    own = overlap[alone]
                    place[alone] = place_of(np.minimum(own, reverse_complement_codes(own, k - 1)) if canonical else own)
                to.append(place)
            same = to[0] == to[1]
            for side, place, mine in ((3, to[0][same], c[same]), (1, to[0][~same], c[~same]), (2, to[1][~same], c[~same])):
                order = np.lexsort((mine, place))
                place, data = place[order], mine[order].astype(kind)
                cut = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(place) else np.zeros(0, np.int64)
                offsets = np.append(cut, len(place)).astype(np.int64) * data.itemsize
                codes = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cut), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())
                yield pa.record_batch([pa.array(place[cut].astype(np.int32)), pa.array(np.full(len(cut), side, np.int8)), codes], ["place", "side", "codes"])

    return c.mapInArrow(deal, "place int, side byte, codes binary").repartition(tasks, "place").sortWithinPartitions("place"), m


def _whole_places(batches: Iterator[pa.RecordBatch], k: int, m: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(c, side) of each place, or of its parts if it has more than ``most`` words; rows come in the order of their places."""
    held: list[tuple[np.ndarray, int]] = []
    now = None

    def whole() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        c = np.concatenate([x for x, _ in held])
        side = np.repeat(np.array([side for _, side in held], np.int8), [len(x) for x, _ in held])
        held.clear()
        if len(c) > most:
            yield from _parts(c, side, k, m, most)
        else:
            yield c.astype(np.int64), side

    for batch in batches:
        for place, side, codes in zip(*(batch.column(x).to_pylist() for x in ("place", "side", "codes")), strict=True):
            if place != now and held:
                yield from whole()
            now = place
            held.append((np.frombuffer(codes, np.uint32 if 2 * k <= 32 else np.int64), side))
    if held:
        yield from whole()


def _parts(c: np.ndarray, side: np.ndarray, k: int, m: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(c, side) of the parts of a place that has more than ``most`` words, so that memory does not grow with places where many words meet.

    All words of an overlap are in one part: minimizers go together as long as they have at most ``most`` words, and the overlaps
    of one that has more are dealt to several parts. A word whose overlaps are in two parts is in both, as if these were two places.
    """
    step = max(1, min(most, AT_ONCE))
    least = np.empty((2, len(c)), np.int32)  # minimizers have at most 15 letters
    for a in range(0, len(c), step):
        least[:, a : a + step] = overlap_minimizers(c[a : a + step].astype(np.int64), k, m)
    here = np.stack(((side & 1) > 0, (side & 2) > 0))
    once = here[1] & ~(here[0] & (least[0] == least[1]))
    which, n = np.unique(np.concatenate((least[0, here[0]], least[1, once])), return_counts=True)
    first, several = np.zeros(len(which), np.int32), np.where(n > most, -(-3 * n // most), 1)  # a word may be in two of several
    part, size = 0, 0
    for i, (words, of) in enumerate(zip(n.tolist(), several.tolist(), strict=True)):
        if size and size + words > most:
            part, size = part + 1, 0
        first[i] = part
        part, size = (part + of, 0) if of > 1 else (part, size + words)
    del once
    to = np.empty((2, len(c)), np.int32)
    for i, drop in enumerate((2, 0)):
        for a in range(0, len(c), step):
            mine = np.minimum(np.searchsorted(which, least[i, a : a + step]), len(which) - 1)  # those that are not here are not asked
            to[i, a : a + step] = first[mine]
            if len(wide := np.flatnonzero(several[mine] > 1)):
                own = (c[a : a + step][wide].astype(np.int64) >> drop) & ((1 << (2 * k - 2)) - 1)
                own = np.minimum(own, reverse_complement_codes(own, k - 1)).astype(np.uint64)
                to[i, a + wide] += ((own * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(33)).astype(np.int64) % several[mine[wide]]
    del least
    for p in range(int(to[here].max()) + 1):
        left, right = here & (to == p)
        mine = left | right
        if mine.any():
            yield c[mine].astype(np.int64), (left[mine] + 2 * right[mine]).astype(np.int8)


def local_ends(words: DataFrame, k: int, canonical: bool, heavy_words: int = HEAVY, at_once: int = AT_ONCE) -> DataFrame:
    """:func:`place_ends` of all places: one row a word, or two if its overlaps are decided in two places."""
    dealt, m = _dealt(words, k, canonical, heavy_words, at_once)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, side in _whole_places(batches, k, m, 2 * at_once):
            yield place_ends(c, side, k, canonical)

    return dealt.mapInArrow(ends, "code long, told byte, goes byte")


def local_paths(words: DataFrame, k: int, canonical: bool, heavy_words: int = HEAVY, at_once: int = AT_ONCE) -> DataFrame:
    """(kind, id, mirror, next, seq) of all places: complete unitigs, parts to be glued, and words that end on one side."""
    dealt, m = _dealt(words, k, canonical, heavy_words, at_once)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, side in _whole_places(batches, k, m, 2 * at_once):
            yield from joined_paths(c, side, k, canonical)

    return written(dealt.mapInArrow(join, _PATHS))


def cut_ring(seq: Column, k: int, canonical: bool) -> Column:
    """A ring's string turned so that it begins with its smallest word; of a ring and its mirror image that which holds the word as it is.

    ``seq`` holds every word once, whatever it begins with.
    """
    n = F.length(seq) - (k - 1)

    def turned(s: Column, at: Column) -> Column:
        around = F.concat(F.substring(s, at, n - at + 1), F.substring(s, F.lit(1), at - 1))
        return F.left(F.repeat(around, F.ceil((n + k - 1) / n).cast("int")), n + k - 1)

    def word(i: Column) -> Column:
        w = F.substring(seq, i, F.lit(k))
        return F.struct((K.canonical(w) if canonical else w).alias("w"), ((w == K.canonical(w)) if canonical else F.lit(True)).alias("own"), i.alias("i"))

    first = F.array_min(F.transform(F.sequence(F.lit(1), n), word))
    mirror = turned(K.reverse_complement(seq), n + 1 - first["i"])
    return F.when(first["own"], turned(seq, first["i"])).otherwise(mirror)
