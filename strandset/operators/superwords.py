"""Counting by super-words: neighbouring words with one minimizer are shuffled as one packed string and counted in place.

Equal words (or mirror images) have equal minimizers, so they meet where the minimizer is dealt. A row of the shuffle holds all
super-words of a batch for one place, two bits a letter, instead of a row a word. Words of minimizers
that are too frequent are counted within a batch and dealt by themselves. Super-words can carry the number of the set or
read that they come from, so that the sets of a word, and the reads that share one, are found in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandset.functions.kmer import BASES
from strandset.operators import words as W

_CODE = np.full(256, 255, np.uint8)
_CODE[np.frombuffer("".join(BASES).encode(), np.uint8)] = np.arange(4)
_LONGEST = 255  # words of a super-word: its number is a byte
_HALF = 4_000_000  # words that are sorted at a time
_PLACE = 2_000_000  # words of a place, about
_PART = 1_000_000  # different words that a counter adds to at a time
#: A fragment is taken for the estimate of minimizers' shares if the hash of its row's other columns but the set (else its own) is 0 modulo this.
SAMPLE = 64
#: Words of a minimizer from which they are dealt by themselves; see :func:`heavy_minimizers` for more.
HEAVY = 20_000_000


def window_codes(x: np.ndarray, size: int, mirror: bool = False) -> np.ndarray:
    """The 2-bit codes of each ``size`` <= 31 neighbouring letters (0 to 3), or of their reverse complements, by doubling."""
    part, n = (3 - x if mirror else x).astype(np.int64), 1
    out, done = None, 0
    while True:
        if size & n:
            if out is None:
                out = part
            else:
                a, b = out[: len(x) - done - n + 1], part[done : len(x) - n + 1]
                out = (b << (2 * done)) | a if mirror else (a << (2 * n)) | b
            done += n
        if done == size:
            return out
        a, b = part[:-n], part[n:]
        part, n = ((b << (2 * n)) | a if mirror else (a << (2 * n)) | b), 2 * n


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    n = 1
    while 2 * n <= width:
        v, n = np.minimum(v[:-n], v[n:]), 2 * n
    return np.minimum(v[: len(v) - (width - n)], v[width - n :]) if width > n else v


def minimizers(x: np.ndarray, k: int, m: int) -> np.ndarray:
    """For each word of k letters the least mixed canonical code of its parts of m letters."""
    mask = (1 << (2 * m)) - 1
    parts = np.minimum(window_codes(x, m), window_codes(x, m, True))
    return _least(((parts ^ (0x2545F491 & mask)) * 0x5851F42D) & mask, k - m + 1)


def _letters(frags: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All letters of a batch and whether a word of k letters starts at each, within one fragment of A, C, G, T."""
    frags = frags.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(frags.buffers()[1], np.int64)[frags.offset : frags.offset + len(frags) + 1]
    data = np.frombuffer(frags.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    x = _CODE[data]
    breaks = np.zeros(len(x) + 1, np.int32)
    ends = offsets[1:] - offsets[0]
    for j in range(1, k):  # no word starts in the last k - 1 letters of a fragment
        at = ends - j
        breaks[at[at >= 0]] = 1
    other = np.flatnonzero(x > 3)
    for j in range(k):
        breaks[np.maximum(other - j, 0)] = 1
    return np.where(x > 3, 0, x), breaks[:-1] == 0


def _super_words(x: np.ndarray, starts: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first letter, words, minimizer) of the super-words of a batch."""
    if len(x) < k:
        return (np.zeros(0, np.int64),) * 3
    least = minimizers(x, k, m)
    good = starts[: len(least)]
    edge = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (good[1:] != good[:-1]))))
    count = np.diff(np.append(edge, len(least)))
    edge, count = edge[good[edge]], count[good[edge]]
    n = -(-count // _LONGEST)
    if len(n) and n.max() > 1:
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        edge, count = np.repeat(edge, n) + step * _LONGEST, np.minimum(np.repeat(count, n) - step * _LONGEST, _LONGEST)
    return edge, count, least[edge]


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1 ... first[i] + count[i] - 1, one after another."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _packed(x: np.ndarray) -> bytes:
    x = np.concatenate((x, np.zeros(-len(x) % 4, np.uint8))).reshape(-1, 4)
    return (x[:, 0] | x[:, 1] << 2 | x[:, 2] << 4 | x[:, 3] << 6).astype(np.uint8).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    y = np.frombuffer(data, np.uint8)
    return np.stack((y & 3, y >> 2 & 3, y >> 4 & 3, y >> 6), axis=1).ravel()


def _narrow(numbers: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the largest needs."""
    low, high = int(numbers.min(initial=0)), int(numbers.max(initial=0))
    return numbers.astype(np.int64 if low < 0 or high >> 32 else np.uint32 if high >> 16 else np.uint16 if high >> 8 else np.uint8).tobytes()


def _widened(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[len(data) // n]).astype(np.int64)


def _codes_of(x: np.ndarray, at: np.ndarray, k: int, canonical: bool) -> np.ndarray:
    if not len(at):
        return np.zeros(0, np.int64)
    words = window_codes(x, k)[at]
    return np.minimum(words, window_codes(x, k, True)[at]) if canonical else words


def minimizer_letters(k: int) -> int:
    """Letters of a minimizer: half a word, at most 9."""
    return max(1, min(9, (k + 1) // 2 - 1))


_BLOB = "place int, counts binary, letters binary, words binary, times binary, tags binary"


def _sliced(batches: Iterator[pa.RecordBatch], letters: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about so many letters; a longer fragment is one slice."""
    for batch in batches:
        sizes = np.concatenate(([0], np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(0)), 0), np.int64))))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(sizes, sizes[start] + letters)) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def heavy_minimizers(strings: DataFrame, k: int, column: str, most: int, quarter: bool = False) -> frozenset[int]:
    """Minimizers that by a sample of the fragments have more than ``most`` words; 4 ** 9 at most.

    With ``quarter`` also more than a quarter of a core's share of all words, if few different words can have one minimizer: then
    a task's memory does not grow with them, and dealing them one by one would move several times the bytes.
    """
    return _sampled(strings, k, column, most, quarter)[0]


def _sampled(strings: DataFrame, k: int, column: str, most: int, quarter: bool) -> tuple[frozenset[int], int]:
    """:func:`heavy_minimizers`, and about how many words there are."""
    m = minimizer_letters(k)
    quarter = quarter and 2 * (k - m + 1) * 4 ** (k - m) <= _HALF

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            _, count, least = _super_words(*_letters(batch.column(0), k), k, m)
            which, of = np.unique(least, return_inverse=True)
            yield pa.record_batch([pa.array(which), pa.array(np.bincount(of, count, len(which)).astype(np.int64))], ["m", "n"])

    rest = [c for c in strings.columns if c not in (column, "__set")] or [column]  # a filter on these is pushed below what makes the fragments
    sample = strings.where(F.pmod(F.xxhash64(*rest), F.lit(SAMPLE)) == 0).select(column).mapInArrow(run, "m long, n long")
    rows = sample.rollup("m").agg(F.sum("n").alias("n")).where(F.col("m").isNull() | (F.col("n") * SAMPLE > most)).collect()  # the sum of all has no minimizer
    total = sum(r["n"] or 0 for r in rows if r["m"] is None)
    least = total / (4 * strings.sparkSession.sparkContext.defaultParallelism) if quarter else 0
    return frozenset(r["m"] for r in rows if r["m"] is not None and r["n"] > least), total * SAMPLE


def _dealt(strings: DataFrame, k: int, canonical: bool, column: str, tag: str | None, heavy_words: int | None, places: int | None) -> DataFrame:
    """The super-words of all strings where their minimizers are dealt, in the order of their places; see :data:`_BLOB`."""
    if not 1 <= k <= 31:
        raise ValueError("codes need 1 <= k <= 31")
    tasks = int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    often, about = _sampled(strings, k, column, HEAVY if heavy_words is None else heavy_words, heavy_words is None)
    n_places, m, heavy = places or max(8 * tasks, -(-about // _PLACE)), minimizer_letters(k), np.array(sorted(often), np.int64)

    def place_of(v: np.ndarray) -> np.ndarray:
        return (((v.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(n_places)).astype(np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), *[pa.binary()] * 5)
        for batch in _sliced(batches):
            x, starts = _letters(batch.column(0), k)
            first, count, least = _super_words(x, starts, k, m)
            rows, tags, often_tags = [], None, None
            if tag is not None:
                ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(0)), 0), np.int64))
                tags = np.asarray(batch.column(1), np.int64)[np.searchsorted(ends, first, "right")]
            if len(heavy):
                often = np.isin(least, heavy)
                words = _codes_of(x, _spread(first[often], count[often]), k, canonical)
                if tag is None:
                    words, times = np.unique(words, return_counts=True)
                else:
                    words, often_tags, times = _counted_pairs(words, np.repeat(tags[often], count[often]))
                    tags = tags[~often]
                first, count, least = first[~often], count[~often], least[~often]
                for p, (a, b), order in _by_place(place_of(words)):
                    mine = order[a:b]
                    rows.append((p, None, None, words[mine].tobytes(), times[mine].astype(np.int64).tobytes(), None if tag is None else _narrow(often_tags[mine])))
            for p, (a, b), order in _by_place(place_of(least)):
                mine = order[a:b]
                rows.append((p, count[mine].astype(np.uint8).tobytes(), _packed(x[_spread(first[mine], count[mine] + k - 1)]), None, None, None if tag is None else _narrow(tags[mine])))
            yield pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], [c.split()[0] for c in _BLOB.split(", ")])

    blobs = strings.select(column, *([F.col(tag).cast("long")] if tag is not None else [])).mapInArrow(deal, _BLOB)
    return blobs.repartition(tasks, "place").sortWithinPartitions("place")


def _each_place(batches: Iterator[pa.RecordBatch], k: int, canonical: bool, held: _Counter | _Tagged) -> Iterator[pa.RecordBatch]:
    """What ``held`` makes of the words of each place."""
    now = None
    for batch in batches:
        columns = {c: batch.column(c) for c in batch.schema.names}
        for i in range(batch.num_rows):  # a batch may hold many MB, so one row is copied at a time
            row = {c: values[i].as_py() for c, values in columns.items()}
            if row["place"] != now:
                yield from held.close()
                now = row["place"]
            tags = None if row["tags"] is None else _widened(row["tags"], len(row["words"]) // 8 if row["counts"] is None else len(row["counts"]))
            if row["words"] is not None:
                held.add(np.frombuffer(row["words"], np.int64), np.frombuffer(row["times"], np.int64), tags)
            else:
                counts = np.frombuffer(row["counts"], np.uint8).astype(np.int64)
                sizes = counts + k - 1
                held.add(_codes_of(_unpacked(row["letters"]), _spread(np.cumsum(sizes) - sizes, counts), k, canonical), None, None if tags is None else np.repeat(tags, counts))
    yield from held.close()


def count_super_words(
    strings: DataFrame, k: int, canonical: bool = True, column: str = "frag", most: int | None = 255, heavy_words: int | None = None, places: int | None = None
) -> DataFrame:
    """(code, cnt): the words of length k <= 31 of all strings, counted; counts stop at ``most``.

    Null strings and those shorter than k have no words; a letter other than A, C, G, T is in no word. An empty table gives an
    empty result. ``places`` defaults to eight for each shuffle partition, or more for more than about two million words each; a task counts one place after another, in
    sorted parts of bounded size. Words of a minimizer with more than ``heavy_words`` (by default :data:`HEAVY` and more, see :func:`heavy_minimizers`) are counted in their batch and dealt by their own hash.
    """
    blobs = _dealt(strings, k, canonical, column, None, heavy_words, places)
    return blobs.mapInArrow(lambda batches: _each_place(batches, k, canonical, _Counter(most)), "code long, cnt long")


def tags_of_words(strings: DataFrame, k: int, tag: str, canonical: bool = True, column: str = "frag", heavy_words: int | None = None, places: int | None = None, below_63: bool = False) -> DataFrame:
    """(code, held): each word of the strings once, with the different numbers in ``tag`` of the strings that hold it, in order.

    A task holds the different pairs of word and number of a place, or if all numbers are ``below_63`` its different words.
    """
    blobs = _dealt(strings, k, canonical, column, tag, heavy_words, places)
    return blobs.mapInArrow(lambda batches: _each_place(batches, k, canonical, _Masked() if below_63 else _Tagged(False)), "code long, held array<int>")


def _numbered(strings: DataFrame, column: str, named: DataFrame | None) -> tuple[DataFrame, list[str | None]]:
    names = sorted((r["set_id"] for r in (strings if named is None else named).select("set_id").distinct().collect()), key=lambda x: (x is not None, x))
    numbers = strings.sparkSession.createDataFrame([(x, i) for i, x in enumerate(names)], "__name string, __set int")
    return strings.join(F.broadcast(numbers), F.col("set_id").eqNullSafe(F.col("__name"))).select(*[c for c in strings.columns if c not in ("set_id", column)], column, "__set"), names


def sets_of_words(strings: DataFrame, k: int, canonical: bool = True, column: str = "frag", named: DataFrame | None = None) -> tuple[DataFrame, list[str | None]]:
    """(code, held) by :func:`tags_of_words` of strings with a set_id, and the sets' names by number, in order, null first.

    All names of the table, or of ``named`` (set_id), from which they can be read without the strings, come to the driver, also those of sets without a word.
    """
    numbered, names = _numbered(strings, column, named)
    return tags_of_words(numbered, k, "__set", canonical, column, below_63=len(names) <= 63), names


def classes_of_sets(strings: DataFrame, k: int, canonical: bool = True, column: str = "frag", named: DataFrame | None = None) -> DataFrame:
    """(colour, cnt): the sets that hold a word, in order, and the number of words with just these; a null set is in no colour.

    Of up to 63 sets the words of a place are classed and counted where they are dealt; see :func:`sets_of_words` for ``named``.
    """
    numbered, names = _numbered(strings, column, named)
    if len(names) > 63:
        return W.named_classes(tags_of_words(numbered, k, "__set", canonical, column), names)
    blobs = _dealt(numbered, k, canonical, column, "__set", None, None)
    found = blobs.mapInArrow(lambda batches: _each_place(batches, k, canonical, _Classed()), "__mask0 long, cnt long")
    if names and names[0] is None:
        found = found.select(F.col("__mask0").bitwiseAND(F.lit(-2)).alias("__mask0"), "cnt")
    return found.groupBy("__mask0").agg(F.sum("cnt").alias("cnt")).select(W.masked_names(names).alias("colour"), "cnt")


def links_by_words(strings: DataFrame, k: int, tag: str, canonical: bool = True, column: str = "frag", heavy_words: int | None = None, places: int | None = None) -> DataFrame:
    """(x, y): numbers in ``tag`` of strings that share a word, x < y, linked so that all that hold a word hang together by it.

    A row may be repeated. A task holds a place's words, each with the smallest of its numbers.
    """
    blobs = _dealt(strings, k, canonical, column, tag, heavy_words, places)
    return blobs.mapInArrow(lambda batches: _each_place(batches, k, canonical, _Tagged(True)), "x long, y long")


def compared_words(strings: DataFrame, words: DataFrame, k: int, canonical: bool = True, heavy_words: int | None = None, places: int | None = None) -> DataFrame:
    """(n_words, n_distinct, n_repeated, n_missing, n_foreign, hash) of the words in strings (seq) against a set (code), a row for each place.

    Both are dealt as super-words and compared where they lie, so that no row a word is grouped.
    """
    both = strings.select(F.col("seq").alias("frag"), F.lit(0).alias("__set")).union(W.spelled(words, k).select("kmer", F.lit(1)))
    schema = ", ".join(f"{c} long" for c in _COMPARED)
    blobs = _dealt(both, k, canonical, "frag", "__set", heavy_words, places)
    return blobs.mapInArrow(lambda batches: _each_place(batches, k, canonical, _Compared(None)), schema)


def _pairs(words: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once, in order."""
    return _counted_pairs(words, tags)[:2]


def _counted_pairs(words: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair once, in order, and how often it is there."""
    low = int(tags.min(initial=0))
    bits = (int(tags.max(initial=0)) - low).bit_length()
    if int(words.max(initial=0)).bit_length() + bits <= 63:  # both are sorted as one number
        both = np.sort((words << bits) | (tags - low))
        starts = _firsts(both)
        both = both[starts]
        return both >> bits, (both & ((1 << bits) - 1)) + low, np.diff(np.append(starts, len(words)))
    order = np.lexsort((tags, words))
    words, tags = words[order], tags[order]
    new = np.ones(len(words), bool)
    new[1:] = (words[1:] != words[:-1]) | (tags[1:] != tags[:-1])
    return words[new], tags[new], np.diff(np.append(np.flatnonzero(new), len(words)))


def _firsts(v: np.ndarray) -> np.ndarray:
    """Where each value of a sorted array begins."""
    return np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1]))) if len(v) else np.zeros(0, np.int64)


def _by_place(place: np.ndarray) -> Iterator[tuple[int, tuple[int, int], np.ndarray]]:
    """(place, range of the order, order) of each place."""
    order = np.argsort(place, kind="stable")
    which, starts = np.unique(place[order], return_index=True)
    for p, a, b in zip(which.tolist(), starts, np.append(starts, len(order))[1:], strict=True):
        yield p, (a, b), order


class _Counter:
    """Counts words in sorted parts, to which new words are added one after another: memory goes by distinct words, nine bytes each if counts stop at 255."""

    def __init__(self, most: int | None) -> None:
        self.most, self.new, self.size, self.held = most, [], 0, []
        self.kind = np.int64 if most is None or most > 255 else np.uint8

    def add(self, words: np.ndarray, times: np.ndarray | None, tags: None = None) -> None:
        self.new.append((words, times))
        self.size += len(words)
        if self.size > _HALF:
            self._merge()

    def _merge(self) -> None:
        if not self.size:
            return
        words, times = _add_up(self.new)
        self.size = 0
        times = (times if self.most is None else np.minimum(times, self.most)).astype(self.kind)
        if not self.held:
            return self._keep(words, times)
        cuts = [0, *np.searchsorted(words, np.array([w[0] for w, _ in self.held[1:]], np.int64)).tolist(), len(words)]
        before, self.held = self.held[::-1], []
        for a, b in pairwise(cuts):
            self._keep(*(self._added(*before.pop(), words[a:b], times[a:b]) if a < b else before.pop()))

    def _keep(self, words: np.ndarray, times: np.ndarray) -> None:
        n = -(-len(words) // _PART)
        self.held += [(words, times)] if n == 1 else [(x.copy(), y.copy()) for x, y in zip(np.array_split(words, n), np.array_split(times, n), strict=True)]

    def _added(self, words: np.ndarray, times: np.ndarray, new: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(words, new)
        known = words[np.minimum(at, len(words) - 1)] == new
        total = times[at[known]].astype(np.int64) + more[known]
        times[at[known]] = total if self.most is None else np.minimum(total, self.most)
        at, new, more = at[~known], new[~known], more[~known]
        return np.insert(words, at, new), np.insert(times, at, more)

    def parts(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The words and their counts in order, a part after another; none is held any more."""
        self._merge()
        held, self.held = self.held[::-1], []
        while held:
            yield held.pop()

    def close(self) -> Iterator[pa.RecordBatch]:
        for words, times in self.parts():
            for a in range(0, len(words), 500_000):
                yield pa.record_batch([pa.array(words[a : a + 500_000]), pa.array(times[a : a + 500_000].astype(np.int64))], ["code", "cnt"])


_COMPARED = ("n_words", "n_distinct", "n_repeated", "n_missing", "n_foreign", "hash")


class _Compared(_Counter):
    """Words of strings (tag 0) against those of a set (tag 1)."""

    def add(self, words: np.ndarray, times: np.ndarray | None, tags: np.ndarray) -> None:
        super().add((words << 1) | tags, times)

    def close(self) -> Iterator[pa.RecordBatch]:
        n_words = n_distinct = n_repeated = n_set = both = found = 0
        last = -1
        for keys, times in self.parts():
            words, in_set = keys >> 1, (keys & 1) > 0
            held, n = words[~in_set], times[~in_set]
            both += int((np.diff(words, prepend=last) == 0).sum())  # a word's two keys may lie in two parts
            last = words[-1]
            n_words, n_distinct, n_repeated, n_set = n_words + int(n.sum()), n_distinct + len(held), n_repeated + int((n > 1).sum()), n_set + int(in_set.sum())
            found ^= int(np.bitwise_xor.reduce(held))
        if last >= 0:
            row = (n_words, n_distinct, n_repeated, n_set - both, n_distinct - both, found)
            yield pa.record_batch([pa.array([x], pa.int64()) for x in row], list(_COMPARED))


class _Tagged:
    """The numbers that come with each word: all of them, or as ``links`` from its smallest number to the others."""

    def __init__(self, links: bool) -> None:
        self.links, self.parts, self.found, self.size, self.most = links, [], [], 0, _HALF

    def add(self, words: np.ndarray, times: None, tags: np.ndarray) -> None:
        self.parts.append((words, tags))
        self.size += len(words)
        if self.size > self.most:
            self.parts = [self._kept()]
            self.size = len(self.parts[0][0])
            self.most = max(_HALF, 2 * self.size)

    def _kept(self) -> tuple[np.ndarray, np.ndarray]:
        words, tags = _pairs(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))
        if not self.links:
            return words, tags
        starts = _firsts(words)
        least = np.repeat(tags[starts], np.diff(np.append(starts, len(words))))
        self.found.append(_pairs(least[least < tags], tags[least < tags]))
        return words[starts], tags[starts]

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            words, tags = self._kept()
            self.parts, self.size, self.most = [], 0, _HALF
            if not self.links:
                starts = _firsts(words)
                for a in range(0, len(starts), 500_000):
                    ends = np.append(starts, len(words))[a : a + 500_001]
                    lists = pa.ListArray.from_arrays(pa.array((ends - ends[0]).astype(np.int32)), pa.array(tags[ends[0] : ends[-1]].astype(np.int32)))
                    yield pa.record_batch([pa.array(words[starts[a : a + 500_000]]), lists], ["code", "held"])
        for x, y in self.found:
            yield pa.record_batch([pa.array(x), pa.array(y)], ["x", "y"])
        self.found = []


class _Masked:
    """The numbers that come with each word, which are below 63, as a mask; memory goes by distinct words."""

    def __init__(self) -> None:
        self.parts, self.size, self.words, self.masks = [], 0, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, words: np.ndarray, times: None, tags: np.ndarray) -> None:
        self.parts.append((words, tags))
        self.size += len(words)
        if self.size > _HALF:
            self._merge()

    def _merge(self) -> None:
        words, tags = _pairs(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))
        self.parts, self.size = [], 0
        words, masks = np.concatenate((self.words, words)), np.concatenate((self.masks, np.left_shift(1, tags)))
        if len(self.words):
            order = np.argsort(words, kind="stable")
            words, masks = words[order], masks[order]
        starts = _firsts(words)
        self.words, self.masks = words[starts], np.bitwise_or.reduceat(masks, starts) if len(starts) else masks

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self._merge()
        words, masks = self.words, self.masks
        self.words, self.masks = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(words):
            yield from self._told(words, masks)

    def _told(self, words: np.ndarray, masks: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(words), 50_000):
            holds = (masks[a : a + 50_000, None] >> np.arange(63)) & 1
            row, tags = np.nonzero(holds)
            offsets = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(holds)))))
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(tags.astype(np.int32)))
            yield pa.record_batch([pa.array(words[a : a + 50_000]), lists], ["code", "held"])


class _Classed(_Masked):
    """How many words have each mask."""

    def _told(self, words: np.ndarray, masks: np.ndarray) -> Iterator[pa.RecordBatch]:
        masks, n = np.unique(masks, return_counts=True)
        yield pa.record_batch([pa.array(masks), pa.array(n.astype(np.int64))], ["__mask0", "cnt"])


def _add_up(parts: list[tuple[np.ndarray, np.ndarray | None]]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all parts in order, each with its count; the list is emptied, so that its words are not held twice."""
    words = np.concatenate([w for w, _ in parts])
    if all(t is None for _, t in parts):
        parts.clear()
        words.sort()
        starts = _firsts(words)
        return words[starts], np.diff(np.append(starts, len(words)))
    times = np.concatenate([np.ones(len(w), np.int64) if t is None else t for w, t in parts])
    parts.clear()
    order = np.argsort(words, kind="stable")
    words, times = words[order], times[order]
    starts = _firsts(words)
    return words[starts], np.add.reduceat(times, starts) if len(starts) else times
