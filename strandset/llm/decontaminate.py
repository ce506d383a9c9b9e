"""Benchmark decontamination by the q-gram lemma.

If a window of m characters of an item occurs in a document with at most e edits, then at least
m - q + 1 - q * e of its q-grams occur there too, on diagonals at most e apart. So the shared q-grams of
documents and items are counted in overlapping bands of diagonals and over a sliding range of the item;
only windows that meet the bound are verified, by a banded alignment.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandset.llm.common import row_key, texts

_Q = 8  # most characters of a q-gram; items of fewer must occur exactly
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22
_ENTRIES = 1 << 21  # shared q-grams expanded at a time
_PIECE = 1 << 18  # characters whose q-grams are made at a time


def normalized(text: str) -> str:
    """Lower case, white space as single spaces."""
    return " ".join(text.lower().split())


def _grams(data: np.ndarray, q: int) -> np.ndarray:
    """Each position's q-gram of code points, hashed to 64 bits."""
    if len(data) < q:
        return np.zeros(0, np.uint64)
    doubled, size, out, taken = data.astype(np.uint64), 1, None, 0
    n = len(data) - q + 1
    while True:
        if q & size:
            part = doubled[taken : taken + n]
            out = part if out is None else (out ^ (out >> np.uint64(31))) * _MULTIPLIER + part
            taken += size
        size *= 2
        if size > q:
            return (out ^ (out >> np.uint64(31))) * _MULTIPLIER
        half = size // 2
        doubled = (doubled[:-half] ^ (doubled[:-half] >> np.uint64(31))) * _MULTIPLIER + doubled[half:]


def _joined(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All strings as code points, with a gap of zeros after each, and each one's start."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings)) + _Q
    gap = "\0" * _Q
    data = np.frombuffer(gap.join([*strings, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    return data, np.concatenate(([0], np.cumsum(sizes)))


class Passages:
    """Items whose windows need q-grams of one size, and the index of these q-grams.

    A window has at most ``window`` characters: the whole of a shorter item, any part of a longer one.
    """

    def __init__(self, items: list[tuple[int | None, str]], window: int, rate: float, q: int) -> None:
        self.q, self.ids, self.strings = q, [k for k, _ in items], [s for _, s in items]
        self.lengths = np.array([len(s) for s in self.strings], np.int64)
        self.sizes = np.minimum(self.lengths, window)
        self.edits = np.floor(rate * self.sizes + 1e-9).astype(np.int64)
        self.least = self.sizes - q + 1 - q * self.edits
        self.data, self.starts = data, starts = _joined(self.strings)
        grams = _grams(data, q)
        position = np.arange(len(grams))
        owner = np.searchsorted(starts, position, "right") - 1
        inside = position - starts[owner] <= np.append(self.lengths, -1)[owner] - q
        order = np.argsort(grams[inside], kind="stable")
        self.owner, self.offset = owner[inside][order], (position - starts[owner])[inside][order]
        self.unique, self.gram, self.count = np.unique(grams[inside][order], return_inverse=True, return_counts=True)
        self.first = np.cumsum(self.count) - self.count
        # The leading bits of a q-gram name a slot: whether it is taken, and where its sorted q-grams begin.
        lead = (self.unique >> np.uint64(64 - _BITS)).astype(np.int64)
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[lead] = True
        self.slot = np.zeros(1 << _BITS, np.int32)
        self.slot[lead[::-1]] = np.arange(len(lead))[::-1]
        self.crowd = int(np.bincount(lead).max(initial=1))

    def candidates(self, data: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(item, lowest and highest diagonal, first and last window) of the regions that meet the bound.

        The parts cover one range of items each, in order; an item's regions are all in one part.
        """
        found = [self._hits(data[start : start + _PIECE + self.q - 1], start) for start in range(0, len(data), _PIECE)]
        position, at = (np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]) for i in (0, 1))
        # No stretch of the longest window's reach with fewer hits than the smallest bound can hold a region.
        reach = int((self.sizes + 2 * self.edits).max())
        last = np.searchsorted(position, position + reach)
        starts = np.flatnonzero(last - np.arange(len(position)) >= self.least.min())
        marks = np.zeros(len(position) + 1, np.int64)
        np.add.at(marks, starts, 1)
        np.add.at(marks, last[starts], -1)
        dense = np.cumsum(marks[:-1]) > 0
        position, at = position[dense], at[dense]
        if not len(position):
            return
        if self.count[at].sum() <= _ENTRIES:
            yield self._regions(position, self.first[at], self.count[at], self.owner, self.offset)
            return
        # Frequent q-grams: items are taken range by range.
        each = np.bincount(self.owner, np.bincount(at, minlength=len(self.unique))[self.gram], len(self.ids))
        part = (np.cumsum(each) // _ENTRIES).astype(np.int64)
        for p in np.unique(part[each > 0]):
            mine = np.flatnonzero(part[self.owner] == p)
            first, last = (np.searchsorted(self.gram[mine], at, side) for side in ("left", "right"))
            yield self._regions(position, first, last - first, self.owner[mine], self.offset[mine])

    def _hits(self, data: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
        """(position, number of the q-gram) of all q-grams of the items in a piece of the texts."""
        grams = _grams(data, self.q)
        lead = grams >> np.uint64(64 - _BITS)
        position = np.flatnonzero(self.bitmap[lead])
        asked, at = grams[position], self.slot[lead[position]].astype(np.int64)
        for _ in range(self.crowd - 1):
            at = np.minimum(at + (self.unique[at] < asked), len(self.unique) - 1)
        true = self.unique[at] == asked
        return position[true] + start, at[true]

    def _regions(self, position: np.ndarray, first: np.ndarray, n: np.ndarray, owner: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, ...]:
        """The regions of positions whose q-grams have ``n`` places in the items from ``first`` on."""
        some = n > 0
        position, first, n = position[some], first[some], n[some]
        found, open_ = [np.zeros((0, 4), np.int64)], None
        ends = np.cumsum(n)
        begin = 0
        while begin < len(n):
            last = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + _ENTRIES, "right")))
            m = n[begin:last]
            post = np.repeat(first[begin:last] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            item, off = owner[post], offset[post]
            diagonal = np.repeat(position[begin:last], m) - off
            # Bands of 2 * (e + 1) diagonals, a new one each e + 1: any e + 1 neighbours share one.
            band = (diagonal + (1 << 40)) // (self.edits[item] + 1)
            rows = np.stack((np.tile(item, 2), np.concatenate((band, band - 1)), np.tile(off, 2)), 1)
            if open_ is not None:
                rows = np.concatenate((open_, rows))
            begin = last
            # Positions ascend: bands that later positions can't reach are settled, the others wait.
            settled = np.ones(len(rows), bool)
            if last < len(n):
                high = (rows[:, 1] + 2) * (self.edits[rows[:, 0]] + 1) - (1 << 40)
                settled = high + self.lengths[rows[:, 0]] < position[last]
            open_ = rows[~settled]
            found.append(self._windows(rows[settled]))
        item, band, low, high = np.concatenate(found).T
        step = self.edits[item] + 1
        diagonal = band * step - (1 << 40)
        order = np.lexsort((band, item))
        return tuple(x[order] for x in (item, diagonal, diagonal + 2 * step - 1, low, high))

    def _windows(self, rows: np.ndarray) -> np.ndarray:
        """(item, band, first window, last window) of the (item, band, offset) with enough offsets in a window."""
        item, band = rows[:, 0], rows[:, 1]
        # Most bands hold a few chance hits: a count over hashed bands, never too small, leaves them out before the sort.
        mixed = ((item.astype(np.uint64) << np.uint64(40)) + band.astype(np.uint64)) * _MULTIPLIER >> np.uint64(44)
        rows = rows[np.bincount(mixed.astype(np.int64), minlength=1 << 20)[mixed.astype(np.int64)] >= self.least[item]]
        item, band, off = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))].T
        far = np.arange(len(item)) + self.least[item] - 1
        to = np.minimum(far, len(item) - 1)
        size = self.sizes[item]
        good = (far < len(item)) & (item[to] == item) & (band[to] == band) & (off[to] - off <= size - self.q)
        item, band, low, high = item[good], band[good], off[to][good] + self.q - size[good], off[good]
        most = self.lengths[item] - self.sizes[item]
        low, high = np.clip(low, 0, most), np.clip(high, 0, most)
        start = np.flatnonzero(np.concatenate(([True], (item[1:] != item[:-1]) | (band[1:] != band[:-1])))[: len(item)])
        if not len(start):
            return np.zeros((0, 4), np.int64)
        return np.stack((item[start], band[start], np.minimum.reduceat(low, start), np.maximum.reduceat(high, start)), 1)


class Benchmark:
    """The items: those of fewer than 8 characters, and the others by the size of q-gram that their edits leave in common."""

    def __init__(self, items: list[tuple[int | None, str]], window: int, rate: float) -> None:
        self.window, self.short, by_size = window, [], {}
        for key, text in items:
            s = normalized(text)
            size = min(len(s), window)
            if 0 < size < _Q:
                self.short.append((key, s))
            elif s:
                by_size.setdefault(min(_Q, max(1, size // (int(rate * size + 1e-9) + 1))), []).append((key, s))
        self.parts = [Passages(some, window, rate, q) for q, some in sorted(by_size.items())]


def banded_distances(patterns: list[np.ndarray], regions: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each whole pattern anywhere in its region, within a band, and where it ends.

    A region covers its band: a cell for each diagonal on which the pattern may begin. All pairs advance
    together, one pattern character a step, over their cells side by side.
    """
    n, longest = len(patterns), max(map(len, patterns))
    cells = max(len(r) - len(p) for r, p in zip(regions, patterns, strict=True)) + 1
    p = np.full((n, longest), -1, np.int64)
    r = np.full((n, longest + cells), -2, np.int64)
    for i, (a, b) in enumerate(zip(patterns, regions, strict=True)):
        p[i, : len(a)], r[i, : len(b)] = a, b
    size = np.array([len(a) for a in patterns])
    far, k = np.int64(1 << 30), np.arange(cells)
    row = np.zeros((n, cells), np.int64)  # the pattern may begin on any diagonal of the band
    best, end = np.full(n, far), np.zeros(n, np.int64)
    for i in range(longest):
        up = np.concatenate((row[:, 1:], np.full((n, 1), far)), 1) + 1
        new = np.minimum(row + (r[:, i : i + cells] != p[:, i : i + 1]), up)
        row = np.minimum.accumulate(new - k, axis=1) + k
        done = np.flatnonzero(size == i + 1)
        if len(done):
            best[done] = row[done].min(axis=1)
            end[done] = row[done].argmin(axis=1) + i + 1
    return best, end


def _region(data: np.ndarray, begin: int, end: int, start: int, stop: int) -> np.ndarray:
    """Codes of a region; what lies before or behind the text is a code that matches nothing."""
    a, b = min(max(begin, start), stop), max(start, min(end, stop))
    out = np.full(end - begin, -3, np.int64)
    if a < b:
        out[a - begin : b - begin] = data[a:b]
    return out


def _search(bench: Benchmark, strings: list[str]) -> list[tuple[int, int | None, int, int, int, int]]:
    """(row, item id, window, edits, start, end) of the verified windows; positions in the normalized text.

    Windows at each half window are verified first; the others, numbered -1, only where none of these is found.
    """
    some = [normalized(s) for s in strings]
    out = [(r, key, 0, 0, s.find(x), s.find(x) + len(x)) for r, s in enumerate(some) for key, x in bench.short if x in s]
    data, starts = _joined(some)
    stops = starts[:-1] + np.array([len(s) for s in some], np.int64)

    for part in bench.parts:
        for block in range(0, len(some), 64):
            last = min(block + 64, len(some))
            base = int(starts[block])
            for regions in part.candidates(data[base : starts[last]]):
                best: dict[tuple[int, int, int], tuple[int, int, int]] = {}

                seen: dict[tuple[int, int, int], list[tuple[int, int]]] = {}

                def verify(ask: Iterator[tuple[int, int, int, int, int]], best: dict = best, seen: dict = seen, grid: bool = True) -> None:
                    while group := list(itertools.islice(ask, 512)):
                        patterns = [part.data[part.starts[q] + o :][: part.sizes[q]] for _, q, o, _, _ in group]
                        places = [_region(data, begin, end, int(starts[r]), int(stops[r])) for r, _, _, begin, end in group]
                        for (r, q, o, begin, _), p, edits, e in zip(group, patterns, *(x.tolist() for x in banded_distances(patterns, places)), strict=True):
                            if grid:
                                seen.setdefault((r, q, begin - o), []).append((o, edits))
                            if edits <= part.edits[q]:
                                to = min(begin + e, int(stops[r])) - int(starts[r])
                                new = (edits, max(0, begin + e - len(p) - int(starts[r])), to)
                                key = (r, q, o if grid else -1)
                                best[key] = min(best.get(key, new), new)

                def asked(grid: bool, regions: tuple = regions, block: int = block, last: int = last, base: int = base, best: dict = best, seen: dict = seen) -> Iterator[tuple[int, int, int, int, int]]:
                    found = set() if grid else {(r, q) for r, q, _ in best}
                    for q, low, high, x, y in zip(*(c.tolist() for c in regions), strict=True):
                        m, e, half = int(part.sizes[q]), int(part.edits[q]), max(1, bench.window // 2)
                        most, near = int(part.lengths[q]) - m, low + base - e
                        marks = sorted({*range(0, most, half), most})
                        first, behind = near + x, high + base + e + y + m
                        at = min(max(int(np.searchsorted(starts, first, "right")) - 1, block), last - 1)
                        # A region at a border may belong to either text; a text shorter than it lies inside.
                        while at < last and starts[at] < behind:
                            if (at, q) in found:
                                windows = []
                            elif grid:  # with those beside the range: they bound what lies between
                                windows = marks[max(0, bisect.bisect_right(marks, x) - 1) : bisect.bisect_left(marks, y) + 1]
                            else:
                                w = np.arange(x, y + 1)
                                # A window k characters on has k edits less at most.
                                for o, edits in seen.get((at, q, near), ()):
                                    w = w[edits - np.abs(w - o) <= e]
                                windows = w[~np.isin(w, marks)].tolist()
                            for o in windows:
                                begin, end = near + o, high + base + o + m + e
                                if min(stops[at], end) - max(starts[at], begin) >= m - e and best.get((at, q, o), (1,))[0]:
                                    yield at, q, o, begin, end
                            at += 1

                verify(asked(True))
                verify(asked(False), grid=False)
                out += [(r, part.ids[q], o, *b) for (r, q, o), b in best.items()]
    return out


def _found(docs: DataFrame, benchmark: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, window: int, rate: float, block_chars: int) -> DataFrame:
    """(doc_id, k1, k2, item_id, passage, edits, start, end) of every window found; (k1, k2) names a row of ``docs``."""
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("length(text) > 0")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // block_chars))
    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    read = read.select("*", *row_key("doc_id", "text"))
    schema = "doc_id long, k1 long, k2 long, item_id long, passage int, edits long, start long, end long"
    names = ["doc_id", "k1", "k2", "item_id", "passage", "edits", "start", "end"]
    kinds = (*[pa.int64()] * 4, pa.int32(), pa.int64(), pa.int64(), pa.int64())
    out = None
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).distinct()
        some = sorted(((r["item_id"], r["text"]) for r in mine.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))

        def run(batches: Iterator[pa.RecordBatch], some: list = some) -> Iterator[pa.RecordBatch]:
            bench = Benchmark(some, window, rate)
            for batch in batches:
                keys = list(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "k1", "k2")), strict=True))
                strings = texts(batch, "text")
                for part in range(0, len(strings), 512):
                    rows = [(*keys[part + r], *x) for r, *x in _search(bench, strings[part : part + 512])]
                    yield pa.record_batch([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names)

        found = read.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 120,
    rate: float = 0.1,
    block_chars: int = 1_000_000,
) -> DataFrame:
    """Benchmark items found in documents: (doc_id, item_id, n_windows, edits, start, end).

    An item is found where the whole item, or any window of ``window`` characters of a longer one, aligns
    with the document's text with at most ``rate`` edits a character. Texts are compared in lower case
    with single spaces; start and end (of the region of fewest edits, then the first) count code points
    of that form. ``n_windows`` counts the windows found at each half window and the item's end, and the
    result is theirs; where none of these is found, others are taken, which count as one. Whole texts are searched. Null and empty texts on either side match nothing; items of
    fewer than 8 characters must occur exactly; null ids are kept as such, repeated documents and items
    with one id are merged into one row; other columns are not read; empty tables give an empty result.

    The benchmark is taken in blocks of about ``block_chars`` characters, so what a task holds is
    bounded; documents are passed once for each block and aren't shuffled.
    """
    best = F.min(F.struct("edits", "start", "end"))
    out = _found(docs, benchmark, doc_id, text, item_id, item_text, window, rate, block_chars)
    return (
        out.groupBy("doc_id", "item_id").agg(F.count_distinct("passage").alias("n_windows"), best.alias("best"))
        .select("doc_id", "item_id", "n_windows", "best.edits", "best.start", "best.end")
    )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 120,
    rate: float = 0.1,
    block_chars: int = 1_000_000,
) -> DataFrame:
    """The documents, all columns, in which no benchmark item is found (see :func:`contaminated`).

    Each row is judged by its own text, whether its id is null or repeated.
    """
    go = _found(docs, benchmark, doc_id, text, item_id, item_text, window, rate, block_chars).select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).distinct()
    keyed = docs.select(F.struct("*").alias("__row"), F.col(f"`{doc_id}`").cast("long").alias("__id"), F.col(f"`{text}`").cast("string").alias("__text"))
    keyed = keyed.select("__row", *[k.alias(f"__k{n}") for n, k in enumerate(row_key("__id", "__text"), 1)])
    return keyed.join(go, ["__k1", "__k2"], "left_anti").select("__row.*")
