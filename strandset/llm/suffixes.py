"""Suffix-array deduplication of bytes by a distributed merge sort that knows common prefixes.

A string of ``length`` bytes is repeated if it starts in two places of the corpus. Strings that start close to each
other share a seed, the least hash among their grams of a quarter of the length; equal strings have equal seeds, so
only the text around seeds that occur twice is sorted, each text once with its number. Tasks sort the suffixes of their
share of the texts, cut at ``length`` bytes, into runs with the longest common prefixes of neighbours. What may be
repeated in another run is front-coded (the length of the prefix shared with the string before, then the rest), exchanged by
ranges of the alphabetical order, and merged by loser trees that compare strings only behind the prefixes they are
known to share. A suffix that shares ``length`` bytes with its neighbour is repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandset.llm.common import runs_of, slices, written
from strandset.llm.substrings import _keyed, superwindows

#: Neighbouring strings of one seed that are one text, at most; and the bytes that are looked at together.
_LONGEST, _PIECE = 1024, 1 << 18


def seeded(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each text its runs of neighbouring strings with one seed: (seeds, digests of the runs' texts, numbers of strings).

    Runs follow each other without a gap. A number is negative if the seed occurs in two places of the run.
    """
    digest = xxhash.xxh3_64_intdigest
    pieces = [(i, at) for i, text in enumerate(texts) for at in range(0, max(1, len(text) - length + 1), _PIECE)]
    found: list[list[tuple]] = [[] for _ in texts]
    start = 0
    while start < len(pieces):
        held, size, stop = [], 0, start
        while stop < len(pieces) and (not held or size < _PIECE):
            i, at = pieces[stop]
            held.append(texts[i][at : at + _PIECE + length - 1])
            size += len(held[-1])
            stop += 1
        joined = b"".join(held)
        sizes = np.fromiter(map(len, held), np.int64, len(held))
        doc, first, count, seed, twice = superwindows(np.frombuffer(joined, np.uint8).astype(np.uint64), sizes, length)
        if len(count) and count.max() > _LONGEST:  # texts of few signs: their runs are cut
            n = -(-count // _LONGEST)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            doc, seed, twice, first, count = (np.repeat(x, n) for x in (doc, seed, twice, first, count))
            first, count = first + step * _LONGEST, np.minimum(count - step * _LONGEST, _LONGEST)
        begin = np.concatenate(([0], np.cumsum(sizes)))[doc] + first
        names = np.fromiter((digest(joined[a:b]) for a, b in zip(begin.tolist(), (begin + count + length - 1).tolist(), strict=True)), np.uint64, len(begin))
        cuts = np.searchsorted(doc, np.arange(len(held) + 1))
        signed = np.where(twice, -count, count)
        for j, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            found[pieces[start + j][0]].append((seed[a:b], names[a:b], signed[a:b]))
        start = stop
    for parts in found:
        yield tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def sorted_suffixes(bodies: list[bytes], counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The first counts[i] suffixes of each body, cut at ``length`` bytes, in order: (strings, lcp, body, offset).

    ``strings`` is a matrix of bytes, lcp[j] the length of what strings j - 1 and j share (0 for the first).
    """
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    body = np.repeat(np.arange(len(bodies)), counts)
    offset = np.arange(len(body)) - np.repeat(np.cumsum(counts) - counts, counts)
    flat = np.frombuffer(b"".join(bodies), np.uint8)
    strings = np.lib.stride_tricks.sliding_window_view(flat, length)[(np.cumsum(sizes) - sizes)[body] + offset]
    order = np.argsort(strings.view(f"S{length}").ravel(), kind="stable")
    strings = strings[order]
    lcp = np.zeros(len(order), np.int64)
    for a in range(1, len(order), 1 << 14):  # a part at a time, so that little is held
        b = min(len(order), a + (1 << 14))
        same = strings[a:b] == strings[a - 1 : b - 1]
        lcp[a:b] = np.where(same.all(axis=1), length, same.argmin(axis=1))
    return strings, lcp, body[order], offset[order]


def front_coded(strings: np.ndarray, lcp: np.ndarray) -> bytes:
    """What each string has behind the prefix that it shares with the one before."""
    return strings[np.arange(strings.shape[1]) >= lcp[:, None]].tobytes()


def decoded(lcp: bytes, tails: bytes, length: int) -> Iterator[tuple[int, bytes]]:
    """(shared prefix, string) of a front-coded run."""
    at, now = 0, b""
    for shared in np.frombuffer(lcp, np.uint16).tolist():
        size = length - shared
        now = now[:shared] + tails[at : at + size]
        at += size
        yield shared, now


def merged(runs: list[Iterator[tuple[int, bytes]]]) -> Iterator[tuple[int, int]]:
    """(run, shared prefix with the string before) of all strings of sorted runs in order, by a loser tree.

    Each loser keeps how much it shares with the last winner that beat it. Of two strings the one that shares more with
    the last string put out is the smaller; only if both share the same is anything compared, and only
    behind that prefix.
    """
    n = 1
    while n < len(runs):
        n *= 2
    ends = [next(r, (-1, b"")) for r in runs] + [(-1, b"")] * (n - len(runs))  # -1: nothing left
    shared, text = [e[0] for e in ends], [e[1] for e in ends]
    loser = [-1] * n

    def play(a: int, b: int) -> tuple[int, int]:
        """The winner and the loser, who keeps what it shares with the winner."""
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        h = shared[a]
        if h < 0:
            return a, b
        x, y = text[a][h:], text[b][h:]
        if x == y:
            shared[b] = h + len(x)
            return a, b
        differ = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
        h += len(x) - (differ.bit_length() + 7) // 8
        if x < y:
            shared[b] = h
            return a, b
        shared[a] = h
        return b, a

    def built(node: int) -> int:
        if node >= n:
            return node - n
        best, loser[node] = play(built(2 * node), built(2 * node + 1))
        return best

    best = built(1)
    while shared[best] >= 0:
        yield best, shared[best]
        shared[best], text[best] = next(runs[best], (-1, b""))
        node = (best + n) // 2
        while node:
            best, loser[node] = play(best, loser[node])
            node //= 2


_NAME = "m long, s long"
_ROW = "k1 long, k2 long"
_MADE = f"range int, {_NAME}, spans binary, shared binary, tails binary, owners binary, names binary"


def _spans(flags: np.ndarray, length: int) -> bytes:
    """The bytes that marked starts cover, as (start, end) pairs."""
    first, last = runs_of(flags)
    return np.stack((first, last - 1 + length), axis=1).astype(np.int32).tobytes()


class _Runs:
    """Sorts texts into runs of bounded size; gives the spans that are settled within a run, and what is to be exchanged."""

    def __init__(self, length: int, borders: list[bytes], most: int) -> None:
        self.length, self.most = length, most
        self.borders = np.array(borders, f"S{length}")
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, row: tuple) -> Iterator[pa.RecordBatch]:
        """A row (m, s, part, open, n, windows, body); a seed that isn't open stays in one run."""
        if self.size >= self.most and (row[3] or row[0] != self.rows[-1][0]):
            yield self.flush()
        self.rows.append(row)
        self.size += row[5]

    def flush(self) -> pa.RecordBatch:
        rows, self.rows, self.size = self.rows, [], 0
        out: list[tuple] = []
        if rows:
            counts = np.array([r[5] for r in rows])
            strings, lcp, body, offset = sorted_suffixes([r[6] for r in rows], counts, self.length)
            new = np.flatnonzero(lcp < self.length)  # where another string begins
            group = np.cumsum(lcp < self.length) - 1
            repeated = (np.bincount(group) > 1) | np.logical_or.reduceat(np.array([r[4] > 1 for r in rows])[body], new)
            marks = np.zeros(counts.sum(), bool)
            marks[(np.cumsum(counts) - counts)[body] + offset] = repeated[group]
            for r, flags in zip(rows, np.split(marks, np.cumsum(counts)[:-1]), strict=True):
                if flags.any():
                    out.append((None, r[0], r[1], _spans(flags, self.length), None, None, None, None))
            wanted = np.flatnonzero(np.array([r[3] for r in rows])[body[new]])
            if len(wanted):
                out += self._exchanged(rows, strings, lcp, body, offset, new, wanted, repeated)
        kinds = (pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5)
        return pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], [c.split()[0] for c in _MADE.split(", ")])

    def _exchanged(self, rows: list[tuple], strings: np.ndarray, lcp: np.ndarray, body: np.ndarray, offset: np.ndarray, new: np.ndarray, wanted: np.ndarray, repeated: np.ndarray) -> Iterator[tuple]:
        """The strings of open seeds, each once and front-coded, by ranges; (text, offset) is told where nothing is known yet."""
        at = new[wanted]
        shared = np.minimum.reduceat(lcp, np.concatenate(([0], at[:-1] + 1)))  # the least since the string before
        kept = strings[at]
        edges = [0, *np.searchsorted(kept.view(self.borders.dtype).ravel(), self.borders).tolist(), len(at)]
        for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if a < b:
                own = np.concatenate(([0], shared[a + 1 : b])).astype(np.uint16)
                texts, text = np.unique(body[at[a:b]], return_inverse=True)
                owner = np.stack((np.where(repeated[wanted[a:b]], -1, text), offset[at[a:b]]), axis=1).astype(np.int32)
                names = np.array([rows[t][:2] for t in texts], np.int64)
                yield (i, None, None, None, own.tobytes(), front_coded(kept[a:b], own), owner.tobytes(), names.tobytes())


def _merged_spans(blocks: list[dict], length: int) -> Iterator[tuple[int, int, bytes]]:
    """(m, s, spans) of the texts whose strings are in more than one run's block of a range."""
    owners = [np.frombuffer(b["owners"], np.int32).reshape(-1, 2) for b in blocks]
    hits = [np.zeros(len(o), bool) for o in owners]
    taken, before = [-1] * len(blocks), None
    for run, shared in merged([decoded(b["shared"], b["tails"], length) for b in blocks]):
        taken[run] += 1
        if shared == length:
            hits[run][taken[run]] = hits[before[0]][before[1]] = True
        before = (run, taken[run])
    for b, owner, hit in zip(blocks, owners, hits, strict=True):
        names, mine = np.frombuffer(b["names"], np.int64).reshape(-1, 2), owner[hit & (owner[:, 0] >= 0)]
        for t in np.unique(mine[:, 0]):
            flags = np.zeros(_LONGEST, bool)
            flags[mine[mine[:, 0] == t, 1]] = True
            yield int(names[t, 0]), int(names[t, 1]), _spans(flags, length)


def dedup_bytes(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 200, run_strings: int = 100_000, closed_runs: int = 64, range_strings: int = 200_000
) -> DataFrame:
    """Removes every byte that a repeated string of ``length`` bytes covers: (doc_id, n_bytes, n_removed, n_spans, kept).

    Texts are UTF-8 bytes, null is empty; matches lie within documents. A string is repeated if it also starts
    anywhere else, the same document and overlaps included; all its places are removed, judged on the input. ``n_spans`` counts
    the maximal removed runs; ``kept`` holds the other bytes, which need not be whole characters. Null ids are
    kept, and repeated rows repeat each other's strings; other columns are not read; an empty table gives an empty result.

    A seed of at most ``closed_runs`` runs of strings is sorted within one run of about ``run_strings`` suffixes, where all its equal
    strings meet. A seed of more is open: its texts are dealt to several runs, and its strings are exchanged and merged, in
    ranges of about ``range_strings``, whose borders come from 2,048 of its texts at most. Equal texts are merged
    before they are dealt, so no seed, text or string is a group without bound.
    """
    if not 4 <= length < _LONGEST:
        raise ValueError(f"strings of 4 to {_LONGEST - 1} bytes")
    keyed = _keyed(docs, doc_id, text)

    def bytes_of(batch: pa.RecordBatch) -> list[bytes]:
        return [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            rows = list(seeded(bytes_of(batch), length))
            columns = [pa.array([r[i].astype(kind).tobytes() for r in rows], pa.binary()) for i, kind in enumerate((np.uint64, np.uint64, np.int16))]
            yield pa.record_batch([batch.column("k1"), batch.column("k2"), *columns], ["k1", "k2", "m", "s", "n"])

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each run of the documents' packed runs."""
        for batch in slices(batches, 4096):
            m, s, n = (np.frombuffer(b"".join(batch.column(c).to_pylist()), kind) for c, kind in (("m", np.int64), ("s", np.int64), ("n", np.int16)))
            sizes = np.array([len(x) // 8 for x in batch.column("m").to_pylist()], np.int64)
            at, count = np.repeat(np.arange(batch.num_rows), sizes), np.abs(n.astype(np.int32))
            before = np.cumsum(count) - count
            first = before - (before[np.minimum(np.cumsum(sizes) - sizes, max(0, len(before) - 1))][at] if len(before) else 0)
            columns = [m, s, first.astype(np.int32), count, np.where(n < 0, 2, 1).astype(np.int32)]
            yield pa.record_batch([*map(pa.array, columns), batch.column("k1").take(pa.array(at)), batch.column("k2").take(pa.array(at))], ["m", "s", "first", "count", "places", "k1", "k2"])

    packed = written(keyed.select("text", "k1", "k2").mapInArrow(scan, f"{_ROW}, m binary, s binary, n binary"))
    found = packed.mapInArrow(single, f"{_NAME}, first int, count int, places int, {_ROW}")
    seeds = (
        found.groupBy("m").agg(F.sum("places").alias("all"), F.min("s").alias("low"), F.max("s").alias("high"), F.max("places").alias("places"))
        .where(F.col("all") > 1).select("m", ((F.col("low") != F.col("high")) | (F.col("places") > 1)).alias("several"), F.ceil(F.col("all") / F.lit(closed_runs)).cast("int").alias("parts"))
    )
    found = written(found.drop("places").join(seeds, "m"))
    several = found.where("several")
    texts = several.groupBy("m", "s").agg(F.count("*").alias("n"), F.first("parts").alias("parts"), F.min(F.struct("k1", "k2", "first", "count")).alias("p"))
    asked = texts.select("m", "s", "n", "parts", "p.*")

    def bodies(of: DataFrame, asks: DataFrame) -> DataFrame:
        """(m, s, part, open, n, count, body): the asked texts, each once however often its row is repeated."""

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 64):
                rows = []
                for data, asks in zip(bytes_of(batch), batch.column("asks").to_pylist(), strict=True):
                    rows += [(a["m"], a["s"], a["s"] % a["parts"], a["parts"] > 1, a["n"], a["count"], data[a["first"] : a["first"] + a["count"] + length - 1]) for a in asks]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.binary())
                yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["m", "s", "part", "open", "n", "count", "body"])

        by = asks.groupBy("k1", "k2").agg(F.collect_list(F.struct("m", "s", "n", "parts", "first", "count")).alias("asks"))
        made = of.join(by, ["k1", "k2"]).select("doc_id", "text", "k1", "k2", "asks").mapInArrow(cut, f"{_NAME}, part int, open boolean, n long, count int, body binary")
        return made.groupBy("m", "s").agg(*[F.first(c).alias(c) for c in ("part", "open", "n", "count", "body")]).select("m", "s", "part", "open", "n", "count", "body")

    opened = several.where("parts > 1").groupBy("m", "s").agg(F.min("count").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    borders: list[bytes] = []
    if opened > range_strings:
        few_asks = written(asked.where("parts > 1").orderBy(F.xxhash64("m", "s")).limit(2048))
        sample = bodies(keyed.join(F.broadcast(few_asks.select("k1", "k2").distinct()), ["k1", "k2"], "left_semi"), few_asks).select("s", "count", "body").collect()
        strings = sorted({r["body"][(at := r["s"] % r["count"]) : at + length] for r in sample})
        n = min(-(-opened // range_strings), len(strings))
        borders = [bytes(strings[len(strings) * i // n]) for i in range(1, n)]

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _Runs(length, borders, run_strings)
        for batch in slices(batches, 256):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from runs.add(row)
        yield runs.flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["m", "s", "spans"])

        for batch in slices(batches, 1024):
            rows = batch.to_pylist()
            for row in rows:
                if held and row["range"] != held[0]["range"]:
                    yield out(list(_merged_spans(held, length)))
                    held = []
                if row["range"] is not None:
                    held.append(row)
            yield out([(r["m"], r["s"], r["spans"]) for r in rows if r["range"] is None])
        if held:
            yield out(list(_merged_spans(held, length)))

    dealt = bodies(keyed, asked).repartition("m", "part").sortWithinPartitions("m", "part", "s")
    made = dealt.mapInArrow(sort, _MADE)
    # What is settled is dealt by its text; a range's blocks meet in one task.
    place = F.coalesce(F.col("range").cast("long"), F.xxhash64("m", "s"))
    spans = made.repartition(place).sortWithinPartitions("range").mapInArrow(merge, f"{_NAME}, spans binary")
    copies = found.where("NOT several").select("k1", "k2", "first", "count", F.lit(None).cast("binary").alias("spans"))
    parts = several.select("m", "s", "k1", "k2", "first").join(spans, ["m", "s"]).select("k1", "k2", "first", F.lit(0).alias("count"), "spans")
    removed = copies.unionByName(parts).groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "count", "spans")).alias("removed"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            rows = []
            for data, removed_ in zip(bytes_of(batch), batch.column("removed").to_pylist(), strict=True):
                if not removed_:
                    rows.append((len(data), 0, 0, data))
                    continue
                change = np.zeros(len(data) + 1, np.int32)
                ends = [np.frombuffer(r["spans"], np.int32).reshape(-1, 2) + r["first"] if r["spans"] is not None else np.array([[r["first"], r["first"] + r["count"] + length - 1]]) for r in removed_]
                ends = np.concatenate(ends)
                np.add.at(change, ends[:, 0], 1)
                np.add.at(change, ends[:, 1], -1)
                gone = np.cumsum(change[:-1]) > 0
                rows.append((len(data), int(gone.sum()), len(runs_of(gone)[0]), np.frombuffer(data, np.uint8)[~gone].tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.record_batch([batch.column("doc_id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    last = keyed.join(removed, ["k1", "k2"], "left").select("doc_id", "text", "k1", "k2", "removed")
    return last.mapInArrow(keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


#: The registered query in DuckDB's SQL: the strings by their texts in hexadecimal digits.
ORACLE = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
y AS MATERIALIZED (SELECT r, a, least(512, n - a) AS n, substring(x, 2 * a + 1, 1422) AS y FROM (SELECT r, x, len(x) // 2 - 199 AS n, unnest(range(0, len(x) // 2 - 199, 512)) AS a FROM d WHERE len(x) >= 400)),
w AS MATERIALIZED (SELECT r, a + q AS p, md5_number(substring(y, 2 * q + 1, 400)) AS h FROM (SELECT r, a, y, unnest(range(0, n)) AS q FROM y)),
g AS (SELECT r, p FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
s AS (SELECT r, p, p - lag(p) OVER (PARTITION BY r ORDER BY p) AS step FROM g),
n AS (SELECT r, p, sum(CASE WHEN step <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY p) AS k FROM s),
c AS MATERIALIZED (SELECT r, min(p) AS a, max(p) + 200 AS b FROM n GROUP BY r, k),
t AS (SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS before FROM c),
k AS (SELECT t.r, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substring(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substring(any_value(x), 2 * max(b) + 1) AS kept FROM t JOIN d ON t.r = d.r GROUP BY t.r)
SELECT doc_id, len(x)::BIGINT // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN k ON d.r = k.r
"""
