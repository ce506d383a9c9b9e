"""Substring deduplication: suffix automata of reference shards.

A passage of ``length`` words is repeated if its word sequence starts in two places of the corpus. All
windows of ``length`` words are dealt by their minimizer, the least hash among their grams of a quarter
of the length: equal windows have equal minimizers, so the places of a window meet in one shard. A shard's
reference is the text around the minimizers that occur twice at least, equal texts once with their
number. A suffix automaton of the reference, with occurrence counts, is asked for matching statistics:
for each word, the longest passage ending there that occurs twice. Spans of ``length`` or more go.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandset.llm.common import cut, slices

_B, _M = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


class Words:
    """64-bit hashes of words, kept in a bounded dictionary."""

    def __init__(self, most: int = 300_000) -> None:
        self.known: dict[bytes, bytes] = {}
        self.most = most

    def __call__(self, text: str | None) -> np.ndarray:
        words, known = _split(text), self.known
        try:
            return np.frombuffer(b"".join(map(known.__getitem__, words)), np.uint64)
        except KeyError:
            if len(known) > self.most:
                known.clear()
            known.update((w, xxhash.xxh3_64_intdigest(w).to_bytes(8, "little")) for w in set(words) if w not in known)
            return np.frombuffer(b"".join(map(known.__getitem__, words)), np.uint64)


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


@functools.cache
def _words() -> Words:
    """One for each worker process, kept from task to task."""
    return Words()


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    """A mixed hash of each k consecutive values, by doubling."""
    part, size, power = h, 1, np.array([_B])  # hashes of `size` values, and the multiplier to the power `size`
    out, done = None, 0
    while True:
        if k & size:
            out = part if out is None else out[: len(h) - done - size + 1] * power + part[done : len(h) - size + 1]
            done += size
        if done == k:
            break
        part, power, size = part[:-size] * power + part[size:], power * power, 2 * size
    out = (out ^ (out >> np.uint64(31))) * _M
    return out ^ (out >> np.uint64(29))


def _sliding(v: np.ndarray, width: int, least: bool) -> np.ndarray:
    """The least or largest of each ``width`` consecutive values."""
    f, size = np.minimum if least else np.maximum, 1
    while 2 * size <= width:
        v, size = f(v[:-size], v[size:]), 2 * size
    return f(v[: len(v) - (width - size)], v[width - size :]) if width > size else v


def superwindows(h: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows with one minimizer: (document, first window, windows, minimizer, twice).

    ``h`` holds the documents' word hashes one after another, ``sizes`` their numbers of words. Windows
    count from their document's start. ``twice`` marks a run whose minimizer occurs in two places of it.
    """
    k = max(1, length // 4)  # short grams make longer runs of windows, and so fewer of them
    width = length - k + 1
    if len(h) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(bool)
    start = np.concatenate(([0], np.cumsum(sizes)))
    doc = np.repeat(np.arange(len(sizes)), sizes)
    v = _grams(h, k) | np.uint64(1)
    m = _sliding(v, width, True)
    inside = doc[: len(m)] == doc[length - 1 :]
    m = np.where(inside, m, np.uint64(0))
    edge = np.flatnonzero(np.concatenate(([True], (m[1:] != m[:-1]) | (doc[1 : len(m)] != doc[: len(m) - 1]))))
    first, count = edge, np.diff(np.append(edge, len(m)))
    good = inside[first]
    first, count = first[good], count[good]
    # A gram is a minimizer if it is the least of some window; two neighbours among those that are equal repeat.
    padded = np.concatenate((np.zeros(width - 1, np.uint64), m, np.zeros(width - 1, np.uint64)))
    minimal = np.flatnonzero(_sliding(padded, width, False)[: len(v)] == v)
    same = (v[minimal[1:]] == v[minimal[:-1]]) & (doc[minimal[1:]] == doc[minimal[:-1]])
    repeats = np.zeros(len(v) + 1, np.int64)
    repeats[minimal[1:][same]] = 1
    total = np.concatenate(([0], np.cumsum(repeats)))
    twice = total[np.minimum(first + count + width - 1, len(v))] - total[first] > 0
    return doc[first], first - start[doc[first]], count, m[first], twice


class Automaton:
    """A suffix automaton of several sequences with the number of places of each state's strings."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.size, self.places = [-1], [0], [0]

    def _state(self, size: int, moves: dict[bytes, int], link: int) -> int:
        self.next.append(moves)
        self.size.append(size)
        self.link.append(link)
        self.places.append(0)
        return len(self.size) - 1

    def _split(self, p: int, c: bytes, q: int) -> int:
        """A copy of q for the strings that reach it by way of p."""
        copy = self._state(self.size[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def add(self, sequence: list[bytes], times: int) -> None:
        last, moves, size = 0, self.next, self.size
        for c in sequence:
            if c in moves[last]:
                q = moves[last][c]
                last = q if size[q] == size[last] + 1 else self._split(last, c, q)
            else:
                new, p = self._state(size[last] + 1, {}, 0), last
                while p >= 0 and c not in moves[p]:
                    moves[p][c] = new
                    p = self.link[p]
                if p >= 0:
                    q = moves[p][c]
                    self.link[new] = q if size[q] == size[p] + 1 else self._split(p, c, q)
                last = new
            self.places[last] += times

    def close(self) -> None:
        """Adds each state's places to its suffixes' and finds each state's longest suffix with two places."""
        for s in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.places[self.link[s]] += self.places[s]
        self.twice = [0] * len(self.size)
        for s in sorted(range(1, len(self.size)), key=self.size.__getitem__):
            self.twice[s] = s if self.places[s] >= 2 else self.twice[self.link[s]]

    def spans(self, sequence: list[bytes], least: int) -> list[tuple[int, int]]:
        """Merged spans of ``sequence`` (one of the reference's) that occur twice and hold ``least`` or more."""
        out: list[tuple[int, int]] = []
        state = 0
        for i, c in enumerate(sequence):
            state = self.next[state][c]
            good = self.twice[state]
            n = i + 1 if good == state else self.size[good]
            if n >= least:
                n = min(n, i + 1)
                if out and out[-1][1] >= i + 1 - n:
                    out[-1] = (min(out[-1][0], i + 1 - n), i + 1)
                else:
                    out.append((i + 1 - n, i + 1))
        return out


_SEGMENT = "m long, s1 long, s2 long"


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text and a key of the row that is never null."""
    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return read.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(2**63))).alias("k1"), F.xxhash64("doc_id", "text").alias("k2"))


def dedup_substrings(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = 35,
    hot: int = 40_000,
    automaton_words: int = 60_000,
) -> DataFrame:
    """Removes every word that a repeated window of ``length`` words covers: (doc_id, n_words, n_removed, kept).

    Words are runs without ASCII white space, compared as they are; a window is repeated if its words also
    start anywhere else in the corpus, the same document included, and all its places are removed.
    ``kept`` joins the other words by one space. A null or empty text has no words and is kept as the
    empty text; shorter texts hold no window; null ids are kept, and repeated rows repeat each other's
    windows; other columns are not read; an empty table gives an empty result.

    Minimizers are chosen by hashes of words; the automata compare the words themselves. A minimizer with more than ``hot`` windows is dealt further, by
    whole windows, so no group is unbounded; equal references are merged into one with their number
    before they are shuffled. An automaton takes whole groups up to about ``automaton_words`` words.
    """
    keyed = _keyed(docs, doc_id, text)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words()
        for batch in slices(batches):
            hashes = [words(s) for s in batch.column("text").to_pylist()]
            sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
            doc, first, count, m, twice = superwindows(np.concatenate([*hashes, np.zeros(0, np.uint64)]), sizes, length)
            cuts = np.searchsorted(doc, np.arange(len(sizes) + 1))
            packed = np.stack((first, count, 1 + twice.astype(np.int64)), axis=1).astype(np.int32)
            rows = [(m[x:y].tobytes(), packed[x:y].tobytes()) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.record_batch([batch.column("k1"), batch.column("k2"), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["k1", "k2", "m", "places"])

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each run of the documents' packed runs."""
        for batch in batches:
            m = np.frombuffer(b"".join(batch.column("m").to_pylist()), np.int64)
            places = np.frombuffer(b"".join(batch.column("places").to_pylist()), np.int32).reshape(-1, 3)
            at = pa.array(np.repeat(np.arange(batch.num_rows), [len(x) // 8 for x in batch.column("m").to_pylist()]))
            yield pa.record_batch([pa.array(m), batch.column("k1").take(at), batch.column("k2").take(at), *map(pa.array, places.T.copy())], ["m", "k1", "k2", "first", "windows", "n"])

    # The runs are found once; a packed row a document is small beside its text.
    packed = cut(keyed.select("text", "k1", "k2").mapInArrow(runs, "k1 long, k2 long, m binary, places binary"))
    found = packed.mapInArrow(single, "m long, k1 long, k2 long, first int, windows int, n int")
    again = (
        found.groupBy("m").agg(F.sum("n").alias("n"), F.sum("windows").alias("all"))
        .where("n > 1").select("m", (F.col("all") > hot).alias("hot"))
    )
    marks = (
        found.select("m", "k1", "k2", "first", "windows").join(again, "m")
        .groupBy("k1", "k2").agg(F.collect_set(F.struct("m", "first", "windows", "hot")).alias("marks"))
    )

    def segments(with_words: bool):
        """The marked runs' texts: merged with their number, or only their names and places."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            digest = xxhash.xxh3_128_digest
            for batch in slices(batches):
                rows, at = [], []
                for d, (s, marks) in enumerate(zip(batch.column("text").to_pylist(), batch.column("marks").to_pylist(), strict=True)):
                    words = _split(s)
                    for mark in marks:
                        key, f, c, is_hot = mark["m"], mark["first"], mark["windows"], mark["hot"]
                        for j, n in ((j, 1) for j in range(c)) if is_hot else ((0, c),):
                            piece = b" ".join(words[f + j : f + j + n + length - 1])
                            name = digest(piece)
                            rows.append((int.from_bytes(name[:8], "little", signed=True) if is_hot else key, name, f + j, piece))
                            at.append(d)
                if with_words:
                    merged: dict[tuple[int, bytes], list] = {}
                    for key, name, _, piece in rows:
                        merged.setdefault((key, name), [piece, 0])[1] += 1
                    names = np.frombuffer(b"".join(name for _, name in merged), np.int64).reshape(-1, 2)
                    rest = [pa.array([n for _, n in merged.values()], pa.int64()), pa.array([x for x, _ in merged.values()], pa.binary())]
                    yield pa.record_batch([pa.array([key for key, _ in merged], pa.int64()), pa.array(names[:, 0]), pa.array(names[:, 1]), *rest], ["m", "s1", "s2", "times", "words"])
                else:
                    names = np.frombuffer(b"".join(r[1] for r in rows), np.int64).reshape(-1, 2)
                    where = pa.array(at, pa.int64())
                    rest = [batch.column("k1").take(where), batch.column("k2").take(where), pa.array([r[2] for r in rows], pa.int32())]
                    yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array(names[:, 0]), pa.array(names[:, 1]), *rest], ["m", "s1", "s2", "k1", "k2", "first"])

        return run

    marked = keyed.join(marks, ["k1", "k2"]).select("doc_id", "text", "k1", "k2", "marks")
    placed = marked.mapInArrow(segments(False), _SEGMENT + ", k1 long, k2 long, first int")
    # Merged within tasks, then dealt by the minimizer alone, so that one shuffle serves sums and shards.
    reference = (
        marked.mapInArrow(segments(True), _SEGMENT + ", times long, words binary").repartition("m")
        .groupBy("m", "s1", "s2").agg(F.sum("times").alias("times"), F.first("words").alias("words"))
    )

    def ask(group: list[tuple], out: list[tuple]) -> None:
        automaton = Automaton()
        for *_, times, sequence in group:
            automaton.add(sequence, times)
        automaton.close()
        for *name, _, sequence in group:
            if spans := automaton.spans(sequence, length):
                out.append((*name, np.array(spans, np.int32).tobytes()))

    def automata(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        held: list[tuple] = []  # whole groups, then the one that is open
        size = 0

        def made(out: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["m", "s1", "s2", "spans"])

        def take(group: list[tuple], out: list[tuple]) -> None:
            nonlocal size
            if len(group) == 1 and group[0][3] >= 2:  # one text and its copies: all of it is repeated
                out.append((*group[0][:3], np.array([[0, len(group[0][4])]], np.int32).tobytes()))
                return
            waiting.extend(group)
            size += sum(len(g[4]) for g in group)
            if size >= automaton_words:
                ask(waiting, out)
                waiting.clear()
                size = 0

        waiting: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for m, s1, s2, times, words in zip(*(batch.column(c).to_pylist() for c in ("m", "s1", "s2", "times", "words")), strict=True):
                if held and held[0][0] != m:
                    take(held, out)
                    held = []
                held.append((m, s1, s2, times, words.split()))
            yield made(out)
        out = []
        if held:
            take(held, out)
        if waiting:
            ask(waiting, out)
        yield made(out)

    shards = reference.sortWithinPartitions("m", "s1", "s2")
    spans = shards.mapInArrow(automata, _SEGMENT + ", spans binary")
    places = placed.join(spans, ["m", "s1", "s2"])
    removed = places.groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "spans")).alias("removed"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for s, rows in zip(batch.column("text").to_pylist(), batch.column("removed").to_pylist(), strict=True):
                words = (s or "").encode("utf-8", "surrogatepass").split()
                n_words.append(len(words))
                if rows:
                    gone = np.zeros(len(words) + 1, np.int64)
                    for row in rows:
                        ends = np.frombuffer(row["spans"], np.int32).reshape(-1, 2) + row["first"]
                        np.add.at(gone, ends[:, 0], 1)
                        np.add.at(gone, ends[:, 1], -1)
                    words = [w for w, g in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if not g]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.record_batch([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    last = keyed.join(removed, ["k1", "k2"], "left").select("doc_id", "text", "k1", "k2", "removed")
    return last.mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept string")


#: The registered query in DuckDB's SQL, by the windows' texts themselves.
ORACLE = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws FROM documents),
w AS (SELECT doc_id, pos, array_to_string(ws[pos:pos + 34], ' ') AS win
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS pos FROM d WHERE len(ws) >= 35)),
r AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY win) AS n FROM w),
e AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS pos, unnest(ws) AS word FROM d),
c AS (SELECT e.doc_id, e.pos, e.word, e.pos - last_value(CASE WHEN r.n > 1 THEN r.pos END IGNORE NULLS)
             OVER (PARTITION BY e.doc_id ORDER BY e.pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS back
      FROM e LEFT JOIN r ON e.doc_id = r.doc_id AND e.pos = r.pos),
k AS (SELECT doc_id, count(*) FILTER (back < 35) AS n_removed, string_agg(CASE WHEN back IS NULL OR back >= 35 THEN word END, ' ' ORDER BY pos) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
