"""Best-fit packing of tokenized documents by minimum bin slack.

Only lengths matter for packing, and there are at most ``capacity`` of them. So the corpus is
reduced to a histogram of lengths; each bin is planned on it by a bitset subset-sum, and the pieces
then find their bin by their rank among the pieces of their length.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandset.llm.common import cut

#: A space before which a text may be cut without changing its tokens follows no white space.
_UNSAFE = re.compile(r"\s ")
_SPECIAL = "<|endoftext|>"


def _byte_of_character() -> dict[str, int]:
    """The bytes behind the characters in a byte-level vocabulary: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class _Ids:
    """Token ids of texts as little-endian 32-bit bytes.

    A byte-level BPE of this kind never merges across a space that follows a visible character, so
    texts are cut there and the parts' ids kept in a bounded dictionary. Texts with other white space
    before a space, or with the special token's string, are encoded whole by ``tokenizers``. Parts are
    encoded with the same vocabulary by ``tiktoken``, which gives the same ids in less time.
    """

    def __init__(self, path: str, most: int = 600_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.known = Tokenizer.from_file(path), most, {}
        byte = _byte_of_character()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if token != _SPECIAL}
        self.parts = tiktoken.Encoding("parts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _encode(self, parts: list[str]) -> list[bytes]:
        encode = self.parts.encode_ordinary
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in map(encode, parts)]

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if _SPECIAL in text or _UNSAFE.search(text):
            return self._whole(text)
        parts = text.replace(" ", "\0 ").split("\0") if "\0" not in text else re.split("(?= )", text)
        known = self.known
        try:
            return b"".join(map(known.__getitem__, parts))
        except KeyError:
            new = list({p for p in parts if p not in known})
            ids = dict(zip(new, self._encode(new), strict=True))
            if len(known) + len(new) <= self.most:
                known.update(ids)
            else:
                return b"".join([known[p] if p in known else ids[p] for p in parts])
        return b"".join([known[p] for p in parts])


@functools.cache
def _ids(path: str) -> _Ids:
    """One for each worker process, kept from task to task."""
    return _Ids(path)


def tokenized_pieces(docs: DataFrame, doc_id: str, text: str, tokenizer: str, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document, with its closing id 0."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _ids(tokenizer)
        for batch in batches:
            out: list[list[int | None]] = [[], [], [], [], []]
            for key, s in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(s.as_py() or "") + b"\0\0\0\0"
                n, view = len(ids) // 4, memoryview(ids)
                start, end = 0, n % capacity or capacity
                for piece in range(-(-n // capacity)):
                    row = (key, piece, start, end - start, zlib.crc32(view[4 * start : 4 * end]))
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
                    start, end = end, end + capacity
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return read.mapInArrow(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(available: dict[int, int], room: int) -> list[int]:
    """The lengths of a fullest feasible combination, larger lengths first.

    Bit ``s`` of the set says that the sum ``s`` can be reached. Lengths enter in descending order, in
    doubling amounts so that each step is one shift; the reached sums after each step are kept for the
    way back.
    """
    steps, reached, mask = [], 1, (1 << (room + 1)) - 1
    for length in sorted(available, reverse=True):
        left, amount = min(available[length], room // length), 1
        while left > 0:
            take = min(amount, left)
            steps.append((length, take, reached))
            reached |= (reached << (length * take)) & mask
            left, amount = left - take, 2 * amount
        if reached >> room & 1:
            break
    best, chosen = reached.bit_length() - 1, []
    for length, take, before in reversed(steps):
        if not before >> best & 1:
            chosen += [length] * take
            best -= length * take
    return sorted(chosen, reverse=True)


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Bins by minimum slack: (lengths in a bin, number of such bins), until no length is left.

    Each bin starts with the longest piece left and is filled as far as the others allow. A found
    combination is removed as often as the counts allow, so that there are about as many plans as
    distinct lengths, however many pieces there are.
    """
    left, plans = {k: v for k, v in counts.items() if v}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        rest = fullest({k: v for k, v in left.items() if v and k <= capacity - longest}, capacity - longest)
        left[longest] += 1
        lengths = [longest, *rest]
        need = {k: lengths.count(k) for k in set(lengths)}
        times = min(left[k] // n for k, n in need.items())
        for k, n in need.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        plans.append((lengths, times))
    return plans


def _places(plans: list[tuple[list[int], int]], capacity: int) -> tuple[np.ndarray, ...]:
    """Plans as arrays by (length, first rank): first bin, pieces of that length in a bin, first offset."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for lengths, times in plans:
        offset = 0
        for length in sorted(set(lengths), reverse=True):
            n = lengths.count(length)
            rows.append((length, used.get(length, 0), base, n, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        base += times
    rows.sort()
    return tuple(np.array([r[i] for r in rows], np.int64) for i in range(5))


def pack_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = 2048,
    tokenizer: str | None = None,
    ranked_at_once: int = 100_000,
) -> DataFrame:
    """Packs every document into sequences of at most ``capacity`` tokens.

    Returns (doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row a piece. A document
    is its tokens and a closing id 0; only longer ones are cut, and only the first piece may then be
    shorter than ``capacity``. A null or empty text is the id 0 alone. Ties of length are ranked by
    id, piece and checksum; repeated rows are packed each; null ids are kept; other columns are not
    read; an empty table gives an empty result.

    The histogram of lengths (at most ``capacity`` rows) is all that reaches the driver. Ranks are
    numbered within (length, salt), with as many salts for a length as keep a group within a partition's
    share of all rows, ``ranked_at_once`` at most, and moved on by the counts of the salts before.
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    pieces = cut(tokenized_pieces(docs, doc_id, text, path, capacity))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    spark = docs.sparkSession
    share = max(1, min(ranked_at_once, sum(counts.values()) // int(spark.conf.get("spark.sql.shuffle.partitions"))))
    salts = spark.createDataFrame([(length, -(-n // share)) for length, n in sorted(counts.items())], "length long, salts long")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts"))).drop("salts")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
        .select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    )
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        salted.withColumn("rank", F.row_number().over(within) - 1)
        .join(shift, ["length", "salt"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("shift")).alias("rank"))
    )
    length_, first, base, per_bin, offset = _places(plan_bins(counts, capacity), capacity)
    wide = np.int64(1 << 44)
    keys = length_ * wide + first

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, length * wide + rank, "right") - 1
            j = rank - first[at]
            sequence = base[at] + j // per_bin[at]
            place_ = offset[at] + j % per_bin[at] * length
            yield pa.record_batch(
                [*batch.columns[:5], pa.array(sequence), pa.array(place_)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
