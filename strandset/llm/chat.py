"""Chat formatting by columnar byte assembly.

A turn becomes ``<s>role\\ntext</s>``. In texts and roles a backslash is put after each ``<`` and ``[``,
so that no text can hold a control string (``<s>``, ``</s>``, ``[INST]``, ``[/INST]``), and taking out
the character after each ``<`` and ``[`` gives the text back. A line end in a role becomes ``<n``.

All turns of an Arrow batch are assembled at once: segment lengths, cumulative offsets and scatter
indices are numpy arrays, and headers and contents are copied into one preallocated buffer, which is
the output column's Arrow buffer as it stands.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandset.llm.common import slices

OPEN, CLOSE = b"<s>", b"</s>"
_TURNS = 256  # turns that are assembled at once: the scatter indices take many times their bytes
_TURN = re.compile(r"<s>([^<\n]*(?:<[\\n][^<\n]*)*)\n([^<]*(?:<\\[^<]*)*)</s>")
_ESCAPED = re.compile(r"([<\[])(.)", re.DOTALL)


def unescape(s: str) -> str:
    return _ESCAPED.sub(r"\1", s)


def _unescaped_role(s: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[2] == "n" else m[1], s)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and its n + 1 offsets into them."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _escaped(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same bytes with a backslash after each ``<`` and ``[``, and the new offsets."""
    special = (data == ord("<")) | (data == ord("["))
    before = np.concatenate(([0], np.cumsum(special)))
    out = np.full(len(data) + before[-1], ord("\\"), np.uint8)
    out[np.arange(len(data)) + before[:-1]] = data
    return out, offsets + before[offsets]


def assemble(segments: list[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row by row concatenation of segments, each (bytes, n + 1 offsets), into one buffer.

    Returns the buffer, the rows' offsets in it and the segments' starts (n by segments).
    """
    lengths = np.stack([np.diff(o) for _, o in segments], axis=1)
    starts = np.concatenate(([0], np.cumsum(lengths)))
    buffer = np.empty(starts[-1], np.uint8)
    places = starts[:-1].reshape(n, len(segments))
    for i, (data, offsets) in enumerate(segments):
        size = lengths[:, i]
        buffer[np.repeat(places[:, i] - offsets[:-1], size) + np.arange(offsets[-1])] = data
    return buffer, starts[:: len(segments)] if n else np.zeros(1, np.int64), places


def _constant(piece: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.tile(np.frombuffer(piece, np.uint8), n), np.arange(n + 1, dtype=np.int64) * len(piece)


def _escaped_role(role: str | None) -> str:
    return re.sub(r"([<\[])", r"\1\\", role or "").replace("\n", "<n")


def _format(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all turns, offsets by turn, and each text's start and end."""
    n = batch.num_rows
    roles = batch.column("role").to_pylist()
    written = {r: _escaped_role(r) for r in set(roles)}
    role = _bytes(pa.array([written[r] for r in roles], pa.large_string()))
    content = _escaped(*_bytes(batch.column("text")))
    segments = [_constant(OPEN, n), role, _constant(b"\n", n), content, _constant(CLOSE, n)]
    buffer, offsets, places = assemble(segments, n)
    return buffer, offsets, places[:, 3], places[:, 4]


class _Conversations:
    """Joins the turns of one conversation, over Arrow batches, into rows of bounded size."""

    SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def __init__(self, part_bytes: int) -> None:
        self.part_bytes, self.open, self.rows = part_bytes, False, []
        self.conv: int | None = None
        self.part, self.pieces, self.size, self.turns, self.loss = 0, [], 0, 0, []

    def close(self) -> None:
        if self.pieces:
            self.rows.append((self.conv, self.part, self.turns, self.pieces, self.loss))
            self.part += 1
        self.pieces, self.size, self.turns, self.loss = [], 0, 0, []

    def add(self, conv: int | None, piece: np.ndarray, turns: int, loss: list[tuple[int, int]]) -> None:
        if not self.open or conv != self.conv:
            self.close()
            self.open, self.conv, self.part = True, conv, 0
        elif self.size + len(piece) > self.part_bytes:
            self.close()
        self.loss += [{"start": a + self.size, "end": b + self.size} for a, b in loss]
        self.pieces.append(piece)
        self.size, self.turns = self.size + len(piece), self.turns + turns

    def ready(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        pieces = [x for row in rows for x in row[3]]
        offsets = np.concatenate(([0], np.cumsum([sum(map(len, row[3])) for row in rows]))).astype(np.int32)
        data = np.concatenate(pieces) if pieces else np.zeros(0, np.uint8)
        formatted = pa.Array.from_buffers(pa.string(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        columns = [pa.array([row[0] for row in rows], pa.int64()), pa.array([row[1] for row in rows], pa.int32()), pa.array([row[2] for row in rows], pa.int64()), formatted, pa.array([row[4] for row in rows], pa.list_(self.SPAN))]
        return pa.record_batch(columns, ["conv_id", "part", "n_turns", "formatted", "loss"])


SCHEMA = "conv_id long, part int, n_turns long, formatted string, loss array<struct<start:long,end:long>>"


def format_conversations(
    turns: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    learned_role: str = "assistant",
    part_bytes: int = 16 << 20,
) -> DataFrame:
    """Conversations as formatted texts: (conv_id, part, n_turns, formatted, loss).

    Turns are ordered by turn (null first), then role and text, so that ties and repeated rows have one
    order; repeated rows are turns each. A null text is empty, and so is a null role. ``loss`` lists
    the byte ranges (start, end) of ``formatted`` that are learned: the texts of ``learned_role``. A
    conversation is one row, part 0; only one longer than ``part_bytes`` goes on in further parts, cut
    between turns, in order in the same partition. Rows with a null id are one conversation. Other
    columns are not read; an empty table gives an empty result.

    Turns are sorted within partitions by conversation and streamed, so memory is bounded by 256 turns
    and a part, however long a conversation is.
    """
    read = turns.select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"),
    )
    ordered = read.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Conversations(part_bytes)
        for batch in slices(batches, _TURNS):
            buffer, offsets, begin, end = _format(batch)
            ids, roles = batch.column("conv_id").to_pylist(), batch.column("role").to_pylist()
            first = 0
            for i in range(1, len(ids) + 1):
                if i < len(ids) and ids[i] == ids[first] and offsets[i] - offsets[first] < part_bytes:
                    continue
                base = offsets[first]
                loss = [(int(begin[j] - base), int(end[j] - base)) for j in range(first, i) if roles[j] == learned_role]
                out.add(ids[first], buffer[base : offsets[i]], i - first, loss)
                first = i
            yield out.ready()
        out.close()
        yield out.ready()

    return ordered.mapInArrow(run, SCHEMA)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation or part."""
    return [(_unescaped_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from formatted conversations, a row for each.

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars); the first digest is of
    role, line end, text, line end for each turn, the second of all text under the loss ranges. Runs on
    the operator's partitions, where the parts of a conversation follow each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None

        def row() -> tuple:
            return (now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5])

        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

        for batch in batches:
            rows = []
            for conv, part, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "formatted", "loss")), strict=True):
                if now is None or part == 0:
                    if now is not None:
                        rows.append(row())
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_back(text):
                    now[1] += 1
                    now[2].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                data = text.encode()
                for span in loss:
                    learned = unescape(data[span["start"] : span["end"]].decode())
                    now[3] += len(learned)
                    now[4].update(learned.encode())
                now[5] += len(text)
            yield batch_of(rows)
        if now is not None:
            yield batch_of([row()])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The registered query in DuckDB's SQL. A turn has eight characters beside its role and text,
#: and each ``<`` and ``[`` one more.
ORACLE = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(8 + length(role) + length(text) + 2 * length(role || text) - length(replace(role || text, '<', '')) - length(replace(role || text, '[', '')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
