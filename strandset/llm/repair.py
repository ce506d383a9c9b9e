"""Conversation structure repair: a forward Viterbi pass over four grammar states.

The roles of a repaired conversation read ``(s?(ua)+)?`` by their initials. A row is kept (cost 0), given the
role user or assistant that comes next (3) or deleted (4); a turn without text is inserted (3). A pass over the
rows carries, for each state of the grammar, the least (cost, audit string) that leads there; after each row its
layer is closed with the insertions, of which two at most can help. An audit string is the edits' initials in
order; as the role that comes next is given by the state, it names one repaired conversation.
"""

from __future__ import annotations

import hashlib
import os.path
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandset.llm.common import few, written

#: States: nothing yet, after system, after user, after assistant; and the state that the next turn leads to.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = (USER, USER, ASSISTANT, USER)
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_KEPT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
_LEGAL = {"su", "ua", "au"}
_SPACE = " \t\n\v\f\r"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Any state can go on like any other after an insertion and a deletion: what costs more than that above the least is never the best.
_APART = INSERT + DELETE

Path = tuple[int, str]
Row = tuple[str, bool, bool]  # initial, to be deleted, truncated


def _close(layer: dict[int, Path]) -> dict[int, Path]:
    """The layer with the insertions that may follow its row."""
    for state in (NOTHING, SYSTEM, ASSISTANT, USER):  # to user first, then to assistant
        if state in layer:
            cost, audit = layer[state]
            to, path = _NEXT[state], (cost + INSERT, audit + "I")
            if to not in layer or path < layer[to]:
                layer[to] = path
    most = min(layer.values())[0] + _APART
    return {state: path for state, path in layer.items() if path[0] <= most}


def forward(rows: Iterable[Row], start: int = NOTHING) -> dict[int, Path]:
    """The least (cost, audit) from ``start`` to each state over the rows; states that can't be on a best path are left out.

    What all audits begin with is set aside, so that a row costs little however long the conversation is.
    """
    layer, done = _close({start: (0, "")}), []
    for n, (initial, gone, truncated) in enumerate(rows):
        after: dict[int, Path] = {}
        extra = TRUNCATED if truncated else 0
        for state, (cost, audit) in layer.items():
            ways = [(state, (cost + DELETE, audit + "D"))]
            if not gone:
                ways.append((_NEXT[state], (cost + REROLE + extra, audit + "R")))
                if (to := _KEPT.get((state, initial))) is not None:
                    ways.append((to, (cost + extra, audit + "K")))
            for to, path in ways:
                if to not in after or path < after[to]:
                    after[to] = path
        layer = _close(after)
        if n % 64 == 63:
            same = os.path.commonprefix([audit for _, audit in layer.values()])
            done.append(same)
            layer = {state: (cost, audit[len(same) :]) for state, (cost, audit) in layer.items()}
    before = "".join(done)
    return {state: (cost, before + audit) for state, (cost, audit) in layer.items()}


def applied(audit: str, turns: Iterable[tuple[str, str]], start: int = NOTHING) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of each edit: a deleted turn with its own role and text, an inserted one without text."""
    state, left = start, iter(turns)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(left)
        if edit == "K":
            state = _KEPT[state, role[:1]]
        elif edit != "D":
            state = _NEXT[state]
            role = _ROLE[state]
        yield edit, role, text


class _Findings:
    """Counts of faults over a conversation's rows in order; those of its segments add up."""

    def __init__(self) -> None:
        self.blank = self.duplicate = self.truncated = self.illegal = self.n_turns = 0
        self.low: int | None = None
        self.high: int | None = None
        self.first = self.last = None  # initials

    def row(self, turn: int | None, role: str, text: str, repeated: bool) -> Row:
        said = text.rstrip(_SPACE)
        blank = not said
        duplicate = not blank and repeated
        truncated = not blank and not duplicate and said[-1] not in ".!?"
        return self.fault(turn, role[:1], blank, duplicate, truncated)

    def fault(self, turn: int | None, initial: str, blank: bool, duplicate: bool, truncated: bool) -> Row:
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        if self.last is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in _LEGAL
        self.last = initial
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.n_turns += turn != self.high
            self.high = turn
        return initial, blank or duplicate, truncated

    def add(self, other: _Findings) -> None:
        """The findings with those of the segment that follows."""
        for name in ("blank", "duplicate", "truncated", "illegal", "n_turns"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        if self.last is not None and other.last is not None:
            self.illegal += self.last + other.first not in _LEGAL
        self.first, self.last = (other.first if self.last is None else self.first), (self.last if other.last is None else other.last)
        if self.high is not None and self.high == other.low:
            self.n_turns -= 1  # one turn lies on both sides
        self.low = other.low if self.low is None else self.low
        self.high = self.high if other.high is None else other.high

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.n_turns


_COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
SCHEMA = f"conv_id long, part int, {_COUNTS}, turns array<struct<edit:string,role:string,text:string>>"
_EDIT = pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
_KINDS = [pa.int64(), pa.int32(), *[pa.int64()] * 6, pa.string(), pa.list_(_EDIT)]
_NAMES = ["conv_id", "part", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "turns"]


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)


def _edits(audit: str, turns: Iterable[tuple[str, str]], start: int = NOTHING) -> list[dict]:
    return [dict(zip(("edit", "role", "text"), e, strict=True)) for e in applied(audit, turns, start)]


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows that follow each other with the same first ``keys`` columns, over Arrow batches."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != now:
                if held:
                    yield now, held
                now, held = row[:keys], []
            held.append(row)
    if held:
        yield now, held


def _out(rows: Iterator[tuple], kinds: list[pa.DataType], names: list[str], most: int = 512) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield _batch(held, kinds, names)
            held = []
    yield _batch(held, kinds, names)


def _whole(conv_id: int | None, rows: list[tuple[int | None, str, str]]) -> tuple:
    """One conversation, its rows in order, repaired."""
    found, seen, states = _Findings(), set(), []
    for turn, role, text in rows:
        states.append(found.row(turn, role, text, (role, text) in seen))
        seen.add((role, text))
    ends = forward(states)
    cost, audit = min(ends[s] for s in (NOTHING, ASSISTANT) if s in ends)
    counts = (found.gaps(), found.blank, found.duplicate, found.truncated, found.illegal, cost, audit)
    return conv_id, 0, *counts, _edits(audit, ((role, text) for _, role, text in rows))


def _repair_long(rows: DataFrame, segment_rows: int, n: int) -> DataFrame:
    """Conversations of any length in segments of about ``segment_rows`` rows.

    Segments are ranges of the sorted rows. Each is passed from every state to every state; a conversation's
    segments are then put together in order, which gives each segment's own state and audit. No task holds
    more than a segment's texts, or a conversation's audit.
    """
    order = ["conv_id", "turn", "role", "text"]
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn"))) > 1
    cut = written(
        rows.withColumn("repeated", seen).repartitionByRange(max(1, -(-n // segment_rows)), *order).sortWithinPartitions(*order, "repeated")
        .withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    )
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 7, pa.string(), pa.string(), *[pa.list_(pa.string())] * 2]
    names = ["conv_id", "part", "blank", "duplicate", "truncated", "illegal", "n_turns", "low", "high", "first", "last", "ways", "audits"]

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for (conv, part), group in _groups(batches, 2):
                f = _Findings()
                states = [f.fault(*row[3:]) for row in group]
                ways = {(a, b): path for a in range(4) for b, path in forward(states, a).items()}
                yield conv, part, *(getattr(f, x) for x in names[2:11]), [f"{a} {b} {cost}" for (a, b), (cost, _) in ways.items()], [audit for _, audit in ways.values()]

        return _out(each(), kinds, names, 4)

    said = F.rtrim("text", F.lit(_SPACE))
    blank = F.length(said) == 0
    duplicate = ~blank & F.col("repeated")
    narrow = cut.select("conv_id", "part", "at", "turn", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), duplicate.alias("duplicate"), (~blank & ~duplicate & ~F.right(said, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    parts = narrow.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "at")
    segments = parts.mapInArrow(passed, "conv_id long, part int, blank long, duplicate long, truncated long, illegal long, n_turns long, low long, high long, first string, last string, ways array<string>, audits array<string>")

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for (conv,), group in _groups(batches, 1):
                total, best, back = _Findings(), {NOTHING: (0, "")}, []
                for _, part, *values, ways, audits in group:
                    f = _Findings()
                    for name, value in zip(names[2:11], values, strict=True):
                        setattr(f, name, value)
                    total.add(f)
                    after: dict[int, tuple] = {}
                    for way, audit in zip(ways, audits, strict=True):
                        a, b, cost = map(int, way.split())
                        if a in best and (b not in after or (best[a][0] + cost, best[a][1] + audit) < after[b][:2]):
                            after[b] = (best[a][0] + cost, best[a][1] + audit, a, audit)
                    best = {b: path[:2] for b, path in after.items()}
                    back.append((part, {b: path[2:] for b, path in after.items()}))
                cost, audit, state = min((*best[s], s) for s in (NOTHING, ASSISTANT) if s in best)
                steps = []
                for part, came in reversed(back):
                    steps.append((part, *came[state]))
                    state = came[state][0]
                counts = (total.gaps(), total.blank, total.duplicate, total.truncated, total.illegal, cost, audit)
                for i, (part, start, own) in enumerate(reversed(steps)):
                    yield conv, part, i, start, own, *(counts if i == 0 else [None] * 7)

        return _out(each(), [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), *_KINDS[2:9]], ["conv_id", "part", "number", "start", "own", *_NAMES[2:9]], 4)

    chosen = segments.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(put_together, f"conv_id long, part int, number int, start int, own string, {_COUNTS}")
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("number", "int"), ("start", "int"), ("own", "string"), *((x, "long") for x in _NAMES[2:8]), ("audit", "string"))]
    lines = cut.select("conv_id", "part", F.col("at").alias("at"), "role", "text", *none).unionByName(chosen.select("conv_id", "part", F.lit(-1).cast("long").alias("at"), F.lit("").alias("role"), F.lit("").alias("text"), "number", "start", "own", *_NAMES[2:9]))

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for (conv, _), (head, *group) in _groups(batches, 2):
                number, start, own, *counts = head[5:]
                yield conv, number, *counts, _edits(own, ((row[3], row[4]) for row in group), start)

        return _out(each(), _KINDS, _NAMES, 1)

    return lines.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "at").mapInArrow(edit, SCHEMA)


def repair_conversations(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment_rows: int = 65_536
) -> DataFrame:
    """Repaired conversations: (conv_id, part, gaps, blank, duplicate, truncated, illegal, cost, audit, turns).

    Rows are taken by turn (null first), then role and text. A null role or text is one space; a role that begins
    with none of s, u and a can't be kept. Each row's first fault counts: blank (white space alone), duplicate
    (role and text seen earlier in the conversation; repeated rows are duplicates), truncated (the last sign is
    none of ``.!?``). Blank and duplicate rows are deleted; a truncated row that stays costs 3 more. ``gaps`` counts
    the turn numbers that are missing between the smallest and the largest, ``illegal`` the neighbours whose
    roles may not follow each other. Of the cheapest repairs that with the least audit string is taken. ``turns``
    lists all edits (K, R, D, I) with role and text, deleted ones too. Rows with a null id are one conversation.
    Other columns are not read; an empty table gives an empty result.

    A conversation is one row, part 0, found by a stream over its sorted rows. One of more than ``segment_rows``
    rows is cut into segments that are passed by themselves and put together (:func:`_repair_long`): a row
    each, the counts and the whole audit on part 0, null on the others.
    """
    read = turns.select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"),
    )
    sizes = written(read.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > segment_rows))
    many = sizes.agg(F.sum("n")).first()[0]
    ids = sizes.select(F.col("conv_id").alias("long_id"))
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    short = read if not many else read.join(few(ids), same, "left_anti")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _out((_whole(conv, [row[1:] for row in rows]) for (conv,), rows in _groups(batches, 1)), _KINDS, _NAMES)

    out = short.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(whole, SCHEMA)
    return out if not many else out.unionByName(_repair_long(read.join(few(ids), same).drop("long_id"), segment_rows, many))


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, gaps ... audit, repaired_sha256): the digest of a conversation's ``role:text`` lines, read part by part.

    Runs in a stream over conversations, so memory is that of a part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            now, digest, first = None, None, True
            for batch in batches:
                for conv, part, *counts, turns in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if part == 0:
                        if now is not None:
                            yield *now, digest.hexdigest()
                        now, digest, first = (conv, *counts), hashlib.sha256(), True
                    for t in turns:
                        if t["edit"] != "D":
                            digest.update(("" if first else "\n").encode() + f"{t['role']}:{t['text']}".encode("utf-8", "surrogatepass"))
                            first = False
            if now is not None:
                yield *now, digest.hexdigest()

        return _out(each(), [pa.int64(), *_KINDS[2:9], pa.string()], ["conv_id", *_NAMES[2:9], "repaired_sha256"])

    by = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return by.mapInArrow(run, f"conv_id long, {_COUNTS}, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with planted faults, by crc32 of ``conv_id:turn`` modulo 20: dropped, emptied, without ``[.!?]``, repeated, of role user.

    A null is one space, in the key too; the turn itself stays null.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    how = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    marked = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), how.alias("how"))
    return marked.where("how <> 0").select(
        "conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("how") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def _crc_sql(s: str) -> str:
    """CRC-32 in SQL: eight shifts for each byte of an ASCII string."""
    bits = "list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda b, i: xor(b >> 1, CASE WHEN b % 2 = 1 THEN 3988292384 ELSE 0 END))"
    chars = f"list_prepend(4294967295::BIGINT, list_transform(string_split({s}, ''), lambda y: ascii(y)::BIGINT))"
    return f"xor(list_reduce({chars}, lambda c, x: {bits}), 4294967295)"


_S = r"[^\x20\x09-\x0D]"


def _oracle() -> str:
    """The registered query in DuckDB's SQL: the same grammar by recursion over the rows, its cost and audit as one sortable string."""
    best, state = "list_min([x FOR x IN {} IF x IS NOT NULL])", ("n", "s", "u", "a")

    def plus(x: str, cost: str, edit: str) -> str:
        return f"(printf('%09d', left({x}, 9)::INT + {cost}) || substring({x}, 10) || '{edit}')"

    more = "(CASE WHEN trunc THEN 3 ELSE 0 END)"
    ways = {x: [plus(f"r.{x}", "4", "D")] for x in state}
    for a, b, initial in (("n", "s", "s"), ("n", "u", "u"), ("s", "u", "u"), ("a", "u", "u"), ("u", "a", "a")):
        ways[b].append(f"CASE WHEN NOT gone AND left(role, 1) = '{initial}' THEN {plus(f'r.{a}', more, 'K')} END")
    for a, b in (("n", "u"), ("s", "u"), ("a", "u"), ("u", "a")):
        ways[b].append(f"CASE WHEN NOT gone THEN {plus(f'r.{a}', '3 + ' + more, 'R')} END")
    step = ", ".join(f"{best.format('[' + ', '.join(w) + ']')} AS {x}" for x, w in ways.items())
    user = best.format("[u, " + ", ".join(plus(x, "3", "I") for x in ("n", "s", "a")) + "]")
    closed = f"SELECT conv, pos, n, s, u2 AS u, {best.format('[a, ' + plus('u2', '3', 'I') + ']')} AS a FROM (SELECT *, {user} AS u2 FROM ({{}}))"
    start = "SELECT conv, 0::BIGINT AS pos, printf('%09d', 0) AS n, NULL::VARCHAR AS s, NULL::VARCHAR AS u, NULL::VARCHAR AS a FROM ids"
    rows = f"SELECT r.conv, l.pos, {step} FROM r JOIN l ON l.conv = r.conv AND l.pos = r.pos + 1"
    after = "CASE WHEN e = 'D' THEN w.st WHEN e = 'K' THEN left(coalesce(l.role, ''), 1) WHEN w.st = 'u' THEN 'a' ELSE 'u' END"
    said = "CASE e WHEN 'D' THEN NULL WHEN 'K' THEN l.role || ':' || l.text ELSE (CASE WHEN w.st = 'u' THEN 'assistant:' ELSE 'user:' END) || CASE WHEN e = 'R' THEN l.text ELSE '' END END"
    return f"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
h AS MATERIALIZED (SELECT *, {_crc_sql('key')} % 20 AS how FROM c),
ids AS MATERIALIZED (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS conv FROM (SELECT DISTINCT conv_id FROM conversations)),
d AS (SELECT conv_id, turn, CASE how WHEN 4 THEN 'user' ELSE role END AS role,
  CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE how WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE how <> 0),
o AS (SELECT conv, turn, role, text, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
  row_number() OVER (PARTITION BY conv, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM d JOIN ids ON d.conv_id IS NOT DISTINCT FROM ids.conv_id),
f AS (SELECT *, NOT regexp_matches(text, '{_S}') AS blank, regexp_extract(text, '({_S})[\\x20\\x09-\\x0D]*$', 1) AS final FROM o),
l AS MATERIALIZED (SELECT *, NOT blank AND nth > 1 AS dup, blank OR nth > 1 AS gone, NOT blank AND nth = 1 AND final NOT IN ('.', '!', '?') AS trunc FROM f),
r AS ({closed.format(start)} UNION ALL {closed.format(rows)}),
z AS MATERIALIZED (SELECT conv, list_min([x FOR x IN [n, a] IF x IS NOT NULL]) AS best FROM r WHERE (conv, pos) IN (SELECT conv, max(pos) FROM r GROUP BY conv)),
w AS (SELECT conv, 0::BIGINT AS i, 0::BIGINT AS pos, '' AS st, NULL::VARCHAR AS said FROM z
  UNION ALL SELECT w.conv, w.i + 1, w.pos + (e <> 'I')::INT, {after}, {said}
  FROM (SELECT w.*, substring(best, 10 + w.i::INT, 1) AS e FROM w JOIN z ON w.conv = z.conv WHERE w.i < length(best) - 9) w LEFT JOIN l ON l.conv = w.conv AND l.pos = w.pos + 1 AND w.e <> 'I'),
t AS (SELECT conv, string_agg(said, chr(10) ORDER BY i) AS whole FROM w GROUP BY conv),
s AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (trunc) AS truncated,
  count(*) FILTER (before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT *, lag(role) OVER (PARTITION BY conv ORDER BY pos) AS before FROM l) GROUP BY conv)
SELECT ids.conv_id::BIGINT AS conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, left(best, 9)::BIGINT AS cost, substring(best, 10) AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM ids LEFT JOIN s USING (conv) JOIN z USING (conv) JOIN t USING (conv)
"""


ORACLE = _oracle()
