"""Conversation repair against a search of all edit strings, in one piece and in segments."""

import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from strandset.llm import queries, repair

TURNS = "conv_id long, turn long, role string, text string"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def ordered(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))


def plain(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest) of a conversation's rows, by every string of edits."""
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    rows, seen, faults = ordered(rows), set(), []
    for _, _, role, text in rows:
        said = text.strip(" \t\n\v\f\r")
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for _, t, _, _ in rows if t is not None]
    best = None
    todo = [(0, "", "", 0, ())]  # cost, audit, state, rows taken, repaired
    while todo:
        cost, audit, state, i, out = todo.pop()
        if best is not None and cost > best[0]:
            continue
        if i == len(rows) and state in ("", "a") and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, out)
        to = NEXT[state]
        if not audit.endswith("III"):
            todo.append((cost + 3, audit + "I", to, i, (*out, ("user:" if to == "u" else "assistant:"))))
        if i < len(rows):
            _, _, role, text = rows[i]
            todo.append((cost + 4, audit + "D", state, i + 1, out))
            if faults[i] in ("", "truncated"):
                extra = 3 if faults[i] else 0
                todo.append((cost + 3 + extra, audit + "R", to, i + 1, (*out, ("user:" if to == "u" else "assistant:") + text)))
                if role[:1] == to or (state == "" and role[:1] == "s"):
                    todo.append((cost + extra, audit + "K", role[:1], i + 1, (*out, f"{role}:{text}")))
    illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, best[0], best[1], hashlib.sha256("\n".join(best[2]).encode()).hexdigest()


def conversations(seed, n=120, most=7):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.randrange(1, most + 1)):
            turn = r.choice([t, t, t, t + 2, None])
            rows.append((c if c else None, turn, r.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), r.choice(["ok.", "so?", "no", "well \n", "", " \t", None, "é!"])))
    return rows


@pytest.mark.parametrize("segment_rows", [65_536, 3])
def test_repairs_are_the_cheapest(spark, segment_rows):
    rows = conversations(4)
    frame = spark.createDataFrame(rows, TURNS).withColumns({"part": F.lit("x"), "n": F.lit(1), "long_id": F.lit(2)})
    got = repair.digests(repair.repair_conversations(frame, segment_rows=segment_rows)).collect()
    expected = {c: plain([r for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert len(got) == len(expected) and {r["conv_id"]: tuple(r)[1:] for r in got} == expected


def test_a_long_conversation_in_segments_is_the_same(spark):
    r = random.Random(9)
    rows = [(1, t // 2, r.choice(["user", "assistant", "system", "x"]), r.choice(["a.", "b", f"t{t}.", f"t{t}", ""])) for t in range(1500)]
    rows += [(2, None, "tool", f"x{i}") for i in range(400)] + [(2, None, "tool", "same.")] * 200
    rows += [(3, t, ("user", "assistant")[t % 2], f"y{t}.") for t in range(400)]
    frame = spark.createDataFrame(rows, TURNS)
    one = {x["conv_id"]: x for x in repair.digests(repair.repair_conversations(frame)).collect()}
    cut = repair.repair_conversations(frame, segment_rows=100)
    assert cut.count() > 12
    assert {x["conv_id"]: x for x in repair.digests(cut).collect()} == one
    edits = [e for p in sorted(cut.where("conv_id = 3").collect(), key=lambda p: p["part"]) for e in p["turns"]]
    assert [e["text"] for e in edits] == [f"y{t}." for t in range(400)] and {e["edit"] for e in edits} == {"K"}


def test_the_query_damages_and_keeps_every_conversation(spark, tmp_path):
    rows = conversations(8, 60)
    rows += [(1000 + i, 0, "user", "gone.") for i in range(60)]
    spark.createDataFrame(rows, TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {x["conv_id"]: tuple(x)[1:] for x in queries.op11_conversation_repair(spark, str(tmp_path)).collect()}
    left = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        how = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if how == 1 else text.translate(str.maketrans("", "", ".!?")) if how == 2 else text
        left += [(c, t, "user" if how == 4 else role, text)] * {0: 0, 3: 2}.get(how, 1)
    expected = {c: plain([r for r in left if r[0] == c]) for c in {r[0] for r in rows}}
    assert got == expected and any(v[6] == "" for v in expected.values())


def test_no_rows(spark, tmp_path):
    empty = spark.createDataFrame([], TURNS)
    assert repair.repair_conversations(empty).count() == 0
    empty.write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op11_conversation_repair(spark, str(tmp_path)).count() == 0
