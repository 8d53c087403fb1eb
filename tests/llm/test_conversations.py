import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from squall.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string, mark string, vector long, at string"


def damaged(rows):
    """Damage by the contract, as (conv, turn, role, text)."""
    out = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub(r"[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows, faults):
    """All edit scripts, by depth-first search: the least (cost, letters) and its lines."""
    best = [None]

    def go(i, state, cost, letters, lines, inserted):
        if best[0] and cost > best[0][0]:
            return
        if i == len(rows) and state in (cv.START, cv.ASSISTANT):
            found = (cost, letters, lines)
            if best[0] is None or found[:2] < best[0][:2]:
                best[0] = found
        if inserted < 2:
            role = "assistant" if state == cv.USER else "user"
            go(i, cv.ASSISTANT if state == cv.USER else cv.USER, cost + 2, letters + "I", [*lines, role + ":"], inserted + 1)
        if i == len(rows):
            return
        role, text = rows[i]
        go(i + 1, state, cost + 3, letters + "D", lines, 0)
        if faults[i] in ("blank", "duplicate"):
            return
        more = faults[i] == "truncated"
        legal = {cv.START: {"s": cv.SYSTEM, "u": cv.USER}, cv.SYSTEM: {"u": cv.USER}, cv.USER: {"a": cv.ASSISTANT},
                 cv.ASSISTANT: {"u": cv.USER}}[state].get(role[:1])
        if legal is not None:
            go(i + 1, legal, cost + more, letters + "K", [*lines, f"{role}:{text}"], 0)
        other = "assistant" if state == cv.USER else "user"
        go(i + 1, cv.ASSISTANT if state == cv.USER else cv.USER, cost + 2 + more, letters + "R", [*lines, f"{other}:{text}"], 0)

    go(0, cv.START, 0, "", [], 0)
    return best[0]


def expected(rows):
    out = {}
    after = damaged(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, faults = set(), []
        for _, _, role, text in own:
            stripped = text.rstrip(cv.BLANKS)
            faults.append("blank" if not stripped else "duplicate" if (role, text) in seen else
                          "truncated" if stripped[-1] not in ".!?" else "")
            seen.add((role, text))
        first = "".join(r[2][:1] or " " for r in own)
        turns = [r[1] for r in own if r[1] is not None]
        cost, audit, lines = cheapest([r[2:] for r in own], faults)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"),
                     faults.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])), cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def rows_of(r, conversations, most):
    rows = []
    for conv in range(conversations):
        for i in range(r.randint(1, most)):
            role = r.choice(["user", "assistant", "system", "user", "assistant", "tool", None, ""])
            text = r.choice([None, "", " \n", "Yes.", "No", "Why? ", "a.\t", "end", f"t{i}.", f"u{i}"])
            rows.append((conv if conv else None, r.choice([i, i, i, None, i + 3]), role, text))
    return rows


@pytest.mark.parametrize(("seed", "sizes"), [(1, {}), (2, {"chunk": 3, "width": 2}), (3, {"chunk": 2, "width": 3, "fixups": 0})])
def test_against_all_edit_scripts(spark, seed, sizes):
    rows = rows_of(random.Random(seed), 25, 6)
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    got = {r["conv_id"]: tuple(r)[1:] for r in cv.repair_report(df, **sizes).collect()}
    assert got == expected(rows)


def straight(marks):
    """Cost vectors and edits of one whole conversation, row by row, without tables or chunks."""
    after = [cv.CLASSES[cv.END]]
    for m in reversed(marks):
        code = ord(m) - ord("A")
        after.append(tuple(cv._before(after[-1], code // 4, code % 4)))
    after.reverse()
    state, letters = cv.START, ""
    for i, m in enumerate(marks):
        code = ord(m) - ord("A")
        made, state = cv._edits(after[i + 1], code // 4, code % 4, state)
        letters += made
    return after[0][cv.START], letters + cv._TAIL[state]


@pytest.mark.parametrize("fixups", [1, 50])
def test_long_conversations_in_chunks(spark, fixups):
    """Runs of one role never make two vectors meet; a hot conversation spans many chunks."""
    r = random.Random(7)
    roles = {0: ["user"] * 90, 1: ["assistant"] * 61, 2: [r.choice(["user", "assistant"]) for _ in range(200)],
             3: ["user", "assistant"] * 40, 4: ["system"] * 33}
    rows = [(c, i, role, r.choice([f"text {i}.", f"text {i}", "same."])) for c, all_roles in roles.items()
            for i, role in enumerate(all_roles)]
    df = spark.createDataFrame(rows, "key long, turn long, role string, text string")
    report, repaired = cv.repair(df, chunk=5, width=3, fixups=fixups)
    report = {r["conv"]: r for r in report.collect()}
    lines = {}
    for row in repaired.collect():
        lines.setdefault(row["conv"], []).append((row["number"], row["role"], row["text"]))
    for c in roles:
        seen, marks = set(), ""
        for _, _, role, text in [x for x in rows if x[0] == c]:
            fault = 3 if (role, text) in seen else 0 if text.endswith(".") else 1
            seen.add((role, text))
            marks += cv.MARKS[4 * "sua".index(role[0]) + fault]
        cost, audit = straight(marks)
        got = report[f"={c}"]
        assert (got["cost"], got["audit"]) == (cost, audit)
        assert re.fullmatch("(s?(ua)+)?", "".join(x[1][0] for x in sorted(lines.get(f"={c}", []))))
        assert [x[0] for x in lines.get(f"={c}", [])] == list(range(1, len(lines.get(f"={c}", [])) + 1))


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert cv.repair_report(empty).collect() == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(gone, 0, "user", "Hi.", "x", 1, "y")], SCHEMA)
    assert [tuple(r) for r in cv.repair_report(one).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_copies_of_one_row_are_not_one_task(spark):
    """A conversation of one repeated row: all copies but the first go, in many chunks."""
    df = spark.range(500).select(F.lit(1).cast("long").alias("key"), F.lit(4).cast("long").alias("turn"),
                                 F.lit("user").alias("role"), F.lit("Hi.").alias("text"))
    report, repaired = cv.repair(df, chunk=20, width=4)
    row = report.first()
    assert (row["duplicate"], row["cost"], row["audit"]) == (499, 499 * 3 + 2, "K" + "D" * 499 + "I")
    assert [tuple(r) for r in repaired.collect()] == [("=1", 1, "user", "Hi."), ("=1", 2, "assistant", "")]
