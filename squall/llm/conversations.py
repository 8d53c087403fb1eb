"""Conversation structure repair: the cheapest edits that make the roles of a conversation read
``system? (user assistant)+``, by a rank-convergence parallel Viterbi search.

Rows get positions in one global order (range partitions, pinned); a *chunk* is what a block of
positions holds of one conversation, so no conversation is ever one task. What a suffix costs is a
vector over four states (nothing yet, after system, after user, after assistant). Only differences
inside a vector decide which edit is best, and only few vectors differ by more than a constant, so
``CLASSES`` lists them once and a chunk is run backwards through small tables:

1. every chunk starts from a speculative vector (all zeros; the last one from the true end);
2. fix-up passes rerun a chunk from its right neighbour's vector until old and new vectors differ
   only by a constant: what lies further left then stands. Rows may be such that they never meet (a
   long run of one role); after ``FIXUPS`` passes the chunks still open give their whole map from
   vector to vector, and maps are composed in groups of bounded size;
3. from the stitched backward vectors each chunk knows its cheapest edits for every state it may be
   entered in, the true states follow by composing these maps, and the edits are traced.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from squall.llm.common import Scratch, map_arrow, pinned, ship
from squall.operators.blocks import POS, global_position

DELETE, INSERT, REROLE, CUT_OFF = 3, 2, 2, 1
COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")
BLANKS = " \t\n\x0b\x0c\r"
#: Rows of one position block, chunks composed at a time, and passes before open chunks give their maps.
CHUNK, WIDTH, FIXUPS = 4096, 1024, 3

START, SYSTEM, USER, ASSISTANT = range(4)
_ROLES = "sua"                                    # other initials are role 3
_AFTER = (USER, USER, ASSISTANT, USER)            # the state after an inserted or reroled row
_KEPT = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (ASSISTANT, 1): USER, (USER, 2): ASSISTANT}
_OK, _TRUNCATED, _BLANK, _DUPLICATE = range(4)
#: One letter a row: its role and its first fault.
MARKS = [chr(ord("A") + i) for i in range(16)]


def _before(after: tuple, role: int, fault: int) -> list[int]:
    """Cost of each state's cheapest suffix before a row, from those after it."""
    more = CUT_OFF if fault == _TRUNCATED else 0
    cost = []
    for state in range(4):
        choices = [DELETE + after[state]]
        if fault < _BLANK:
            choices.append(REROLE + more + after[_AFTER[state]])
            if (state, role) in _KEPT:
                choices.append(more + after[_KEPT[state, role]])
        cost.append(min(choices))
    for _ in range(3):
        cost = [min(c, INSERT + cost[_AFTER[state]]) for state, c in enumerate(cost)]
    return cost


def _edits(after: tuple, role: int, fault: int, state: int) -> tuple[str, int]:
    """The ASCII-least cheapest edits up to and with this row, and the state then."""
    cost, made = _before(after, role, fault), ""
    more = CUT_OFF if fault == _TRUNCATED else 0
    while True:
        if DELETE + after[state] == cost[state]:
            return made + "D", state
        if INSERT + cost[_AFTER[state]] == cost[state]:
            made, state = made + "I", _AFTER[state]
            continue
        if (state, role) in _KEPT and more + after[_KEPT[state, role]] == cost[state]:
            return made + "K", _KEPT[state, role]
        return made + "R", _AFTER[state]


def _tables():
    """All vectors that occur, up to a constant; where each mark leads; edits by vector, mark, state."""
    classes, number = [(0, 2 * INSERT, INSERT, 0), (0, 0, 0, 0)], {}
    step, edits = [], []
    for v in classes:                             # grows while it is read
        number[v] = len(number)
        leads = {}
        for i, mark in enumerate(MARKS):
            cost = _before(v, i // 4, i % 4)
            least = min(cost)
            w = tuple(c - least for c in cost)
            if w not in classes:
                classes.append(w)
            leads[mark] = w
        step.append(leads)
        edits.append({m: [_edits(v, i // 4, i % 4, q) for q in range(4)] for i, m in enumerate(MARKS)})
    return classes, [{m: number[w] for m, w in leads.items()} for leads in step], edits


CLASSES, _STEP, _EDITS = _tables()
END, GUESS = 0, 1                                 # the vector after a conversation's last row; the speculative one
_TAIL = ("", "II", "I", "")                       # what a state still lacks at the end


def run_back(marks: str, vector: int) -> int:
    """The vector before a chunk from the one after it."""
    for mark in reversed(marks):
        vector = _STEP[vector][mark]
    return vector


def fix_up(marks: str, was: int, now: int, out: int) -> int:
    """The vector before a chunk that ran from ``was`` to ``out``, when run from ``now``: only until
    both vectors differ by a constant."""
    for mark in reversed(marks):
        if was == now:
            return out
        was, now = _STEP[was][mark], _STEP[now][mark]
    return now


def _stitched(marks: str, vector: int) -> list[int]:
    """The vector after each row."""
    after = [vector] * len(marks)
    for i in range(len(marks) - 1, 0, -1):
        after[i - 1] = vector = _STEP[vector][marks[i]]
    return after


def leaves(marks: str, vector: int) -> list[int]:
    """The state after a chunk, for each state before it."""
    after, states = _stitched(marks, vector), [0, 1, 2, 3]
    for mark, v in zip(marks, after, strict=True):
        row = _EDITS[v][mark]
        states = [row[q][1] for q in states]
    return states


def trace(marks: str, vector: int, state: int, last: bool) -> str:
    """The edits of a chunk entered in ``state``; each row's end with K, R or D."""
    made = []
    for mark, v in zip(marks, _stitched(marks, vector), strict=True):
        letters, state = _EDITS[v][mark][state]
        made.append(letters)
    return "".join(made) + (_TAIL[state] if last else "")


def damage(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Damaged copy (key, turn, role, text) of ``rows``: crc32(``key:turn``) modulo 20 drops a row (0),
    empties its text (1), takes ``.!?`` from it (2), repeats it (3) or makes it the user's (4). Null
    roles and texts, and null numbers in the checksum, are one space."""
    blank = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col(key).cast("string"), blank), F.lit(":"),
                            F.coalesce(F.col(turn).cast("string"), blank))) % 20
    d = rows.select(F.col(key).alias("key"), F.col(turn).alias("turn"), F.coalesce(F.col(role), blank).alias("role"),
                    F.coalesce(F.col(text), blank).alias("text"), kind.alias("kind")).where("kind <> 0")
    d = d.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return d.select("key", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                    F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", ""))
                    .otherwise(F.col("text")).alias("text"))


def _conversation(key: str) -> Column:
    """A conversation's name, null keys included."""
    return F.when(F.col(key).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(key).cast("string")))


def _composed(maps: DataFrame, size: int, name: str) -> DataFrame:
    """Maps of ``size`` states composed in order of ``at`` within (conv, block)."""
    same = F.array(*[F.lit(i) for i in range(size)])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "to"))), lambda x: x["to"])
    return maps.groupBy("conv", "block").agg(ordered.alias("maps")).select(
        "conv", F.col("block").alias("at"),
        F.aggregate("maps", same, lambda done, m: F.transform(done, lambda s: F.element_at(m, s + 1))).alias(name))


def entered(maps: DataFrame, start: int, scratch: Scratch, width: int = WIDTH, size: int = 4) -> DataFrame:
    """(conv, at, state): the state in which each map is entered, maps (conv, at, to) applied in order
    of ``at`` from ``start``. Maps are composed ``width`` at a time and level by level."""
    first = maps.groupBy("conv").agg(F.min("at").alias("begin"))
    maps = maps.join(first, "conv").withColumn("block", F.floor((F.col("at") - F.col("begin")) / width).cast("long")).drop("begin")
    blocks = maps.agg(F.max("block")).first()[0]
    if blocks:
        whole = scratch.pin(_composed(maps, size, "to"), "conversation-maps")
        above = entered(whole, start, scratch, width, size).select("conv", F.col("at").alias("block"), "state")
    else:
        above = maps.select("conv", "block").distinct().withColumn("state", F.lit(start))
    begun = F.struct(F.col("state").alias("state"), F.array().cast("array<struct<at:bigint,state:int>>").alias("seen"))
    walked = F.aggregate("maps", begun, lambda done, m: F.struct(
        F.element_at(m["to"], done["state"] + 1).alias("state"),
        F.concat(done["seen"], F.array(F.struct(m["at"].alias("at"), done["state"].alias("state")))).alias("seen")))
    grouped = maps.groupBy("conv", "block").agg(F.array_sort(F.collect_list(F.struct("at", "to"))).alias("maps"))
    return grouped.join(above, ["conv", "block"]).select("conv", F.explode(walked["seen"]).alias("x")) \
        .select("conv", "x.at", "x.state")


def _column(function, kind: str):
    """A column function of whole rows' values; the package is with the workers."""
    def call(*values: pd.Series) -> pd.Series:
        return pd.Series([function(*row) for row in zip(*values, strict=True)], dtype=object)

    return F.pandas_udf(call, kind)


def _positioned(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows with conversation, position, role, fault and letter. Of equal rows any may be the first."""
    named = rows.select(_conversation("key").alias("conv"), "turn", "role", "text",
                        F.monotonically_increasing_id().alias("tie"))
    placed = global_position(named, ["conv", "turn", "role", "text", "tie"])
    kept = F.rtrim(F.col("text"), F.lit(BLANKS))
    content = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    first = placed.where(kept != "").groupBy("conv", content.alias("content")).agg(F.min(POS).alias(POS)) \
        .select(POS, F.lit(True).alias("first"))       # joined by position: no hot key
    fault = F.when(kept == "", _BLANK).when(F.col("first").isNull(), _DUPLICATE) \
        .when(~F.substring(kept, -1, 1).isin(".", "!", "?"), _TRUNCATED).otherwise(_OK)
    role = F.instr(F.lit(_ROLES), F.substring("role", 1, 1))
    role = F.when((role == 0) | (F.col("role") == ""), 3).otherwise(role - 1)
    return scratch.pin(placed.join(first, POS, "left").select(
        "conv", POS, "turn", "role", "text", F.char(F.lit(ord("A")) + 4 * role + fault).alias("mark")), "conversation-rows")


def _settled(chunks: DataFrame, scratch: Scratch, width: int, fixups: int) -> DataFrame:
    """Chunks (conv, at, marks, last) with the vector after each."""
    back = _column(run_back, "int")
    again = _column(lambda marks, was, now, out: out if was == now else fix_up(marks, was, now, out), "int")
    start = F.when(F.col("last"), F.lit(END)).otherwise(F.lit(GUESS))
    state = scratch.pin(chunks.withColumn("vector", start).withColumn("out", back("marks", "vector")), "conversation-vectors")
    for _ in range(fixups):
        right = state.select("conv", (F.col("at") - 1).alias("at"), F.col("out").alias("now"))
        joined = state.join(right, ["conv", "at"], "left").withColumn("now", F.coalesce("now", F.lit(END)))
        new = joined.select("conv", "at", "marks", "last", F.col("now").alias("vector"),
                            again("marks", "vector", "now", "out").alias("out"), F.col("out").alias("was"))
        new = scratch.pin(new, "conversation-vectors")
        state = new.drop("was")
        if not new.where("out <> was").limit(1).count():
            return state
    whole = _column(lambda marks: [run_back(marks, v) for v in range(len(CLASSES))], "array<int>")
    maps = scratch.pin(chunks.select("conv", (-F.col("at")).alias("at"), whole("marks").alias("to")), "conversation-maps")
    found = entered(maps, END, scratch, width, len(CLASSES)).select("conv", (-F.col("at")).alias("at"), F.col("state").alias("vector"))
    return chunks.join(found, ["conv", "at"])


def _counts(marks: str, following, audit: str) -> list[int]:
    """Blank, duplicate and truncated rows, neighbours with illegal roles, and cost of a chunk."""
    codes = [ord(m) - ord("A") for m in marks]
    faults = [c % 4 for c in codes]
    roles = [c // 4 for c in codes]
    if following is not None:
        roles.append((ord(following) - ord("A")) // 4)
    illegal = sum(pair not in ((0, 1), (1, 2), (2, 1)) for pair in zip(roles, roles[1:], strict=False))
    deeds = [c for c in audit if c != "I"]
    cost = INSERT * audit.count("I") + REROLE * audit.count("R") + DELETE * audit.count("D")
    cost += CUT_OFF * sum(f == _TRUNCATED and e != "D" for f, e in zip(faults, deeds, strict=True))
    return [faults.count(_BLANK), faults.count(_DUPLICATE), faults.count(_TRUNCATED), illegal, cost]


def _apply(batches):
    """Repaired rows from rows and chunk heads (conv, pos, head, role, text, audit), sorted; state goes
    over from batch to batch, so a conversation may be of any length."""
    conv = audit = None
    state = number = at = 0
    for batch in batches:
        made = {"conv": [], "number": [], "role": [], "text": []}

        def add(role, text, made=made):
            made["conv"].append(conv)
            made["number"].append(number)
            made["role"].append(role)
            made["text"].append(text)

        for name, is_head, role, text, edits in zip(*(batch.column(c).to_pylist() for c in ("conv", "head", "role", "text", "audit")),
                                                    strict=True):
            if name != conv:
                conv, state, number = name, START, 0
            if is_head:
                audit, at = edits, 0
            else:
                while audit[at] == "I":
                    state = _AFTER[state]
                    number += 1
                    add("user" if state == USER else "assistant", "")
                    at += 1
                edit = audit[at]
                at += 1
                if edit != "D":
                    number += 1
                    if edit == "K":
                        state = _KEPT[state, _ROLES.index(role[:1])]
                    else:
                        state = _AFTER[state]
                        role = "user" if state == USER else "assistant"
                    add(role, text)
            while 0 < len(audit) - at < 3 and audit[at] == audit[-1] == "I":      # what lacks after the last row
                state = _AFTER[state]
                number += 1
                add("user" if state == USER else "assistant", "")
                at += 1
        yield pa.record_batch({"conv": pa.array(made["conv"], pa.string()), "number": pa.array(made["number"], pa.int64()),
                               "role": pa.array(made["role"], pa.string()), "text": pa.array(made["text"], pa.string())})


def repair(rows: DataFrame, chunk: int = CHUNK, width: int = WIDTH, fixups: int = FIXUPS,
           scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """Report and repaired rows of conversations (key, turn, role, text).

    A conversation's rows are taken by turn (nulls first; rows of one turn by role and text). The first
    fault of a row counts: blank, duplicate (role and text seen earlier), truncated (the last character
    that is not blank is none of ``.!?``). Blank and duplicate rows are deleted. Of the cheapest edits
    those with the ASCII-least letters are taken. Null keys are one conversation; null roles and texts
    must be made strings before (``damage`` does).

    The report has (conv, blank, duplicate, truncated, illegal, cost, audit, turns, first_turn,
    last_turn), one row for each conversation with rows; the repaired rows (conv, number, role, text)
    come sorted by conversation and number within their partitions. Both read tables in the shared
    folder, which ``scratch`` removes."""
    ship(rows.sparkSession)
    scratch = scratch or Scratch(rows.sparkSession)
    placed = _positioned(rows, scratch)
    block = F.floor(F.col(POS) / chunk).cast("long")
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(POS, "mark"))), lambda x: x["mark"]), "")
    chunks = scratch.pin(placed.groupBy("conv", block.alias("at")).agg(letters.alias("marks")), "conversation-chunks")
    right = chunks.select("conv", (F.col("at") - 1).alias("at"), F.substring("marks", 1, 1).alias("following"))
    chunks = chunks.join(right, ["conv", "at"], "left").withColumn("last", F.col("following").isNull())
    chunks = scratch.pin(chunks, "conversation-chunks")
    alone = chunks.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    several = chunks.join(alone.where("n > 1").select("conv"), "conv", "left_semi")
    several = scratch.pin(several, "conversation-several")
    if several.limit(1).count():
        states = _settled(several.drop("following"), scratch, width, fixups)
        maps = scratch.pin(states.select("conv", "at", _column(leaves, "array<int>")("marks", "vector").alias("to"), "vector"),
                           "conversation-states")
        into = entered(maps.select("conv", "at", "to"), START, scratch, width)
        known = chunks.join(maps.select("conv", "at", "vector").join(into, ["conv", "at"]), ["conv", "at"], "left")
    else:
        known = chunks.withColumn("vector", F.lit(END)).withColumn("state", F.lit(START))
    audited = known.withColumn("audit", _column(trace, "string")(
        "marks", F.coalesce("vector", F.lit(END)), F.coalesce("state", F.lit(START)), "last"))
    counted = _column(_counts, "array<long>")
    audited = scratch.pin(audited.withColumn("found", counted("marks", "following", "audit")), "conversation-audits")
    totals = audited.groupBy("conv").agg(
        *[F.sum(F.col("found")[i]).alias(c) for i, c in enumerate(COUNTS)],
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    turns = placed.groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv").agg(
        F.count("turn").alias("turns"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))
    heads = audited.select("conv", (F.col("at") * chunk).alias(POS), F.lit(True).alias("head"), F.lit("").alias("role"),
                           F.lit("").alias("text"), "audit")
    texts = placed.select("conv", POS, F.lit(False).alias("head"), "role", "text", F.lit("").alias("audit"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    repaired = heads.unionByName(texts).repartition(parts, "conv").sortWithinPartitions("conv", POS, F.desc("head"))
    return totals.join(turns, "conv"), map_arrow(repaired, _apply, "conv string, number long, role string, text string")


def _digest(batches):
    """sha256 of each conversation's ``role:text`` lines; rows come sorted."""
    conv = made = None
    for batch in batches:
        out = {"conv": [], "sha": []}
        for name, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text")), strict=True):
            if name != conv:
                if made is not None:
                    out["conv"].append(conv)
                    out["sha"].append(made.hexdigest())
                conv, made = name, hashlib.sha256()
            else:
                made.update(b"\n")
            made.update(f"{role}:{text}".encode())
        yield pa.record_batch({"conv": pa.array(out["conv"], pa.string()), "sha": pa.array(out["sha"], pa.string())})
    if made is not None:
        yield pa.record_batch({"conv": pa.array([conv], pa.string()), "sha": pa.array([made.hexdigest()], pa.string())})


def repair_report(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                  **sizes) -> DataFrame:
    """(key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every
    conversation of ``conversations`` after ``damage``; one left without rows has zeros, an empty audit
    and the digest of nothing. The digest of one conversation is one stream by its nature; it holds one
    batch of rows at a time."""
    damaged = damage(conversations, key, turn, role, text)
    scratch = Scratch(conversations.sparkSession)
    report, repaired = repair(damaged, scratch=scratch, **sizes)
    digests = map_arrow(repaired, _digest, "conv string, sha string")
    names = conversations.select(F.col(key).alias("key")).distinct().withColumn("conv", _conversation("key"))
    gaps = F.when(F.col("turns") > 0, F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns")).otherwise(F.lit(0))
    joined = names.join(report, "conv", "left").join(digests, "conv", "left")
    report = joined.select(
        F.col("key").alias(key), F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
    report = pinned(report, "conversation-report")
    scratch.drop()
    return report
