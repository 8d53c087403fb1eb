"""Quality rules as a learned decision list: sequential covering over statistics of whole texts.

Rules that reject documents are learned one after the other from labelled rows. A rule grows on two
thirds of the rows not yet covered, one threshold condition at a time, each the one with the largest
gain of information (FOIL). It is then pruned on the other third: last conditions go while that
raises (poor - good) / (poor + good) there. It stays if it is precise enough on that third, and what
it covers is left out for the next one; the first rule that is not ends the list. Learning needs only
counts of poor and good rows by cells of each statistic's values, so it uses every labelled row and
the driver sees a bounded table. The list is one ordered Spark CASE expression over columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from squall.llm.common import Scratch, column, crc_of, map_arrow, pinned

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = ("word_length", "symbol_rate", "symbol_words", "dup_line_share", "repeat_share", "distinct_share", "top_word_share",
          "capital_share", "digit_share", "shout_rate", "bar_rate", "mark_rate", "line_words", "longest_word")
#: Values of a statistic that share a cell differ by about 2 %.
CELLS_TO_DOUBLE, FINEST = 32, 1000.0

_SPACES = [9, 10, 11, 12, 13, 32]
_IN_WORD = np.ones(256, dtype=bool)
_IN_WORD[_SPACES] = False
_CHARACTER = _IN_WORD.copy()
_CHARACTER[0x80:0xC0] = False                     # further bytes of one character
_SYMBOL, _MARK = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_MARK[[ord(c) for c in ".,;:?"]] = True
_STRETCH = 1 << 20


def _pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Numbers of the pairs (left, right), equal for equal pairs; exact."""
    return np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)[1]


def repeated_words(ids: np.ndarray, size: int = 5) -> int:
    """How many words lie in windows of ``size`` words that occur twice or more."""
    if len(ids) <= size:
        return 0
    two = _pairs(ids[:-1], ids[1:])
    four = _pairs(two[:-2], two[2:])
    five = _pairs(four[:-1], ids[4:])
    often = np.bincount(five)[five] > 1
    covered = np.zeros(len(ids) + 1, dtype=np.int64)
    at = np.flatnonzero(often)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + size, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def statistics_of(text: bytes) -> tuple[list[int], list[float]]:
    """COUNTS and SHARES of one text's UTF-8. Bytes are counted a stretch at a time."""
    raw = np.frombuffer(text, dtype=np.uint8)
    by_byte = np.zeros(256, dtype=np.int64)
    for at in range(0, len(raw), _STRETCH):
        by_byte += np.bincount(raw[at:at + _STRETCH], minlength=256)
    words = text.split()                          # at exactly the six blanks
    n = len(words)
    chars, symbols = int(by_byte[_CHARACTER].sum()), int(by_byte[_SYMBOL].sum())
    lines = [line for line in text.split(b"\n") if line.strip()]
    dup_lines = len(lines) - len(set(lines))
    repeats = top = distinct = longest = marked = 0
    if n:
        known = dict(zip(words, range(n), strict=True))
        ids = np.fromiter(map(known.__getitem__, words), np.int64, n)
        distinct, top = len(known), int(np.bincount(ids).max())
        longest = max(map(len, known))
        marked = sum(w[-1:] in b"#*$%&|<>" for w in words)
        repeats = repeated_words(ids)
    few, many = max(n, 1), max(chars, 1)
    letters = int(by_byte[65:91].sum() + by_byte[97:123].sum() + by_byte[0xC0:].sum())
    shares = [chars / few, symbols / few, marked / few, dup_lines / max(len(lines), 1), repeats / few, distinct / few, top / few,
              int(by_byte[65:91].sum()) / max(letters, 1), int(by_byte[48:58].sum()) / many, int(by_byte[33]) / few,
              int(by_byte[124]) / few, int(by_byte[_MARK].sum()) / few, n / max(len(lines), 1), float(longest)]
    return [n, chars, symbols, dup_lines, repeats], shares


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, *COUNTS, *SHARES) of every row of ``docs``; null texts are empty."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def made(batches):
        for batch in batches:
            texts = column(batch, "text").cast(pa.large_binary())
            found = [statistics_of(t.as_py() or b"") for t in texts]
            out = [column(batch, "key")]
            out += [pa.array([f[0][i] for f in found], pa.int64()) for i in range(len(COUNTS))]
            out += [pa.array([f[1][i] for f in found], pa.float64()) for i in range(len(SHARES))]
            yield pa.RecordBatch.from_arrays(out, ["key", *COUNTS, *SHARES])

    schema = [f"key {kind}", *(f"{c} long" for c in COUNTS), *(f"{c} double" for c in SHARES)]
    return map_arrow(rows, made, ", ".join(schema))


def base_failed() -> Column:
    """Too few words, or more than a fifth of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    limit: float

    def column(self) -> Column:
        return F.col(self.name) >= self.limit if self.above else F.col(self.name) < self.limit

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.above else '<'} {self.limit:g}"


@dataclass
class DecisionList:
    """Rules in order; the first whose conditions all hold rejects, none keeps."""

    rules: list[list[Condition]] = field(default_factory=list)

    def column(self) -> Column:
        """The text of the rule that rejects a row, null for a row that is kept."""
        made = None
        for rule in self.rules:
            said = F.lit(" and ".join(map(str, rule)))
            made = F.when(_all(rule), said) if made is None else made.when(_all(rule), said)
        return F.lit(None).cast("string") if made is None else made

    def __str__(self) -> str:
        return "\n".join(f"{i + 1}. poor if {' and '.join(map(str, rule))}" for i, rule in enumerate(self.rules))


def _all(conditions) -> Column:
    made = F.lit(True)
    for c in conditions:
        made = made & c.column()
    return made


def _cell(name: str) -> Column:
    return F.floor(CELLS_TO_DOUBLE * F.log2(1 + FINEST * F.col(name))).cast("int")


def _limit(cell: int) -> float:
    """The least value of a cell, to six digits."""
    return float(f"{(2 ** (cell / CELLS_TO_DOUBLE) - 1) / FINEST:.6g}")


def _information(poor, good):
    return np.log2(np.maximum(poor, 1e-9) / np.maximum(poor + good, 1e-9))


def _best(rows: list, names: list[str], p0: int, n0: int) -> tuple[float, Condition | None]:
    """The condition with the largest gain, from rows (statistic, cell, poor, good); of equal ones that
    with the widest gap between the values it parts. Its limit lies in the middle of the gap."""
    best, chosen = (1e-9, 0), None
    for i, name in enumerate(names):
        own = sorted((r[1], r[2], r[3]) for r in rows if r[0] == i)
        if len(own) < 2:
            continue
        cells = np.array([r[0] for r in own])
        gap = np.diff(cells)
        poor, good = (np.cumsum([0, *(r[k] for r in own)]) for k in (1, 2))
        for above in (False, True):
            p = (poor[-1] - poor if above else poor)[1:-1]
            n = (good[-1] - good if above else good)[1:-1]
            gain = np.round(p * (_information(p, n) - _information(p0, n0)), 6)
            k = int(np.lexsort((gap, gain))[-1])
            if (gain[k], gap[k]) > best:
                best = (float(gain[k]), int(gap[k]))
                chosen = Condition(name, above, _limit((int(cells[k]) + 1 + int(cells[k + 1])) // 2))
    return best[0], chosen


def learn(train: DataFrame, names: list[str], poor: str = "poor", grow: str = "grow", most_rules: int = 24,
          most_conditions: int = 4, least_precision: float = 0.97, least_rows: int = 4) -> DecisionList:
    """The decision list of labelled rows ``train`` (statistics ``names``, booleans ``poor`` and
    ``grow``). ``least_precision`` and ``least_rows`` (poor rows covered) hold on the pruning rows.
    Rows of one class give no rule."""
    scratch = Scratch(train.sparkSession)
    cells = F.array(*[_cell(c) for c in names]).alias("cells")
    rows = scratch.pin(train.select(F.col(poor).alias("poor"), F.col(grow).alias("grow"), *names, cells), "rules-labelled")
    bad, fine = F.sum(F.col("poor").cast("long")), F.sum((~F.col("poor")).cast("long"))
    found = DecisionList()
    left = F.lit(True)
    while len(found.rules) < most_rules:
        rule: list[Condition] = []
        p0 = n0 = None
        while len(rule) < most_conditions:
            counts = rows.where(F.col("grow") & left & _all(rule)).select("poor", F.posexplode("cells").alias("i", "cell")) \
                .groupBy("i", "cell").agg(bad.alias("p"), fine.alias("n")).collect()      # names x cells, whatever the rows
            counts = [tuple(r) for r in counts]
            p0, n0 = (sum(r[k] for r in counts if r[0] == 0) for k in (2, 3))
            if not p0 or not n0:
                break
            _, condition = _best(counts, names, p0, n0)
            if condition is None:
                break
            rule.append(condition)
        if not rule:
            break
        held = [F.sum((_all(rule[:k + 1]) & F.col("poor")).cast("long")) for k in range(len(rule))]
        wrong = [F.sum((_all(rule[:k + 1]) & ~F.col("poor")).cast("long")) for k in range(len(rule))]
        tested = rows.where(~F.col("grow") & left).agg(*held, *wrong).first()
        p, n = tested[:len(rule)], tested[len(rule):]
        worth = [((p[k] or 0) - (n[k] or 0)) / max((p[k] or 0) + (n[k] or 0), 1) for k in range(len(rule))]
        k = max(range(len(rule)), key=lambda i: (worth[i], -i))
        if (p[k] or 0) < least_rows or p[k] < least_precision * (p[k] + n[k]):
            break
        found.rules.append(rule[:k + 1])
        left = left & ~_all(rule[:k + 1])
    scratch.drop()
    return found


def labelled(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """Rows of ``stats`` with a label (0 is poor) that are not held out (crc32 of the key as text
    modulo 3 is 1) and not failed already. A key labelled twice counts by its smaller label."""
    named = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")) \
        .where("key is not null and label in (0, 1)").where(crc_of("key") % 3 != 1).groupBy("key").agg(F.min("label").alias("label"))
    return stats.where(~base_failed()).join(named, "key").withColumn("poor", F.col("label") == 0) \
        .withColumn("grow", F.pmod(F.xxhash64(F.lit("rules"), "key"), F.lit(3)) != 0)


def quality_rules(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
                  **options) -> tuple[DataFrame, DecisionList]:
    """Statistics and verdict of every row of ``docs`` and the list that gave it: (key, *COUNTS,
    base_failed, kept, reason, held_out, *SHARES). ``reason`` is the rule that rejects a row. Null and
    empty texts have no words and fail; repeated rows each count; without labels of both classes the
    list is empty and only the base conditions reject. Rules are learned over SHARES, which do not grow
    with a text's length."""
    stats = pinned(statistics(docs, key, text), "rules-statistics")
    rules = learn(labelled(stats, labels, key, label), list(SHARES), **options)
    judged = stats.withColumn("base_failed", base_failed()).withColumn("reason", rules.column())
    judged = judged.withColumn("kept", ~F.col("base_failed") & F.col("reason").isNull())
    return judged.select(F.col("key").alias(key), *COUNTS, "base_failed", "kept",
                         F.when(F.col("base_failed"), F.lit("base")).otherwise(F.col("reason")).alias("reason"),
                         F.coalesce(crc_of("key") % 3 == 1, F.lit(False)).alias("held_out"), *SHARES), rules
