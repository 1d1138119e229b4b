"""Conversation structure repair: the cheapest edits that make roles alternate, by an integer-minimum DP.

Rows are damaged first by a rule of their key (`damaged`), then each
conversation is looked at in order of turn. A repair keeps (K), reroles (R) or
deletes (D) each row and may insert (I) empty ones anywhere, so that the role
initials read `(s?(ua)+)?`. The states of that pattern and the rows make a DAG.

A path's weight is one big integer: its high digits carry the cost, below them
each edit has a digit of BITS bits, the first edit the highest, and zeros fill
the end. Less is therefore cheaper, then ASCII-least, an audit before one that
goes on. A letter's digit depends on how many letters come before it, so the DP
runs from the end: an edit before a suffix moves the suffix's digits down by one
place and takes the highest, which keeps the order of suffixes, so that the
ordinary minimum of integers at each node decides everything.

Conversations of up to LONG rows meet in a task by conv_id, in order. Longer
ones, which may be a third of all rows, are dealt by ranges of their order in
blocks of BLOCK rows. A block's weights between all pairs of states are found by
the same DP in parallel; then one row for each block, in order, is folded. Of two
audits of a block with the same ends and cost none begins with the other (it
would have more inserts and cost more), so the fold loses no tie. Rows alike in
all columns are counted before they are dealt; whether a text has been seen is
an aggregation by text. Only what the result holds as one value goes through one
task in order: a conversation's audit, and its SHA-256, which reads its texts
once as a stream.

Defined results: null role or text is one space; null conv_id is a conversation
of its own and null turn comes first; in the damage rule both are one space. Rows
of one turn go by role, then text. A conversation without rows after the damage
has zeros, an empty audit and the hash of the empty string. Extra columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import shuffle_partitions, staged
from assayer.llm.files import as_rows

LONG = 2_000
BLOCK = 1_000
SALTS = 16
BITS = 3
BLANK = " \t\n\x0b\x0c\r"
LETTERS = {"D": 1, "I": 2, "K": 3, "R": 4}  # in ASCII order; 0 is the end
_NAMED = {ord(str(n)): letter for letter, n in LETTERS.items()}
REPAIRED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_KINDS = [pa.int64()] * 7 + [pa.string(), pa.string()]
_NAMES = [x.split()[0] for x in REPAIRED.split(", ")]

# states: 0 nothing yet, 1 after s, 2 after u, 3 after a
KEEP = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
NEXT = (2, 2, 3, 2)  # the state after another user or assistant
ENDS = (0, 3)
LEGAL = ("su", "ua", "au")
NONE, BLANKED, DUPLICATE, TRUNCATED = 0, 1, 2, 3


def fault(text: str, seen: bool) -> int:
    """A row's first fault."""
    left = text.rstrip(BLANK)
    return BLANKED if not left else DUPLICATE if seen else NONE if left[-1] in ".!?" else TRUNCATED


class Weights:
    """Weights of suffixes of up to `rows` rows; None is no path."""

    def __init__(self, rows: int):
        self.low = BITS * (3 * rows + 2)  # two inserts before each row and at the end are all that a cheapest path can use
        self.mask = (1 << self.low) - 1

    def before(self, letter: str, cost: int, rest: int | None) -> int | None:
        if rest is None:
            return None
        return ((rest >> self.low) + cost << self.low) | LETTERS[letter] << self.low - BITS | (rest & self.mask) >> BITS

    def inserted(self, own: list[int | None]) -> list[int | None]:
        """With up to two rows inserted first."""
        out = own
        for _ in range(2):
            out = [least(x, self.before("I", 2, out[NEXT[s]])) for s, x in enumerate(own)]
        return out

    def row(self, initial: str, kind: int, after: list[int | None]) -> list[int | None]:
        """Weights from each state before a row, of those after it."""
        out = []
        for s in range(4):
            best = self.before("D", 3, after[s])
            if kind in (NONE, TRUNCATED):
                more = kind == TRUNCATED
                if (initial, s) in KEEP:
                    best = least(best, self.before("K", more, after[KEEP[initial, s]]))
                best = least(best, self.before("R", 2 + more, after[NEXT[s]]))
            out.append(best)
        return self.inserted(out)

    def read(self, weight: int) -> tuple[int, str]:
        """(cost, audit)."""
        digits = f"{weight & self.mask:0{self.low // BITS}o}"  # a digit of BITS bits is an octal one
        return weight >> self.low, digits.rstrip("0").translate(_NAMED)


def least(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


@lru_cache(1 << 16)
def cheapest(rows: tuple[tuple[str, int], ...]) -> tuple[int, str]:
    """(cost, audit) of a conversation of (initial, fault)."""
    w = Weights(len(rows))
    now = w.inserted([0 if s in ENDS else None for s in range(4)])
    for initial, kind in reversed(rows):
        now = w.row(initial, kind, now)
    return w.read(now[0])


def between(rows: list[tuple[str, int]]) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, audit) of a block, for each pair of states with a path."""
    w = Weights(len(rows))
    out = []
    for t in range(4):
        now: list[int | None] = [0 if s == t else None for s in range(4)]
        for initial, kind in reversed(rows):
            now = w.row(initial, kind, now)
        out += [(s, t, *w.read(x)) for s, x in enumerate(now) if x is not None]
    return out


def folded(now: dict[int, tuple[int, str]], block: list[tuple[int, int, int, str]]) -> dict[int, tuple[int, str]]:
    """Cheapest (cost, audit) from the start to each state, a block further."""
    ways: dict[int, tuple[int, str]] = {}
    for s, t, cost, audit in block:
        if s in now:
            way = (now[s][0] + cost, now[s][1] + audit)
            if t not in ways or way < ways[t]:
                ways[t] = way
    return ways


def end_of(now: dict[int, tuple[int, str]]) -> tuple[int, str]:
    """The cheapest whole repair, with what is inserted at the end."""
    w = Weights(0)
    last = w.inserted([0 if s in ENDS else None for s in range(4)])
    return min((now[s][0] + w.read(last[s])[0], now[s][1] + w.read(last[s])[1]) for s in now)


class Repaired:
    """SHA-256 of the repaired text, fed by rows in order, each with the letters up to its own."""

    def __init__(self):
        self.hash, self.state, self.any = hashlib.sha256(), 0, False

    def put(self, role: str, text: str) -> None:
        self.hash.update(f"{'\n' if self.any else ''}{role}:{text}".encode())
        self.any = True

    def insert(self) -> None:
        self.put("user" if self.state != 2 else "assistant", "")
        self.state = NEXT[self.state]

    def row(self, letter: str, role: str, text: str) -> None:
        if letter == "K":
            self.put(role, text)
            self.state = KEEP[role[:1], self.state]
        elif letter == "R":
            self.put("user" if self.state != 2 else "assistant", text)
            self.state = NEXT[self.state]


def repaired_sha256(audit: str, rows: Iterator[tuple[str, str]]) -> str:
    out, rows = Repaired(), iter(rows)
    for letter in audit:
        if letter == "I":
            out.insert()
        else:
            out.row(letter, *next(rows))
    return out.hash.hexdigest()


def whole(conv: int | None, rows: list[tuple[int | None, str, str]]) -> tuple:
    """The result of one conversation of (turn, role, text) in order."""
    seen: set[tuple[str, str]] = set()
    kinds = []
    for _, role, text in rows:
        kinds.append(fault(text, (role, text) in seen))
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    initials = [role[:1] for _, role, _ in rows]
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
    cost, audit = cheapest(tuple(zip(initials, kinds, strict=True)))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    counts = [kinds.count(x) for x in (BLANKED, DUPLICATE, TRUNCATED)]
    return (conv, gaps, *counts, illegal, cost, audit, repaired_sha256(audit, ((r, t) for _, r, t in rows)))


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, _times): each row with how often it is there after the damage, 0 where it is dropped."""
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    part = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    rule = F.crc32(F.concat(part(conv), F.lit(":"), part(turn)).cast("binary")) % 20
    text = F.when(rule == 1, "").when(rule == 2, F.translate(part(F.col("text")), ".!?", "")).otherwise(part(F.col("text")))
    role = F.when(rule == 4, "user").otherwise(part(F.col("role")))
    times = F.when(rule == 0, 0).when(rule == 3, 2).otherwise(1)
    empty = rule == 0  # a dropped row only stands for its conversation
    return rows.select(conv.alias("conv_id"), F.when(~empty, turn).alias("turn"), F.when(~empty, role).otherwise("").alias("role"), F.when(~empty, text).otherwise("").alias("text"), times.cast("int").alias("_times"))



def _short(rows: DataFrame) -> DataFrame:
    """Results of conversations that a task holds one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, started, rows_, out = None, False, [], []
        for batch in batches:
            for conv, turn, role, text, times in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "_times")), strict=True):
                if started and conv != own:
                    out.append(whole(own, rows_))
                    rows_ = []
                own, started = conv, True
                rows_ += [(turn, role, text)] * times
            if len(out) > 1_000:
                yield as_rows(_NAMES, _KINDS, out)
                out = []
        if started:
            out.append(whole(own, rows_))
        yield as_rows(_NAMES, _KINDS, out)

    by = rows.repartition(shuffle_partitions(rows.sparkSession), "conv_id")
    return by.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text").mapInArrow(run, REPAIRED)


def _salted(rows: DataFrame, few: DataFrame, key: str, how: str) -> DataFrame:
    """rows, read from files, joined by key with a table of one row for each key; rows of a hot key are spread over SALTS tasks."""
    dealt = rows.withColumns({"_salt": F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)), "_key": F.coalesce(F.col(key).cast("string"), F.lit(" "))})
    copies = few.withColumns({"_salt": F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))), "_key": F.coalesce(F.col(key).cast("string"), F.lit(" "))}).drop(key)
    return dealt.join(copies.hint("merge"), ["_key", "_salt"], how).drop("_key", "_salt")


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """(conv_id, part, number, first, last, illegal, ways) of blocks of ordered rows (conv_id, turn, role, text, times, first)."""
    schema = "conv_id long, part int, number int, first string, last string, blank long, duplicate long, truncated long, illegal long, ways array<struct<s: int, t: int, cost: long, audit: string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, own, held = TaskContext.get().partitionId(), 0, None, []
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 4, pa.list_(pa.struct([("s", pa.int32()), ("t", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))]
        names = ["conv_id", "part", "number", "first", "last", "blank", "duplicate", "truncated", "illegal", "ways"]

        def close() -> pa.RecordBatch:
            nonlocal number
            number += 1
            initials, faults = [x for x, _ in held], [x for _, x in held]
            illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
            ways = [dict(zip(("s", "t", "cost", "audit"), x, strict=True)) for x in between(held)]
            row = (own, part, number, initials[0], initials[-1], *(faults.count(x) for x in (BLANKED, DUPLICATE, TRUNCATED)), illegal, ways)
            held.clear()
            return as_rows(names, kinds, [row])

        for batch in batches:
            for conv, role, text, times, first in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "times", "first")), strict=True):
                for i in range(times):
                    if held and (conv != own or len(held) >= block):
                        yield close()
                    own = conv
                    held.append((role[:1], fault(text, not first or i > 0)))
        if held:
            yield close()

    return rows.mapInArrow(run, schema)


def _long(rows: DataFrame, block: int) -> DataFrame:
    """Results of long conversations, of which no task holds all rows."""
    spark = rows.sparkSession
    n = shuffle_partitions(spark)
    text_key = F.sha1(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    # rows alike are one row with a number; counted before they are shuffled
    each = staged(rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("_times").alias("times")), "long-rows").withColumn("_text", F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), text_key))
    present = each.where("times > 0")
    first = present.groupBy("_text").agg(F.min(F.struct(F.col("turn").isNotNull().alias("dated"), "turn")).alias("_first"))
    marked = _salted(present, first, "_text", "inner").withColumn("first", F.col("_first.turn").eqNullSafe(F.col("turn")))
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text"]
    dealt = marked.select("conv_id", "turn", "role", "text", "times", "first").repartitionByRange(n, *order).sortWithinPartitions(*order)
    blocks = staged(_blocks(dealt, block), "long-blocks")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, now, last, sums, started = None, {}, None, [0] * 4, False
        names, kinds = ["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit"], [*[pa.int64()] * 6, pa.string()]
        for batch in batches:
            for row in batch.to_pylist():
                if not started or row["conv_id"] != own:
                    if started:
                        yield as_rows(names, kinds, [(own, *sums, *end_of(now))])
                    own, now, last, sums, started = row["conv_id"], {0: (0, "")}, None, [0] * 4, True
                counted = [row["blank"], row["duplicate"], row["truncated"], row["illegal"] + (last is not None and last + row["first"] not in LEGAL)]
                sums = [a + b for a, b in zip(sums, counted, strict=True)]
                last = row["last"]
                now = folded(now, [(x["s"], x["t"], x["cost"], x["audit"]) for x in row["ways"]])
        if started:
            yield as_rows(names, kinds, [(own, *sums, *end_of(now))])

    audits = blocks.repartition(n, "conv_id").sortWithinPartitions("conv_id", "part", "number")
    audits = staged(audits.mapInArrow(fold, "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"), "long-audits")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, started, out, letters = None, False, Repaired(), iter("")

        def close() -> pa.RecordBatch:
            for _ in letters:  # what is left is inserted at the end
                out.insert()
            return as_rows(["conv_id", "repaired_sha256"], [pa.int64(), pa.string()], [(own, out.hash.hexdigest())])

        for batch in batches:
            for conv, role, text, times, audit in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "times", "audit")), strict=True):
                if audit is not None:  # comes before its rows
                    if started:
                        yield close()
                    own, started, out, letters = conv, True, Repaired(), iter(audit)
                    continue
                for _ in range(times):
                    while (letter := next(letters)) == "I":
                        out.insert()
                    out.row(letter, role, text)
        if started:
            yield close()

    head = audits.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).cast("long").alias("times"), "audit")
    body = present.select("conv_id", "turn", "role", "text", "times", F.lit(None).cast("string").alias("audit"))
    stream = head.unionByName(body).repartition(n, "conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), F.asc_nulls_first("turn"), "role", "text")
    digests = stream.mapInArrow(digest, "conv_id long, repaired_sha256 string")
    turns = present.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    named = lambda df: df.withColumnRenamed("conv_id", "_id")
    out = each.select("conv_id").distinct()
    for other in (turns, audits, digests):
        out = out.join(named(other), F.col("conv_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return out.withColumns(zero).withColumns({"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest()))}).select(*_NAMES)


def repair(conversations: DataFrame, long: int = LONG, block: int = BLOCK) -> DataFrame:
    """One row for each conv_id of conversations (conv_id, turn, role, text): its faults, the cheapest repair's cost and audit, and the repaired text's SHA-256."""
    rows = damaged(conversations)
    counts = rows.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > long)
    if counts.isEmpty():
        return _short(rows)
    large = staged(counts.select("conv_id", F.lit(True).alias("_long")), "long")
    told = _salted(rows, large, "conv_id", "left")
    return _short(told.where("_long is null").drop("_long")).unionByName(_long(told.where("_long").drop("_long"), block))


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
