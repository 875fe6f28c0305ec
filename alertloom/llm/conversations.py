"""Least repair of conversations by a generalised LR parse of their roles.

The roles of a repaired conversation obey the grammar

    conversation -> (nothing) | pairs | s pairs        pairs -> pairs u a | u a

for the initials of system, user and assistant.  A row may be kept (cost 0), given the role
user or assistant (rerole, 1) or deleted (2, the only way for blank and repeated rows);
an empty user or assistant row may be inserted anywhere (5); a truncated row that is not
deleted costs 5 more.  The audit spells the edits by their initials.

* The parse keeps a graph-structured stack: tops that share what lies below them, and equal
  tops merged by the minimum of (cost, audit).  Audits at one row all hold a letter per row, so
  the order of two does not change with what is put after them; tops carry the rank of
  their audit and its newest letters, and older letters are a shared chain.
* Only digests and faults of rows are parsed, never texts.  They are range-partitioned in
  conversation order, so a conversation that holds a third of all rows is cut into segments;
  a segment that may start inside a conversation is parsed from every top there is, and
  the ways through the segments are joined by minimum at the end.
* Texts move once, to the place where the repaired conversation is written in order.  It is
  streamed there, sorted on disk: a digest of a whole conversation can be made in no other way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import WHITE
from alertloom.session import written

SHIFT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 5, (3, "u"): 6, (4, "u"): 6, (6, "a"): 7}
REDUCE = {5: 2, 7: 3}  # both to pairs, by the length of the rule
GOTO = {0: 3, 1: 4}
ACCEPTING = (0, 3, 4)
EMPTY = (0, None)
# a stack for each top that can stand between two rows
STACKS = [EMPTY, (1, EMPTY), (2, EMPTY), (3, EMPTY), (4, (1, EMPTY)), (6, (3, EMPTY))]
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SALTS = 16
NEWEST = 2048
OUT = 2000
PLACE = ["conv_id", "turn", "role", "key"]


def said(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``copies`` of every row after damage by the checksum of ``conv_id:turn``.

    Of 20 remainders 0 drops the row (no copies), 1 empties its text, 2 takes its ``.!?`` away,
    3 repeats it and 4 makes it the user's.  Nulls count as one space.
    """
    rows = conversations.select(
        conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].cast("long").alias("turn"),
        F.coalesce(conversations["role"], F.lit(" ")).alias("role"), F.coalesce(conversations["text"], F.lit(" ")).alias("text"))
    fate = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    return rows.withColumn("fate", fate).select(
        "conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("fate") == 0, 0).when(F.col("fate") == 3, 2).otherwise(1).alias("copies"))


def with_key(rows: DataFrame) -> DataFrame:
    """Add ``key``, a digest of conversation, role and text: rows of one key say the same."""
    spelled = F.concat(said("conv_id"), F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", "text")
    return rows.withColumn("key", F.unhex(F.sha2(spelled.cast("binary"), 256)))


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, key, copies and the fault (B, D, T or none) of the first copy; further ones repeat it.

    ``rows`` has conv_id, turn, role, text and copies.  Equal rows of a turn are one row here.
    """
    trimmed = F.rtrim(F.col("text"), F.lit(WHITE))
    own = written(with_key(rows).withColumns({
        "blank": trimmed == "", "cut": ~F.right(trimmed, F.lit(1)).isin(".", "!", "?"),
    }).groupBy(*PLACE, "blank", "cut").agg(F.sum("copies").alias("copies")), "turns")
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    repeated = own.filter("copies > 0").groupBy("key").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    repeated = repeated.select("key", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return own.withColumn("salt", F.pmod(F.xxhash64("turn"), F.lit(SALTS)).cast("int")).join(repeated, ["key", "salt"], "left").select(
        *PLACE, "copies",
        F.when(F.col("blank"), "B").when(at > F.col("first"), "D").when(F.col("cut"), "T").otherwise("").alias("fault"))


def counts(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate and truncated of every conversation, also of those without rows."""
    copies, here = F.col("copies"), F.col("copies") > 0
    turn = F.when(here, F.col("turn"))

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).cast("long")

    return turns.groupBy("conv_id").agg(
        F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0)).alias("gaps"),
        total(F.when(F.col("fault") == "B", copies)).alias("blank"),
        total(F.when(F.col("fault") == "D", copies).when((F.col("fault") != "B") & here, copies - 1)).alias("duplicate"),
        total(F.when((F.col("fault") == "T") & here, 1)).alias("truncated"))


def shift(stack: tuple, symbol: str) -> tuple | None:
    """The stack after a symbol and the reductions that follow, None where the grammar has no such symbol."""
    state = SHIFT.get((stack[0], symbol))
    if state is None:
        return None
    stack = (state, stack)
    while stack[0] in REDUCE:
        for _ in range(REDUCE[stack[0]]):
            stack = stack[1]
        stack = (GOTO[stack[0]], stack)
    return stack


class Parse:
    """The tops after some rows: by state (cost, rank of the older letters, newest letters, older letters, stack)."""

    def __init__(self, start: tuple):
        self.tops = {start[0]: (0, 0, "", None, start)}

    @staticmethod
    def put(tops: dict, way: tuple) -> bool:
        """Merge a way into the tops by the minimum of (cost, audit)."""
        held = tops.get(way[4][0])
        if held is None or way[:3] < held[:3]:
            tops[way[4][0]] = way
            return True
        return False

    def inserted(self) -> dict:
        """The tops and all that inserts lead to."""
        tops, new = dict(self.tops), list(self.tops.values())
        while new:
            cost, rank, newest, older, stack = new.pop()
            for symbol in "ua":
                to = shift(stack, symbol)
                if to and self.put(tops, way := (cost + INSERT, rank, newest + "I", older, to)):
                    new.append(way)
        return tops

    def row(self, symbol: str, fault: str) -> None:
        after: dict = {}
        for cost, rank, newest, older, stack in self.tops.values():
            self.put(after, (cost + DELETE, rank, newest + "D", older, stack))
        if fault not in ("B", "D"):
            more = TRUNCATED if fault == "T" else 0
            for cost, rank, newest, older, stack in self.inserted().values():
                for letter, price, to in (("K", 0, symbol), ("R", REROLE, "u"), ("R", REROLE, "a")):
                    to = shift(stack, to)
                    if to:
                        self.put(after, (cost + price + more, rank, newest + letter, older, to))
        self.tops = after
        if len(next(iter(after.values()))[2]) >= NEWEST:
            ranks = {own: n for n, own in enumerate(sorted({w[1:3] for w in after.values()}))}
            self.tops = {state: (w[0], ranks[w[1:3]], "", (w[3], w[2]), w[4]) for state, w in after.items()}

    @staticmethod
    def audit(way: tuple) -> str:
        parts, older = [way[2]], way[3]
        while older:
            older, part = older
            parts.append(part)
        return "".join(reversed(parts))

    def ways(self) -> list[tuple[int, int, str]]:
        """End state, cost and audit of every top."""
        return [(state, way[0], self.audit(way)) for state, way in self.tops.items()]


def parsed_segments(turns: DataFrame) -> DataFrame:
    """A row per conversation and partition: its ways from top to top, its illegal neighbours, its first and last initial."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        names = ["conv_id", "part", "ways", "illegal", "first", "last"]
        way = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
        kinds = [pa.int64(), pa.int64(), way, pa.int64(), pa.string(), pa.string()]
        segments, own, parses, illegal, first, last = [], None, [], 0, "", ""

        def close() -> None:
            segments.append((own[0], part, [dict(start=state, end=end, cost=cost, audit=audit)
                                            for state, p in parses for end, cost, audit in p.ways()], illegal, first, last))

        for batch in batches:
            for conv_id, role, copies, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "copies", "fault"))):
                initial = role[:1]
                if own is None or conv_id != own[0]:
                    # only a partition's first segment can go on with a conversation of the one before
                    starts = STACKS if own is None else [EMPTY]
                    if own is not None:
                        close()
                    own, parses, illegal, first, last = (conv_id,), [(s[0], Parse(s)) for s in starts], 0, initial, None
                for copy in range(copies):
                    if last is not None and last + initial not in ("su", "ua", "au"):
                        illegal += 1
                    last = initial
                    for _, parse in parses:
                        parse.row(initial, fault if copy == 0 or fault == "B" else "D")
            if len(segments) >= OUT:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*segments), kinds)], names)
                segments.clear()
        if own is not None:
            close()
        if segments:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*segments), kinds)], names)

    there = turns.filter("copies > 0").select(*PLACE, F.col("copies").cast("long").alias("copies"), "fault")
    return there.repartitionByRange(*PLACE).sortWithinPartitions(*PLACE).mapInArrow(
        run, "conv_id long, part long, ways array<struct<start:int,end:int,cost:long,audit:string>>, illegal long, first string, last string")


def audits(segments: DataFrame) -> DataFrame:
    """conv_id, illegal, cost and audit; the segments of a conversation are at most as many as partitions."""

    def joined(parts: list[dict]) -> tuple[int, int, str]:
        parts = sorted(parts, key=lambda p: p["part"])
        illegal = sum(p["illegal"] for p in parts)
        illegal += sum(a["last"] + b["first"] not in ("su", "ua", "au") for a, b in zip(parts, parts[1:]))
        tops = {0: (0, "")}
        for part in parts:
            after: dict[int, tuple[int, str]] = {}
            for way in part["ways"]:
                if way["start"] in tops:
                    cost, audit = tops[way["start"]]
                    new = (cost + way["cost"], audit + way["audit"])
                    after[way["end"]] = min(new, after.get(way["end"], new))
            tops = after
        best = None
        for stack in STACKS:
            if stack[0] in tops:
                cost, audit = tops[stack[0]]
                for state, way in Parse(stack).inserted().items():
                    if state in ACCEPTING:
                        new = (cost + way[0], audit + way[2])
                        best = min(new, best or new)
        return (illegal, *best)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(conv_id, *joined(parts)) for conv_id, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["conv_id", "illegal", "cost", "audit"])

    return segments.groupBy("conv_id").agg(F.collect_list(F.struct("part", "ways", "illegal", "first", "last")).alias("parts")).mapInArrow(
        run, "conv_id long, illegal long, cost long, audit string")


def by_conversation(fields: tuple[str, ...], start: Callable) -> Callable:
    """A walk over sorted batches; ``start`` gives a walker of a conversation: a function of a row, and one for its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        own, step, end = None, None, None
        for batch in batches:
            rows = []
            for conv_id, *values in zip(*(batch.column(c).to_pylist() for c in ("conv_id", *fields))):
                if own is None or conv_id != own[0]:
                    if own is not None:
                        rows.extend(end())
                    own, (step, end) = (conv_id,), start(conv_id)
                rows.extend(step(*values))
            if rows:
                yield rows
        if own is not None and (rows := list(end())):
            yield rows

    return run


def repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role and text of the repaired conversations, in order inside partitions.

    ``rows`` as for ``faults``, ``edits`` has conv_id and audit.  Inserted and reroled rows
    take the role that the one before asks for.
    """

    def start(conv_id):
        left, place, before = iter(""), 0, ""

        def put(role, text):
            nonlocal place, before
            role = role if role is not None else "assistant" if before == "u" else "user"
            place, before = place + 1, role[:1]
            return conv_id, place - 1, role, text

        def step(audit, role, text, copies):
            nonlocal left
            if audit is not None:
                left = iter(audit)
                return
            for _ in range(copies):
                while (edit := next(left)) == "I":
                    yield put(None, "")
                if edit != "D":
                    yield put(role if edit == "K" else None, text)

        def end():
            for _ in left:
                yield put(None, "")

        return step, end

    walk = by_conversation(("audit", "role", "text", "copies"), start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in walk(batches):
            for low in range(0, len(out), OUT):
                columns = zip(*out[low:low + OUT])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()))],
                                                 ["conv_id", "place", "role", "text"])

    texts = with_key(rows.filter("copies > 0")).select(
        "conv_id", F.lit(1).alias("kind"), "turn", "role", "key", "text", F.col("copies").cast("long").alias("copies"), F.lit(None).cast("string").alias("audit"))
    heads = edits.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"),
                         F.lit(None).cast("binary").alias("key"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("copies"), "audit")
    return heads.union(texts).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "key").mapInArrow(
        run, "conv_id long, place long, role string, text string")


def digests(conversations: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of ``role:text`` lines of conversations that stand in order inside partitions."""

    def start(conv_id):
        digest, first = hashlib.sha256(), True

        def step(role, text):
            nonlocal first
            digest.update((f"{role}:{text}" if first else f"\n{role}:{text}").encode())
            first = False
            return ()

        return step, lambda: [(conv_id, digest.hexdigest())]

    walk = by_conversation(("role", "text"), start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in walk(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.string()))], ["conv_id", "sha256"])

    return conversations.mapInArrow(run, "conv_id long, sha256 string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The least repair of conversations: a report by conversation, and the repaired rows.

    ``rows`` has conv_id, turn, role, text (not null) and copies (how often the row stands there;
    0 for rows that are lost but whose conversation is to be reported).  A conversation's rows
    stand by turn, nulls first; ties, which the data should not have, by role and then by
    the digest of the text.  Further columns are ignored.

    Report: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.  A null conv_id is
    a conversation of its own; one without rows has zeros and an empty audit; a role without
    letters fits no place of the grammar; an empty table gives empty results.
    """
    turns = written(faults(rows), "faults")
    edits = written(audits(parsed_segments(turns)), "audits")
    own = edits.withColumnRenamed("conv_id", "id")
    report = counts(turns).join(own, F.col("conv_id").eqNullSafe(F.col("id")), "left").select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", F.coalesce("illegal", F.lit(0)).alias("illegal"),
        F.coalesce("cost", F.lit(0)).alias("cost"), F.coalesce("audit", F.lit("")).alias("audit"))
    return report, repaired(rows, edits)


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """The report of ``repair`` after damage, with repaired_sha256, the digest of the repaired conversation."""
    report, rows = repair(damaged(conversations))
    own = digests(rows).withColumnRenamed("conv_id", "id")
    return report.join(own, F.col("conv_id").eqNullSafe(F.col("id")), "left").select(
        *report.columns, F.coalesce("sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))
