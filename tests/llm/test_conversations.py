from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from itertools import groupby

import pytest

from alertloom.llm import conversations
from alertloom.llm.queries import op13_conversation_repair
from tests.llm.conftest import SF

WHITE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, key string, copies string, part int"


def least(rows):
    """Cheapest (cost, audit) by trying edits in that order; rows are (initial, fault)."""
    seen, heap = set(), [(0, "", 0, "")]
    while heap:
        cost, audit, i, roles = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit
        if (i, roles[-2:], len(roles) > 2) in seen or not re.fullmatch("s?(ua)*u?", roles):
            continue
        seen.add((i, roles[-2:], len(roles) > 2))
        for role in "ua":
            heapq.heappush(heap, (cost + 5, audit + "I", i, roles + role))
        if i < len(rows):
            initial, fault = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, roles))
            if fault not in ("B", "D"):
                more = 5 * (fault == "T")
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, roles + (initial or "?")))
                for role in "ua":
                    heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, roles + role))


def expected(rows):
    out = []
    ids = sorted({r[0] for r in rows}, key=str)
    for conv_id in ids:
        held = []
        for _, turn, role, text in sorted((r for r in rows if r[0] == conv_id), key=lambda r: (r[1] is not None, r[1] or 0)):
            role, text = " " if role is None else role, " " if text is None else text
            key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
            fate = zlib.crc32(key.encode()) % 20
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            role = "user" if fate == 4 else role
            held += [(turn, role, text)] * {0: 0, 3: 2}.get(fate, 1)
        turns = [t for t, _, _ in held if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, faults = set(), []
        for _, role, text in held:
            last = text.rstrip(WHITE)[-1:]
            faults.append("B" if not last else "D" if (role, text) in seen else "T" if last not in ".!?" else "")
            seen.add((role, text))
        initials = [role[:1] for _, role, _ in held]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = least(list(zip(initials, faults)))
        lines, at, before = [], 0, ""
        for edit in audit:
            _, role, text = held[at] if edit != "I" else (None, None, "")
            at += edit != "I"
            if edit != "D":
                if edit != "K":
                    role = "assistant" if before == "u" else "user"
                lines.append(f"{role}:{text}")
                before = role[:1]
        out.append((conv_id, gaps, faults.count("B"), faults.count("D"), faults.count("T"), illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def got(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    result = op13_conversation_repair(spark, SF)
    assert result.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert got(result) == sorted(expected(rows), key=str)


def random_rows(seed, convs, length):
    draw, rows = random.Random(seed), []
    for conv_id in [*range(convs), None]:
        turns = draw.sample(range(2 * length), draw.randint(1, length))
        for turn in [*turns, *[None] * (draw.random() < 0.3)]:
            role = draw.choice(["user", "assistant", "system", "user", "assistant", "tool", None, "", "u", "User"])
            rows.append((conv_id, turn, role, draw.choice(["Yes.", "No", "", None, " \n", "Oh!  \n", "a.\x85", "Well?", f"t{turn}.", f"é{turn}"])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations(spark, seed):
    rows = random_rows(seed, 40, 12)
    frame = spark.createDataFrame([(*r, "k", "c", 1) for r in rows], SCHEMA)
    assert got(conversations.repair_damaged(frame)) == sorted(expected(rows), key=str)


def test_one_long_conversation_in_segments(spark, monkeypatch):
    """A conversation over many partitions; letters pass into the chain."""
    monkeypatch.setattr(conversations, "NEWEST", 7)
    rows = [(5, *r[1:]) for r in random_rows(3, 1, 900)[:600] if r[1] is not None and r[0] == 0] + random_rows(4, 3, 6)
    frame = spark.createDataFrame([(*r, "k", "c", 1) for r in rows], SCHEMA).repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = conversations.faults(conversations.damaged(frame))
        assert conversations.parsed_segments(turns).filter("conv_id = 5").count() > 2
        assert got(conversations.repair_damaged(frame)) == sorted(expected(rows), key=str)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_repeats_ties_and_long_texts(spark):
    """Equal rows of one turn are one more copy each; a tied turn has a fixed order; empty tables give nothing."""
    rows = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 1, "assistant", "word " * 20000 + "."), (2, None, "user", "x."), (2, None, "user", "x.")]
    frame = spark.createDataFrame([(*r, "k", "c", 1) for r in rows], SCHEMA)
    assert got(conversations.repair_damaged(frame)) == sorted(expected(rows), key=str)
    tied = [(7, 3, role, text) for role in ("user", "assistant") for text in ("a.", "b.", "c.")]
    results = {tuple(got(conversations.repair_damaged(spark.createDataFrame([(*r, "k", "c", 1) for r in order], SCHEMA).repartition(n))))
               for order, n in ((tied, 1), (tied[::-1], 3))}
    assert len(results) == 1
    assert got(conversations.repair_damaged(spark.createDataFrame([], SCHEMA))) == []


def test_repaired_rows_obey_the_grammar(spark):
    frame = spark.createDataFrame([(*r, "k", "c", 1) for r in random_rows(8, 30, 9)], SCHEMA)
    report, rows = conversations.repair(conversations.damaged(frame))
    held = sorted(map(tuple, rows.collect()), key=lambda r: (str(r[0]), r[1]))
    for conv_id, own in groupby(held, key=lambda r: r[0]):
        own = list(own)
        assert [r[1] for r in own] == list(range(len(own)))
        assert re.fullmatch("s?(ua)+", "".join(r[2][:1] for r in own))
    kept = {r.conv_id: len(r.audit) - r.audit.count("D") for r in report.collect()}
    assert sum(kept.values()) == len(held)
