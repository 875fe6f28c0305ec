from __future__ import annotations

import random

import pytest

from alertloom.llm import decontamination
from alertloom.llm.queries import op4_decontamination
from tests.llm.conftest import SF


def semi_global(passage, text):
    """Least edits of a passage at any place of a text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(passage, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row)


def brute(items, text):
    passages = decontamination.Passages(items)
    codes = decontamination.codes_of(decontamination.plain(text or ""))
    return sorted({item for item, part, edits in passages.windows if semi_global(part.tolist(), codes.tolist()) <= edits})


def test_query_finds_every_whole_passage(spark, documents):
    items = {r.item_id: decontamination.plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {r.doc_id: r for r in op4_decontamination(spark, SF).collect()}
    found = 0
    for r in documents.collect():
        whole = {i for i, p in items.items() if len(p) >= decontamination.LEAST_CHARS and p in decontamination.plain(r.text or "")}
        found += len(whole)
        assert whole <= set(got[r.doc_id].item_ids)
        assert got[r.doc_id].contaminated == bool(got[r.doc_id].item_ids)
    assert found and sum(r.contaminated for r in got.values()) < len(got) / 4


@pytest.mark.parametrize("seed", range(4))
def test_edited_passages_equal_brute_force(seed):
    rng = random.Random(seed)
    items = [(k, "".join(rng.choice("abcde ") for _ in range(rng.randrange(30, 220)))) for k in range(5)]
    passages = decontamination.Passages(items)
    for _ in range(6):
        text = "".join(rng.choice("abcde ") for _ in range(60))
        for _, passage in rng.sample(items, 2):
            part = list(passage[rng.randrange(40) * (rng.random() < 0.3):])
            for _ in range(rng.randrange(14)):
                place = rng.randrange(len(part))
                part[place:place + rng.randrange(2)] = rng.choice(["", "x", "yz"])
            text += "".join(part) + "".join(rng.choice("abcde ") for _ in range(30))
        assert sorted({hit[0] for hit in passages.hits(text)}) == brute(items, text)


def test_odd_rows(spark, docs_of, odd_texts):
    passage = "The quick brown fox jumps over the lazy dog and runs away from it all"
    benchmark = spark.createDataFrame([(1, passage, "x"), (2, None, "x"), (3, "", "x"), (4, "short", "x"), (None, passage[::-1], "x"), (1, passage, "x")],
                                      "item_id long, text string, doc_id string")
    rows = [*enumerate(odd_texts), (50, f"a {passage.upper()}\n"), (51, passage.replace(" ", "\n")), (52, passage[::-1]), (None, passage), (50, passage)]
    got = decontamination.find_passages(docs_of(rows), benchmark).collect()
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), r.item_ids) for r in got if r.contaminated) == [
        ("50", [1]), ("50", [1]), ("51", [1]), ("52", [None]), ("None", [1])]
    kept = decontamination.without_passages(docs_of(rows), benchmark)
    assert kept.count() == len(odd_texts) and kept.columns == docs_of(rows).columns
    assert decontamination.find_passages(docs_of([]), benchmark).count() == 0
    assert not any(r.contaminated for r in decontamination.find_passages(docs_of(rows), benchmark.limit(0)).collect())


@pytest.mark.parametrize("seed", range(3))
def test_short_passages_equal_brute_force(seed):
    """Passages of 20 to 50 characters keep their 5 % of edits."""
    rng = random.Random(seed)
    items = [(k, "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(18, 50)))) for k in range(12)]
    passages = decontamination.Passages(items)
    assert all(edits == int(decontamination.ERROR * len(part)) for _, part, edits in passages.windows)
    assert {item for item, _, _ in passages.windows} == {k for k, t in items if len(decontamination.plain(t)) >= 20}
    found = 0
    for _ in range(12):
        text = "".join(rng.choice("abcdefgh ") for _ in range(40))
        for _, passage in rng.sample(items, 3):
            part = list(passage)
            for _ in range(rng.randrange(4)):
                place = rng.randrange(len(part))
                part[place:place + rng.randrange(2)] = rng.choice(["", "x", "yz"])
            text += "".join(part) + "".join(rng.choice("abcdefgh ") for _ in range(20))
        got = sorted({hit[0] for hit in passages.hits(text)})
        assert got == brute(items, text)
        found += len(got)
    assert found


def test_parts_one_after_another(spark, docs_of, monkeypatch):
    rng = random.Random(3)
    items = [(k, " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(12))) for k in range(9)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = [(k, f"before {items[k][1]} and {items[(k + 4) % 9][1]} after") for k in range(0, 9, 2)] + [(20, "clean"), (21, None)]
    whole = decontamination.find_passages(docs_of(rows), benchmark).orderBy("doc_id").collect()
    monkeypatch.setattr(decontamination, "PART_CHARS", 200)
    parts = decontamination.PassageParts(benchmark)
    assert parts.number > 2 and sum(len({w[0] for w in p.windows}) for p in parts) == 9
    got = decontamination.find_passages(docs_of(rows), benchmark).orderBy("doc_id").collect()
    assert [(r.doc_id, r.item_ids, sorted(r.places)) for r in got] == [(r.doc_id, r.item_ids, sorted(r.places)) for r in whole]
    assert [r.item_ids for r in got[:2]] == [[0, 4], [2, 6]]
    kept = decontamination.without_passages(docs_of(rows), benchmark)
    assert sorted(r.doc_id for r in kept.collect()) == [20, 21]
