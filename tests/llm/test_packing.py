from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from alertloom.llm import packing
from alertloom.llm.queries import op1_best_fit_packing, tokenizer_path
from tests.llm.conftest import SF


def expected_pieces(rows, capacity):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    out = []
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start:start + capacity]
            out.append((doc_id, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return sorted(out, key=str)


def check(result, rows, capacity):
    got = result.collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == expected_pieces(rows, capacity)
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(held)


def test_query(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    used = check(op1_best_fit_packing(spark, SF), rows, 2048)
    tokens = sum(p[3] for p in expected_pieces(rows, 2048))
    assert used <= -(-tokens // 2048) + 1


def test_odd_rows(docs_of, odd_texts):
    rows = [*enumerate(odd_texts), (None, "null id"), (3, "a"), (3, "a")]
    check(packing.pack(docs_of(rows), tokenizer_path(), capacity=16), rows, 16)
    assert packing.pack(docs_of([]), tokenizer_path()).count() == 0


def test_ids_do_not_depend_on_what_was_seen_before():
    """Random parts, each encoded by one function whose tables fill up, against the tokenizer."""
    tokenizer, encode, draw = Tokenizer.from_file(tokenizer_path()), packing.word_ids(tokenizer_path()), random.Random(11)
    texts = ["a . ..", "see ) ). end", "x ( (, ", "a ! !. b", "Wait . .. ... !", "ª ª. ª, x. x,. x.."]
    texts += [" ".join("".join(draw.choices("aAbé's9.,!()…ªÀ漢", k=draw.randint(1, 5))) for _ in range(draw.randint(1, 8)))
              for _ in range(4000)]
    for text in texts * 2:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert encode(text) == np.array(ids, "<u4").tobytes(), text


@pytest.mark.parametrize("histogram", [{}, {2048: 3}, {1: 5}, {1500: 4, 600: 4, 548: 4}, {1025: 7, 1024: 2, 1023: 7}, {1000: 9, 24: 40, 3: 1}])
def test_plan_holds_every_piece(histogram):
    plan = packing.sequence_plan(histogram)
    held = Counter()
    for lengths, times in plan:
        assert sum(lengths) <= 2048 and times > 0
        for length in lengths:
            held[length] += times
    assert held == Counter(histogram)
    # no plan can do with fewer than the tokens, or the pieces over half, need
    least = max(-(-sum(s * n for s, n in histogram.items()) // 2048), sum(n for s, n in histogram.items() if s > 1024))
    assert sum(n for _, n in plan) <= least + 1


def test_knapsack_prices_the_best_pattern():
    sizes, weights = np.array([3, 5, 7]), np.array([0.31, 0.55, 0.7])
    copies = packing.best_pattern(sizes, weights, 22)
    best = max(a * 0.31 + b * 0.55 + c * 0.7 for a in range(8) for b in range(5) for c in range(4) if 3 * a + 5 * b + 7 * c <= 22)
    assert sizes @ copies <= 22 and abs(weights @ copies - best) < 1e-9
