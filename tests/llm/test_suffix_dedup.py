from __future__ import annotations

import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from alertloom.llm import suffix_dedup
from alertloom.llm.queries import op2_suffix_dedup
from tests.llm.conftest import SF


def brute(texts, span):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i:i + span] for d in data for i in range(len(d) - span + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - span + 1):
            if count[d[i:i + span]] > 1:
                gone[i:i + span] = True
        kept = bytes(b for b, g in zip(d, gone) if not g)
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(d) else 0
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def rows_of(df):
    return sorted([tuple(r)[:5] for r in df.collect()], key=lambda r: (r[0] is None, r[0] or 0, r))


def test_query_equals_brute_force(spark, documents):
    rows = sorted((r.doc_id, r.text) for r in documents.collect())
    want = [(i, *b) for (i, _), b in zip(rows, brute([t for _, t in rows], 400))]
    assert rows_of(op2_suffix_dedup(spark, SF)) == want
    assert any(r[2] for r in want)


def test_both_ways_of_counting(spark, docs_of):
    rng = random.Random(1)
    base = "".join(rng.choice("abcd ") for _ in range(300))
    texts = []
    for i in range(60):
        at = rng.randrange(200)
        own = "".join(rng.choice("abcd ") for _ in range(rng.randrange(120)))
        texts.append(own + base[at:at + rng.randrange(100)] + own[::-1] + base[:rng.randrange(80)])
    texts += ["ab" * 200, "aaaa" * 90, texts[0], None, "", "é" * 50, "xé" + "é" * 49]
    want = [(i, *b) for i, b in enumerate(brute(texts, 24))]
    for most in (1_000, 1):
        got = suffix_dedup.without_repeats(docs_of(list(enumerate(texts))), span=24, seed=6, most_blocks=most)
        assert rows_of(got) == want


def test_odd_rows(docs_of, odd_texts, spark):
    got = rows_of(suffix_dedup.without_repeats(docs_of([*enumerate(odd_texts), (None, "y" * 500), (3, "a")])))
    assert len(got) == len(odd_texts) + 2
    assert got[-1][:4] == (None, 500, 500, 1)
    assert suffix_dedup.without_repeats(docs_of([])).count() == 0
    repeated = "".join(chr(97 + (i * i) % 26) for i in range(600))
    assert [r[2] for r in rows_of(suffix_dedup.without_repeats(docs_of([(1, repeated), (1, repeated)])))] == [600, 600]


def test_order_is_the_suffix_order():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    starts = np.arange(0, 390, 3)
    ends = np.minimum(starts + rng.integers(1, 40, len(starts)), 400)
    found = suffix_dedup.Suffixes(data, starts, ends)
    order = found.order()
    text = [data[s:e].tobytes() for s, e in zip(starts, ends)]
    assert [text[i] for i in order] == sorted(text)
    for before, here, common in zip(order, order[1:], found.neighbours(order)[1:]):
        a, b = text[before], text[here]
        assert common == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


def test_windows_of_hot_anchors_are_counted_together(spark, docs_of, monkeypatch):
    """Near copies with anchors that have many blocks: the right bytes go, and far fewer rows are made than there are windows."""
    rng = random.Random(4)
    base = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    texts = []
    for k in range(60):
        at = rng.randrange(3000)
        texts.append(f"{base[:at]}<{k}>{base[at + rng.randrange(9):]}")
    made = []

    def counted(df, name):
        out = written(df, name)
        made.extend([out.count()] if name == "windows" else [])
        return out

    written = suffix_dedup.written
    monkeypatch.setattr(suffix_dedup, "written", counted)
    got = suffix_dedup.without_repeats(docs_of(list(enumerate(texts))), most_blocks=1)
    assert rows_of(got) == [(i, *b) for i, b in enumerate(brute(texts, 400))]
    windows = suffix_dedup.anchors(docs_of(list(enumerate(texts))), 400, suffix_dedup.SEED).groupBy("anchor").agg(
        F.count_distinct("digest").alias("kinds"), F.sum(F.expr("last - first + 1")).alias("n")).filter("kinds > 1").agg(
        F.sum("n").alias("n")).first().n
    assert 0 < 4 * sum(made) < windows


def test_a_sort_of_blocks_takes_few_bytes_for_each_of_theirs():
    """Hashes of prefixes are kept in 32 bits, and powers only as far as the longest block."""
    rng = np.random.default_rng(4)
    shared = rng.integers(97, 123, 500, np.uint8).tobytes()
    blocks = [rng.integers(97, 123, 100, np.uint8).tobytes() + shared + rng.integers(97, 123, 100, np.uint8).tobytes() for _ in range(700)]
    at, count = np.full(700, 250), np.full(700, 301)
    tracemalloc.start()
    flags = suffix_dedup.repeated_windows(blocks, at, count, np.arange(700) // 100, 400)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(f[100:201].all() and not f[:95].any() and not f[206:].any() for f in flags)
    assert peak < 40 * sum(map(len, blocks))
