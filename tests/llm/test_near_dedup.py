from __future__ import annotations

import random
import re

from alertloom.llm import near_dedup
from alertloom.llm.queries import op9_near_dedup
from tests.llm.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def brute(rows, words, percent):
    sets = []
    for _, text in rows:
        found = WORD.findall(lower(text))
        sets.append({tuple(found[i:i + words]) for i in range(max(1, len(found) - words + 1))} if found else set())
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j]:
                both = len(a & sets[j])
                if 100 * both >= percent * (len(a) + len(sets[j]) - both):
                    x, y = find(i), find(j)
                    top[max(x, y)] = min(x, y)
    first = {}
    for i, (doc_id, _) in enumerate(rows):
        first[find(i)] = min(first.get(find(i), doc_id), doc_id)
    return [(doc_id, len(sets[i]), first[find(i)], doc_id == first[find(i)]) for i, (doc_id, _) in enumerate(rows)]


def got(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


def test_query_equals_brute_force(spark, documents):
    rows = sorted((r.doc_id, r.text) for r in documents.collect())
    want = brute(rows, 3, 85)
    assert got(op9_near_dedup(spark, SF)) == want
    assert any(not r[3] for r in want)


def test_large_loose_group(spark, docs_of):
    """Copies with many edits of one text: links form chains, and leaders do not reach everyone."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(rng.randrange(6)):
            words[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(100, "one two"), (101, "ONE\ttwo"), (102, "one"), (103, ""), (104, None), (105, " \n"), (106, "one two three four")]
    assert got(near_dedup.near_groups(docs_of(rows), 3, 85)) == brute(rows, 3, 85)


def test_odd_rows(docs_of, odd_texts):
    rows = list(enumerate(odd_texts))
    assert got(near_dedup.near_groups(docs_of(rows), 3, 85)) == brute(rows, 3, 85)
    assert near_dedup.near_groups(docs_of([])).count() == 0
    none = near_dedup.near_groups(docs_of([(None, "a b c d"), (4, "a b c d"), (4, "a b c d")]), 3).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in none) == [
        ("4", "4", True), ("4", "4", True), ("None", "None", True)]
    one = near_dedup.one_of_each(docs_of([(9, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, None)]))
    assert sorted(str(r.doc_id) for r in one.collect()) == ["2", "3", "None"] and "length" in one.columns


def test_missed_is_small():
    assert near_dedup.missed(85) < 2e-6


def test_loose_copies_are_not_looked_at_in_pairs(docs_of, monkeypatch):
    """A group of copies that are all too far apart: shingles that few have rule their pairs out, and lose no link."""
    rng = random.Random(8)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(120):
        words = list(base)
        for at in rng.sample(range(len(words)), 6):
            words[at] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
        if i % 20 == 0:  # shares its own rare words with the one before
            words[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
            rows.append((1000 + i, " ".join(words)))
    rows.sort()
    looked, plain = [], near_dedup.linked

    def counted(posts, look, **more):
        def count(pairs):
            looked.append(pairs.count())
            return look(pairs)
        return plain(posts, count, **more)

    monkeypatch.setattr(near_dedup, "linked", counted)
    assert got(near_dedup.near_groups(docs_of(rows), 3, 85)) == brute(rows, 3, 85)
    assert len(looked) == 4 and looked[-1] < 200


def test_rare_shingles_of_one_component_make_no_key(spark):
    """Copies that are linked already share many shingles, under none of which a pair is left to be looked at."""
    texts = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d f"), (3, "x y c d e"), (4, "p q r s")], "rep long, text string")
    still = spark.createDataFrame([(1, 7, 1, [1], 0), (2, 7, 1, [2], 0), (3, 7, 3, [3], 0), (4, 7, 4, [4], 0)],
                                  "node long, key long, component long, mark array<int>, place int")
    sharp = near_dedup.with_rare_shingles(still, texts, 3).collect()
    met = {}
    for r in sharp:
        if r.place == -1:
            met.setdefault(r.key, set()).add(r.node)
    assert list(met.values()) == [{1, 3}]  # c d e; not a b c and b c d, which only 1 and 2 have
    assert {(r.node, r.mark["size"], r.mark["shared"], r.mark["common"]) for r in sharp} == {(1, 3, 3, 0), (2, 3, 2, 0), (3, 3, 1, 0), (4, 2, 0, 0)}
