from __future__ import annotations

import hashlib
from collections import defaultdict

import duckdb

from alertloom.llm import exact_dedup
from alertloom.llm.queries import op5_exact_dedup
from tests.llm.conftest import SF


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        bare = "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")
        groups[hashlib.sha256(bare.encode()).hexdigest()].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out = []
    for digest, members in groups.items():
        keep = min(members)[3]
        out += [(m[3], keep, len(members), m[3] == keep, digest) for m in members]
    return sorted(out, key=str)


def test_query_equals_sql(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = duckdb.sql(exact_dedup.SQL).fetchall()
    assert sorted(map(tuple, op5_exact_dedup(spark, SF).collect())) == sorted(want)
    assert any(not r[3] for r in want)


def test_odd_rows_and_hot_groups(docs_of, odd_texts):
    rows = [*enumerate(odd_texts), *[(100 + i, " same" * (i % 3)) for i in range(300)], (None, "same"), (7, "b"), (7, "b")]
    for runs, fan_in in ((4096, 16), (8, 2), (1, 2)):
        got = sorted(map(tuple, exact_dedup.exact_groups(docs_of(rows), runs, fan_in).collect()), key=str)
        assert got == brute(rows)
    assert exact_dedup.exact_groups(docs_of([])).count() == 0
    kept = exact_dedup.keep_first(docs_of([(2, "x y"), (1, "xy"), (None, "z"), (3, None)])).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == [("2", "x y"), ("3", None), ("None", "z")]
