"""Run registered queries and their SQL side by side: ``python -m checks.compare [sf_dir] [name ...]``."""

from __future__ import annotations

import hashlib
import sys
import time

import duckdb

from alertloom.session import build_session
from checks.oracle import SQL
from checks.queries import QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple("" if row[i] is None else str(row[i]) for i in order) for row in rows)


def main(sf_dir: str, names: list[str]) -> int:
    spark = build_session("checks", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    bad = 0
    for name in names or QUERIES:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            got = df.collect()
        except Exception as exc:
            print(f"FAIL {name}: {str(exc)[:1500]}", flush=True)
            bad += 1
            continue
        took = time.time() - start
        if name not in SQL:
            print(f"rows {name}: {len(got)} in {took:.1f}s", flush=True)
            continue
        try:
            cursor = con.execute(SQL[name])
            names_sql, want = [c[0] for c in cursor.description], cursor.fetchall()
        except Exception as exc:
            print(f"SQL  {name}: {str(exc)[:800]}", flush=True)
            bad += 1
            continue
        a, b = rows_of(df.columns, got), rows_of(names_sql, want)
        same = sorted(df.columns) == sorted(names_sql) and a == b
        bad += not same
        print(f"{'ok  ' if same else 'DIFF'} {name}: {len(a)} rows, {took:.1f}s, sql {time.time() - start - took:.1f}s",
              hashlib.md5(str(a).encode()).hexdigest()[:8], flush=True)
        if not same:
            print("   columns", sorted(df.columns), sorted(names_sql))
            only_a, only_b = [r for r in a if r not in set(b)][:2], [r for r in b if r not in set(a)][:2]
            for label, part in (("spark", only_a), ("sql", only_b)):
                for row in part:
                    print("  ", label, [v[:160] for v in row])
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    raise SystemExit(main(folder, sys.argv[2:]))
