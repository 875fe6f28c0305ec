"""The registered queries against their SQL, on the smallest tables.

``python -m checks.compare`` does the same for all of them at any scale.
"""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_file
from checks.compare import TABLES, rows_of
from checks.inputs import table
from alertloom.operators import dedupe
from checks.oracle import SQL
from checks.queries import QUERIES, _event_scores

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_equals_sql(spark, duck, name):
    df = entry_file.queries()[name](spark, SF)
    cursor = duck.execute(entry_file.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL) <= set(entry_file.queries())


def test_entry(spark):
    rows = entry_file.entry(spark).orderBy("place").collect()
    assert [r.place for r in rows] == list(range(1, len(rows) + 1)) and rows


def test_hot_keys_are_combined_before_the_shuffle(spark):
    """Both passes aggregate in the map tasks, and nothing is windowed by key."""
    best = dedupe.collapse_offers(dedupe.best_per_key(_event_scores(spark, SF)))
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_max_by") == 2 and "Window" not in plan


def test_scan_reads_needed_columns_only(spark):
    plan = entry_file.queries()["norm_url"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "html" not in plan and "html" in table(spark, SF, "pages").columns


def plan_of(df, spark):
    """The plan with every join shuffled."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_ranking_moves_no_text(spark):
    plan = plan_of(entry_file.queries()["rank_documents"](spark, SF), spark)
    widths = [line for line in plan.splitlines() if "max_by" in line or "TakeOrderedAndProject" in line]
    assert widths and not any("summary" in line or "title" in line for line in widths)


def test_bucketed_pages_are_not_moved(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry_file.queries()["page_scan_bucketed"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    scan = next(i for i, line in enumerate(lines) if "Bucketed: true" in line)
    depth = lines[scan].index("FileScan")
    above = [line for line in lines[:scan] if "Exchange" in line and len(line) - len(line.lstrip(" :+-")) < depth]
    assert plan.count("Exchange hashpartitioning") == 1 and all("html" not in line for line in above)


def test_few_detail_pages_are_parsed(spark):
    """With a limit the candidates are joined below the reading of dates."""
    from pyspark.sql import functions as F

    from alertloom.operators.verify import check_dates

    pages = spark.range(50).select(F.concat(F.lit("u"), "id").alias("url"), F.lit(True).alias("ok"), F.lit("<p>2024-01-05</p>").alias("html"))
    some = spark.createDataFrame([("u3",), ("u7",), ("nowhere",)], "detail_url string")
    out = check_dates(some, pages, F.lit("2024-02-01").cast("timestamp"), limit=20)
    lines = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = {word: next(i for i, line in enumerate(lines) if word in line) for word in ("MapInArrow", "LeftSemi")}
    assert at["MapInArrow"] < at["LeftSemi"] and sorted(r.detail_url for r in out.collect()) == ["u3", "u7"]
