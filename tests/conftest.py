from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from alertloom.session import build_session  # noqa: E402
from tests.clock import AS_OF  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "alertloom-tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
           "spark.driver.memory": "4g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def as_of():
    return F.lit(AS_OF).cast("timestamp")


@pytest.fixture(scope="session")
def evaluate(spark):
    """Apply an expression builder to plain values, one per row, in order."""

    def run(build, values, schema="v string"):
        rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, f"i int, {schema}")
        names = [c for c in df.columns if c != "i"]
        out = df.select("i", build(*[F.col(n) for n in names]).alias("out")).orderBy("i").collect()
        return [r.out for r in out]

    return run
