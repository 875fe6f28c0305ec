from __future__ import annotations

import datetime as dt
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from alertloom.operators import dedupe
from alertloom.sources import seen as S
from alertloom.sources.seen_log import SeenLog
from tests.clock import AS_OF


def stamp(days):
    return (AS_OF - dt.timedelta(days=days)).isoformat() + "+00:00"


@pytest.fixture
def rows_of(spark):
    return lambda **times: spark.createDataFrame(list(times.items()), S.SEEN_SCHEMA)


def as_dict(df):
    rows = [tuple(r) for r in df.collect()]
    assert len({k for k, _ in rows}) == len(rows)
    return dict(rows)


def runs_of(log):
    return sorted(p.rsplit("/", 1)[-1] for p in S._files(log.spark, f"{log.path}/runs/*"))


def test_a_write_adds_its_rows_only(spark, tmp_path, rows_of):
    log = SeenLog(spark, str(tmp_path / "log"))
    assert as_dict(log.read()) == {} and log.current().drop_from(rows_of(a="1")).count() == 1
    log.append(rows_of(a=stamp(5), b=stamp(4)))
    before, old = runs_of(log), log.current()
    log.append(rows_of(b=stamp(1), c=stamp(2), d="not-a-date"))
    log.append(rows_of(d=stamp(0)).limit(0))
    new = [r for r in runs_of(log) if r not in before]
    assert spark.read.parquet(str(tmp_path / "log" / "runs" / new[0])).count() in (0, 3)
    assert as_dict(log.read()) == {"a": stamp(5), "b": stamp(1), "c": stamp(2), "d": "not-a-date"}
    assert as_dict(old.read()) == {"a": stamp(5), "b": stamp(4)}
    # the latest time counts, in whatever order it comes
    log.append(rows_of(c=stamp(30)))
    assert as_dict(log.read())["c"] == stamp(2)


def test_forgetting_drops_whole_runs(spark, tmp_path, rows_of, as_of):
    log = SeenLog(spark, str(tmp_path / "log"))
    log.append(rows_of(a=stamp(200), b=stamp(100)))
    log.append(rows_of(c=stamp(95), e=stamp(90), f=stamp(1)))
    log.append(rows_of(d="weird", g=stamp(300)))
    log.prune(as_of, 90)
    assert as_dict(log.read()) == {"e": stamp(90), "f": stamp(1), "d": "weird"}
    assert sorted(r["rows"] for r in log.current().runs) == [2, 3]
    log.append(rows_of(a=stamp(0)))
    assert set(as_dict(log.read())) == {"a", "d", "e", "f"}


def test_merging_by_size(spark, tmp_path, rows_of):
    log = SeenLog(spark, str(tmp_path / "log"), fan=3, bucket_rows=10**9)
    want = {}
    for n in range(8):
        new = {f"k{n}": stamp(n + 1), "again": stamp(20 - n)}
        log.append(rows_of(**new))
        want |= new
        log.compact()
        assert len(log.current().runs) < 3 and as_dict(log.read()) == want
    assert len(log._entries()) < 4
    small = log.current().runs[0] | {"rows": 5_000_000}
    assert log._tier(small) > log._tier(log.current().runs[0])


def test_two_writers_at_once(spark, tmp_path, rows_of):
    """Nothing is lost, also when both merge what they see."""
    frames = [rows_of(**{f"k{n}": stamp(1), "shared": stamp(n)}) for n in range(6)]

    def work(n):
        log = SeenLog(spark, str(tmp_path / "log"), fan=2, bucket_rows=10**9)
        log.append(frames[n])
        log.compact()

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(work, range(6)))
    assert as_dict(SeenLog(spark, str(tmp_path / "log")).read()) == {**{f"k{n}": stamp(1) for n in range(6)}, "shared": stamp(0)}


def test_a_merge_that_saw_less_loses_nothing(spark, tmp_path, rows_of):
    """A run that comes between reading the log and committing the merge stays."""
    log = SeenLog(spark, str(tmp_path / "log"), fan=2)
    log.append(rows_of(a=stamp(1)))
    log.append(rows_of(b=stamp(1)))
    write = log._write

    def slow(rows, tag="", buckets=0):
        run = write(rows, tag, buckets)
        SeenLog(spark, log.path, fan=2).append(rows_of(c=stamp(1)))
        return run

    log._write = slow
    assert log.compact()
    assert set(as_dict(SeenLog(spark, log.path).read())) == {"a", "b", "c"}


def test_tags(spark, tmp_path, rows_of):
    """Work done again looks past its own run and replaces it; the last run of a stream is not merged."""
    log = SeenLog(spark, str(tmp_path / "log"), fan=2)
    log.append(rows_of(a=stamp(1)), tag="s-0")
    log.append(rows_of(b=stamp(1), x=stamp(1)), tag="s-1")
    assert not log.compact() or set(as_dict(log.read(not_by="s-1"))) == {"a"}
    assert set(as_dict(log.read(not_by="s-1"))) == {"a"}
    log.append(rows_of(b=stamp(1)), tag="s-1")
    assert set(as_dict(log.read())) == {"a", "b"}
    log.append(rows_of(c=stamp(1)), tag="s-2")
    assert log.compact() and set(as_dict(log.read(not_by="s-2"))) == {"a", "b"}


def test_bucketed_runs_are_not_moved(spark, tmp_path, rows_of):
    """Rows are compared with a bucketed run without an exchange of the run, from another session too."""
    log = SeenLog(spark, str(tmp_path / "it's"), buckets=4, bucket_rows=1, fan=2)
    log.append(rows_of(**{f"k{n}": stamp(1) for n in range(50)}))
    log.append(rows_of(**{f"k{n}": stamp(1) for n in range(50, 90)}))
    assert log.compact() and [r["buckets"] for r in log.current().runs] == [4]
    other = SeenLog(spark.newSession(), log.path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scored = spark.range(200).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("dedupe_key"))
        left = dedupe.drop_seen(scored, log.current())
        assert left.count() == 110
        plan = left._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        right = plan[plan.index("LeftAnti"):]
        state = right[right.index("seen_us"):] if "seen_us" in right else right
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in state
        for name in spark.catalog.listTables():
            if name.name.startswith("bucketed_"):
                spark.sql(f"DROP TABLE {name.name}")
        assert len(as_dict(other.read())) == 90 and dedupe.drop_seen(scored, log.current()).count() == 110
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_expired_keys_leave_the_stream_state(spark, tmp_path):
    """The stream's own state shrinks once the clock has passed the retention."""
    from alertloom.streaming.incremental import first_alert_per_key

    path, held = str(tmp_path / "events"), []
    for day in range(4):
        rows = [(f"k{day}-{n}", dt.datetime(2026, 1, 1) + dt.timedelta(days=4 * day)) for n in range(20 if day < 2 else 1)]
        spark.createDataFrame(rows, "key string, ts timestamp").write.mode("append").parquet(path)
        stream = spark.readStream.schema("key string, ts timestamp").parquet(path)
        query = first_alert_per_key(stream, ["key"], "ts", "1 day").writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
            "checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        query.awaitTermination()
        held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert max(held) >= 20 and held[-1] <= 2
