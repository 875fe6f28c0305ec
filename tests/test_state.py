from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from alertloom.config import Rules, Settings
from alertloom.plans.alert_run import alert_run, finish, run
from alertloom.sources import seen as S
from alertloom.sources.seen import SeenStore
from alertloom.streaming.incremental import PAGES_SCHEMA, drain, first_alert_per_key, incremental_alerts, page_stream
from tests.clock import AS_OF

RULES = Rules(locations=("casablanca",), terms=("stage",), skills=("java",), excluded=())
CARD = '<div class="job"><a href="/{0}">Stage Java {0}</a> casablanca posted {1} days ago</div>'


def as_dict(df):
    return {r.dedupe_key: r.first_seen for r in df.collect()}


def test_read_json(spark, tmp_path, as_of):
    assert as_dict(S.read_seen_json(spark, str(tmp_path / "nope.json"), as_of)) == {}
    texts = {"v2": {"version": 2, "seen": {"aa": "2026-08-01T00:00:00+00:00"}}, "v1": {"seen": ["aa", "bb"]},
             "none": {"version": 2}, "list": [1]}
    expected = {"v2": {"aa": "2026-08-01T00:00:00+00:00"},
                "v1": {k: "2026-08-25T12:00:00.000000+00:00" for k in ("aa", "bb")}, "none": {}, "list": {}}
    for name, doc in texts.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=2), encoding="utf-8")
        assert as_dict(S.read_seen_json(spark, str(tmp_path / f"{name}.json"), as_of)) == expected[name], name
    (tmp_path / "bad.json").write_text("NOT JSON", encoding="utf-8")
    assert as_dict(S.read_seen_json(spark, str(tmp_path / "bad.json"), as_of)) == {}


def test_prune_and_write_json(spark, tmp_path, as_of):
    seen = spark.createDataFrame([
        ("fresh", AS_OF.isoformat() + "+00:00"), ("stale", (AS_OF - dt.timedelta(days=200)).isoformat()),
        ("edge", (AS_OF - dt.timedelta(days=90)).isoformat() + "+00:00"), ("weird", "not-a-date"),
    ], S.SEEN_SCHEMA)
    kept = S.prune(seen, as_of, 90)
    assert set(as_dict(kept)) == {"fresh", "edge", "weird"}
    S.write_seen_json(kept, str(tmp_path / "out"), as_of)
    (file,) = (tmp_path / "out").glob("part-*")
    doc = json.loads(file.read_text(encoding="utf-8"))
    assert doc["version"] == 2 and set(doc["seen"]) == {"fresh", "edge", "weird"}
    assert as_dict(S.read_seen_json(spark, str(tmp_path / "out"), as_of)) == as_dict(kept)


def test_merge_gives_new_time(spark, as_of):
    seen = spark.createDataFrame([("a", "old"), ("b", "old")], S.SEEN_SCHEMA)
    out = as_dict(S.merge(seen, spark.createDataFrame([("b",), ("c",)], "dedupe_key string"), as_of))
    now = "2026-08-25T12:00:00.000000+00:00"
    assert out == {"a": "old", "b": now, "c": now}


def test_versions(spark, tmp_path):
    store = SeenStore(spark, str(tmp_path / "state"))
    assert store.read().count() == 0
    one = spark.createDataFrame([("a", "t")], S.SEEN_SCHEMA)
    assert store.write(one) == 1
    assert store.write(store.read().unionByName(one.select(F.lit("b").alias("dedupe_key"), "first_seen"))) == 2
    (tmp_path / "state" / "version=9").mkdir()  # a write that never finished
    assert store.versions() == [1, 2] and store.read().count() == 2
    assert store.write(one, tag="job-0") == 3 and store.read().count() == 1 and store.read(not_by="job-0").count() == 2
    assert store.write(one.limit(0), tag="job-0") == 4 and store.read(not_by="job-0").count() == 2


def test_run_end_to_end(spark, tmp_path, as_of):
    schema = ("source_pos long, name string, enabled boolean, kind string, search_url string, url string, "
              "default_location string, company string, queries array<string>")
    sources = spark.createDataFrame([
        (0, "one", True, "generic", "https://one.example/?q={query}", None, "", None, None),
        (1, "two", True, "generic", None, "https://two.example/", "", None, None)], schema)
    html = {0: CARD.format("a", 1) + CARD.format("b", 30), 1: '<div class="job"><a href="/u">Stage Java u</a> casablanca</div>'
            '<div class="job"><a href="/w">Stage Java w</a> casablanca</div>'}

    def pages_for(plan):
        rows = [(0, True, "200", "", html[0]), (1, True, "200", "https://one.example/moved/", html[1]), (2, False, "403", "", "")]
        results = spark.createDataFrame(rows, "id long, ok boolean, status string, final_url string, html string")
        return results.join(plan.select("id"), "id")

    details = spark.createDataFrame([("https://one.example/u", True, "<p>posted 2 days ago</p>"),
                                     ("https://one.example/w", True, "<p>none</p>")], "url string, ok boolean, html string")
    store = SeenStore(spark, str(tmp_path / "state"))
    sent = []

    def go(ok=True, **kw):
        def deliver(messages):
            sent.append([json.loads(r.message) for r in messages.orderBy("chunk").collect()])
            return ok

        done, stats = run(spark, sources, pages_for, store, as_of, RULES, Settings(queries=("x", "y")), details,
                          deliver=deliver, **kw)
        return [r.title for r in done.ranked.orderBy("place").collect()], done, stats

    assert go(dry_run=True)[0] == ["Stage Java a", "Stage Java u"] and sent == [] and store.versions() == []
    assert go(ok=False)[0] == ["Stage Java a", "Stage Java u"]
    assert store.versions() == [1] and store.read().count() == 0  # nothing was delivered
    titles, done, stats = go(debug_path=str(tmp_path / "raw"), digest_path=str(tmp_path / "digest"))
    assert titles == ["Stage Java a", "Stage Java u"] and store.read().count() == 2
    assert {r.step: r.rows for r in done.funnel().collect()} == {"raw": 4, "relevant": 2, "new_unique": 2, "returned": 2}
    assert [tuple(r)[:5] for r in stats.collect()] == [("one", 2, 0, 4, 4), ("two", 1, 1, 0, 0)]
    raw = [json.loads(line) for f in sorted((tmp_path / "raw").glob("part-*")) for line in f.read_text().splitlines()]
    assert len(raw) == 4 and set(raw[0]) == {"source", "title", "company", "location", "url", "posted_at", "summary",
                                             "match_score", "match_reason", "matched_skills"}
    assert go()[0] == [] and store.read().count() == 2
    assert sent[-1][0]["embeds"][0]["title"].startswith("No new matching")


def test_stream_of_pages(spark, tmp_path, as_of):
    def drop(task_id, html):
        row = [(task_id, "s", "generic", "https://h.example/", "", "", html)]
        spark.createDataFrame(row, PAGES_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "pages"))

    store, out = SeenStore(spark, str(tmp_path / "state")), str(tmp_path / "out")

    def go():
        stream = page_stream(spark, str(tmp_path / "pages"), files_per_batch=1)
        incremental_alerts(stream, store, out, lambda _: as_of, str(tmp_path / "log"), RULES, Settings()).awaitTermination()
        rows = spark.read.parquet(out).select("batch", "title").collect()
        return sorted((r.batch, r.title) for r in rows)

    drop(1, CARD.format("a", 1) + CARD.format("b", 2))
    assert go() == [(0, "Stage Java a"), (0, "Stage Java b")]
    drop(2, CARD.format("b", 2) + CARD.format("c", 3))
    assert go() == [(0, "Stage Java a"), (0, "Stage Java b"), (1, "Stage Java c")]
    assert store.versions() == [1, 2] and store.read().count() == 3


def test_stream_shares_a_store_with_runs(spark, tmp_path, as_of):
    """Batch, stream, batch on one store: no key comes twice, whatever the numbers of batches and versions."""
    def pages(*names):
        rows = [(i, "s", "generic", "https://h.example/", "", "", CARD.format(n, 1)) for i, n in enumerate(names)]
        return spark.createDataFrame(rows, PAGES_SCHEMA)

    store, out, sent = SeenStore(spark, str(tmp_path / "state")), str(tmp_path / "out"), []

    def batch(*names):
        done = alert_run(pages(*names), store.read(), as_of, RULES, Settings())
        titles = sorted(r.title for r in done.ranked.collect())
        finish(done, store, lambda _: True)
        return titles

    def stream(*names, ok=True, checked=None):
        pages(*names).coalesce(1).write.mode("append").parquet(str(tmp_path / "pages"))
        incremental_alerts(page_stream(spark, str(tmp_path / "pages")), store, out, lambda _: as_of, str(tmp_path / "log"), RULES, Settings(),
                           lambda m: sent.append([r.message for r in m.collect()]) or ok, checked).awaitTermination()

    assert batch("a") == ["Stage Java a"] and batch("b") == ["Stage Java b"]
    stream("a", "b", "c")
    assert len(sent) == 1 and "Stage Java c" in sent[0][0] and "Stage Java a" not in sent[0][0]
    assert batch("a", "b", "c", "d") == ["Stage Java d"]
    # a batch that is not delivered stops the stream and comes again
    with pytest.raises(StreamingQueryException, match="not delivered"):
        stream("e", ok=False)
    assert store.read().count() == 4
    stream("f")
    assert ["Stage Java e" in m[0] for m in sent] == [False, True, True, False] and "Stage Java f" in sent[3][0]
    # undated rows are looked up as in a run
    undated = '<div class="job"><a href="/{0}">Stage Java {0}</a> casablanca</div>'
    spark.createDataFrame([(1, "s", "generic", "https://h.example/", "", "", undated.format("g") + undated.format("h"))], PAGES_SCHEMA) \
        .coalesce(1).write.mode("append").parquet(str(tmp_path / "pages"))
    details = spark.createDataFrame([("https://h.example/g", True, "<p>2026-08-24</p>"), ("https://h.example/h", True, "<p>no</p>")],
                                    "url string, ok boolean, html string")
    stream("a", checked=details)
    assert "Stage Java g" in sent[-1][0] and "Stage Java h" not in sent[-1][0]


def test_ttl_dedupe_forgets(spark, tmp_path):
    schema = "key string, ts timestamp_ntz, n int"
    path = str(tmp_path / "events")
    start = dt.datetime(2026, 1, 1)
    batches = [[("a", start, 1), ("a", start + dt.timedelta(hours=1), 2)], [("b", start + dt.timedelta(days=3), 3)],
               [("c", start + dt.timedelta(days=3), 4)], [("a", start + dt.timedelta(days=4), 5)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/d={i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/d=*")
    out = drain(first_alert_per_key(stream, ["key"], "ts", "1 day"), "ttl").collect()
    assert sorted(r.n for r in out) == [1, 3, 4, 5]
