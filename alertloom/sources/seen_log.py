"""The state between runs as a log: a run writes what it adds and nothing else.

Under one folder there are ``runs`` (parquet, never changed) and ``log`` (small JSON files).
A file of the log is the commit point: it names runs that are added and runs that no longer
count.  The state is what all files together say, so it does not depend on their order:

* Two writers at once each add a file under a name of its own, and neither is lost.
* Of several times of a key the latest counts; one that cannot be read counts for ever.  So
  rows may stand in several runs, and a run may be read twice, without a difference.
* Forgetting is a cutoff in the log.  Rows before it do not count, and a run all of whose
  rows lie before it is dropped without being read.
* Runs of about one size are merged when there are ``fan`` of them, so there are few of them
  at any time.  The merged run leaves out what is forgotten.  Large ones are bucketed by key, and
  rows are compared with them without moving the state.  The log is folded into one file then.

A run may carry a tag ``stream-number``.  Work that is done again replaces its own runs, and
the last one of a stream is not merged, so that the stream can still look past it.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from alertloom.functions.dates import iso_parse
from alertloom.sources.bucketed import read_bucketed, read_text, rename, write_bucketed, write_text
from alertloom.sources.seen import SEEN_SCHEMA, _files, empty_seen, iso_text

RUN_SCHEMA = f"{SEEN_SCHEMA}, seen_us long"
SMALLEST = 10_000


def _micros(spark: SparkSession, moment: Column) -> int:
    return spark.sql("SELECT 1").select(F.unix_micros(moment)).head()[0]


def _newest(rows: DataFrame) -> DataFrame:
    """One row per key, the latest; a time that cannot be read is later than all."""
    order = F.struct(F.col("seen_us").isNull(), F.col("seen_us"), F.col("first_seen"))
    return rows.groupBy("dedupe_key").agg(F.max_by(F.struct("first_seen", "seen_us"), order).alias("best")).select("dedupe_key", "best.*")


@dataclass
class SeenView:
    """The state at one moment; later writes do not change it."""

    log: SeenLog
    runs: list[dict]
    cutoff: int | None

    def _alive(self, rows: DataFrame) -> DataFrame:
        return rows if self.cutoff is None else rows.where(F.col("seen_us").isNull() | (F.col("seen_us") >= self.cutoff))

    def _parts(self) -> list[DataFrame]:
        """Live rows: all plain runs in one frame, each bucketed run in one of its own."""
        plain = [self.log.folder(run) for run in self.runs if not run["buckets"]]
        frames = [self.log.spark.read.schema(RUN_SCHEMA).parquet(*plain)] if plain else []
        return [self._alive(f) for f in frames + [read_bucketed(self.log.spark, self.log.folder(run)) for run in self.runs if run["buckets"]]]

    def read(self) -> DataFrame:
        """``dedupe_key, first_seen``, once per key."""
        parts = self._parts()
        if not parts:
            return empty_seen(self.log.spark)
        rows = parts[0]
        for more in parts[1:]:
            rows = rows.unionByName(more)
        return _newest(rows).select("dedupe_key", "first_seen")

    def drop_from(self, rows: DataFrame) -> DataFrame:
        """Rows whose ``dedupe_key`` is not in the state.

        One anti-join for the plain runs and one per bucketed run; the latter are read by
        their buckets, so only ``rows`` are dealt out for them, and once for all.
        """
        for part in self._parts():
            rows = rows.join(part.select("dedupe_key"), "dedupe_key", "left_anti")
        return rows


class SeenLog:
    """See the module.  ``buckets`` is fixed for a run when it is written; it should follow the size of the state."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 200, bucket_rows: int = 5_000_000, fan: int = 4) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets, self.bucket_rows, self.fan = buckets, bucket_rows, fan

    # --- the log -----------------------------------------------------------------

    def _commit(self, **said) -> None:
        """Write a file of the log; it counts from its renaming on, which is one step."""
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex[:12]}"
        write_text(self.spark, f"{self.path}/log/_{name}", json.dumps(said))
        rename(self.spark, f"{self.path}/log/_{name}", f"{self.path}/log/{name}.json")

    def _entries(self) -> dict[str, dict]:
        entries = {path.rsplit("/", 1)[-1]: json.loads(read_text(self.spark, path)) for path in _files(self.spark, f"{self.path}/log/*.json")}
        covered = {name for entry in entries.values() for name in entry.get("covers", ())}
        return {name: entry for name, entry in entries.items() if name not in covered}

    def _state(self) -> tuple[dict[str, dict], set[str], int | None, list[str]]:
        """Live runs by id, ids that no longer count, cutoff, names of the log's files."""
        entries = self._entries()
        gone = {i for entry in entries.values() for i in entry.get("removes", ())}
        runs = {run["id"]: run for entry in entries.values() for run in entry.get("adds", ()) if run["id"] not in gone}
        cutoff = max((entry["cutoff"] for entry in entries.values() if entry.get("cutoff") is not None), default=None)
        return runs, gone, cutoff, list(entries)

    # --- runs ----------------------------------------------------------------------

    def folder(self, run: dict) -> str:
        return f"{self.path}/runs/{run['id']}"

    def _write(self, rows: DataFrame, tag: str = "", buckets: int = 0) -> dict | None:
        """Write a run and return what the log has to know of it; nothing for no rows."""
        run, watch = {"id": uuid.uuid4().hex, "tag": tag, "buckets": buckets}, Observation()
        seen = rows.select("dedupe_key", "first_seen", F.unix_micros(iso_parse(F.col("first_seen"))).alias("seen_us"))
        watched = seen.observe(watch, F.count(F.lit(1)).alias("rows"), F.max("seen_us").alias("high"),
                               F.count_if(F.col("seen_us").isNull()).alias("undated"))
        if buckets:
            write_bucketed(watched, self.folder(run), "dedupe_key", buckets)
        else:
            watched.write.parquet(self.folder(run))
        run |= watch.get
        return run if run["rows"] else None

    def append(self, rows: DataFrame, tag: str = "", cutoff: int | None = None) -> None:
        """Add ``dedupe_key, first_seen`` rows, in place of earlier ones with this tag; forget what is before ``cutoff``."""
        run = self._write(rows, tag)
        runs, _, known, _ = self._state()
        limit = max((c for c in (known, cutoff) if c is not None), default=None)
        removes = [i for i, r in runs.items() if tag and r["tag"] == tag or limit is not None and not r["undated"] and r["high"] < limit]
        self._commit(adds=[run] if run else [], removes=removes, cutoff=cutoff)

    def prune(self, as_of: Column, retention_days: int) -> None:
        """Forget keys older than the retention; runs that hold no others are dropped, none is rewritten."""
        cutoff = _micros(self.spark, as_of - F.make_dt_interval(F.lit(retention_days)))
        runs = self._state()[0]
        self._commit(removes=[i for i, r in runs.items() if not r["undated"] and r["high"] < cutoff], cutoff=cutoff)

    def _tier(self, run: dict) -> int:
        return int(math.log(max(run["rows"] / SMALLEST, 1), self.fan))

    def compact(self) -> bool:
        """Merge the runs of a size of which there are ``fan`` or more; True if there were any."""
        runs, gone, cutoff, names = self._state()
        newest: dict[str, int] = {}
        for run in runs.values():
            stream, _, number = run["tag"].rpartition("-")
            if number.isdigit():
                newest[stream] = max(newest.get(stream, -1), int(number))

        def is_last(run: dict) -> bool:
            stream, _, number = run["tag"].rpartition("-")
            return bool(run["tag"]) and (not number.isdigit() or newest[stream] == int(number))

        tiers: dict[int, list[dict]] = {}
        for run in runs.values():
            if not is_last(run):
                tiers.setdefault(self._tier(run), []).append(run)
        full = [held for held in tiers.values() if len(held) >= self.fan]
        if not full:
            return False
        merged = [run for held in full for run in held]
        size = sum(run["rows"] for run in merged)
        rows = SeenView(self, merged, cutoff).read()
        new = self._write(rows, buckets=self.buckets if size >= self.bucket_rows else 0)
        out = {run["id"] for run in merged}
        self._commit(adds=[r for i, r in runs.items() if i not in out] + ([new] if new else []), removes=sorted(gone | out),
                     cutoff=cutoff, covers=names)
        return True

    # --- what a run asks for -----------------------------------------------------------

    def current(self, not_by: str | None = None) -> SeenView:
        """The state now; with ``not_by``, without what this tag wrote."""
        runs, _, cutoff, _ = self._state()
        return SeenView(self, [r for r in runs.values() if not not_by or r["tag"] != not_by], cutoff)

    def read(self, not_by: str | None = None) -> DataFrame:
        return self.current(not_by).read()

    def after_run(self, run, sent: bool, tag: str = "") -> None:
        """Add the keys of a run that was sent, forget old ones, merge where there are many runs."""
        keys = run.ranked.select("dedupe_key").distinct() if sent else run.ranked.select("dedupe_key").limit(0)
        cutoff = _micros(self.spark, run.as_of - F.make_dt_interval(F.lit(run.settings.retention_days)))
        self.append(keys.withColumn("first_seen", iso_text(run.as_of)), tag, cutoff)
        self.compact()
