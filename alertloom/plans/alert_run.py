"""One alert run, from fetched pages to messages and the next state."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from alertloom.config import Rules, Settings
from alertloom.operators import dedupe, digest, matching, stats, verify
from alertloom.operators.extract import extract_listings
from alertloom.operators.requests import fetched_pages, request_plan
from alertloom.session import written
from alertloom.sources import seen as state
from alertloom.sources.seen import SeenStore
from alertloom.sources.seen_log import SeenLog, SeenView
from alertloom.sources.sinks import dump_raw, write_digest


def rank_listings(
    listings: DataFrame, as_of: Column, rules: Rules, settings: Settings, seen: DataFrame | SeenView | None = None
) -> DataFrame:
    """Filter, score, de-duplicate and rank rows.

    Duplicates and order are decided on keys, scores and times; no text takes part in a
    shuffle.  The rows that win, at most ``max_results``, are fetched by ``seq`` from
    ``listings``, which are read a second time for that, and only they are explained.
    """
    young = listings.where(matching.young_enough(as_of, settings))
    keys = matching.with_keys(matching.match_listings(young, rules))
    top = dedupe.rank_new(matching.score_keys(keys, as_of, rules, settings), seen, settings.max_results)
    won = listings.join(top.select("seq", "key_slot", "slot", "place"), "seq").withColumn("hits", matching.hits(rules))
    return matching.score_listings(matching.with_keys(won), as_of, rules, settings).drop("hits", "detail_url")


@dataclass
class AlertRun:
    """Results of one run; all but the written ``listings`` are lazy."""

    listings: DataFrame
    scored: DataFrame
    collapsed: DataFrame
    ranked: DataFrame
    digest: DataFrame
    messages: DataFrame
    as_of: Column
    settings: Settings
    seen: DataFrame | SeenView
    watched: dict[str, Observation]

    def funnel(self) -> DataFrame:
        """Rows after each step, counted while they passed by; nothing is computed again."""
        return stats.watched_funnel(self.listings.sparkSession, self.watched)

    def next_seen(self, delivered: bool) -> DataFrame:
        """State after the run: only rows that were sent count as seen."""
        seen = self.seen.read() if isinstance(self.seen, SeenView) else self.seen
        merged = state.merge(seen, self.ranked, self.as_of) if delivered else seen
        return state.prune(merged, self.as_of, self.settings.retention_days)


def alert_run(
    pages: DataFrame,
    seen: DataFrame | SeenView,
    as_of: Column,
    rules: Rules = Rules(),
    settings: Settings = Settings(),
    detail_pages: DataFrame | None = None,
    day_first: bool = False,
) -> AlertRun:
    """Run over fetched pages (columns as ``extract_listings`` asks for).

    Extraction and keyword matching are the expensive part and feed several results, so
    their output is written once to the shared folder and read from there.  Ranking reads
    its narrow columns; the rows that win are fetched by ``seq``.
    """
    watched = {step: Observation() for step in stats.STEPS}

    def watch(df: DataFrame, step: str) -> DataFrame:
        return df.observe(watched[step], F.count(F.lit(1)).alias("rows"))

    marked = matching.mark_listings(extract_listings(pages, as_of, day_first=day_first), rules)
    listings = written(watch(matching.with_keys(marked), "raw"), "listings")
    found = listings.where(F.col("hits").isNotNull()).where(matching.valid())
    if detail_pages is not None:
        pairs = verify.unseen_undated(found, seen)
        candidates = verify.date_check_candidates(pairs, settings.date_check_max)
        checked = written(verify.check_dates(
            candidates, detail_pages, as_of, day_first, settings.date_check_max), "checked")
        found = verify.apply_dates(found, pairs, checked)
    young = found.where(matching.young_enough(as_of, settings))
    scored = matching.score_keys(young, as_of, rules, settings)
    unique = dedupe.best_per_key(watch(scored, "relevant"))
    collapsed = dedupe.collapse_offers(dedupe.drop_seen(unique, seen))
    top = dedupe.rank_top(watch(collapsed, "new_unique"), settings.max_results)
    # at most ``max_results`` rows, with the date that was found for them
    won = listings.drop("posted_at").join(top.select("seq", "posted_at", "key_slot", "slot", "place"), "seq")
    texts = matching.score_listings(won, as_of, rules, settings).drop("hits", "detail_url")
    ranked = written(watch(texts, "returned"), "ranked")
    rows = digest.digest_rows(ranked, as_of)
    return AlertRun(
        listings, scored, collapsed, ranked, rows, digest.digest_messages(rows), as_of, settings, seen, watched
    )


def finish(
    run: AlertRun,
    store: SeenStore | SeenLog,
    deliver: Callable[[DataFrame], bool] | None = None,
    dry_run: bool = False,
    tag: str = "",
) -> bool:
    """Deliver the messages, then write the state.

    ``deliver`` gets the messages and says whether all of them went out.  If it fails,
    nothing becomes seen, so the rows come again: delivery is at least once.  The pruned
    state is written even when nothing was sent, but never on a dry run.
    """
    if dry_run:
        return False
    sent = bool(deliver(run.messages)) if deliver else False
    store.after_run(run, sent and not run.ranked.isEmpty(), tag)
    return sent


def run(
    spark: SparkSession,
    sources: DataFrame,
    pages_for: Callable[[DataFrame], DataFrame],
    store: SeenStore | SeenLog,
    as_of: Column,
    rules: Rules = Rules(),
    settings: Settings = Settings(),
    detail_pages: DataFrame | None = None,
    only_sources: Iterable[str] | None = None,
    limit_queries: int | None = None,
    deliver: Callable[[DataFrame], bool] | None = None,
    dry_run: bool = False,
    debug_path: str | None = None,
    digest_path: str | None = None,
) -> tuple[AlertRun, DataFrame]:
    """Plan requests, take the pages that answer them, and do one alert run.

    ``pages_for`` maps the request plan to ``id, ok, status, final_url, html`` rows, as a
    crawler left them.  Returns the run and its per-source breakdown.
    """
    plan = request_plan(sources, settings.queries, only_sources, limit_queries)
    results = pages_for(plan)
    done = alert_run(
        fetched_pages(plan, results), store.current(), as_of, rules, settings, detail_pages
    )
    breakdown = stats.source_breakdown(plan, results, done.listings)
    if debug_path:
        dump_raw(done.listings, debug_path)
    if digest_path:
        write_digest(done.messages, digest_path)
    finish(done, store, deliver, dry_run)
    return done, breakdown
