"""Finding the real age of rows that carry no date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.operators.dedupe import drop_seen
from alertloom.operators.extract import detail_dates


def unseen_undated(matched: DataFrame, seen: DataFrame) -> DataFrame:
    """Distinct ``dedupe_key, detail_url`` of undated rows that were not alerted."""
    pairs = matched.where(F.col("posted_at").isNull()).select("dedupe_key", "detail_url").distinct()
    return drop_seen(pairs, seen)


def undated_groups(matched: DataFrame) -> DataFrame:
    """How many undated rows share a detail address, and the first of them."""
    return (
        matched.where(F.col("posted_at").isNull())
        .groupBy("detail_url")
        .agg(F.count(F.lit(1)).alias("rows"), F.min("seq").alias("first_seq"))
    )


def date_check_candidates(pairs: DataFrame, limit: int | None = None) -> DataFrame:
    """The detail addresses to look at: all, or the first ``limit`` by address."""
    every = pairs.select("detail_url").distinct()
    return every if limit is None else every.orderBy("detail_url").limit(limit)


def check_dates(candidates: DataFrame, detail_pages: DataFrame, as_of: Column, day_first: bool = False,
                limit: int | None = None) -> DataFrame:
    """``detail_url, found_at`` of the candidates whose page was fetched.

    ``detail_pages`` has ``url, ok, html``.  With ``limit``, the most candidates there can be, they are
    sent to the scan and no other page is parsed.  Without it dates are read on the scan of
    all pages, and only they are joined with the candidates.  ``html`` is never moved.
    """
    good = detail_pages.where("ok").select(F.col("url").alias("detail_url"), "html")
    if limit is not None:
        good = good.join(F.broadcast(candidates.limit(limit)), "detail_url", "left_semi")
    dated = detail_dates(good, as_of, day_first).groupBy("detail_url").agg(F.min("found_at").alias("found_at"))
    return dated if limit is not None else dated.join(candidates, "detail_url", "left_semi")


def apply_dates(matched: DataFrame, pairs: DataFrame, checked: DataFrame) -> DataFrame:
    """Give undated rows the date that was found; drop rows whose page shows none.

    Rows whose page could not be fetched stay undated.  Dated rows are not moved.
    """
    dated = matched.where(F.col("posted_at").isNotNull())
    undated = matched.where(F.col("posted_at").isNull())
    no_date = checked.where(F.col("found_at").isNull()).select("detail_url")
    found = pairs.join(checked.where(F.col("found_at").isNotNull()), "detail_url")
    filled = (
        undated.join(no_date, "detail_url", "left_anti")
        .join(found, ["dedupe_key", "detail_url"], "left")
        .withColumn("posted_at", F.col("found_at"))
    )
    return dated.unionByName(filled.select(*dated.columns))
