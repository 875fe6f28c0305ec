"""Duplicates, rows already alerted, and the final order.

Both passes are grouped aggregations.  Spark combines them inside every map task, so a
key that holds a third of all rows arrives at its reducer as one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.sources.seen_log import SeenView


def _best(df: DataFrame, keys: list[str], tie: str, slot: str) -> DataFrame:
    """Highest score per key; ties go to the smallest ``tie``, which also names the slot."""
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(F.col("match_score"), (-F.col(tie)).alias("earlier"))
    chosen = F.max_by(F.struct(*rest), order).alias("best")
    grouped = df.groupBy(*keys).agg(F.min(tie).alias(slot), chosen)
    return grouped.select(*keys, *[F.col(f"best.{c}").alias(c) for c in rest], slot)


def best_per_key(scored: DataFrame) -> DataFrame:
    """One row per ``dedupe_key``: a better score wins, ties keep the earlier arrival.

    ``key_slot`` is the arrival of the key's first row, the place it is ranked at.
    """
    return _best(scored, ["dedupe_key"], tie="seq", slot="key_slot")


def collapse_offers(unique: DataFrame) -> DataFrame:
    """One row per address and company, by the same rule, in order of ``key_slot``."""
    return _best(unique, ["norm_url", "norm_company"], tie="key_slot", slot="slot")


def drop_seen(rows: DataFrame, seen: DataFrame | SeenView) -> DataFrame:
    """Rows whose key has not been alerted.

    Used after ``best_per_key``, whose output is already partitioned by the key, and
    without a broadcast hint: the state grows, Spark decides by its measured size.  A view
    of a state log compares with its runs as they lie.
    """
    if isinstance(seen, SeenView):
        return seen.drop_from(rows)
    return rows.join(seen.select("dedupe_key"), "dedupe_key", "left_anti")


def ranking() -> list[Column]:
    """Fresh first, then newest, then best score, then arrival."""
    return [
        F.col("freshness_rank").asc(),
        F.coalesce(F.unix_micros("posted_at"), F.lit(0)).desc(),
        F.col("match_score").desc(),
        F.col("slot").asc(),
    ]


def rank_top(rows: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` rows with their place, counted from 1.

    The limit is taken per task before anything is moved; only the rows that are left
    are numbered.
    """
    top = rows.orderBy(*ranking()).limit(limit)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*ranking())))


def rank_new(scored: DataFrame, seen: DataFrame | SeenView | None, limit: int) -> DataFrame:
    """Duplicates removed, seen keys removed, offers collapsed, top rows kept."""
    unique = best_per_key(scored)
    if seen is not None:
        unique = drop_seen(unique, seen)
    return rank_top(collapse_offers(unique), limit)
