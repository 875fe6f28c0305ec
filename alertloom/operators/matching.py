"""Relevance, score and the texts that explain them.

Reading the text costs the most per row, so the predicate and the lists of hits are kept
apart: filter with ``relevant`` first, then build ``hits`` for the rows that are left.
Never filter on the hits themselves, Catalyst would build the lists twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.config import Rules, Settings
from alertloom.functions.dates import age_text
from alertloom.functions.terms import any_sql, let_sql, list_sql, low_sql, present_sql
from alertloom.functions.text import dedupe_key, detail_url, normalize_text, normalize_url, text_or_empty

# --- Fixed values: weights, limits and phrases -------------------------------
TERM_POINTS, LOCATION_POINTS = 25, 20
SKILL_POINTS, SKILL_CAP = 5, 30
PRIORITY_POINTS, FRESH_POINTS, UNDATED_POINTS = 25, 15, 5
SCORE_CAP = 100
REASON_TERMS, REASON_SKILLS = 3, 5
RANK_PRIORITY, RANK_FRESH, RANK_UNDATED, RANK_OLD = 0, 1, 2, 9
# --- end of fixed values ------------------------------------------------------

HOUR = 3600 * 1_000_000


HAYSTACK = "concat_ws(' ', coalesce(title, ''), coalesce(company, ''), coalesce(location, ''), coalesce(summary, ''))"


def haystack() -> Column:
    """The text keywords are looked for in."""
    return F.expr(HAYSTACK)


def relevant(rules: Rules) -> Column:
    """A location, a term and a skill occur; an excluded title needs a term of its own."""
    head, hay = ("head", "head_low"), ("hay", "hay_low")
    barred = f"{any_sql(rules.excluded, rules, *head)} AND NOT {any_sql(rules.terms, rules, *head)}"
    found = " AND ".join(any_sql(kind, rules, *hay) for kind in (rules.locations, rules.terms, rules.skills))
    in_title = let_sql("head", "coalesce(title, '')", let_sql("head_low", low_sql("head"), f"({barred})"))
    in_text = let_sql("hay", HAYSTACK, let_sql("hay_low", low_sql("hay"), f"({found})"))
    return F.expr(f"{in_text} AND NOT {in_title}")


def hits(rules: Rules) -> Column:
    """Struct of the locations, terms and skills that occur, each in configured order."""
    kinds = {"locations": rules.locations, "terms": rules.terms, "skills": rules.skills}
    lists = ", ".join(
        f"'{name}', {list_sql(kind, rules, 'hay', 'hay_low', 'hay_words')}" for name, kind in kinds.items()
    )
    words = present_sql("hay_low", sum(kinds.values(), ()))
    body = let_sql("hay_low", low_sql("hay"), let_sql("hay_words", words, f"named_struct({lists})"))
    return F.expr(let_sql("hay", HAYSTACK, body))


def valid() -> Column:
    """Rows need a title and an address."""
    return (text_or_empty(F.col("title")) != "") & (text_or_empty(F.col("url")) != "")


def _age(as_of: Column) -> Column:
    return F.unix_micros(as_of) - F.unix_micros(F.col("posted_at"))


def young_enough(as_of: Column, settings: Settings) -> Column:
    """Not older than the limit; undated rows and dates to come stay."""
    return F.col("posted_at").isNull() | (_age(as_of) <= settings.max_age_days * 24 * HOUR)


def freshness_rank(as_of: Column, settings: Settings) -> Column:
    return (
        F.when(F.col("posted_at").isNull(), RANK_UNDATED)
        .when(_age(as_of) <= settings.priority_hours * HOUR, RANK_PRIORITY)
        .when(_age(as_of) <= settings.max_age_days * 24 * HOUR, RANK_FRESH)
        .otherwise(RANK_OLD)
    )


def _title_boost(rules: Rules) -> Column:
    boost = F.lit(0)
    for words, points in reversed(rules.title_boosts):
        found = F.lit(False)
        for word in words:
            found = found | F.contains(F.lower(F.col("title")), F.lit(word))
        boost = F.when(found, points).otherwise(boost)
    return boost


def score(as_of: Column, settings: Settings, rules: Rules) -> Column:
    """Points from 0 to 100 for hits, freshness and title."""
    fresh = (
        F.when(F.col("posted_at").isNull(), UNDATED_POINTS)
        .when(_age(as_of) <= settings.priority_hours * HOUR, PRIORITY_POINTS)
        .when(_age(as_of) <= settings.max_age_days * 24 * HOUR, FRESH_POINTS)
        .otherwise(0)
    )
    skills = F.least(F.lit(SKILL_CAP), F.size(F.array_distinct(F.col("hits.skills"))) * SKILL_POINTS)
    total = (
        F.when(F.size("hits.terms") > 0, TERM_POINTS).otherwise(0)
        + F.when(F.size("hits.locations") > 0, LOCATION_POINTS).otherwise(0)
        + skills + fresh + _title_boost(rules)
    )
    return F.least(F.lit(SCORE_CAP), total)


def _named(label: str, words: Column, limit: int) -> Column:
    shown = F.slice(F.array_sort(F.array_distinct(words)), 1, limit)
    return F.when(F.size(words) > 0, F.concat(F.lit(f"{label}: "), F.array_join(shown, ", ")))


def match_reason(as_of: Column, rules: Rules) -> Column:
    """Why a row was chosen, in words."""
    return F.concat_ws(
        "; ",
        _named("internship term", F.col("hits.terms"), REASON_TERMS),
        F.when(F.size("hits.locations") > 0, rules.location_reason),
        _named("skills", F.col("hits.skills"), REASON_SKILLS),
        age_text(F.col("posted_at"), as_of),
    )


def with_keys(df: DataFrame) -> DataFrame:
    """Add the keys rows are compared by."""
    url, company, title = F.col("url"), F.col("company"), F.col("title")
    return df.withColumns({
        "dedupe_key": dedupe_key(url, company, title),
        "norm_url": normalize_url(url),
        "norm_company": normalize_text(company),
        "detail_url": detail_url(url),
    })


def match_listings(listings: DataFrame, rules: Rules) -> DataFrame:
    """Relevant rows with their hits."""
    return listings.where(valid()).where(relevant(rules)).withColumn("hits", hits(rules))


def mark_listings(listings: DataFrame, rules: Rules) -> DataFrame:
    """All rows; ``hits`` is null where a row is not relevant.

    For use before a write, when rows that fail must still be counted.
    """
    return listings.withColumn("hits", F.when(relevant(rules), hits(rules)))


def score_keys(matched_rows: DataFrame, as_of: Column, rules: Rules, settings: Settings) -> DataFrame:
    """What rows are ranked by and nothing else; ``score_listings`` tells the rest."""
    return matched_rows.select(
        "dedupe_key", "norm_url", "norm_company", score(as_of, settings, rules).alias("match_score"),
        freshness_rank(as_of, settings).alias("freshness_rank"), "posted_at", "seq")


def score_listings(matched_rows: DataFrame, as_of: Column, rules: Rules, settings: Settings) -> DataFrame:
    """Add score, freshness rank, reason and the sorted list of skills."""
    return matched_rows.withColumns({
        "match_score": score(as_of, settings, rules),
        "freshness_rank": freshness_rank(as_of, settings),
        "match_reason": match_reason(as_of, rules),
        "matched_skills": F.array_sort(F.array_distinct(F.col("hits.skills"))),
    })
