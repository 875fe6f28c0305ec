"""Listings from plain article pages, and the ranked list made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.config import Rules, Settings
from alertloom.functions import dom as D
from alertloom.functions.text import url_host
from alertloom.plans.alert_run import rank_listings
from alertloom.sources.dom import with_dom


def article_listings(pages: DataFrame, posted_at: Column) -> DataFrame:
    """One row per page: its first article, titled by the first heading inside.

    ``pages`` has ``page_id, url, html``.  The page's language stands for the location.
    """
    els, texts = F.col("els"), F.col("texts")
    article = D.first(els, D.tag("article"))
    fields = F.struct(
        D.attr(D.first(els, D.tag("html")), "lang").alias("location"),
        D.text_of(texts, D.first(D.inside(els, article), D.tag("h1"))).alias("title"),
        D.text_of(texts, article).alias("summary"),
    )
    trees = with_dom(pages.select("page_id", "url", "html"))
    # Exploding one struct keeps later filters above it, so that the tree is searched
    # once per page instead of once for every filter that names a field.
    chosen = trees.select("page_id", "url", F.inline(F.array(fields)))
    return chosen.select(
        F.lit("pages").alias("source"),
        F.coalesce("title", F.lit("")).alias("title"),
        url_host(F.col("url")).alias("company"),
        "location",
        "url",
        posted_at.alias("posted_at"),
        F.coalesce("summary", F.lit("")).alias("summary"),
        F.col("page_id").alias("seq"),
    )


def top_listings(
    pages: DataFrame, posted_at: Column, as_of: Column, rules: Rules, settings: Settings,
    seen: DataFrame | None = None,
) -> DataFrame:
    """The ranked top of all article pages."""
    return rank_listings(article_listings(pages, posted_at), as_of, rules, settings, seen)
