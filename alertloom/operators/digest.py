"""Ranked rows to messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.functions.dates import age_text
from alertloom.functions.text import truncate

# --- Fixed values: message texts, limits and colours -------------------------
HEADLINE = "Internship Opportunities Found"
NOTHING_NEW = "No new matching internship opportunities found this run."
PER_MESSAGE = 10
PRIORITY_COLOR, FRESH_COLOR, OTHER_COLOR, NOTHING_COLOR = 0x2ECC71, 0xF1C40F, 0x95A5A6, 0x5865F2
NO_COMPANY, NO_LOCATION, NO_SKILLS = "Unknown Company", "Casablanca/Morocco", "-"
LIMITS = {"title": 256, "description": 300, "Company": 200, "Location": 200, "Skills": 200,
          "Source": 100, "URL": 400}
# --- end of fixed values ------------------------------------------------------

EMBED = (
    "struct<title:string,url:string,description:string,color:int,"
    "fields:array<struct<name:string,value:string,inline:boolean>>,footer:struct<text:string>>"
)


def embed_color(rank: Column) -> Column:
    return F.when(rank == 0, PRIORITY_COLOR).when(rank == 1, FRESH_COLOR).otherwise(OTHER_COLOR)


def _or(col: str, other: str) -> Column:
    return F.coalesce(F.nullif(F.col(col), F.lit("")), F.lit(other))


def digest_rows(ranked: DataFrame, as_of: Column) -> DataFrame:
    """One row per alert, texts cut to what a message may hold, ten to a message."""

    def cut(name: str, col: Column) -> Column:
        return truncate(col, LIMITS[name])

    skills = F.coalesce(F.nullif(F.array_join("matched_skills", ", "), F.lit("")), F.lit(NO_SKILLS))
    return ranked.select(
        "place",
        F.floor((F.col("place") - 1) / PER_MESSAGE).cast("long").alias("chunk"),
        cut("title", F.col("title")).alias("title"),
        F.col("url"),
        cut("description", F.col("match_reason")).alias("description"),
        embed_color(F.col("freshness_rank")).alias("color"),
        cut("Company", _or("company", NO_COMPANY)).alias("company"),
        cut("Location", _or("location", NO_LOCATION)).alias("location"),
        age_text(F.col("posted_at"), as_of).alias("posted"),
        F.concat(F.col("match_score").cast("string"), F.lit("/100")).alias("score"),
        cut("Skills", skills).alias("skills"),
        cut("Source", F.col("source")).alias("source"),
        cut("URL", F.col("url")).alias("url_text"),
        F.concat(F.lit("#"), F.col("place").cast("string")).alias("footer"),
    )


def _embed() -> Column:
    shown = (("Company", "company", True), ("Location", "location", True), ("Posted", "posted", True),
             ("Match Score", "score", True), ("Skills", "skills", True), ("Source", "source", True),
             ("URL", "url_text", False))
    fields = F.array(*[
        F.struct(F.lit(name).alias("name"), F.col(col).alias("value"), F.lit(inline).alias("inline"))
        for name, col, inline in shown
    ])
    return F.struct(
        F.col("title"), F.col("url"), F.col("description"), F.col("color"),
        fields.alias("fields"), F.struct(F.col("footer").alias("text")).alias("footer"),
    )


def digest_messages(rows: DataFrame) -> DataFrame:
    """``chunk, message``: JSON payloads in order; one that says so when there is nothing."""
    embeds = F.transform(
        F.sort_array(F.collect_list(F.struct("place", _embed().alias("embed")))), lambda x: x.embed
    )
    full = rows.groupBy("chunk").agg(embeds.cast(f"array<{EMBED}>").alias("embeds"))
    notice = F.array(F.struct(F.lit(NOTHING_NEW).alias("title"), F.lit(NOTHING_COLOR).alias("color")))
    empty = rows.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(
        F.lit(0).cast("long").alias("chunk"),
        F.to_json(F.struct(F.lit(HEADLINE).alias("content"), notice.alias("embeds"))).alias("message"),
    )
    return full.select(
        "chunk", F.to_json(F.struct(F.lit(HEADLINE).alias("content"), F.col("embeds"))).alias("message")
    ).unionByName(empty)
