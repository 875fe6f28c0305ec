"""Where results go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def export_rows(listings: DataFrame) -> DataFrame:
    """Rows as they are exported: no internal columns, the date as ISO text."""
    names = set(listings.columns)

    def optional(name: str, default: Column) -> Column:
        return F.col(name) if name in names else default.alias(name)

    stamp = F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.when(
        F.pmod(F.unix_micros("posted_at"), F.lit(1_000_000)) != 0, F.date_format("posted_at", ".SSSSSS")
    ).otherwise("")
    return listings.select(
        "source", "title", "company", "location", "url",
        F.concat(stamp, micros, F.lit("+00:00")).alias("posted_at"),
        "summary",
        optional("match_score", F.lit(0)),
        optional("match_reason", F.lit("")),
        optional("matched_skills", F.array().cast("array<string>")),
    )


def dump_raw(listings: DataFrame, path: str) -> None:
    """Every extracted row, before any filter, as JSON lines."""
    export_rows(listings).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_digest(messages: DataFrame, path: str) -> None:
    """Messages in order, one JSON document per line."""
    messages.orderBy("chunk").select(F.col("message").alias("value")).write.mode("overwrite").text(path)
