"""Counts about a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

STEPS = ("raw", "relevant", "new_unique", "returned")
# What is noted about a failed request.
NOTES = {"robots": "robots.txt disallow", "403": "HTTP 403", "429": "HTTP 429"}


def source_breakdown(requests: DataFrame, results: DataFrame, listings: DataFrame) -> DataFrame:
    """Per source: requests, failures, rows extracted, rows relevant, notes.

    ``results`` has ``id, ok, status``; ``listings`` has ``source`` and ``hits``, null
    where a row is not relevant.  Notes are kept as note and count, so a source with any
    number of failures stays one small row; ``notes_text`` spells them out.
    """
    answered = requests.select("id", "source").join(results.select("id", "ok", "status"), "id", "left")
    status = F.col("status").cast("string")
    failed = ~F.coalesce("ok", F.lit(True))
    asked = answered.groupBy("source").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(failed).alias("failed"),
        *[F.count_if(failed & (status == code)).alias(f"_{code}") for code in NOTES],
    )
    noted = F.array(*[
        F.struct(F.lit(note).alias("note"), F.col(f"_{code}").alias("n")) for code, note in NOTES.items()
    ])
    found = listings.groupBy("source").agg(
        F.count(F.lit(1)).alias("jobs_extracted"), F.count("hits").alias("relevant")
    )
    zero = F.lit(0).cast("long")
    return (
        asked.join(found, "source", "left")
        .select(
            "source", "requests", "failed",
            F.coalesce("jobs_extracted", zero).alias("jobs_extracted"),
            F.coalesce("relevant", zero).alias("relevant"),
            F.filter(noted, lambda x: x.n > 0).alias("notes"),
        )
        .orderBy("source")
    )


def notes_text(notes: Column) -> Column:
    """Notes as one line, each said as often as it was made."""
    said = F.flatten(F.transform(notes, lambda x: F.array_repeat(x.note, x.n.cast("int"))))
    return F.array_join(said, "; ")


def funnel(listings: DataFrame, scored: DataFrame, collapsed: DataFrame, ranked: DataFrame) -> DataFrame:
    """How many rows each step of a run left: raw, relevant, new and unique, returned."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(i).alias("step_no"), F.lit(name).alias("step"), "rows")
        for i, (name, df) in enumerate(
            zip(STEPS, (listings, scored, collapsed, ranked))
        )
    ]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out


def watched_funnel(spark: SparkSession, watched: dict[str, Observation]) -> DataFrame:
    """``funnel`` from counts that were taken while the steps ran."""
    rows = [(i, step, watched[step].get["rows"]) for i, step in enumerate(STEPS)]
    return spark.createDataFrame(rows, "step_no int, step string, rows long")
