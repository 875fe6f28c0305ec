"""Exact duplicates by a tree of merged digest runs, in DataFrame operations only.

Every row has a digest of its normalised text and belongs to one of ``runs`` runs.  A
round merges ``fan_in`` neighbouring runs: rows of one digest are sorted together and the
best of them stays, with their number.  After ``log(runs) / log(fan_in)`` rounds one row
per digest is left.  The way back hands it down the same tree, so that no join and no
group ever sees more than ``fan_in`` rows of a key, or the rows of one run of a copy.

Two texts count as equal when SHA-256, an independent 64-bit hash and the length of the
normalised text all agree, at every level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import WHITE, narrow, whole
from alertloom.session import written

RUNS = 4096
FAN_IN = 16
KEYS = ["digest", "proof", "proof_length"]


def digest_rows(documents: DataFrame, runs: int = RUNS) -> DataFrame:
    """doc_id, digest and its proofs, code points of the original text, run."""
    norm = F.translate("body", WHITE, "")
    return (
        narrow(documents).select("doc_id", whole().alias("body"))
        .select("doc_id", F.unhex(F.sha2(norm.cast("binary"), 256)).alias("digest"), F.xxhash64(norm).alias("proof"),
                F.length(norm).alias("proof_length"), F.length("body").alias("n_points"))
        .withColumn("run", F.pmod(F.xxhash64("doc_id", "n_points"), F.lit(runs)))
    )


def merge_runs(level: DataFrame, fan_in: int) -> DataFrame:
    """One round: the sorted entries of ``fan_in`` neighbouring runs become one run."""
    return (
        level.withColumn("run", F.expr(f"run div {fan_in}")).groupBy(*KEYS, "run")
        .agg(F.sum("size").alias("size"), F.min("best").alias("best"))
    )


def exact_groups(documents: DataFrame, runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """One row per row of ``documents``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without ASCII white space; null counts as empty, and
    all empty texts are one group.  Of a group the row with the most code points in its
    original text stays, then the smallest doc_id; a null doc_id only if there is no
    other.  Repeated rows of the id that stays are all marked as kept, since the id alone
    names a row.  An empty table gives an empty result; other columns are ignored.
    """
    rows = written(digest_rows(documents, runs), "digests")
    best = F.struct((-F.col("n_points")).alias("less"), F.col("doc_id").isNull().alias("none"), F.col("doc_id"))
    levels = [rows.groupBy(*KEYS, "run").agg(F.count(F.lit(1)).alias("size"), F.min(best).alias("best"))]
    left = runs
    while left > 1:
        levels.append(merge_runs(levels[-1], fan_in))
        left = -(-left // fan_in)
    found = levels[-1].select(*KEYS, "run", "size", F.col("best.doc_id").alias("keep_id"))
    for level in reversed(levels[:-1]):
        below = level.select(*KEYS, "run", F.expr(f"run div {fan_in}").alias("above"))
        found = below.join(found.withColumnRenamed("run", "above"), [*KEYS, "above"]).drop("above")
    return rows.join(found, [*KEYS, "run"]).select(
        "doc_id", "keep_id", F.col("size").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that stay, with all their columns."""
    kept = exact_groups(documents).filter("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return documents.join(kept, documents["doc_id"].eqNullSafe(kept["_kept_id"]), "left_semi")


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS body FROM documents
), n AS (
  SELECT doc_id, length(body) AS n_points, sha256(regexp_replace(body, '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM t
), r AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id) AS keep_id FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""
