"""Connected components of links by contraction, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.session import written

ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest reachable node) for every node of ``links`` (a, b: long).

    In a round every node takes its smallest neighbour as parent, and the parent's parent
    after that; links are then drawn between parents, and those inside one are dropped.
    Links fall fast from round to round.  A node with many links is one row per task
    after map-side minima.
    """
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    labels = None
    for _ in range(ROUNDS):
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")).select(
            "node", F.least("node", "parent").alias("parent"))
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        jumped = written(parents.join(up, "parent").select("node", F.col("above").alias("parent")), "parents")
        if labels is None:
            labels = jumped.select("node", F.col("parent").alias("component"))
        else:
            step = jumped.select(F.col("node").alias("component"), "parent")
            labels = labels.join(step, "component", "left").select("node", F.coalesce("parent", "component").alias("component"))
        left, right = (jumped.select(F.col("node").alias(n), F.col("parent").alias(f"{n}_top")) for n in ("a", "b"))
        links = written(links.join(left, "a").join(right, "b").select(
            F.least("a_top", "b_top").alias("a"), F.greatest("a_top", "b_top").alias("b")).filter("a < b").distinct(), "links")
        if links.isEmpty():
            return labels
    raise RuntimeError("the links did not contract")
