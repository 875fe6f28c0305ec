"""Components of similar nodes that meet under common keys, without pairing whole groups.

Nodes are posted under keys; two nodes that are similar enough share a key.  ``look``
tells which of some pairs really are linked.  Most pairs of a large group need no look,
since their nodes are already linked through others:

1. every node is compared with the smallest node of each of its keys;
2. under keys where several components are left, with another leader per key and turn;
3. under keys where several are left still, every node outside the largest component
   of its key is compared with all nodes of the key that are in another component.  For
   this step nodes can be marked in more detail (``sharpen``), since few are left.

So no pair of different components that shares a key stays unlooked at, and what a round
emits follows the posts and not the squares of groups, as long as groups are linked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.llm.components import components
from alertloom.session import written

LEADER_ROUNDS = 2


def linked(posts: DataFrame, look: Callable[[DataFrame], DataFrame], rounds: int = LEADER_ROUNDS,
           alike: Callable[[Column, Column, Column], Column] | None = None,
           sharpen: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """node and component of the nodes of ``posts`` (node long, key long) that have a link.

    ``look`` takes distinct pairs (a, b: long) and returns those that are linked.  ``alike``
    tells from the nodes' ``mark`` and the key's ``place``, two further columns of ``posts``, which
    pairs are worth a look under this key; the last step then emits no others.  ``sharpen`` takes the
    posts that are open in the last step (node, key, mark, place, component) and gives them the marks
    that ``alike`` reads; it may add keys, as long as all pairs that are alike meet under some key.
    """
    carried = ["mark", "place"] if alike else []
    links: list[DataFrame] = []
    found = None

    def compare(pairs: DataFrame) -> None:
        nonlocal found
        links.append(written(look(pairs.distinct()).select("a", "b"), "links"))
        every = links[0]
        for more in links[1:]:
            every = every.union(more)
        found = components(every)

    def still_open(of: DataFrame) -> DataFrame:
        """Posts with components, under the keys that hold more than one."""
        labelled = of.select("node", "key", *carried).join(found, "node", "left").select(
            "node", "key", *carried, F.coalesce("component", "node").alias("component"))
        keys = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
        return written(labelled.join(keys.select("key"), "key", "left_semi"), "open_posts")

    least = posts.groupBy("key").agg(F.min("node").alias("a"))
    compare(posts.join(least, "key").filter("node > a").select("a", F.col("node").alias("b")))
    still = still_open(posts)
    for turn in range(rounds):
        if still.isEmpty():
            return found
        lot = F.struct(F.xxhash64(F.lit(turn), "key", "node").alias("lot"), F.col("node").alias("a"), F.col("component").alias("own"))
        leaders = still.groupBy("key").agg(F.min(lot).alias("l")).select("key", "l.a", "l.own")
        compare(still.join(leaders, "key").filter("component <> own").select(
            F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")))
        still = still_open(still)
    if still.isEmpty():
        return found
    if sharpen:
        still = written(sharpen(still), "sharp_posts")
    shares = still.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = shares.groupBy("key").agg(F.max(F.struct("n", "component")).alias("most")).select(
        "key", F.col("most.component").alias("largest"))
    outside = still.join(largest, "key").filter("component <> largest").select(
        "key", F.col("node").alias("other"), F.col("component").alias("apart"), *[F.col(c).alias(f"other_{c}") for c in carried])
    met = (still["key"] == outside["key"]) & (F.col("component") != F.col("apart"))
    if alike:
        # the place, equal for all of a key, is read from both sides: with the same columns the wide posts are shuffled once
        met = met & alike(F.col("mark"), F.col("other_mark"), F.least("place", "other_place"))
    compare(still.join(outside, met).select(
        F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")))
    return found
