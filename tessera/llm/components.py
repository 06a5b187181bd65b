"""Connected components of a link table, by random contraction in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import table


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id in `links`; component is the smallest id that links reach.

    Each round every id points to that neighbour (or itself) which has the least hash in this round, and links are
    drawn anew between the ids pointed to. About half of the ids vanish each round whatever the graph's shape; hubs
    are summed before they are shuffled. Rounds are written as tables, so nothing is gathered on the driver and a
    lost executor costs one round. Self-links and nulls are ignored; an empty table gives an empty result.
    """
    now = table(
        links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a < b").distinct(), "links"
    )
    labels = None
    for turn in range(200):
        if now.isEmpty():
            break
        hashed = lambda c: F.xxhash64(F.lit(turn), F.col(c))  # noqa: E731, B023
        ends = now.select(F.col("a").alias("id"), F.col("b").alias("to")).unionAll(now.select(F.col("b").alias("id"), F.col("a").alias("to")))
        # the pair's lesser end, then the least over an id's links
        best = ends.groupBy("id").agg(F.min(hashed("to")).alias("h"), F.min_by("to", hashed("to")).alias("to"))
        points = table(best.select("id", F.when(hashed("id") <= F.col("h"), F.col("id")).otherwise(F.col("to")).alias("to")), f"points{turn}")
        left, right = (points.select(F.col("id").alias(c), F.col("to").alias(f"to_{c}")) for c in "ab")
        moved = now.join(left, "a").join(right, "b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).filter("a < b").distinct()
        now = table(moved, f"links{turn}")
        if labels is None:
            labels = points.withColumnRenamed("to", "label")
        else:
            nearer = points.select(F.col("id").alias("label"), F.col("to").alias("next"))
            labels = table(labels.join(nearer, "label", "left").select("id", F.coalesce("next", "label").alias("label")), f"labels{turn}")
    else:
        raise RuntimeError("links remain after 200 rounds")
    if labels is None:
        return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    least = labels.groupBy("label").agg(F.min("id").alias("component"))
    return labels.join(least, "label").select("id", "component")
