"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import discard, materialize

__all__ = ["connected_components"]


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of an edge table; component is the least node.

    Each round hangs neighbours on the least node seen (large star), then shortens the
    paths below it (small star); rounds grow with the logarithm of the longest path. All
    steps are equi-joins and combinable minima, so a hub costs no task more than its
    partial minimum, and its join can be split by the adaptive skew rule. The edge table
    of a round is written to the shared folder, which bounds lineage.

    Null ends and loops are ignored, repeated edges count once, no edges give no rows.
    """
    ends = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    now = materialize(ends.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
    seen = _signature(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        below = large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, now = now, materialize(below.unionAll(down.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(before)
        last, seen = seen, _signature(now)
        if seen == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
