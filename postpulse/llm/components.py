"""Connected components by alternating large and small stars, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postpulse.llm.storage import discard, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the smallest node in sight.

    Large star: the larger neighbours of every node move to its smallest neighbour.
    Small star: the smaller neighbours and the node itself do. ``a > b`` holds before
    and after. Minima are combined before the shuffle, and the join back splits hubs.
    """
    if large:
        seen = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        seen = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = seen.groupBy("u").agg(F.min("v").alias("m"))
    least = least.withColumn("m", F.least("u", "m")) if large else least
    joined = seen.join(least, "u")
    if large:
        moved = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), "m")
    else:
        moved = joined.select(F.col("v").alias("a"), "m").union(
            least.select(F.col("u").alias("a"), "m"))
    return moved.filter(F.col("a") != F.col("m")).select(
        "a", F.col("m").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(
        F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (its smallest node) of every node of ``edges`` (a, b).

    Loops, repeated and null edges do no harm. Nodes are of any orderable type. The result
    is a stored table; the edges of the rounds are deleted.
    """
    pairs = edges.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"),
    ).filter(F.col("a") != F.col("b")).distinct()
    current = stored(pairs, "edges")
    before = _mark(current)
    while True:
        last, current = current, stored(_star(_star(current, True), False), "edges")
        discard(last)
        now = _mark(current)
        if now == before:
            break
        before = now
    members = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    result = stored(members.union(roots), "components")
    discard(current)
    return result
