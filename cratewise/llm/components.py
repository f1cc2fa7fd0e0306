"""Connected components of links between integer ids, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cratewise.llm.storage import stored


def connected_components(links: DataFrame) -> DataFrame:
    """``id`` and ``component`` (the least id reachable) of every id in ``links`` (columns a, b).

    In each round every id points to the neighbour, or itself, that comes first
    in an order hashed anew for the round, and links are drawn between the ids
    pointed to. A hashed order leaves a constant share of ids on any shape of
    graph, chains included, so the rounds grow with the logarithm of the
    longest one. Nothing but one row per id or link is ever kept, and neither
    links nor ids reach the driver.
    """
    edges = stored(links.select("a", "b").where("a <> b")
                   .select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
                   .select("e.*").distinct(), "links")
    members = None
    turn = 0
    while not edges.isEmpty():
        turn += 1
        first = F.struct(F.xxhash64("b", F.lit(turn)).alias("h"), F.col("b").alias("id"))
        own = F.struct(F.xxhash64("a", F.lit(turn)).alias("h"), F.col("a").alias("id"))
        points = stored(edges.groupBy("a").agg(F.min(first).alias("m"))
                        .select(F.col("a").alias("id"), F.least(F.col("m"), own)["id"].alias("to")), "points")
        if members is None:
            members = points
        else:
            moved = points.select(F.col("id").alias("to"), F.col("to").alias("next"))
            members = stored(members.join(moved, "to", "left").select("id", F.coalesce("next", "to").alias("to")), "members")
        ends = edges.join(points.withColumnRenamed("id", "a"), "a").select("b", F.col("to").alias("a2"))
        edges = stored(ends.join(points.withColumnRenamed("id", "b"), "b").select(F.col("a2").alias("a"), F.col("to").alias("b"))
                       .where("a <> b").distinct(), "links")
    if members is None:
        return links.select(F.col("a").alias("id"), F.col("a").alias("component")).limit(0)
    least = members.groupBy("to").agg(F.min("id").alias("component"))
    return members.join(least, "to").select("id", "component")
