"""Connected components of links, and first-come groups inside them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cratewise.session import written

# A component of more links is grouped in rounds; smaller ones, together up to so many links, in one task.
TASK_LINKS = 500_000


def components(links: DataFrame) -> DataFrame:
    """(id, component): every id of ``links`` (i, j) with one id of its component, the same for all of it.

    In a round every id picks, of itself and its neighbours, the one that comes
    first in an order drawn anew by a hash; links then join the picked ids. The
    order leaves a constant share of ids whatever the shape of the graph, so a
    chain takes rounds in proportion to the logarithm of its length.
    """
    edges = written(links.select("i", "j").where("i <> j").distinct())
    placed = None
    turn = 0
    while not edges.isEmpty():
        turn += 1
        both = edges.unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j")))

        def drawn(c: str):
            return F.struct(F.xxhash64(c, F.lit(turn)).alias("at"), F.col(c).alias("id"))

        picked = written(both.groupBy("i").agg(F.min(drawn("j")).alias("near")).select(
            "i", F.least(drawn("i"), F.col("near"))["id"].alias("to")))
        if placed is None:
            placed = picked.select(F.col("i").alias("id"), F.col("to").alias("component"))
        else:
            moved = picked.select(F.col("i").alias("component"), F.col("to").alias("next"))
            placed = written(placed.join(moved, "component", "left").select("id", F.coalesce("next", "component").alias("component")))
        edges = (edges.join(picked.withColumnRenamed("to", "a"), "i")
                 .join(picked.select(F.col("i").alias("j"), F.col("to").alias("b")), "j")
                 .where("a <> b").select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).distinct())
        edges = written(edges)
    return links.select(F.col("i").alias("id"), F.col("i").alias("component")).limit(0) if placed is None else placed


def greedy_groups(edges: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """(seed, member, score): what a first-come seeding in id order would group; ``edges`` (i, j, score) have i < j.

    The first unclaimed id seeds a group and claims all later unclaimed
    neighbours. Components don't touch each other, so many small ones are
    solved in one task, by their links in order. A component of more than
    ``task_links`` links is solved in rounds over all tasks.
    """
    edges = written(edges)
    kind = edges.schema["i"].dataType.simpleString()
    solution = f"seed {kind}, member {kind}, score double"
    if edges.limit(task_links + 1).count() <= task_links:
        return edges.withColumn("bin", F.lit(0)).groupBy("bin").applyInArrow(_first_come, solution)
    placed = components(edges)
    tagged = written(edges.join(placed.withColumnRenamed("id", "i"), "i"))
    sizes = tagged.groupBy("component").agg(F.count(F.lit(1)).alias("links"))
    large = written(sizes.where(F.col("links") > task_links).select("component"))
    small = tagged.join(large, "component", "left_anti")
    bins = max(1, -(-small.count() // task_links))
    solved = small.select(F.pmod(F.xxhash64("component"), F.lit(bins)).alias("bin"), "i", "j", "score").groupBy("bin").applyInArrow(
        _first_come, solution)
    if large.isEmpty():
        return solved
    return solved.unionByName(_in_rounds(tagged.join(large, "component", "left_semi").select("i", "j", "score")))


def _first_come(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by([("i", "ascending"), ("j", "ascending")])
    i, j = rows.column("i").to_pylist(), rows.column("j").to_pylist()
    claimed, kept = set(), []
    for k, (a, b) in enumerate(zip(i, j)):
        # All that could claim a come before it, so whether a seeds is known by now.
        if a not in claimed and b not in claimed:
            claimed.add(b)
            kept.append(k)
    chosen = rows.take(pa.array(kept, pa.int64()))
    return pa.table({"seed": chosen.column("i"), "member": chosen.column("j"), "score": chosen.column("score").cast(pa.float64())})


def _in_rounds(edges: DataFrame) -> DataFrame:
    """Seeds are the ids without an undecided smaller neighbour; each round writes its own claims only."""
    edges = written(edges)
    left, claims = edges.select("i", "j"), []
    while not left.isEmpty():
        seeds = left.select("i").distinct().join(left.select(F.col("j").alias("i")), "i", "left_anti")
        now = written(left.join(seeds, "i", "left_semi").select("j").distinct())
        claims.append(now)
        decided = seeds.unionByName(now.withColumnRenamed("j", "i"))
        left = written(left.join(decided, "i", "left_anti").join(decided.withColumnRenamed("i", "j"), "j", "left_anti"))
    claimed = claims[0]
    for more in claims[1:]:
        claimed = claimed.unionByName(more)
    seeds = edges.join(claimed.withColumnRenamed("j", "i"), "i", "left_anti")
    return seeds.groupBy(F.col("j").alias("member")).agg(F.min(F.struct("i", "score")).alias("s")).select(
        F.col("s.i").alias("seed"), "member", F.col("s.score").alias("score"))
