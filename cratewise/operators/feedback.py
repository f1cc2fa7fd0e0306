"""Transition feedback log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def recently_played(log: DataFrame, limit: int = 20) -> DataFrame:
    """Targets of the latest accepted or played transitions; repeats stay."""
    return (log.where(F.col("action").isin("accepted", "played"))
            .orderBy(F.desc("at"), F.desc("id")).limit(limit).select("to_id", "at"))


def feedback_for(log: DataFrame, from_id: int) -> DataFrame:
    return log.where(F.col("from_id") == from_id)


def acceptance_stats(log: DataFrame) -> DataFrame:
    taken = F.col("action") == "accepted"
    return log.agg(F.count(F.lit(1)).alias("shown"), F.count_if(taken).alias("accepted"),
                   F.count_if(taken & (F.col("rank") == 0)).alias("top_rank_accepted"))
