"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame

from cratewise.session import checkpoint_folder


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    It cuts the lineage, keeps only the columns written, compressed, and
    survives the loss of executors.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def joined_small(df: DataFrame, small: DataFrame, on: list[str] | Column, how: str = "inner", most: int = 1_000_000) -> DataFrame:
    """Join with a side that is usually small: broadcast up to ``most`` rows, a shuffled join beyond."""
    from pyspark.sql import functions as F

    few = small.limit(most + 1).count() <= most
    return df.join(F.broadcast(small) if few else small, on, how)
