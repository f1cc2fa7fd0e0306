"""A stored token index of the catalogue, read by token range.

The index is two tables: (token, id), range-clustered and sorted by token with
small row groups, and the key rows, clustered by id. A search asks the first for
tokens from the prefix up to its successor, a filter that the reader compares
with the statistics of files, row groups and pages, so it reads the few that
can hold the prefix. Their ids pick the key rows, and the whole text is tested
on those only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cratewise.operators.catalog import search_contains, token_index

ROW_GROUP_BYTES = 1 << 20
BROADCAST_IDS = 100_000


def write_search_index(keys: DataFrame, folder: str) -> None:
    """Store the index of ``keys`` (id, search, tokens, ...) below ``folder``."""
    (token_index(keys).write.mode("overwrite").option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.row.count.limit", 5000)
     .parquet(f"{folder}/tokens"))
    (keys.drop("tokens").repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite")
     .option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{folder}/keys"))


def search_prefix(text: str) -> str:
    """The token prefix a search text asks for: its first two distinct words, or its only one; empty without words."""
    plain = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in text.strip().lower())
    return " ".join(list(dict.fromkeys(plain.split()))[:2])


def token_range(tokens: DataFrame, prefix: str) -> DataFrame:
    """Index rows whose token starts with ``prefix``, as a range that the reader can push down."""
    return tokens.where((F.col("token") >= prefix) & (F.col("token") < prefix[:-1] + chr(ord(prefix[-1]) + 1)))


def search_index(spark: SparkSession, folder: str, text: str) -> DataFrame:
    """Key rows that hold a token with the text's prefix and contain the text; a text without words is searched in all rows."""
    keys = spark.read.parquet(f"{folder}/keys")
    prefix = search_prefix(text)
    if not prefix:
        return search_contains(keys, text)
    ids = token_range(spark.read.parquet(f"{folder}/tokens"), prefix).select("id").distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return search_contains(keys.join(F.broadcast(ids) if few else ids, "id", "left_semi"), text)
