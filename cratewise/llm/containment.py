"""Test items inside documents: size-partitioned minhash sketches, confirmed by exact containment.

Items are partitioned by the size of their shingle sets. The sketch of an item
is the few shingles of its set with the least hashes; its length is chosen per
partition so that a document which holds the required share of the item, and so
misses fewer shingles than the sketch has, always holds one of the sketch. The
length of the document plays no part, so a short item is found in a very long
document, and no pair is lost before the exact test.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cratewise.llm.storage import joined_small, stored
from cratewise.llm.text import with_shingles


def item_sketches(items: DataFrame, *, item_id: str = "item_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """item_id, n_item, shingles (distinct) and sketch of each item with at least ``size`` words."""
    sets = with_shingles(items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")), "text", size, "shingles")
    sets = (sets.where("item_id is not null").withColumn("shingles", F.array_distinct("shingles"))
            .withColumn("n_item", F.size("shingles").cast("long")).where("n_item > 0"))
    # Partition k holds sizes 2^k .. 2^(k+1) - 1; its upper end fixes the sketch length.
    upper = F.pow(F.lit(2), F.length(F.bin("n_item"))) - 1
    length = F.least(F.col("n_item"), F.floor((100 - percent) * upper / 100) + 1).cast("int")
    ranked = F.sort_array(F.transform("shingles", lambda s: F.struct(F.xxhash64(s, F.lit(1)).alias("h"), s.alias("s"))))
    return sets.select("item_id", "n_item", "shingles", F.transform(F.slice(ranked, F.lit(1), length), lambda x: x["s"]).alias("sketch"))


def contained_items(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                    item_text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, item_id, n_item, n_shared of each document that holds ``percent`` of an item's shingles or more.

    Items with fewer than ``size`` words, null texts and null ids give no rows.
    Rows with the same id and text give one row; of rows that repeat a document's
    id with other texts, the best one counts. The sketch keys are broadcast only
    up to a million rows, and so are the candidates; beyond, both joins shuffle.
    """
    sketches = stored(item_sketches(items, item_id=item_id, text=item_text, size=size, percent=percent), "sketches")
    body = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    keys = sketches.select("item_id", F.explode("sketch").alias("_key")).distinct()
    # explode_outer, as the filter that explode implies would compute the shingles once more for each of them
    held = with_shingles(body, "text", size, "_s").select("doc_id", F.explode_outer("_s").alias("_key"))
    candidates = stored(joined_small(held, keys, ["_key"]).select("doc_id", "item_id").distinct(), "candidates")
    chosen = joined_small(body, candidates.select("doc_id").distinct(), ["doc_id"], "left_semi")
    full = with_shingles(chosen, "text", size, "_s").select("doc_id", "_s")
    pairs = joined_small(joined_small(full, candidates, ["doc_id"]), sketches.drop("sketch"), ["item_id"])
    shared = F.size(F.array_intersect("shingles", "_s")).cast("long")
    return (pairs.select("doc_id", "item_id", "n_item", shared.alias("n_shared")).where(f"100 * n_shared >= {percent} * n_item")
            .groupBy("doc_id", "item_id").agg(F.max("n_item").alias("n_item"), F.max("n_shared").alias("n_shared")))


def without_contaminated(docs: DataFrame, found: DataFrame, *, doc_id: str = "doc_id") -> DataFrame:
    """The documents in which no item was found."""
    marked = found.select(F.col("doc_id").alias(doc_id)).distinct()
    return joined_small(docs, marked, [doc_id], "left_anti")
