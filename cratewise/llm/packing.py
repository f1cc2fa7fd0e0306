"""Packed training sequences: exact-complement packing of pieces, and matrices of ids by best-fit decreasing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cratewise.llm import bins


def pack_exact(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, end_id: int = 0, text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every row of ``docs`` is packed, repeated ones too; a null or empty text is
    the end id alone. Longer documents are cut without loss, the first piece
    taking what does not fill a sequence. An empty table gives no rows.
    """
    pieces = bins.tokenized_pieces(docs, tokenizer, capacity=capacity, end_id=end_id, text=text)
    return bins.pack_pieces(pieces, bins.exact_complement, capacity).drop("part", "rank")


def packed_matrix(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, end_id: int = 0, text: str = "text") -> DataFrame:
    """One row per packed sequence, by best-fit decreasing.

    ``input_ids`` holds the ids as little-endian bytes (16 bits each where the
    vocabulary allows, else 32), ``cu_seqlens`` the cumulative segment lengths
    from 0, ``position_resets`` the offsets at which positions start again at
    0, ``doc_ids``, ``pieces`` and ``starts`` where each segment comes from.
    Null texts count as empty; repeated rows are packed each; an empty table
    gives no rows.
    """
    pieces = bins.tokenized_pieces(docs, tokenizer, capacity=capacity, end_id=end_id, text=text, keep_ids=True)
    placed = bins.pack_pieces(pieces, bins.best_fit_decreasing, capacity)
    segment = F.struct("offset", "length", "doc_id", "piece", "start", "ids")
    # A sequence holds at most ``capacity`` segments, so the list is bounded.
    rows = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(segment)).alias("s"))

    def each(name: str) -> Column:
        return F.transform("s", lambda x: x[name])

    ends = F.transform("s", lambda x: (x["offset"] + x["length"]).cast("int"))
    return rows.select(
        "sequence_id", F.element_at(ends, -1).alias("n_tokens"), F.size("s").alias("n_segments"),
        F.aggregate("s", F.unhex(F.lit("")), lambda b, x: F.concat(b, x["ids"])).alias("input_ids"),
        F.concat(F.array(F.lit(0)), ends).alias("cu_seqlens"),
        F.transform("s", lambda x: x["offset"].cast("int")).alias("position_resets"),
        each("doc_id").alias("doc_ids"), each("piece").alias("pieces"), each("start").alias("starts"))


def write_packed(rows: DataFrame, path: str) -> None:
    """Write packed rows as Parquet parts in sequence order within each part."""
    rows.repartitionByRange("sequence_id").sortWithinPartitions("sequence_id").write.parquet(path)
