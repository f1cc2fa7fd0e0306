"""Normalisation of raw tag rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cratewise.functions.numbers import half_up
from cratewise.functions.text import tidy


def read_tags(raw: DataFrame) -> DataFrame:
    """Raw tag columns -> clean tags; every column is optional but ``id``.

    Text is trimmed with inner whitespace collapsed and empty becomes NULL; the
    artist falls back to the first of ``artists``; year and BPM count only when
    positive; the bit rate turns from bits to kilobits per second.
    """
    have = set(raw.columns)
    none = F.lit(None)

    def text(name):
        return tidy(F.col(name)) if name in have else none.cast("string")

    def number(name, kind):
        return F.col(name).cast(kind) if name in have else none.cast(kind)

    def positive(col):
        return F.when((col > 0) & (col < float("inf")), col)

    artists = tidy(F.get("artists", F.lit(0))) if "artists" in have else none.cast("string")
    genre = tidy(F.get("genres", F.lit(0))) if "genres" in have else text("genre")
    return raw.select(
        "id", text("title").alias("title"), F.coalesce(text("artist"), artists).alias("artist"),
        text("album").alias("album"), text("album_artist").alias("album_artist"), genre.alias("genre"),
        F.when(number("year", "int") > 0, number("year", "int")).alias("year"),
        number("track_number", "int").alias("track_number"), positive(number("bpm", "double")).alias("tagged_bpm"),
        text("key").alias("tagged_key"), text("comment").alias("comment"),
        F.coalesce(text("codec"), text("container")).alias("codec"),
        F.when(number("bitrate", "double") > 0, half_up(number("bitrate", "double") / 1000).cast("int")).alias("bitrate_kbps"),
        number("sample_rate", "int").alias("sample_rate"), number("channels", "int").alias("channels"),
        number("lossless", "boolean").alias("lossless"))
