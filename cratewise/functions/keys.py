"""Musical key notation as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The twelve pitch class names, C = 0.
PITCH_NAMES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]


def pitch_name(tonic: Column) -> Column:
    return F.get(F.array(*[F.lit(p) for p in PITCH_NAMES]), tonic.cast("int"))


def open_key_number(tonic: Column, mode: Column) -> Column:
    major_tonic = F.when(mode == "minor", (tonic + 3) % 12).otherwise(tonic)
    return ((major_tonic * 7) % 12 + 1).cast("int")


def open_key(tonic: Column, mode: Column) -> Column:
    return F.concat(open_key_number(tonic, mode).cast("string"),
                    F.when(mode == "major", "d").otherwise("m"))


def camelot_number(tonic: Column, mode: Column) -> Column:
    return ((open_key_number(tonic, mode) + 6) % 12 + 1).cast("int")


def camelot(tonic: Column, mode: Column) -> Column:
    return F.concat(camelot_number(tonic, mode).cast("string"),
                    F.when(mode == "major", "B").otherwise("A"))


def key_name(tonic: Column, mode: Column) -> Column:
    return F.concat_ws(" ", pitch_name(tonic), mode)


def relative_tonic(tonic: Column, mode: Column) -> Column:
    return ((tonic + F.when(mode == "major", 9).otherwise(3)) % 12).cast("int")


def relative_mode(mode: Column) -> Column:
    return F.when(mode == "major", "minor").otherwise("major")


def tonality(tonic: Column, mode: Column) -> Column:
    """Classic notation such as ``Am`` or ``F#``; empty when the key is unknown."""
    return F.when(tonic.isNull() | mode.isNull(), "").otherwise(
        F.concat(pitch_name(tonic), F.when(mode == "minor", "m").otherwise("")))
